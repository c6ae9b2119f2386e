"""What the operators share: stage tables in the cluster's shared folder, text helpers, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []  # the temporary folder of a local session without a shared one
#: Parts in which rows under one key are handled, see :func:`spread_join`.
PARTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a local session, as in tests, gets a temporary folder; on
    a cluster, whose executors could not read one, it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='quern-')}")
        given = _OWN[0]
    return given.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage at a table that survives the loss of any executor; each
    later use of it reads only the columns it needs. Removed by :func:`discard`, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_stage = path
    return out


def discard(*staged: DataFrame) -> None:
    """Removes stage tables that no result reads any more: what was made of them has been staged itself."""
    for df in staged:
        _remove(df.sparkSession, df._quern_stage)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], salt: list[str], how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``left`` joined to ``right`` on ``on``, where a third of ``left`` may stand under one key.

    ``right`` has few rows a key. The rows of ``left`` are told apart by a hash of
    their columns ``salt``; each key's rows of ``right`` go once to each part of the key that
    ``left`` has, so a hot key is ``parts`` tasks and a rare key is not copied.
    """
    numbered = left.withColumn("_part", F.pmod(F.xxhash64(*salt), F.lit(parts)).cast("int"))
    ways = numbered.select(*on, "_part").distinct()  # combined before the shuffle: at most ``parts`` rows a key
    return numbered.join(ways.join(right, on), [*on, "_part"], how).drop("_part")


def vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls, all of length ``dim``, as a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def unit(df: DataFrame, **columns: str) -> DataFrame:
    """The given columns only, under fixed names: further columns of any name are left out early."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
