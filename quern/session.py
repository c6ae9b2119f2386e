"""Session and table access shared by every query module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "quern", cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    Further settings come as keywords, with two underscores for a dot. On a cluster the caller brings its own session; nothing in the library
    depends on a setting made here.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config(map={k.replace("__", "."): v for k, v in conf.items()})
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of one data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share, ``spark.checkpoint.dir`` of the session; None where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return given.rstrip("/") if given else None


def spread(df: DataFrame, least_bytes: int = 1 << 18) -> DataFrame:
    """``df`` in as many partitions as there are cores, where its scan has fewer.

    A file with one row group is one task, however costly the work on its rows. Large inputs
    have enough partitions and are left as they are, so nothing is shuffled at
    scale; so are inputs under ``least_bytes``, for which a shuffle costs more than it saves.
    Apply it behind the choice of columns.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < least_bytes:
        return df
    # behind a shuffle the number is chosen when it runs; to ask for it would run it
    if "AdaptiveSparkPlan" in plan.executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
