"""The boundary to neural models: what the engine needs of one, and deterministic stand-ins that need none.

A model is a function from a DataFrame with ``text`` to the same with a column more, so
one that runs as an iterator ``pandas_udf`` or over HTTP fits without the engine knowing it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quern.functions import text as T

Model = Callable[[DataFrame], DataFrame]


def hashed_vectors(dim: int = 64) -> Model:
    """Unit vectors of hashed lexical tokens with signs: similar for texts that share words. Null or token-free text gives a null vector."""

    def run(df: DataFrame) -> DataFrame:
        def embed(batches):
            for batch in batches:
                at = batch.schema.get_field_index("_tokens")
                out = []
                for tokens in batch.column(at).to_pylist():
                    v = np.zeros(dim)
                    for t in tokens or ():
                        h = xxhash.xxh32_intdigest(t)
                        v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
                    n = np.linalg.norm(v)
                    out.append((v / n).astype(np.float32).tolist() if n else None)
                names = [n for n in batch.schema.names if n != "_tokens"]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(out, pa.list_(pa.float32()))], [*names, "vector"])

        return df.withColumn("_tokens", T.lexical_tokens(F.col("text"))).mapInArrow(embed, StructType([*df.schema.fields, StructField("vector", ArrayType(FloatType()))]))

    return run


def overlap_scorer(df: DataFrame) -> DataFrame:
    """A stand-in for a joint model of ``query`` and ``text``: the share of the query's tokens in the text, as ``score``."""
    asked = T.search_tokens(F.col("query"))
    return df.withColumn("score", F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.search_tokens(F.col("text")))) / F.size(asked)).otherwise(0.0))


def first_sentences(df: DataFrame) -> DataFrame:
    """A stand-in for a generator: the beginning of the ``text``, as ``answer``."""
    return df.withColumn("answer", F.substring(F.regexp_extract("text", r"(?s)^(.*?[.!?])(?:\s|$)", 1), 1, 3000))


@dataclass
class Models:
    """The models of a pipeline."""

    embed: Model = field(default_factory=hashed_vectors)
    score: Model = overlap_scorer
    generate: Model = first_sentences
