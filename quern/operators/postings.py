"""A lexical index that is built once for a version of the documents, kept as Parquet, and searched by its terms only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import ranking
from quern.session import spread

#: Parts of a kept index by its terms; a search reads those of the asked terms.
BUCKETS = 16


@dataclass
class Index:
    """``postings`` (scope, bucket, term, key, dl, tf) and ``weights`` (scope, bucket, term, idf, avgdl) of the documents ``key`` within each scope."""

    key: str
    scope: list[str]
    postings: DataFrame
    weights: DataFrame


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _postings(docs: DataFrame, key: str, text: str, columns: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Postings, and the length of every document, those without a token too."""
    tokens = spread(docs.select(*columns, key, text)).select(*columns, key, T.lexical_tokens(F.col(text)).alias("tokens")).withColumn("dl", F.greatest(F.size("tokens"), F.lit(0)))
    # a document's terms are counted where it stands: only its distinct terms are shuffled
    postings = tokens.select(*columns, key, "dl", F.explode("tokens").alias("term")).groupBy(*columns, key, "dl", "term").agg(F.count("*").alias("tf")).withColumn("bucket", _bucket(buckets))
    return postings, tokens.select(*columns, key, "dl")


def _weights(postings: DataFrame, lengths: DataFrame, scope: list[str]) -> DataFrame:
    totals = lengths.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    both = (lambda a, b: a.join(b, scope) if scope else a.crossJoin(F.broadcast(b)))  # without a scope the totals are one row
    idf = both(postings.groupBy(*scope, "bucket", "term").agg(F.count("*").alias("df")), totals).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = idf.groupBy(*scope).agg((F.avg("idf") * ranking.EPSILON).alias("floor"))
    return both(idf, floor).select(*scope, "bucket", "term", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"), "avgdl")


def build(docs: DataFrame, key: str, text: str, *, scope: list[str] | None = None, buckets: int = BUCKETS) -> Index:
    """The index of ``docs``, not yet evaluated. Null and token-free texts count as documents without postings."""
    scope = scope or []
    postings, lengths = _postings(docs, key, text, scope, buckets)
    return Index(key, scope, postings, _weights(postings, lengths, scope))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def invalidate(spark: SparkSession, path: str) -> None:
    """Drops what is kept at ``path``, whatever its version: what a write to the documents asks for."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def version_of(docs: DataFrame, columns: list[str]) -> str:
    """A digest of the rows' ``columns``, in any order: it changes with every row written, changed or removed."""
    seen = docs.select(F.xxhash64(*columns).alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("s")).first()
    return f"{seen['n']:x}-{seen['x'] & (2**64 - 1):x}-{seen['s']:x}"


def kept(docs: DataFrame, key: str, text: str, path: str, version: str, columns: list[str], *, scope: list[str] | None = None, where: str = "true", buckets: int = BUCKETS) -> Index:
    """The index of a version of the documents: read from ``path`` if it is there, else built, written, and older versions dropped.

    Texts are tokenised once a version. ``columns`` of the documents stand beside the postings, so that one table of
    them serves any ``scope`` and filter ``where`` over these; each combination keeps its own small weights.
    """
    spark, scope = docs.sparkSession, scope or []
    home = f"{path.rstrip('/')}/{version}"
    if not _exists(spark, f"{home}/lengths/_SUCCESS"):
        invalidate(spark, path)
        postings, lengths = _postings(docs, key, text, columns, buckets)
        postings.repartition("bucket").write.partitionBy("bucket").parquet(f"{home}/postings")
        # a document's length stands with its postings; only those without any are read again
        held = spark.read.parquet(f"{home}/postings").groupBy(*columns, key).agg(F.max("dl").alias("dl"))
        bare = docs.where(F.coalesce(F.size(T.lexical_tokens(F.col(text))), F.lit(0)) <= 0).select(*columns, key, F.lit(0).alias("dl"))
        held.unionByName(bare).write.parquet(f"{home}/lengths")
    own = spark.read.parquet(f"{home}/postings").where(where)
    named = f"{home}/weights-{hashlib.sha256(f'{scope}|{where}'.encode()).hexdigest()[:16]}"
    if not _exists(spark, f"{named}/_SUCCESS"):
        _weights(own, spark.read.parquet(f"{home}/lengths").where(where), scope).write.mode("overwrite").parquet(named)
    return Index(key, scope, own, spark.read.parquet(named))


def search(index: Index, queries: DataFrame, query_key: str, query_text: str, *, only: DataFrame | None = None, k: int = 40, buckets: int = BUCKETS) -> DataFrame:
    """What :func:`quern.operators.ranking.bm25` gives over the index's documents; only the buckets of asked terms are read."""
    scope, own = index.scope, [c for c in index.scope if c in queries.columns]
    asked = queries.select(query_key, *own, F.explode(T.lexical_tokens(F.col(query_text))).alias("term"))
    asked = asked.groupBy(*asked.columns).agg(F.count("*").alias("qtf")).withColumn("bucket", _bucket(buckets))
    seen = asked.agg(F.count("*").alias("n"), F.collect_set("bucket").alias("buckets")).first()  # at most ``buckets`` numbers
    weight = index.weights.join(asked, ["bucket", "term", *own])
    if seen["n"] <= ranking.TERMS:
        weight = index.weights.join(F.broadcast(asked), ["bucket", "term", *own])
        # a bounded number of weights goes to the postings, never the other way round; a term asked in every scope has one in each
        if len(own) == len(scope) or weight.limit(ranking.TERMS + 1).count() <= ranking.TERMS:
            weight = F.broadcast(weight)
    length = ranking.K1 * (1 - ranking.B + ranking.B * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (ranking.K1 + 1) / (F.col("tf") + length)
    postings = index.postings.where(F.col("bucket").isin(seen["buckets"])) if len(seen["buckets"]) < buckets else index.postings
    scored = postings.join(weight, [*scope, "bucket", "term"]).groupBy(*scope, query_key, index.key).agg(F.round(F.sum(part), 6).alias("score"))
    if only is not None:
        scored = scored.join(only.select(query_key, index.key), [query_key, index.key], "left_semi")
    return ranking.top(scored, [*scope, query_key], "score", [index.key], k)
