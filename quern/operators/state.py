"""Tables that hold state: answer caches, sessions, pending documents and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import ranking

#: Entries of a cache, and the similarities that an entry must reach to answer.
CACHE_SIZE, SIMILARITY, OVERLAP = 128, 0.6, 0.6
#: Minutes after which a session is over.
IDLE_MINUTES = 30


def cache_lookup(entries: DataFrame, asked: DataFrame, scope: list[str], *, similarity: float = SIMILARITY, overlap: float = OVERLAP) -> DataFrame:
    """The cached answer of each question: (ask_id, entry_id, seq, similarity, overlap).

    ``entries`` (scope, entry_id, seq, vector, members), ``asked`` (scope, ask_id, seq,
    vector, members). Scopes match null-safely. Only entries before the question,
    with both similarities reached; the most similar, then the earliest. The questions are a stated set and go out in blocks,
    so a tenant with a third of all entries costs no shuffle of them.
    """
    key = F.to_json(F.struct(*scope))
    a = asked.withColumn("scope_key", key).select("scope_key", "ask_id", F.col("seq").alias("ask_seq"), F.col("vector").alias("qv"), F.col("members").alias("qm"))
    e = entries.withColumn("scope_key", key).select("scope_key", "entry_id", "seq", "vector", "members")
    pairs = ranking.in_blocks(e, a, "ask_id", ["scope_key"], ["ask_seq", "qv", "qm"]).where("seq < ask_seq")
    scored = pairs.select("ask_id", "entry_id", "seq", F.round(V.cosine(F.col("vector"), F.col("qv")), 6).alias("similarity"), F.round(V.overlap(F.col("members"), F.col("qm")), 6).alias("overlap"))
    fit = scored.where((F.col("similarity") >= similarity) & (F.col("overlap") >= overlap))
    w = Window.partitionBy("ask_id").orderBy(F.desc("similarity"), "seq", "entry_id")
    return fit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cache_kept(entries: DataFrame, by: list[str], order: list[str], *, size: int = CACHE_SIZE) -> DataFrame:
    """What a cache of ``size`` entries holds after all writes: the last ones of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return entries.withColumn("age", F.row_number().over(w)).where(F.col("age") <= size)


def lru_kept(accesses: DataFrame, by: list[str], key: str, at: str, *, size: int = CACHE_SIZE) -> DataFrame:
    """The keys that a least-recently-used cache holds: those of the latest last accesses."""
    last = accesses.groupBy(*by, key).agg(F.max(at).alias("last_access"), F.count("*").alias("accesses"))
    w = Window.partitionBy(*by).orderBy(F.desc("last_access"), key)
    return last.withColumn("age", F.row_number().over(w)).where(F.col("age") <= size)


def sessions(events: DataFrame, user: str, at: str, *, minutes: int = IDLE_MINUTES) -> DataFrame:
    """Sessions of each user: a gap of more than ``minutes`` ends one. ``session_no`` from 1, begin, end, events."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    w = Window.partitionBy(user).orderBy(at)
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    new = F.when(gap.isNull() | (gap > minutes * 60 * 1_000_000), 1).otherwise(0)
    marked = events.where(F.col(at).isNotNull()).select(user, at).withColumn("new", new)
    run = marked.withColumn("session_no", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(user, "session_no").agg(F.min(at).alias("begins"), F.max(at).alias("ends"), F.count("*").alias("events"))


def abandoned(seen: DataFrame, user: str, at: str, now: Column | None = None, *, minutes: int = IDLE_MINUTES) -> DataFrame:
    """Users not seen for ``minutes`` before ``now`` (the latest event if not given); those without any time count as abandoned."""
    last = seen.groupBy(user).agg(F.max(at).alias("last_seen"))
    if now is None:
        latest = seen.agg(F.max(at).alias("now"))
        last = last.crossJoin(F.broadcast(latest))  # one row
    else:
        last = last.withColumn("now", now)
    return last.where(F.col("last_seen").isNull() | (F.unix_micros("last_seen") < F.unix_micros("now") - minutes * 60 * 1_000_000)).select(user, "last_seen")


def last_operation(log: DataFrame, key: list[str], order: list[str], operation: str, removed: list[str]) -> DataFrame:
    """The entries that a log of operations leaves: the last operation of each key, unless it removes it."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & ~F.col(operation).isin(removed)).drop("_n")


def settings(stored: Column, defaults: dict[str, str]) -> Column:
    """Stored settings over the defaults, a map; null stored settings are none."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    return F.map_concat(rest, own)
