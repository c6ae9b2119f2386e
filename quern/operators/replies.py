"""Replies of judging and rewriting models, parsed tolerantly: a reply that cannot be read loses nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

_VERDICTS = "overall string, chunks array<struct<index:string,relevance:string,reason:string>>"
_TRANSFORM = "rewrite string, is_complex boolean, sub_queries array<string>, paraphrases array<string>, keywords array<string>, hyde string"
_CRITIQUE = "faithfulness struct<score:string,reason:string>, relevance struct<score:string,reason:string>, completeness struct<score:string,reason:string>, hallucinations array<string>"


def _parsed(raw: Column, schema: str) -> Column:
    return F.from_json(T.strip_fence(raw), schema)


def verdicts(df: DataFrame, key: str, raw: str, count: str) -> DataFrame:
    """A grade for each of a query's ``count`` results: (key, index, relevance, graded).

    The first grade of an index counts; indices out of range are dropped; unknown
    grades, results without one and unreadable replies are correct.
    """
    read = df.select(key, F.col(count).alias("n"), _parsed(F.col(raw), _VERDICTS)["chunks"].alias("chunks"))
    given = read.select(key, "n", F.posexplode("chunks").alias("pos", "c")).withColumn("index", F.expr("try_cast(c.index as int)"))
    given = given.where("index >= 0 and index < n")
    first = given.withColumn("_n", F.row_number().over(Window.partitionBy(key, "index").orderBy("pos"))).where("_n = 1")
    grade = F.lower(F.trim("c.relevance"))
    first = first.select(key, "index", F.when(grade.isin("correct", "partial", "incorrect"), grade).otherwise("correct").alias("relevance"))
    every = df.where(F.col(count) > 0).select(key, F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("index"))
    return every.join(first, [key, "index"], "left").select(key, "index", F.coalesce("relevance", F.lit("correct")).alias("relevance"), F.col("relevance").isNotNull().alias("graded"))


def variants(original: Column, raw: Column) -> Column:
    """The texts to search for: the question, its rewriting, the parts of a complex one, paraphrases; trimmed, without repeats whatever the case."""
    t = _parsed(raw, _TRANSFORM)
    none = F.array().cast("array<string>")
    parts = F.when(F.coalesce(t["is_complex"], F.lit(False)), F.slice(F.coalesce(t["sub_queries"], none), 1, 4)).otherwise(none)
    every = F.concat(F.array(original, t["rewrite"]), parts, F.slice(F.coalesce(t["paraphrases"], none), 1, 2))
    clean = F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

    def add(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(clean, none, add)


def keywords(raw: Column) -> Column:
    """Up to five keywords of a rewriting."""
    return F.slice(F.filter(F.coalesce(_parsed(raw, _TRANSFORM)["keywords"], F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, 5)


def standalone(question: Column, raw: Column) -> Column:
    """The question that a reply resolves against its history, or the question itself."""
    got = F.trim(F.get_json_object(T.strip_fence(raw), "$.standalone_question"))
    return F.when(F.coalesce(got, F.lit("")) != "", got).otherwise(question)


def critique(raw: Column) -> Column:
    """Three scores (0.5 where unreadable), their least, whether it is low, and up to five claims without support."""
    c = _parsed(raw, _CRITIQUE)
    score = lambda name: T.clamp(c[name]["score"], 0.5)
    f, r, k = score("faithfulness"), score("relevance"), score("completeness")
    claims = F.slice(F.filter(F.transform(F.coalesce(c["hallucinations"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, 5)
    return F.struct(f.alias("faithfulness"), r.alias("relevance"), k.alias("completeness"), F.least(f, r, k).alias("least"), (F.least(f, r, k) < 0.5).alias("low"), claims.alias("claims"))


def judge_score(raw: Column) -> Column:
    """The score of a judge's reply between 0 and 1; null, never 0, where it cannot be read."""
    return T.clamp(F.get_json_object(T.strip_fence(raw), "$.score"))


def pill(crag: Column, flagged: Column, checked: Column) -> Column:
    """The line that sums up an answer's checks."""
    return F.when(F.coalesce(flagged, F.lit(False)), "Needs review").when(F.coalesce(checked, F.lit(False)) | crag.isNotNull(), "Verified").otherwise("Unverified")
