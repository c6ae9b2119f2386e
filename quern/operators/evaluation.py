"""Retrieval quality: all metrics of a run in one grouping, and their averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def retrieval_metrics(retrieved: DataFrame, expected: DataFrame, item: str, key: str, *, k: int) -> DataFrame:
    """Hit rate, MRR, nDCG, precision and recall of each item, rounded to 6.

    ``retrieved`` (item, key, rank from 1), ``expected`` (item, key). All but MRR
    are cut at ``k``. A key that is retrieved more than once counts each time for
    DCG and precision, once for recall; the ideal DCG is over the smaller of what is expected and
    what was retrieved, so nDCG may exceed 1 where keys repeat. Precision is over the rows there are, not over ``k``.
    Items without results have zeros; items without expectations have no row.
    """
    want = expected.select(item, key).distinct()
    wanted = want.groupBy(item).agg(F.count("*").alias("n_expected"))
    hits = retrieved.select(item, key, "rank").join(want.withColumn("match", F.lit(True)), [item, key], "left")
    match, within = F.col("match").isNotNull(), F.col("rank") <= k
    per = hits.groupBy(item).agg(
        F.sum(F.when(within, 1).otherwise(0)).alias("n_top"),
        F.sum(F.when(match & within, 1).otherwise(0)).alias("n_match"),
        F.count_distinct(F.when(match & within, F.col(key))).alias("n_found"),
        F.min(F.when(match, F.col("rank"))).alias("first"),
        F.sum(F.when(match & within, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    joined = wanted.join(per, item, "left").fillna(0, ["n_top", "n_match", "n_found", "dcg"])
    ideal = F.least("n_expected", "n_top").cast("int")
    idcg = F.when(ideal > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(ideal, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(0.0)
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return joined.select(
        item,
        F.when(F.col("n_match") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        ratio(F.col("dcg"), idcg).alias("ndcg"),
        ratio(F.col("n_match"), F.col("n_top")).alias("precision"),
        ratio(F.col("n_found"), F.col("n_expected")).alias("recall"),
    )


def mean_metrics(results: DataFrame, by: list[str], metrics: list[str], error: str) -> DataFrame:
    """Of each run: items, failed ones, and each metric's mean over its values, rounded to 3, with their number. A metric without any value is null."""
    means = [x for m in metrics for x in (F.round(F.avg(m), 3).alias(f"mean_{m}"), F.count(m).alias(f"n_{m}"))]
    return results.groupBy(*by).agg(F.count("*").alias("items"), F.count(error).alias("failed"), *means)


def verdict(verdicts: DataFrame, by: list[str], grade: str, *, ratio: float = 0.6) -> DataFrame:
    """Of each query the judgement of its graded results: correct from a share on, ambiguous if any is of use, else incorrect."""
    n, good = F.count("*"), F.sum(F.when(F.col(grade) == "correct", 1).otherwise(0))
    kept = F.sum(F.when(F.col(grade).isin("correct", "partial"), 1).otherwise(0))
    counted = verdicts.groupBy(*by).agg(n.alias("graded"), good.alias("correct"), kept.alias("kept"))
    return counted.withColumn("overall", F.when(F.col("correct") / F.col("graded") >= ratio, "correct").when(F.col("kept") >= 1, "ambiguous").otherwise("incorrect"))


def weakest(*scores: str) -> tuple[Column, Column]:
    """The least of several scores, and whether it is low: under a half. Null where any score is."""
    least = F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scores]), F.least(*scores))
    return least, least < 0.5


def evaluation_run(items: DataFrame, retrieved: DataFrame, results: DataFrame, *, item: str = "item_id", key: str = "document_id", k: int = 10) -> DataFrame:
    """A run over evaluation items in one plan: every item once, with its retrieval metrics, its result and its error.

    ``items`` (item, expected_document_ids), ``retrieved`` (item, key, rank), ``results`` (item, answer, error, latency). Metrics are null for
    items that expect no document or whose run failed; an item without a result counts as failed.
    """
    want = items.select(item, F.explode("expected_document_ids").alias(key))
    scored = retrieval_metrics(retrieved, want, item, key, k=k)
    run = items.select(item).join(results, item, "left").withColumn("error", F.when(F.col("answer").isNull() & F.col("error").isNull(), "no answer").otherwise(F.col("error")))
    joined = run.join(scored, item, "left")
    names = ["hit_rate", "mrr", "ndcg", "precision", "recall"]
    return joined.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in names})


def report_rows(summary: DataFrame, name: Column) -> DataFrame:
    """``slug`` and ``line`` of each row of a summary: a pipe-table line, floats to 3 decimals, nulls as dashes."""
    cell = lambda c, t: F.coalesce(F.format_string("%.3f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string"), F.lit("—"))
    return summary.select(T.slug(name).alias("slug"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, t) for c, t in summary.dtypes]), F.lit(" |")).alias("line"))


def write_report(summary: DataFrame, path: str) -> None:
    """A run's rows as JSON lines, all of them, at ``path``/json; and as a pipe table's lines at ``path``/markdown."""
    summary.write.mode("overwrite").json(f"{path}/json")
    report_rows(summary, F.lit("")).select("line").write.mode("overwrite").text(f"{path}/markdown")


def report_markdown(summary: DataFrame, name: str) -> str:
    """A run's averages as a pipe table; nulls as dashes. For the table of :func:`mean_metrics`, one row a run; all rows are shown."""
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {name}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in summary.orderBy(*summary.columns[:1]).toLocalIterator()]) + "\n"
