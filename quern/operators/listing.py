"""What the tables hold: counts, listings, lookups and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def counts(chunks: DataFrame, base: str) -> DataFrame:
    """Rows of each base and, under null, of all."""
    return chunks.rollup(base).agg(F.count("*").alias("n"))


def documents(chunks: DataFrame) -> DataFrame:
    """(owner, kb, document, n): documents with their rows; in the base of repositories a repository is the document. Nameless rows are left out."""
    name = F.when(F.col("kb") == "github", F.col("repository")).otherwise(F.col("document_id"))
    return chunks.withColumn("document", name).where("document <> ''").groupBy("owner", "kb", "document").agg(F.count("*").alias("n"))


def repositories(chunks: DataFrame) -> DataFrame:
    """The distinct repositories (owner, repository) that have a name."""
    return chunks.where("repository <> ''").select("owner", "repository").distinct()


def populated(chunks: DataFrame) -> DataFrame:
    """The bases that each owner has rows in, sorted."""
    return chunks.where("kb is not null").groupBy("owner").agg(F.array_sort(F.collect_set("kb")).alias("bases"))


def source_summary(loaded: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each loaded document (owner, document_id): indexed or pending, and its chunks."""
    n = chunks.groupBy("owner", "document_id").agg(F.count("*").alias("n"))
    d = loaded.where("owner is not null and document_id is not null").select("owner", "document_id").distinct()
    return d.join(n, ["owner", "document_id"], "left").select("owner", "document_id", F.when(F.col("n").isNull(), "pending").otherwise("indexed").alias("status"), F.coalesce("n", F.lit(0)).alias("chunks"))


def first_chunks(chunks: DataFrame, asked: DataFrame, order: list[str]) -> DataFrame:
    """The first chunk in ``order`` of each asked document (owner, document_id), over all bases; documents without any have no row."""
    cols = [c for c in chunks.columns if c not in ("owner", "document_id")]
    found = chunks.join(asked.select("owner", "document_id").distinct(), ["owner", "document_id"], "left_semi")
    least = found.groupBy("owner", "document_id").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return least.select("owner", "document_id", "r.*")


def of_type(chunks: DataFrame, owner: str, content_type: str) -> DataFrame:
    """All chunks of an owner of one content type."""
    return chunks.where((F.col("owner") == owner) & (F.col("content_type") == content_type))


def inspect(rows: DataFrame, part: str | None = None) -> DataFrame:
    """Rows for inspection: all, or those whose url or file name holds ``part``, whatever the case."""
    if part is None:
        return rows
    low = part.lower()
    hit = [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in ("url", "file_name") if c in rows.columns]
    return rows.where(hit[0] | hit[1] if len(hit) > 1 else hit[0])


def markdown_tables(rows: DataFrame, by: list[str], order: list[str], cells: dict[str, Column]) -> DataFrame:
    """``by`` and ``markdown``: the rows of each group as a pipe table with head and divider."""
    head = "| " + " | ".join(cells) + " |\n| " + " | ".join(["---"] * len(cells)) + " |\n"
    line = F.struct(F.struct(*order).alias("o"), T.pipe_row(*cells.values()).alias("line"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("l")).select(*by, F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))
