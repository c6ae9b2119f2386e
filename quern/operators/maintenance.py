"""Writes to the chunk tables, as the tables they leave; and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import keep_last

# The knowledge bases.
KNOWN = ["markdown", "pdf", "docx", "web", "github", "audio", "video"]


def base_of(source_type: Column) -> Column:
    """The knowledge base of a source type; markdown for any other."""
    return F.when(source_type.isin(KNOWN), source_type).otherwise("markdown")


def row_key(owner: Column, document: Column, page: Column, index: Column) -> Column:
    """``owner::document::[page_p::]chunk_i``; the owner is local by default."""
    return F.concat_ws("::", F.coalesce(owner, F.lit("local")), document, F.when(page.isNotNull(), F.concat(F.lit("page_"), page.cast("string"))), F.concat(F.lit("chunk_"), index.cast("string")))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table after the new rows: the last row of each key."""
    return keep_last(stored.unionByName(new, allowMissingColumns=True), key, order)


def write_chunks(df: DataFrame, path: str) -> None:
    """Chunks as Parquet by knowledge base, so that a base's reader prunes the others."""
    df.withColumn("kb", base_of(F.col("source_type"))).write.mode("overwrite").partitionBy("kb").parquet(path)


def without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The rows that no key of ``gone`` removes."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def sanitise(columns: dict[str, Column]) -> Column:
    """Metadata as a map of strings: lists joined by ", ", nulls left out."""
    full = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def backfill_role(df: DataFrame) -> DataFrame:
    """Readings of images without a role become parents; ``changed`` tells which."""
    miss = F.coalesce(F.col("content_type").isin("image_ocr", "image_code"), F.lit(False)) & F.col("chunk_role").isNull()
    return df.withColumn("changed", miss).withColumn("chunk_role", F.when(miss, "parent").otherwise(F.col("chunk_role")))


def adopt(df: DataFrame, owner: str, key: str, name: str) -> DataFrame:
    """Rows without an owner given to ``name``, their key prefixed; rows with one are as they were, so it can be run again."""
    miss = F.col(owner).isNull() | (F.col(owner) == "")
    return df.withColumn(key, F.when(miss, F.concat(F.lit(f"{name}::"), F.col(key).cast("string"))).otherwise(F.col(key).cast("string"))).withColumn("adopted", miss).withColumn(owner, F.when(miss, name).otherwise(F.col(owner)))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table when documents (owner, document_id) go, and of each document the number of its text rows that went.

    ``tables``: chunks and, where there are any, images (owner, page_url, video_document_id) and clips (owner, document_id).
    Images go with the page they stand on and with the video they are frames of. Other owners' rows stay.
    """
    keys = gone.select("owner", "document_id").distinct()
    left = {"chunks": without(tables["chunks"], keys, ["owner", "document_id"])}
    if "images" in tables:
        of_video = without(tables["images"], keys.withColumnRenamed("document_id", "video_document_id"), ["owner", "video_document_id"])
        left["images"] = without(of_video, keys.withColumnRenamed("document_id", "page_url"), ["owner", "page_url"])
    if "clips" in tables:
        left["clips"] = without(tables["clips"], keys, ["owner", "document_id"])
    return left, tables["chunks"].join(keys, ["owner", "document_id"], "left_semi").groupBy("owner", "document_id").agg(F.count("*").alias("removed"))


def delete_repositories(chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks that are left when repositories (owner, repository) go, and how many went of each. Only the base of repositories loses rows."""
    keys = gone.select("owner", "repository").distinct().withColumn("kb", F.lit("github"))
    return without(chunks, keys, ["owner", "repository", "kb"]), chunks.join(keys, ["owner", "repository", "kb"], "left_semi").groupBy("owner", "repository").agg(F.count("*").alias("removed"))


def upsert_images(stored: DataFrame | None, new: DataFrame, order: list[str]) -> DataFrame:
    """Images (owner, image_url, ...) by ``owner::url``: the last of a batch, over what is stored."""
    keyed = keep_last(new.withColumn("key", F.concat_ws("::", F.coalesce("owner", F.lit("local")), "image_url")), ["key"], order)
    return keyed if stored is None else upsert(stored, keyed, ["key"], order)


def clip_key(owner: Column, document: Column, start: Column) -> Column:
    """``owner::document::clip_start``; the owner is local by default."""
    return F.concat_ws("::", F.coalesce(owner, F.lit("local")), document, F.concat(F.lit("clip_"), start.cast("string")))
