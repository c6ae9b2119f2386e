"""Items packed into containers of fixed capacity, by hierarchical residual packing.

Each partition packs its items best-fit, largest first, and keeps the bins that are
nearly full. The others become items of the next round, which sees fewer
partitions, as in a tree merge. Every round writes one narrow table; an item's
container is found by following its bin through the rounds.

Best fit opens a bin only for an item that fits none of the others, so a task
leaves at most one bin that is half full or less, and two bins can be merged only
if one of them is. The merge is therefore at its end when one task held all that
was underfull, or when at most one half-empty bin is left anywhere: then no two
containers, this one apart, fit into one. A round that did not halve the half-empty bins is followed by one
over these alone, any two of which fit together, so the rounds are at most
twice the logarithm of the first round's tasks.
"""

from __future__ import annotations

import base64
import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _base
from quern.session import spread

#: Items that one task packs, about.
TASK_ITEMS = 50_000


def encoding(path: str):
    """The tokenizer whose ranks are in the file ``path``."""
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("quern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """``id`` and ``tokens`` of every text that is not null or empty; rows with a null id are left out.

    ``vocabulary`` is the path, on every executor, of a rank file of a public byte-level tokenizer.
    """

    def run(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            counts = [len(enc.encode_to_numpy(t, disallowed_special=())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "tokens"])

    rows = _base.unit(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return spread(rows.where("id is not null and text <> ''")).mapInArrow(run, "id bigint, tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and each bin's fill. Items must fit."""
    bins = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    free: list[tuple[int, int]] = []  # (space left, bin), sorted
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        fill[b] += size
        bins[i] = b
        if left > size:
            bisect.insort(free, (left - size, b))
    return bins, fill


def _pack_round(capacity: int, no: int):
    def run(batches):
        ids, sizes = [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            sizes.append(batch.column(1).to_numpy())
        if not ids:
            return
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        order = np.argsort(ids.astype(str), kind="stable")
        ids, sizes = ids[order], sizes[order]
        bins, fill = best_fit(sizes, capacity)
        part = TaskContext.get().partitionId()
        names = np.array([f"{no}-{part}-{b}" for b in range(len(fill))], dtype=object)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names[bins], pa.string()), pa.array(np.array(fill)[bins], pa.int64()), pa.array(sizes, pa.int64())], ["item", "bin", "fill", "size"])

    return run


def pack(items: DataFrame, id_col: str, size_col: str, *, capacity: int = 2048, nearly: float = 0.995, task_items: int = TASK_ITEMS) -> DataFrame:
    """A container for every item: ``id``, ``part``, ``tokens``, ``container``, ``fill``.

    An item over the capacity is split: its full parts are containers of their
    own, its rest is packed as ``part`` 0. Items with a null id or a null, zero or negative size
    are left out; a repeated id with equal or other sizes counts as further items.
    An empty table gives an empty result.
    """
    rows = _base.unit(items, id=id_col, size=size_col).select(F.col("id").cast("bigint").alias("id"), F.col("size").cast("bigint").alias("size")).where("id is not null and size > 0")
    rows = _base.stage(rows.withColumn("row", F.monotonically_increasing_id()), "pack-items")
    over = rows.withColumn("parts", F.floor(F.col("size") / capacity)).where("parts > 0")
    full = over.withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), "parts"))).select("id", F.col("part").cast("int").alias("part"), F.lit(capacity).cast("bigint").alias("tokens"), F.concat(F.lit("f-"), F.col("row").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"), F.lit(capacity).cast("bigint").alias("fill"))
    rest = rows.select("id", "row", (F.col("size") % capacity).alias("size")).where("size > 0")
    todo = rest.select(F.col("row").cast("string").alias("item"), "size")
    count, no, small = todo.count(), 0, None
    links: list[DataFrame] = []  # of each round: item, bin, fill
    while count:
        parts = max(1, -(-count // task_items))
        packed = _base.stage(todo.repartition(parts, "item").mapInArrow(_pack_round(capacity, no), "item string, bin string, fill bigint, size bigint"), f"pack-round{no}")
        links.append(packed)
        bins = packed.where(F.col("fill") < nearly * capacity).groupBy("bin").agg(F.max("fill").alias("size"))
        under = bins.select(F.col("bin").alias("item"), "size")
        half = F.col("size") <= capacity // 2
        seen = under.agg(F.count("*").alias("n"), F.coalesce(F.sum(half.cast("int")), F.lit(0)).alias("half")).first()
        if seen["half"] <= 1:  # no two others fit together
            break
        slow = small is not None and seen["half"] > small // 2
        todo, count = (under.where(half), seen["half"]) if slow else (under, seen["n"])
        small, no = seen["half"], no + 1
    if not links:
        return full
    own = links[0].select("item", F.col("bin").alias("container"), "fill")
    for later in links[1:]:
        own = own.join(later.select(F.col("item").alias("container"), F.col("bin").alias("next"), F.col("fill").alias("next_fill")), "container", "left").select("item", F.coalesce("next", "container").alias("container"), F.coalesce("next_fill", "fill").alias("fill"))
    held = rest.withColumn("item", F.col("row").cast("string")).join(own, "item").select("id", F.lit(0).alias("part"), F.col("size").alias("tokens"), "container", "fill")
    return held.unionByName(full)
