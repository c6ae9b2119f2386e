"""Near-duplicate records by pigeonhole blocks over fingerprints.

A text's fingerprint is a row of symbols, each the minimum of its word shingles
under one hash function: two texts agree in a symbol with a probability equal to
the Jaccard similarity of their shingle sets, so similarity becomes Hamming
distance over symbols. The fingerprint is split into blocks of a few symbols.
The blocks are join keys, the candidates' Hamming distance is verified, and the
pairs that are left are checked exactly on the shingle sets of their texts.

By the pigeonhole principle a pair that differs in fewer symbols than there are blocks
has a block free of differences and cannot be missed. Pairs near the threshold differ in more
(48 of 120 symbols are expected at 0.6), and there the principle holds on average only: with ``blocks`` blocks
of ``width`` symbols a pair of similarity s shares none with
probability (1 - s ** width) ** blocks: 6e-5 at s = 0.6 for the 40 blocks of 3
used there, 4e-9 at 0.7. As many blocks as would make it certain are blocks of one symbol,
which any two texts of a site share. The Hamming limit lies six standard deviations beyond
the distance expected at the threshold. No bucket is capped.

Texts with the same words in the same order are one class, whatever their
number: only one row of the class is fingerprinted into blocks and joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _base
from quern.session import spread
from quern.llm.text import WORD, Hashes, mix, shingles, word_hashes

#: Members of a class, or texts of a block, that one task pairs with all of it.
SALT = 2000
#: Most blocks of more than two texts that are sent to the fingerprints; more are joined.
SEND = 200_000


def _bits(width: int) -> int:
    """Bits of a symbol: a block's symbols and its number (below 256) fill one 64-bit key."""
    return min(16, 56 // width)


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, count + 1, dtype=np.uint64)
    return mix(base * np.uint64(0x9E3779B97F4A7C15)), mix(base + np.uint64(0x51ED270B)) | np.uint64(1)


def _digests(h: np.ndarray, mul: np.ndarray) -> tuple[int, int]:
    """Two digests of words in their order, 128 bits together."""
    place = np.arange(1, len(h) + 1, dtype=np.uint64)
    return int(np.bitwise_xor.reduce(mix(h + place * mul[0])).view(np.int64)), int(np.add.reduce(mix(h * mul[-1] ^ mix(place))).view(np.int64))


def _fingerprints(size: int, min_words: int, blocks: int, width: int):
    xor, mul = _seeds(blocks * width)

    def run(batches):
        cache = Hashes()
        for batch in batches:
            kind, key, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            at, sets, w1, w2 = [], [], [], []
            for i, text in enumerate(texts):
                if not text or len(text) < 2 * min_words - 1:
                    continue
                words = WORD.findall(text.lower())
                if len(words) < max(min_words, size):
                    continue
                h = word_hashes(words, cache)
                one, two = _digests(h, mul)
                w1.append(one)
                w2.append(two)
                at.append(i)
                sets.append(np.unique(shingles(h, size)))
            if not at:
                continue
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            prints = np.empty((blocks * width, len(sets)), np.uint64)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            lo = 0
            while lo < len(sets):  # by about 30,000 shingles, which stay in the processor's cache
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + 30_000)))
                flat = np.concatenate(sets[lo:hi])
                cut = first[lo:hi] - first[lo]
                buf = np.empty_like(flat)
                for j in range(blocks * width):
                    np.bitwise_xor(flat, xor[j], out=buf)
                    np.multiply(buf, mul[j], out=buf)
                    prints[j, lo:hi] = np.minimum.reduceat(buf, cut)
                lo = hi
            bits = _bits(width)
            prints = (mix(prints) & np.uint64((1 << bits) - 1)).reshape(blocks, width, -1)
            keys = np.arange(blocks, dtype=np.uint64)[:, None] << np.uint64(bits * width)
            for j in range(width):
                keys = keys | prints[:, j] << np.uint64(bits * j)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * blocks), pa.array(np.ascontiguousarray(keys.T).ravel().view(np.int64)))
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [kind.take(pick), key.take(pick), pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(n.astype(np.int32)), lists],
                ["kind", "id", "w1", "w2", "n", "print"],
            )

    return run


def _sets(size: int, mul_of: int):
    """The shingle sets of asked texts: of rows with the asked digests only, as an id may have other texts too."""
    _, mul = _seeds(mul_of)

    def run(batches):
        cache = Hashes()
        for batch in batches:
            keep, sets = [], []
            for i, (text, w1, w2) in enumerate(zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), strict=True)):
                h = word_hashes(WORD.findall(text.lower()), cache)
                if _digests(h, mul) == (w1, w2):
                    keep.append(i)
                    sets.append(np.unique(shingles(h, size)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["row", "shingles"])

    return run


def _distance(a: str, b: str, width: int):
    """Symbols in which two fingerprints differ."""
    bits = _bits(width)
    one = lambda x, j: F.when(F.shiftrightunsigned(x, bits * j).bitwiseAND(F.lit((1 << bits) - 1)) != 0, 1).otherwise(0)
    apart = F.zip_with(a, b, lambda x, y: sum((one(x.bitwiseXOR(y), j) for j in range(1, width)), one(x.bitwiseXOR(y), 0)))
    return F.aggregate(apart, F.lit(0), lambda s, x: s + x)


def classes(df: DataFrame, kind_col: str, id_col: str, text_col: str, *, size: int = 5, threshold: float = 0.8, min_words: int = 20, blocks: int = 20, width: int = 4, send: int = SEND) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and the links between classes.

    Returns ``members`` (kind, id, rep) with one row per record and text that takes part,
    and ``links`` (kind, a, b, similarity), a < b, between different classes
    whose sets of ``size``-word shingles have a Jaccard
    similarity of at least ``threshold``. A class is named by a row of its own, not by an id,
    so that a repeated (kind, id) counts with each of its texts. Links are only within one kind.

    Records with a null id, a null text or under ``min_words`` words take no part
    (texts shorter than a shingle neither). A null kind is a kind of its own. An empty table gives empty results.
    """
    rows = _base.unit(df, kind=kind_col, id=id_col, text=text_col).select(F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    prints = spread(rows).mapInArrow(_fingerprints(size, min_words, blocks, width), "kind string, id bigint, w1 bigint, w2 bigint, n int, print array<bigint>")
    prints = _base.stage(prints.withColumn("row", F.monotonically_increasing_id()), "neardup-prints")
    word = ["kind", "w1", "w2"]
    rep = prints.groupBy(*word).agg(F.min("row").alias("rep"))
    members = _base.spread_join(prints.select(*word, "id", "row"), rep, word, ["row"]).select("kind", "id", "rep").distinct()
    heads = prints.join(rep.select(F.col("rep").alias("row")), "row", "left_semi")
    close = _base.stage(_close(heads, threshold, blocks, width, send), "neardup-close")
    asked = close.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    named = heads.select("row", *word, "id").join(asked, "row")
    texts = rows.join(named, ["kind", "id"]).select("row", "text", "w1", "w2")
    sets = texts.mapInArrow(_sets(size, blocks * width), "row bigint, shingles array<bigint>").dropDuplicates(["row"])
    both = close.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("s_b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    links = both.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("s_a") + F.size("s_b") - F.col("common"))).where(F.col("similarity") >= threshold).select("kind", "a", "b", "similarity")
    return members, links


def _close(heads: DataFrame, threshold: float, blocks: int, width: int, send: int) -> DataFrame:
    """Pairs (kind, a, b), a < b, of rows that share a block and lie within the Hamming limit.

    Blocks are counted before they are joined, in parts where they stand. A block that one text has gives
    nothing; one that two have is their pair at once; only those of more are
    joined, and one of very many in as many parts as its size asks for.
    """
    keys = heads.select("row", F.explode("print").alias("block"), "kind").select("row", F.xxhash64("kind", "block").alias("key"))
    counted = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b")).where("n > 1")
    counted = _base.stage(counted, "neardup-blocks")
    many = counted.where("n > 2").select("key", F.ceil(F.col("n") / F.lit(SALT)).cast("int").alias("salts"))
    # a bounded number of blocks is sent to the fingerprints; more are joined, each hot one in parts
    if many.limit(send + 1).count() <= send:
        held = keys.join(F.broadcast(many), "key")
    else:
        held = _base.spread_join(keys, many, ["key"], ["row"])
    left = held.select("key", F.col("row").alias("a"), F.pmod(F.xxhash64("row"), "salts").cast("int").alias("salt"))
    right = held.select("key", F.col("row").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    joined = left.join(right, ["key", "salt"]).where("a < b").select("a", "b")
    near = counted.where("n = 2").select("a", "b").unionByName(joined).distinct()
    of = lambda c: heads.select(F.col("row").alias(c), F.col("kind").alias(f"kind_{c}"), F.col("n").alias(f"n_{c}"), F.col("print").alias(f"print_{c}"))
    both = near.join(of("a"), "a").join(of("b"), "b")
    symbols = blocks * width
    most = math.ceil(symbols * (1 - threshold) + 6 * math.sqrt(symbols * threshold * (1 - threshold)))
    sizes = (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))
    fits = both.where((F.col("kind_a") == F.col("kind_b")) & sizes).where(_distance("print_a", "print_b", width) <= most)
    return fits.select(F.col("kind_a").alias("kind"), "a", "b")


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (kind, id_a, id_b), each once, of different ids: of equal texts, and of linked classes.

    The result itself is quadratic in the size of a class; a large class is
    paired in salted blocks, each of at most ``SALT`` of its members by all.
    """
    several = members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1").withColumn("salts", F.ceil(F.col("size") / F.lit(SALT)).cast("int"))
    sized = _base.spread_join(members, several, ["rep"], ["id"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    many = sized.where("size > 1")
    right = many.select("rep", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    equal = many.select("kind", "rep", F.col("id").alias("id_a"), "salt").join(right, ["rep", "salt"]).where("id_a < id_b").select("kind", "id_a", "id_b")
    # a link meets each salt of either class
    ways = links.select("kind", "a", "b")
    for side in ("a", "b"):
        own = several.select(F.col("rep").alias(side), "salts")
        ways = ways.join(own, side, "left").withColumn(f"salt_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    of = lambda c: sized.select(F.col("rep").alias(c), F.col("salt").alias(f"salt_{c}"), F.col("id").alias(f"id_{c}"))
    linked = ways.join(of("a"), ["a", "salt_a"]).join(of("b"), ["b", "salt_b"]).where("id_a <> id_b")
    linked = linked.select("kind", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return equal.unionByName(linked).distinct()


def groups(members: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """One row per record (kind, id): ``class_id``, the smallest id with its text, ``group_id``, the smallest id reachable over links, and ``links``, its number of linked records.

    Connected components by minimum labels with pointer jumping over the class
    graph; every round is cut at a table in the shared folder. Raises if
    ``rounds`` do not suffice, rather than return a half result. A record that is there with several texts has a row for each.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = _base.stage(edges, "neardup-edges")
    label = _base.stage(edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")), "neardup-label")
    for _ in range(rounds):
        seen = _base.spread_join(edges, label.withColumnRenamed("v", "b"), ["b"], ["a"]).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("seen"))
        step = label.join(seen, "v").select("v", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        jump = label.select(F.col("v").alias("label"), F.col("label").alias("far"))
        now = _base.stage(_base.spread_join(step, jump, ["label"], ["v"]).select("v", F.least("label", "far").alias("label"), "old"), "neardup-label")
        moved = now.where("label <> old").limit(1).count()
        _base.discard(label)
        label = now.select("v", "label")
        label._quern_stage = now._quern_stage
        if not moved:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    size = members.groupBy("rep").agg(F.count("*").alias("size"), F.min("id").alias("class_id"))
    linked = _base.spread_join(edges, size.select(F.col("rep").alias("b"), "size"), ["b"], ["a"]).groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("beside"))
    of_class = size.join(linked, "rep", "left").join(label.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = _base.spread_join(of_class, of_class.groupBy("label").agg(F.min("class_id").alias("group_id")), ["label"], ["rep"])
    out = _base.spread_join(members, named, ["rep"], ["id"])
    return out.select("kind", "id", "class_id", "group_id", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))
