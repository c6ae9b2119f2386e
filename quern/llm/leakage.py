"""Evaluation passages inside training texts, by greedy string tiling.

Texts and test fields are reduced to words. Every run of ``least`` words of the
test fields has a hash, the seed. A map of bits of fixed size says which
hashes can be seeds; it goes to every task, so that each document is read and
normalised once, whatever the size of the test set, and only the stretches of it whose runs
the map lets through go on. They are joined to the seeds by hash, which gives the
pairs of document and field that share a run.

Each pair is tiled by running Karp-Rabin: rolling hashes find the greatest length at
which an unmarked run of the one equals one of the other, all such runs are
compared, marked on both sides, and so on with shorter ones until none of ``least``
words is left; so reordered passages count each at their place. The field's words under tiles
are its coverage, which decides whether the pair comes out. A tiling costs its two lengths times the number of different
lengths of its tiles, also for repetitive texts.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _base
from quern.session import spread
from quern.llm.text import WORD, Hashes, mix, word_hashes

#: Bits, as a power of two, of the map of possible seeds: 2 MB to each task.
MAP_BITS = 24

# HTML elements: those that end a line of text part words, the others do not
_BREAKING = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
_INLINE = "a|abbr|b|bdi|bdo|cite|code|data|del|dfn|em|font|i|img|ins|kbd|mark|q|rp|rt|ruby|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr"
_BREAK = re.compile(rf"</?(?:{_BREAKING})(?:\s[^<>]*)?/?>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.I)
_HIDDEN = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")


def plain_words(text: str) -> list[str]:
    """The words of a text, without what makes no difference: case, punctuation, markup, invisible characters, width and compatibility forms."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if text.isascii():
        return WORD.findall(text.lower())
    text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).casefold()
    return WORD.findall(unicodedata.normalize("NFKC", text))


def runs(h: np.ndarray, least: int) -> np.ndarray:
    """A hash of each run of ``least`` words."""
    n = len(h) - least + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, least):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return mix(out)


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Karp-Rabin values of the runs of any length of a row of words, by prefix sums modulo 2^64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:n], dtype=np.uint64)])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.back[starts])


def _starts(free: np.ndarray, length: int) -> np.ndarray:
    """Where a run of ``length`` unmarked words begins."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.nonzero(marked[length:] == marked[:-length])[0] if length <= len(free) else np.empty(0, np.int64)


def tiles(a: np.ndarray, b: np.ndarray, least: int, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of ``a``, where it is ``free``, by ``b``: (start in a, start in b, length), longest first."""
    free_a = np.ones(len(a), bool) if free is None else free.copy()
    free_b = np.ones(len(b), bool)
    roll_a, roll_b = Rolling(a), Rolling(b)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of equal unmarked runs of ``length`` in both, with their values."""
        i, j = _starts(free_a, length), _starts(free_b, length)
        x, y = roll_a.at(i, length), roll_b.at(j, length)
        in_a, in_b = np.isin(x, y), np.isin(y, x)
        return i[in_a], x[in_a], j[in_b], y[in_b]

    out = []
    most = min(len(a), len(b))
    while most >= least:
        low, high = least - 1, most
        while low < high:  # where runs of a length agree, shorter ones do
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        i, x, j, y = common(low)
        places: dict[int, list[int]] = {}
        for at, value in zip(j[::-1].tolist(), y[::-1].tolist(), strict=True):
            places.setdefault(value, []).append(at)
        done = 0
        for at, value in zip(i.tolist(), x.tolist(), strict=True):
            if at < done:
                continue
            own = places[value]
            while own and not free_b[own[-1] : own[-1] + low].all():
                own.pop()
            if own and np.array_equal(a[at : at + low], b[own[-1] : own[-1] + low]):
                there = own.pop()
                free_a[at : at + low] = free_b[there : there + low] = False
                out.append((at, there, low))
                done = at + low
        most = low - 1
    return out


def _fields(least: int):
    """Words and seeds of test fields."""

    def run(batches):
        cache = Hashes()
        for batch in batches:
            words = [word_hashes(plain_words(t), cache) for t in batch.column(2).to_pylist()]
            keep = [i for i, w in enumerate(words) if len(w) >= least]
            lists = lambda rows: pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), lists([words[i] for i in keep]), lists([np.unique(runs(words[i], least)) for i in keep])], ["item_id", "field", "own", "seeds"])

    return run


def _candidates(packed: bytes, least: int):
    """Documents with runs that the map lets through: those runs, and the stretches of words under them."""

    def run(batches):
        cache = Hashes()
        sieve = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        shift = np.uint64(64 - MAP_BITS)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "hits", "lengths", "words")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain_words(text)
                if len(words) < least:
                    continue
                h = word_hashes(words, cache)
                r = runs(h, least)
                hit = np.nonzero(sieve[(r >> shift).astype(np.int64)])[0]
                if not len(hit):
                    continue
                cut = np.nonzero(np.diff(hit) > least)[0]
                first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])] + least
                out["doc_id"].append(doc)
                out["hits"].append(np.unique(r[hit]).view(np.int64))
                out["lengths"].append((last - first).astype(np.int32))
                out["words"].append(np.concatenate([h[i:j] for i, j in zip(first, last, strict=True)]).view(np.int64))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("hits", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("words", pa.list_(pa.int64()))]))

    return run


_ROW = "doc_id bigint, item_id bigint, field string, tiles int, longest int, covered int, coverage double"


def _tile(least: int):
    def run(batches):
        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "item_id", "field", "lengths", "words", "own")}
            out: dict[str, list] = {n: [] for n in ("doc_id", "item_id", "field", "tiles", "longest", "covered", "coverage")}
            for i in range(batch.num_rows):
                lengths, words, own = (np.asarray(cols[n][i].values) for n in ("lengths", "words", "own"))
                # a closed place behind each stretch: no tile reaches from one into the next
                ends = np.cumsum(lengths)
                text = np.insert(words, ends, 0).view(np.uint64)
                free = np.ones(len(text), bool)
                free[ends + np.arange(len(ends))] = False
                got = tiles(text, own.view(np.uint64), least, free)
                if got:
                    covered = sum(n for _, _, n in got)
                    for n, v in zip(out, (*(cols[c][i].as_py() for c in ("doc_id", "item_id", "field")), len(got), got[0][2], covered, round(covered / len(own), 6)), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("field", pa.string()), ("tiles", pa.int32()), ("longest", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())]))

    return run


def _bit_map(seeds: DataFrame) -> bytes:
    """The map of possible seeds: 512 rows at most come to the driver, 2 MB whatever the test set."""
    bit = F.shiftrightunsigned("h", 64 - MAP_BITS)
    rows = seeds.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    packed = bytearray(1 << (MAP_BITS - 3))
    for r in rows:
        packed[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(packed)


def leaks(docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, fields: list[str], *, least: int = 12, min_covered: int | None = None, min_coverage: float = 0.0) -> DataFrame:
    """Documents and test fields of which tiles of at least ``least`` words cover enough.

    One row per document, item and field: the number of ``tiles``, the
    ``longest`` one, the field's ``covered`` words, at least ``min_covered`` (``least`` if not given),
    and their share ``coverage``, at least ``min_coverage``. Null ids, null texts and texts or fields under
    ``least`` words have no rows; a repeated document or item has rows for each
    of its copies. Without documents or items the result is empty. Neither side is held by the driver.
    """
    texts = _base.unit(docs, doc_id=doc_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    given = items.select(F.col(f"`{item_col}`").cast("bigint").alias("item_id"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("text")) for c in fields]))).where("item_id is not null and text is not null")
    asked = _base.stage(spread(given).mapInArrow(_fields(least), "item_id bigint, field string, own array<bigint>, seeds array<bigint>").withColumn("no", F.monotonically_increasing_id()), "leak-fields")
    seeds = asked.select("no", F.explode("seeds").alias("h"))
    held = spread(texts).mapInArrow(_candidates(_bit_map(seeds), least), "doc_id bigint, hits array<bigint>, lengths array<int>, words array<bigint>")
    held = _base.stage(held.withColumn("row", F.monotonically_increasing_id()), "leak-candidates")
    pairs = _base.spread_join(held.select("row", F.explode("hits").alias("h")), seeds, ["h"], ["row"]).select("row", "no").distinct()
    tiled = _base.spread_join(pairs, asked.select("no", "item_id", "field", "own"), ["no"], ["row"]).join(held.select("row", "doc_id", "lengths", "words"), "row").mapInArrow(_tile(least), _ROW)
    return tiled.where((F.col("covered") >= (least if min_covered is None else min_covered)) & (F.col("coverage") >= min_coverage))
