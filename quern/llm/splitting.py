"""Oversized items cut at natural boundaries, by byte ranges with halos.

An item is covered by byte ranges of its UTF-8 text, each with a halo on either
side, whether it lies in a table or in a file. A first pass detects boundaries: a worker
sees one range and its halos, counts the characters that begin in it and fixes the range's
anchor, the best boundary near its start; both neighbours see the same bytes there and
agree on it without talking. Between anchors each range is cut on its own. The
ranges' boundary tables are stitched by running sums of their characters and pieces, and a
second pass emits the pieces by offset. No worker of either pass loads a whole item. An item of
one range needs no stitching, so both passes are one for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import _base
from quern.session import spread

#: Bytes of a range of a table's text and of a file. Halo: bytes on either side, enough to see every boundary a piece in reach of the anchor could use.
RANGE, FILE_RANGE, HALO = 65_536, 8 << 20, 16_384

# boundary kinds, strongest first; a cut is placed at the end of the match
_LEVELS = (
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][”’」』]?\s*"),
    re.compile(r"\s+"),
)
_JOINS = re.compile(r"[̀-ͯ‍︀-️ঀ-ൿ]|[\U0001f3fb-\U0001f3ff]|\n")


def best_cut(text: str, low: int, high: int) -> int:
    """The place in (low, high] to cut ``text``: the last paragraph end there, else line, sentence or word end, else ``high``.

    A weaker boundary is used only where no stronger one lies in the window's
    last two thirds; if none lies there, any in the window is used. Without a
    boundary the cut falls at ``high``, but not within a character sequence
    that is drawn as one, unless the window has nothing else.
    """
    if high >= len(text):
        return len(text)
    for start in (low + (high - low) // 3, low):
        for level in _LEVELS:
            last = -1
            for m in level.finditer(text, start, min(len(text), high + 1)):
                end = min(m.end(), high)
                if m.start() < high and (m.end() <= high or text[high - 1].isspace()) and end > start:
                    last = end
            if last > low:
                return last
    cut = high
    while cut > low + 1 and _JOINS.match(text, cut):
        cut -= 1
    return cut if cut > low + 1 else high


def overlap_start(text: str, cut: int, least: int, most: int) -> int:
    """Where the piece after ``cut`` begins, ``least`` to ``most`` characters before it, at a word's start if one lies there."""
    low, high = max(0, cut - most), max(0, cut - least)
    for m in re.finditer(r"(?<=\s)\S", text[max(0, low - 1) : high + 1]):
        at = max(0, low - 1) + m.start()
        if low <= at <= high:
            return at
    return max(low, cut - (least + most) // 2)


def anchor(text: str, at: int, reach: int) -> int:
    """The strongest boundary within ``reach`` of ``at``, else ``at``. Sees only that window."""
    low, high = max(0, at - reach), min(len(text), at + reach)
    cut = best_cut(text[low:high] + "x" * reach, 0, high - low)
    return low + cut if cut < high - low else at


def cuts(text: str, start: int, stop: int, limit: int, overlap: tuple[int, int], first: bool) -> list[int]:
    """Ends of the pieces that cover text[start:stop].

    The first piece of an item may use the whole limit, the others what the
    overlap leaves. No piece is shorter than the overlap that is to repeat its end.
    """
    out, at = [], start
    room = limit if first else limit - overlap[1]
    least = overlap[1] + 1
    while stop - at > room:
        at = best_cut(text, at + least, min(at + room, stop - least))
        out.append(at)
        room = limit - overlap[1]
    if stop > at:
        out.append(stop)
    return out


def _starts(raw: bytes) -> int:
    """Characters that begin in these bytes of UTF-8."""
    return int(((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).sum())


class _Range:
    """One range as a worker sees it: its text and halos, and where in them the range begins and ends, in characters."""

    def __init__(self, raw: bytes, low: int, begin: int, end: int, total: int):
        high = low + len(raw)
        cut = 0
        while low and cut < len(raw) and raw[cut] & 0xC0 == 0x80:  # a halo may start inside a character
            cut += 1
        stop = len(raw)
        while high < total and stop > cut and raw[stop - 1] & 0xC0 == 0x80:  # and end inside one
            stop -= 1
        if high < total and stop > cut and raw[stop - 1] & 0xC0 == 0xC0:
            stop -= 1
        self.text = raw[cut:stop].decode("utf-8", "surrogateescape")
        self.start = _starts(raw[cut : begin - low])
        self.chars = _starts(raw[begin - low : end - low])
        self.first, self.last = begin == 0, end >= total

    def boundaries(self, limit: int, overlap: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """Begin and end of each of the range's pieces, in characters from the range's begin."""
        reach = limit // 2
        at = 0 if self.first else anchor(self.text, self.start, reach)
        stop = len(self.text) if self.last else anchor(self.text, self.start + self.chars, reach)
        for i, end in enumerate(cuts(self.text, at, stop, limit, overlap, self.first)):
            begin = at if self.first and i == 0 else overlap_start(self.text, at, *overlap)
            yield begin - self.start, end - self.start
            at = end

    def piece(self, begin: int, end: int) -> str:
        return self.text[self.start + begin : self.start + end]


_BOUNDS = "kind string, id bigint, h bigint, range_no bigint, chars bigint, begins array<bigint>, stops array<bigint>"
_PIECES = "kind string, id bigint, piece_no int, begin bigint, stop bigint, piece string"


def _detect(limit: int, overlap: tuple[int, int], read):
    """One row a range: its boundary table."""
    offsets = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            keys = [batch.column(i) for i in range(4)]
            chars, begins, stops = [], [], []
            for raw, low, begin, end, total in zip(*read(batch), strict=True):
                r = _Range(raw, low, begin, end, total)
                found = list(r.boundaries(limit, overlap))
                chars.append(r.chars)
                begins.append([b for b, _ in found])
                stops.append([e for _, e in found])
            yield pa.RecordBatch.from_arrays([*keys, pa.array(chars, pa.int64()), pa.array(begins, offsets), pa.array(stops, offsets)], ["kind", "id", "h", "range_no", "chars", "begins", "stops"])

    return run


def _emit(limit: int, overlap: tuple[int, int], read):
    """The pieces of ranges by their stitched boundaries; ranges without a boundary table are the only one of their item."""

    def run(batches):
        for batch in batches:
            rest = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("kind", "id", "first_char", "first_piece", "begins", "stops")}
            out: dict[str, list] = {n: [] for n in ("kind", "id", "piece_no", "begin", "stop", "piece")}
            for kind, key, char, no, begins, stops, (raw, low, begin, end, total) in zip(*rest.values(), zip(*read(batch), strict=True), strict=True):
                r = _Range(raw, low, begin, end, total)
                for i, (b, e) in enumerate(r.boundaries(limit, overlap) if begins is None else zip(begins, stops, strict=True)):
                    for n, v in zip(out, (kind, key, no + i, char + b, char + e, r.piece(b, e)), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("kind", pa.string()), ("id", pa.int64()), ("piece_no", pa.int32()), ("begin", pa.int64()), ("stop", pa.int64()), ("piece", pa.string())]))

    return run


def _held(batch: pa.RecordBatch) -> list[list]:
    """Bytes and places of ranges that the rows hold."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("raw", "low", "from_byte", "to_byte", "bytes")]


def _read_files(halo: int):
    def read(batch: pa.RecordBatch):
        """Bytes and places of ranges of files, read from whatever file system their address names."""
        paths, begins, ends, totals = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("kind", "from_byte", "to_byte", "bytes"))
        lows = [max(0, b - halo) for b in begins]

        def raws():
            for path, low, end, total in zip(paths, lows, ends, totals, strict=True):
                system, inside = fs.FileSystem.from_uri(path)
                with system.open_input_file(inside) as f:
                    yield f.read_at(min(total, end + halo) - low, low)

        return [raws(), lows, begins, ends, totals]

    return read


def _stitched(bounds: DataFrame) -> DataFrame:
    """Boundary tables with ``first_char`` and ``first_piece`` of each range: running sums over the ranges of an item."""
    before = Window.partitionBy("kind", "id", "h").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    once = bounds.dropDuplicates(["kind", "id", "h", "range_no"])  # a row that is there twice
    return once.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in (("first_char", F.col("chars")), ("first_piece", F.size("begins")))])


def _check(limit: int, overlap: tuple[int, int], size: int, halo: int) -> None:
    if not 0 < overlap[0] <= overlap[1] <= limit // 4:
        raise ValueError("the overlap must be positive and at most a quarter of the limit")
    if halo < 8 * limit or size < 8 * limit:
        raise ValueError("ranges and halos must be large against the limit")


def _ranges(df: DataFrame, kind_col: str, id_col: str, text_col: str, limit: int, size: int, halo: int) -> DataFrame:
    """The byte ranges, with halos, of every text over the limit. A slice of bytes costs its own length, wherever it lies."""
    rows = _base.unit(df, kind=kind_col, id=id_col, text=text_col).select(F.col("kind").cast("string").alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    long = spread(rows).where(F.length("text") > limit).where("id is not null")
    items = long.select("kind", "id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("bigint").alias("bytes"), F.col("text").cast("binary").alias("all"))
    each = items.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(bytes - 1) div {size}"))).alias("range_no"))
    each = each.withColumn("from_byte", F.col("range_no") * size).withColumn("to_byte", F.least(F.col("from_byte") + size, "bytes")).withColumn("low", F.greatest(F.col("from_byte") - halo, F.lit(0)))
    length = F.least(F.col("to_byte") + halo, "bytes") - F.col("low")
    return each.select("kind", "id", "h", "range_no", "bytes", "from_byte", "to_byte", "low", F.col("all").substr((F.col("low") + 1).cast("int"), length.cast("int")).alias("raw"))


def _parted(ranges: DataFrame, size: int) -> DataFrame:
    """Ranges of items of several, each at a task of its own choosing: a giant item is work for many."""
    return ranges.where(F.col("bytes") > size).repartition("kind", "id", "range_no")


def boundaries(df: DataFrame, kind_col: str, id_col: str, text_col: str, *, limit: int = 1200, overlap: tuple[int, int] = (100, 200), size: int = RANGE, halo: int = HALO) -> DataFrame:
    """Where :func:`split_oversized` cuts: (kind, id, piece_no, begin, stop), without the pieces' text."""
    _check(limit, overlap, size, halo)
    ranges = _ranges(df, kind_col, id_col, text_col, limit, size, halo)
    find = _detect(limit, overlap, _held)
    single = ranges.where(F.col("bytes") <= size).mapInArrow(find, _BOUNDS).select("*", F.lit(0).alias("first_char"), F.lit(0).alias("first_piece"))
    several = _parted(ranges, size).mapInArrow(find, _BOUNDS)
    rows = single.unionByName(_stitched(several)).select("kind", "id", "first_char", "first_piece", F.posexplode(F.arrays_zip("begins", "stops")).alias("no", "o"))
    return rows.select("kind", "id", (F.col("first_piece") + F.col("no")).cast("int").alias("piece_no"), (F.col("first_char") + F.col("o.begins")).alias("begin"), (F.col("first_char") + F.col("o.stops")).alias("stop"))


def split_oversized(df: DataFrame, kind_col: str, id_col: str, text_col: str, *, limit: int = 1200, overlap: tuple[int, int] = (100, 200), size: int = RANGE, halo: int = HALO) -> DataFrame:
    """The pieces (kind, id, piece_no from 0, begin, stop, piece) of every text longer than ``limit`` code points.

    Each piece has at most ``limit`` characters; each after the first repeats the
    last ``overlap`` characters of the one before; without those repeats the
    pieces concatenate to the text. Texts within the limit, nulls and empty texts
    give no rows; rows with a null id neither. A repeated (kind, id) gives the pieces of each of its
    rows, numbered from 0. An empty table gives an empty result. ``size`` and ``halo`` are bytes.
    """
    _check(limit, overlap, size, halo)
    ranges = _ranges(df, kind_col, id_col, text_col, limit, size, halo)
    emit = _emit(limit, overlap, _held)
    none = F.lit(None).cast("array<bigint>")
    single = ranges.where(F.col("bytes") <= size).withColumns({"first_char": F.lit(0).cast("bigint"), "first_piece": F.lit(0).cast("bigint"), "begins": none, "stops": none}).mapInArrow(emit, _PIECES)
    several = _parted(ranges, size)
    bounds = _base.stage(several.mapInArrow(_detect(limit, overlap, _held), _BOUNDS), "split-bounds")  # one narrow row a range
    return single.unionByName(several.join(_stitched(bounds), ["kind", "id", "h", "range_no"]).mapInArrow(emit, _PIECES))


def split_files(files: DataFrame, path_col: str, bytes_col: str, *, limit: int = 1200, overlap: tuple[int, int] = (100, 200), size: int = FILE_RANGE, halo: int = HALO) -> DataFrame:
    """Pieces (path, piece_no, begin, stop, piece) of UTF-8 files, of which ``files`` has address and length, as file discovery gives them.

    Addresses name a file system that every executor reaches, such as hdfs:// or a
    mounted file:///; each worker reads byte ranges only. Offsets are in
    characters. Files within the limit give one piece; empty files, nulls and repeated rows none.
    """
    _check(limit, overlap, size, halo)
    rows = _base.unit(files, kind=path_col, bytes=bytes_col).select(F.col("kind").cast("string").alias("kind"), F.col("bytes").cast("bigint").alias("bytes")).where("kind is not null and bytes > 0").distinct()
    ranges = rows.withColumn("from_byte", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(size).cast("bigint"))))
    ranges = ranges.select("kind", F.lit(0).cast("bigint").alias("id"), F.col("bytes").alias("h"), F.expr(f"from_byte div {size}").alias("range_no"), "from_byte", F.least(F.col("from_byte") + size, "bytes").alias("to_byte"), "bytes")
    read = _read_files(halo)
    bounds = _base.stage(ranges.repartition("kind", "range_no").mapInArrow(_detect(limit, overlap, read), _BOUNDS), "split-bounds")
    pieces = ranges.join(_stitched(bounds), ["kind", "id", "h", "range_no"]).mapInArrow(_emit(limit, overlap, read), _PIECES)
    return pieces.select(F.col("kind").alias("path"), "piece_no", "begin", "stop", "piece")


def checked(pieces: DataFrame, *, overlap: tuple[int, int] = (100, 200)) -> DataFrame:
    """What the pieces of each (kind, id) amount to: ``longest`` piece, whether numbers and overlaps are ``sound``, and the MD5 of the text put together again."""
    w = Window.partitionBy("kind", "id").orderBy("piece_no")
    before = F.lag("stop").over(w)
    repeats = F.coalesce(before - F.col("begin"), F.lit(0))
    fits = F.when(before.isNull(), (F.col("begin") == 0) & (F.col("piece_no") == 0)).otherwise(repeats.between(*overlap) & (F.col("piece_no") == F.lag("piece_no").over(w) + 1))
    rows = pieces.select("*", fits.alias("fits"), F.expr("substring(piece, 1 + cast(coalesce(lag(stop) over (partition by kind, id order by piece_no) - begin, 0) as int))").alias("own"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")
    return rows.groupBy("kind", "id").agg(F.max(F.length("piece")).alias("longest"), F.bool_and("fits").alias("sound"), F.md5(joined).alias("digest"))

