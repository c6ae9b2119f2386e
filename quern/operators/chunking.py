"""One document to many chunks: Markdown structure, code structure, word and sentence windows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.session import spread

#: Words of a chunk, and of the end of a chunk that the next one repeats; words of a child window, and its least.
SIZE, OVERLAP, CHILD, CHILD_LEAST = 150, 30, 40, 5

_FENCE = re.compile(r"\s*```")
_RULE = re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*$")
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_ROW = re.compile(r"\s*\|.*\|\s*$")
_DIVIDER = re.compile(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")
_PAGE = re.compile(r"\x00PAGE:(\d+)\x00$")
_IMAGE = re.compile(r"\[Image: [^\]]*\] \([^)]*\)")


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """The Markdown blocks of a text: page_marker, code, heading, table and paragraph.

    Fences are taken whole, an open one to the end; rules are dropped; a table
    needs a divider below its first row; blank lines end paragraphs.
    """
    lines = text.split("\n")
    plain: list[str] = []

    def paragraph() -> Iterator[tuple[str, str]]:
        body = "\n".join(plain).strip()
        plain.clear()
        if body:
            yield "paragraph", body

    at = 0
    while at < len(lines):
        line = lines[at]
        kind, stop, body = None, at + 1, ""
        if m := _PAGE.match(line.strip()):
            kind, body = "page_marker", m.group(1)
        elif _FENCE.match(line):
            close = next((i for i in range(at + 1, len(lines)) if _FENCE.match(lines[i])), len(lines) - 1)
            kind, stop = "code", close + 1
            body = "\n".join(lines[at:stop])
        elif _RULE.match(line):
            kind = "rule"
        elif _HEADING.match(line):
            kind, body = "heading", line.strip()
        elif _ROW.match(line) and at + 1 < len(lines) and _DIVIDER.match(lines[at + 1]):
            stop = next((i for i in range(at + 2, len(lines)) if not _ROW.match(lines[i])), len(lines))
            kind, body = "table", "\n".join(lines[at:stop])
        elif not line.strip():
            kind = "blank"
        if kind is None:
            plain.append(line)
        else:
            yield from paragraph()
            if body:
                yield kind, body
        at = stop
    yield from paragraph()


def sections(parts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Blocks by heading: the path of headings joined by " > ", and the blocks below the last of them."""
    path: list[tuple[int, str]] = []
    own: list[tuple[str, str]] = []
    for kind, body in parts:
        if kind == "heading":
            if own:
                yield " > ".join(t for _, t in path), own
            own = []
            m = _HEADING.match(body)
            level = len(m.group(1))
            path = [p for p in path if p[0] < level]  # levels grow along the path, so this is a pop
            path.append((level, m.group(2).strip()))
        own.append((kind, body))
    if own:
        yield " > ".join(t for _, t in path), own


@dataclass
class Piece:
    """A chunk in the making, and a finished one."""

    parts: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    pages: list[int | None] = field(default_factory=list)
    section: str = ""
    content_type: str | None = None
    table: int | None = None  # number of the table, shared by its rows
    content: str = ""
    class_name: str | None = None
    function_name: str | None = None
    owner_class: int | None = None  # number of the class, shared by its methods

    @property
    def body(self) -> str:
        return "\n\n".join(self.parts)

    def add(self, kind: str, body: str, page: int | None) -> None:
        self.parts.append(body)
        self.types.append(kind)
        self.pages.append(page)

    @property
    def words(self) -> int:
        return sum(len(p.split()) for p in self.parts)

    @property
    def only_captions(self) -> bool:
        return bool(self.parts) and all(t in ("paragraph", "overlap") and _IMAGE.fullmatch(p.strip()) for p, t in zip(self.parts, self.types, strict=True))


def pack(section: str, parts: list[tuple[str, str]], size: int, overlap: int) -> Iterator[Piece]:
    """The chunks of one section: filled to ``size`` words, the end of one repeated in the next.

    Code is never cut, and takes mere image captions before it along; a table is a
    chunk of its own, followed by one per row; a longer paragraph is cut in word windows.
    """
    page: int | None = None
    now = Piece(section=section)

    def close(piece: Piece, carry: bool) -> Piece:
        """Finishes ``piece`` and starts the next, with its last words if they are to be repeated."""
        after = Piece(section=section)
        if carry and piece.parts:
            pages = sorted({p for p in piece.pages if p is not None})
            tail = " ".join(piece.body.split()[-overlap:]) if overlap else ""
            if tail:
                after.add("overlap", tail, pages[-1] if pages else None)
        return after

    for kind, body in parts:
        units = len(body.split())
        if kind == "page_marker":
            page = int(body)
        elif kind == "heading":
            continue
        elif kind == "code":
            if now.parts and now.words + units > size and not now.only_captions:
                done, now = now, close(now, True)
                yield done
            now.add(kind, body, page)
            if now.words > size:
                done, now = now, close(now, False)
                yield done
        elif kind == "table":
            if now.parts:
                done, now = now, close(now, True)
                yield done
            now.add(kind, body, page)
            now.content_type, now.table = "table", id(now)
            done, now = now, close(now, False)
            yield done
            head, *rows = body.split("\n")
            for row in rows[1:]:
                one = Piece(section=section, content_type="table_row", table=done.table)
                one.add("table_row", "\n".join([head, rows[0], row]), page)
                yield one
        elif units > size:
            if now.parts:
                done, now = now, close(now, False)
                yield done
            own = body.split()
            for start in range(0, len(own), size - overlap):
                one = Piece(section=section)
                one.add("paragraph_fallback", " ".join(own[start : start + size]), page)
                yield one
            now = Piece(section=section)
        else:
            if now.parts and now.words + units > size:
                done, now = now, close(now, True)
                yield done
            now.add(kind, body, page)
    if now.parts:
        yield now


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Piece]:
    out = []
    for section, parts in sections(blocks(text)):
        for piece in pack(section, parts, size, overlap):
            piece.content = f"[Section: {section}]\n\n{piece.body}" if section else piece.body
            out.append(piece)
    return out


def chunk_python(source: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Piece]:
    """A chunk for each class, each of its methods and each function; what is left over as ordinary text of type module.

    Source that does not parse is chunked as text.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return chunk_text(source, size, overlap)
    out: list[Piece] = []
    rest = dict(enumerate(source.split("\n"), 1))

    def take(node: ast.AST) -> str:
        for no in range(min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), node.end_lineno + 1):
            rest.pop(no, None)
        return ast.get_source_segment(source, node) or ""

    def function(node: ast.AST, owner: str | None, number: int | None) -> Piece:
        name = f"{owner}.{node.name}" if owner else node.name
        kind = "method" if owner else "function"
        return Piece(section=name, content_type=kind, class_name=owner, function_name=node.name, owner_class=number, content=f"[{kind.capitalize()}: {name}]\n\n{take(node)}", types=[kind])

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            whole = Piece(section=node.name, content_type="class", class_name=node.name, types=["class"])
            whole.owner_class = id(whole)
            whole.content = f"[Class: {node.name}]\n\n{take(node)}"
            out.append(whole)
            out += [function(x, node.name, whole.owner_class) for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(function(node, None, None))
    left = "\n".join(rest.values())
    if left.strip():
        for piece in chunk_text(left, size, overlap):
            piece.content_type = piece.content_type or "module"
            out.append(piece)
    return out


_SCHEMA = "document_key bigint, chunk_index int, content string, section string, content_type string, block_types array<string>, table_id string, class_id string, class_name string, function_name string, page_number int, page_range string"


def _rows(size: int, overlap: int):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n.split(" ")[0]: [] for n in _SCHEMA.split(", ")}
            keys, texts, names, python = (batch.column(i).to_pylist() for i in range(4))
            for key, text, name, code in zip(keys, texts, names, python, strict=True):
                pieces = chunk_python(text, size, overlap) if code else chunk_text(text, size, overlap)
                tables = {p.table: i for i, p in reversed(list(enumerate(pieces))) if p.table is not None}
                classes = {p.owner_class: i for i, p in reversed(list(enumerate(pieces))) if p.owner_class is not None}
                for i, p in enumerate(pieces):
                    pages = sorted({x for x in p.pages if x is not None})
                    prefix = f"{name}::" + (f"page_{pages[0]}::" if pages else "")
                    row = (
                        key, i, p.content, p.section, p.content_type, p.types,
                        f"{prefix}table_{tables[p.table]}" if p.table is not None else None, f"{name}::class_{classes[p.owner_class]}" if p.owner_class is not None else None,
                        p.class_name, p.function_name, pages[0] if pages else None, f"{pages[0]}-{pages[-1]}" if len(pages) > 1 else None,
                    )
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            fields = [("document_key", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string()), ("section", pa.string()), ("content_type", pa.string()), ("block_types", pa.list_(pa.string())), *[(c, pa.string()) for c in ("table_id", "class_id", "class_name", "function_name")], ("page_number", pa.int32()), ("page_range", pa.string())]
            yield pa.RecordBatch.from_pydict(out, pa.schema(fields))

    return run


def chunk_documents(df: DataFrame, key: str, text: str, name: str, is_python: Column, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of every document, numbered from 0 in each; Python sources by their syntax tree.

    Null and empty texts give none. Raises where the overlap is not below the size.
    """
    if overlap >= size:
        raise ValueError("the overlap must be below the size")
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.coalesce(F.col(name), F.lit("document")).alias("n"), F.coalesce(is_python, F.lit(False)).alias("p"))
    return spread(rows.where("t <> ''")).mapInArrow(_rows(size, overlap), _SCHEMA)


def word_windows(df: DataFrame, key: str, text: str, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` words, a new one every ``size - overlap`` words, the last maybe mere overlap."""
    w = spread(df.select(key, text)).select(key, T.words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))
    out = w.select(key, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(size)), " "))).alias("window_no", "window"))
    return out.withColumn("words", F.size(F.split("window", " ")))


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, blank ones left out: cut behind . ! or ? and white space."""
    marked = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """The paragraphs (key, block_no from 0, block) of every text: what blank lines part, stripped. Null texts have none."""
    strip = lambda x: F.btrim(x, F.lit(" \n\t\r"))
    parts = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda x: strip(x) != "")
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.transform(parts, strip)).alias("block_no", "block"))


def continues(by: list[str], page: str, order: list[str], head: str) -> Column:
    """Whether a page's first table goes on from the page before: the next page, with the same ``head``."""
    w = Window.partitionBy(*by).orderBy(page, *order)
    return F.coalesce((F.col(page) == F.lag(page).over(w) + 1) & (F.col(head) == F.lag(head).over(w)), F.lit(False))


def sentence_windows(text: Column, target: int = CHILD, least: int = CHILD_LEAST) -> Column:
    """Whole sentences filled to ``target`` words a window; a last window under ``least`` words only if it is the only one."""
    count = lambda s: F.size(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        n = count(s)
        full = (acc["n"] > 0) & (acc["n"] + n > target)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when((acc["n"] >= least) | ((F.size(acc["done"]) == 0) & (acc["n"] > 0)), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])

    return F.aggregate(sentences(text), empty, step, finish)


def parent_child(chunks: DataFrame, by: list[str], text: str = "content") -> DataFrame:
    """Chunks as parents, and their sentence windows as children numbered on after the document's last parent.

    Classes, methods, functions, tables and rows get no children. Needs
    ``chunk_index`` and ``content_type``; adds ``chunk_role`` and ``parent_chunk_index``.
    """
    whole = F.coalesce(F.col("content_type"), F.lit("")).isin("class", "method", "function", "table", "table_row")
    last = chunks.groupBy(*by).agg((F.max("chunk_index") + 1).alias("parents"))
    kids = chunks.where(~whole).select(*by, "chunk_index", F.posexplode(sentence_windows(F.col(text))).alias("no", text))
    order = Window.partitionBy(*by).orderBy("chunk_index", "no")
    kids = kids.join(last, by).withColumn("index", F.col("parents") + F.row_number().over(order) - 1)
    parents = chunks.select(*by, "chunk_index", text, F.lit("parent").alias("chunk_role"), F.lit(None).cast("int").alias("parent_chunk_index"))
    return parents.unionByName(kids.select(*by, F.col("index").cast("int").alias("chunk_index"), text, F.lit("child").alias("chunk_role"), F.col("chunk_index").cast("int").alias("parent_chunk_index")))


def table_rows(df: DataFrame, key: list[str], table: str) -> DataFrame:
    """A row chunk for each data line of a pipe table, its header and divider before it; ``row_no`` from 0."""
    lines = df.select(*key, F.split(table, "\n").alias("l")).where(F.size("l") >= 3)
    rows = lines.select(*key, F.col("l")[0].alias("head"), F.col("l")[1].alias("rule"), F.posexplode(F.slice("l", F.lit(3), F.size("l"))).alias("row_no", "row"))
    return rows.select(*key, "row_no", F.concat_ws("\n", "head", "rule", "row").alias("content"))
