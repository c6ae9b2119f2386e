"""Code graphs: built from Python sources, searched by symbol, walked along typed edges."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases that ask for an edge kind and a direction.
DIRECTIONS = {
    "who calls": ("calls", "in"), "what calls": ("calls", "in"), "callers of": ("calls", "in"), "callers": ("calls", "in"), "used by": ("calls", "in"), "who uses": ("calls", "in"),
    "what does": ("calls", "out"), "calls to": ("calls", "out"), "calls from": ("calls", "out"), "callees of": ("calls", "out"), "dependencies of": ("calls", "out"), "depends on": ("calls", "out"),
    "who imports": ("imports", "in"), "importers of": ("imports", "in"), "imports of": ("imports", "out"), "what does it import": ("imports", "out"), "what imports": ("imports", "in"),
    "subclasses of": ("inherits", "in"), "who extends": ("inherits", "in"), "who inherits": ("inherits", "in"),
    "extends": ("inherits", "out"), "inherits from": ("inherits", "out"), "base classes of": ("inherits", "out"), "parent class of": ("inherits", "out"),
}


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a name or attribute, or None."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None


def edges_of(path: str, source: str) -> list[tuple[str, str, str]]:
    """(source node, target node, kind) of one file; nothing if it does not parse. Parallel edges stay."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    file = f"file:{path}"
    out: list[tuple[str, str, str]] = []

    def calls(node: ast.AST, own: str) -> None:
        out.extend((own, f"external:{name}", "calls") for x in ast.walk(node) if isinstance(x, ast.Call) and (name := dotted(x.func)))

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.extend((file, f"external:{a.name}", "imports") for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            out.extend((file, f"external:{node.module + '.' if node.module else ''}{a.name}", "imports") for a in node.names)
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            own = f"class:{path}::{node.name}"
            out.append((file, own, "contains"))
            out.extend((own, f"external:{name}", "inherits") for b in node.bases if (name := dotted(b)))
            for x in node.body:
                if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                    method = f"method:{path}::{node.name}.{x.name}"
                    out.append((own, method, "contains"))
                    calls(x, method)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            own = f"function:{path}::{node.name}"
            out.append((file, own, "contains"))
            calls(node, own)
    return out


def build_edges(files: DataFrame, repository: str, path: str, source: str) -> DataFrame:
    """Edges (repository, src, dst, kind) of all files. Null paths or sources give none."""

    def run(batches):
        for batch in batches:
            rows = [(r, *e) for r, p, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for e in edges_of(p, s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["repository", "src", "dst", "kind"])

    return files.select(repository, path, source).where(F.col(path).isNotNull() & F.col(source).isNotNull()).mapInArrow(run, "repository string, src string, dst string, kind string")


def nodes(edges: DataFrame) -> DataFrame:
    """The nodes of the edges: ``id``, ``kind`` and ``name``."""
    ids = edges.select("repository", F.explode(F.array("src", "dst")).alias("id")).distinct()
    name = F.element_at(F.split("id", "::|:"), -1)
    return ids.select("repository", "id", F.substring_index("id", ":", 1).alias("kind"), name.alias("name"))


def seeds(nodes_: DataFrame, symbols: DataFrame, symbol: str) -> DataFrame:
    """Nodes whose name is a symbol, or ends with it behind a dot, whatever the case; own nodes before external ones.

    An equi-join on the last part of the dotted name finds the candidates.
    """
    last = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    a = nodes_.withColumn("part", last(F.col("name")))
    b = symbols.select(F.col(symbol).alias("symbol")).distinct().withColumn("part", last(F.col("symbol")))
    low, name = F.lower("symbol"), F.lower("name")
    hit = a.join(b, "part").where((name == low) | name.endswith(F.concat(F.lit("."), low))).drop("part")
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("repository", "symbol").orderBy(F.col("kind") == "external", "id")))


def directions(question):
    """The (kind, direction) pairs that a question's phrases ask for, longest phrase first, without repeats; calls both ways if none."""
    found = F.array_compact(F.array(*[F.when(F.lower(question).contains(p), F.lit(":".join(DIRECTIONS[p]))) for p in sorted(DIRECTIONS, key=lambda p: -len(p))]))
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit("calls:in"), F.lit("calls:out")))


def hop(edges: DataFrame, starts: DataFrame, start: str, kind: str, direction: str) -> DataFrame:
    """(start, node): the distinct neighbours of each start along one kind of edge, one step, with the start itself."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    s = starts.select(F.col(start).alias("start")).distinct()
    step = edges.where(F.col("kind") == kind).select(F.col(near).alias("start"), F.col(far).alias("node")).join(s, "start")
    return step.unionByName(s.select("start", F.col("start").alias("node"))).distinct()


def chunks_of(nodes_: DataFrame, chunks: DataFrame, document: list[str]) -> DataFrame:
    """All chunks of the documents that the nodes stand in, each once."""
    return chunks.join(nodes_.select(*document).distinct(), document, "left_semi")


def save(edges: DataFrame, path: str) -> None:
    """Edges (owner, repository, src, dst, kind) as Parquet by owner and repository: one repository is replaced without touching the others."""
    edges.repartition("owner", "repository").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner", "repository").parquet(path)


def load(spark: SparkSession, path: str, owner: str, repository: str) -> DataFrame | None:
    """The stored edges of one repository, or None where there are none or they cannot be read, so that the caller falls back."""
    try:
        found = spark.read.parquet(path).where((F.col("owner") == owner) & (F.col("repository") == repository))
        return None if found.isEmpty() else found
    except AnalysisException:
        return None
