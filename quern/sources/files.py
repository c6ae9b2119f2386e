"""Files to documents: Markdown, address lists, evaluation items, repositories and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What of a repository is read.
EXCLUDED_DIRS = ["node_modules", ".git", "dist", "build", "vendor", "venv", ".venv", "env", "__pycache__", "target", ".idea", ".vscode", "coverage", ".next", ".pytest_cache", "bin", "obj", "out", ".mypy_cache", ".tox", "egg-info"]
EXCLUDED_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "Gemfile.lock", "composer.lock"]
LANGUAGES = {".md": "markdown", ".markdown": "markdown", ".rst": "text", ".txt": "text", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".rs": "rust", ".kt": "kotlin", ".swift": "swift", ".sh": "shell", ".sql": "sql"}
FILE_LANGUAGES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "README": "text", "LICENSE": "text"}
MOST_FILES, MOST_BYTES = 300, 200_000
EXTENSIONS = {".md": "markdown", ".pdf": "pdf", ".docx": "docx", ".mp3": "audio", ".wav": "audio", ".m4a": "audio", ".mp4": "video", ".mov": "video"}


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One document a file, line ends as "\\n": ``document_id`` (the file's name), ``file_path``, ``content``."""
    raw = spark.read.text(path, wholetext=True).select("*", "_metadata.file_path", "_metadata.file_name")
    return raw.select(F.col("file_name").alias("document_id"), "file_path", F.lit("markdown").alias("source_type"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("content"))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """The files below a directory of a known kind: ``path``, ``length``, ``source_type``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("source_type", lookup(suffix(F.col("path")), EXTENSIONS)).where("source_type is not null")


def lookup(value: Column, table: dict[str, str]) -> Column:
    """The value's entry in a small fixed table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path with its dot, or null."""
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1)), F.lit(""))


def language_of(path: Column) -> Column:
    """The language of a file by its name or suffix, or null."""
    return F.coalesce(lookup(file_name(path), FILE_LANGUAGES), lookup(suffix(path), LANGUAGES))


def wanted(path: Column, size: Column) -> Column:
    """Whether a repository's file is read: of a known language, not too large, outside what is generated."""
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))
    return ~inside & ~file_name(path).isin(EXCLUDED_FILES) & (size <= MOST_BYTES) & language_of(path).isNotNull()


def repository_scan(files: DataFrame, path: str, size: str, by: list[str], *, tie: str | None = None, most: int = MOST_FILES) -> DataFrame:
    """The files of each repository that are read: the wanted ones, the first ``most`` in the order of their paths (then ``tie``), with ``language``."""
    kept = files.where(wanted(F.col(path), F.col(size))).withColumn("language", language_of(F.col(path)))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*[c for c in (path, tie) if c]))).where(F.col("_n") <= most).drop("_n")


def commit_path(question: Column) -> Column:
    """The first word of a question that looks like a file's path or name, or null: what its history is asked of."""
    return F.nullif(F.regexp_extract(question, r"([\w./-]*\w\.[A-Za-z]{1,8})\b", 1), F.lit(""))


def commit_text(sha: Column, author: Column, at: Column, message: Column) -> Column:
    """A commit as text: its short digest, who made it and when, and its message."""
    return F.concat(F.lit("Commit "), F.substring(sha, 1, 7), F.lit(" by "), F.coalesce(author, F.lit("unknown")), F.lit(" on "), F.coalesce(at.cast("string"), F.lit("unknown date")), F.lit("\n\n"), F.coalesce(message, F.lit("")))


def history(commits: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """The latest commits (query_id, rank, sha, content) of each question's repository, of the file it names if it names one.

    ``commits`` (repository, sha, author, at, message, paths), ``queries`` (query_id, repository, text). Hits have no similarity.
    """
    asked = queries.select("query_id", "repository", commit_path(F.col("text")).alias("path"))
    met = commits.join(asked, "repository").where(F.col("path").isNull() | F.exists("paths", lambda p: p.endswith(F.col("path"))))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("at"), "sha")
    hits = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "sha", commit_text(F.col("sha"), F.col("author"), F.col("at"), F.col("message")).alias("content"))


def topics(nodes: DataFrame, *, most_levels: int = 64) -> DataFrame:
    """A contents tree (tree, node, parent, position, topic, label) flattened depth first: (tree, place from 0, topic, label) of the nodes with a topic.

    One join a level; the order is that of the path of positions. Raises where ``most_levels`` do not reach the leaves, as with a cycle.
    """
    level = nodes.where("parent is null").withColumn("path", F.array("position"))
    done = level
    for _ in range(most_levels):
        above = level.select("tree", F.col("node").alias("parent"), F.col("path").alias("above"))
        level = nodes.join(above, ["tree", "parent"]).withColumn("path", F.concat("above", F.array("position"))).select(done.columns)
        if level.isEmpty():
            break
        done = done.unionByName(level)
    else:
        raise ValueError(f"a tree is deeper than {most_levels} levels")
    w = Window.partitionBy("tree").orderBy("path", "node")
    return done.where("topic is not null").select("tree", (F.row_number().over(w) - 1).alias("place"), "topic", "label")


def url_modes(lines: DataFrame, line: str) -> DataFrame:
    """Addresses of a list with how they are fetched: (url, crawl, browser). Blank lines and comments are skipped."""
    t = F.trim(F.col(line))
    rows = lines.select(t.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    crawl, browser = F.col("t").rlike("^crawl(-js)?:"), F.col("t").rlike("^(crawl-)?js:")
    return rows.select(F.trim(F.regexp_replace("t", "^(crawl-js|crawl|js):", "")).alias("url"), crawl.alias("crawl"), browser.alias("browser"))


_ITEM = "question string, kb string, expected_answer string, expected_document_ids array<string>, expected_chunk_ids array<string>, notes string"


def eval_items(lines: DataFrame, line: str) -> DataFrame:
    """Evaluation items of JSON lines; blank lines, comments, what cannot be read and items without a question are skipped; missing lists are empty."""
    t = F.trim(F.col(line))
    read = lines.where((t != "") & ~t.startswith("#")).select(F.from_json(t, _ITEM).alias("j")).select("j.*").where("trim(question) <> ''")
    return read.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("expected_document_ids", "expected_chunk_ids")})


def repository(url: Column) -> Column:
    """Owner, name and branch of a repository's address in any of its forms; null where it has no owner and name."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^\[[^\]]*\]\(([^)]*)\)$", "$1"), r"^(?:https?://)?(?:www\.)?[\w.-]+\.[a-z]+/", "")
    owner, name = F.regexp_extract(bare, r"^([\w.-]+)/([\w.-]+?)(?:\.git)?/?(?:/tree/(.+?))?/?$", 1), F.regexp_extract(bare, r"^([\w.-]+)/([\w.-]+?)(?:\.git)?/?(?:/tree/(.+?))?/?$", 2)
    branch = F.nullif(F.regexp_extract(bare, r"^([\w.-]+)/([\w.-]+?)(?:\.git)?/?(?:/tree/(.+?))?/?$", 3), F.lit(""))
    return F.when((owner != "") & (name != ""), F.struct(owner.alias("owner"), name.alias("name"), branch.alias("branch")))


def activity_text(number: Column, title: Column, state: Column, body: Column) -> Column:
    """An issue, pull request or discussion as text."""
    return F.concat(F.lit("# #"), number.cast("string"), F.lit(": "), F.coalesce(title, F.lit("")), F.lit("\nState: "), F.coalesce(state, F.lit("open")), F.lit("\n\n"), F.coalesce(F.nullif(F.trim(body), F.lit("")), F.lit("(no description provided)")))


def heading(style: Column, text: Column) -> Column:
    """A paragraph of a word processor by its style: titles and headings get hashes, at most six."""
    number = F.regexp_extract(style, r"^Heading (\d+)$", 1).try_cast("int")
    level = F.when(style == "Title", 1).when(number.isNotNull(), F.least(number, F.lit(6)))
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)
