"""Pages to Markdown-like text with the standard library's parser, and the links and image markers in them."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements whose content is no text of the page, and those that have no end.
_SKIPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
IMAGE = r"\[Image: ([^\]]*)\] \(([^)]*)\)"


class _Page(HTMLParser):
    """Collects blocks in order, once for each of article, main and body."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url = url
        self.title = ""
        self.blocks: list[tuple[frozenset[str], str]] = []
        self.links: list[str] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.block: str | None = None
        self.rows: list[list[str]] | None = None

    def _emit(self, s: str) -> None:
        if s.strip():
            self.blocks.append((frozenset(self.stack), s))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append(urldefrag(urljoin(self.url, a["href"]))[0])
        if tag not in _VOID:
            self.stack.append(tag)
        if _SKIPPED & set(self.stack):
            return
        if tag == "table" and self.rows is None:
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.text = []
        elif tag == "img" and (a.get("alt") or "").strip() and a.get("src"):
            mark = f"[Image: {a['alt'].strip()}] ({urljoin(self.url, a['src'])})"
            self.text.append(mark) if self.block else self._emit(mark)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre") and self.block is None:
            self.block, self.text = tag, []
        elif tag == "title":
            self.text = []

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        hidden = bool(_SKIPPED & set(self.stack))
        body = "".join(self.text)
        if tag == "title" and not self.title:
            self.title = " ".join(body.split())
        if not hidden:
            if self.rows is not None:
                if tag in ("td", "th") and self.rows:
                    self.rows[-1].append(" ".join(body.split()).replace("|", "\\|"))
                elif tag == "table":
                    rows, self.rows = [r for r in self.rows if r], None
                    if len(rows) > 1:
                        line = lambda r: "| " + " | ".join(r) + " |"
                        self._emit("\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])]))
            elif tag == self.block:
                flat = " ".join(body.split())
                if flat:
                    if tag[0] == "h":
                        self._emit("#" * int(tag[1]) + " " + flat)
                    elif tag == "li":
                        self._emit("- " + flat)
                    elif tag == "pre":
                        self._emit("```\n" + body.strip("\n") + "\n```")
                    else:
                        self._emit(flat)
                self.block, self.text = None, []
        while self.stack and self.stack.pop() != tag:
            pass

    def handle_data(self, data):
        if not _SKIPPED & set(self.stack):
            self.text.append(data)


def read_page(url: str, html: str) -> tuple[str, str, list[str]]:
    """Title (the address if there is none), text of the article, else of main, else of the body, and links."""
    page = _Page(url)
    page.feed(html)
    page.close()
    for root in ("article", "main", None):
        own = [b for where, b in page.blocks if root is None or root in where]
        if own:
            break
    return page.title or url, "\n\n".join(own), page.links


def pages(df: DataFrame, url: str, html: str) -> DataFrame:
    """``url``, ``title``, ``content`` and ``links`` of every page. Null pages have none."""

    def run(batches):
        for batch in batches:
            got = [read_page(u, h) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.string()))], ["url", "title", "content", "links"])

    return df.select(F.col(url).alias("url"), F.col(html).alias("html")).where("url is not null and html is not null").mapInArrow(run, "url string, title string, content string, links array<string>")


def image_records(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """A record for each image marker of a text: ``image_no`` from 0, ``alt_text``, ``image_url``."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(IMAGE), F.lit(1)).alias("a"), F.regexp_extract_all(F.col(text), F.lit(IMAGE), F.lit(2)).alias("u"))
    return df.where(F.col(text).contains("[Image: ")).select(*key, F.posexplode(found).alias("image_no", "m")).select(*key, "image_no", F.col("m.a").alias("alt_text"), F.col("m.u").alias("image_url"))


def in_scope(link: Column, seed: Column) -> Column:
    """Same scheme and host, and the path the seed's or below it."""
    part = lambda u, p: F.coalesce(F.expr(f"parse_url({u}, '{p}')"), F.lit("")) if isinstance(u, str) else F.coalesce(F.parse_url(u, F.lit(p)), F.lit(""))
    prefix = F.rtrim(part(seed, "PATH"), F.lit("/"))
    path = part(link, "PATH")
    return (part(link, "PROTOCOL") == part(seed, "PROTOCOL")) & (part(link, "HOST") == part(seed, "HOST")) & ((path == prefix) | path.startswith(F.concat(prefix, F.lit("/"))))


def crawl(links: DataFrame, seeds: DataFrame, *, most: int | None = None, depth: int | None = None) -> DataFrame:
    """Pages (seed, url, depth) reached from each seed over links in its scope, breadth first.

    All of them, unless ``most`` pages a seed (the nearest, then by address) or a ``depth`` are asked for. A loop of joins over the link table
    (src, dst); each step meets only pages that were not seen, and ends when there are none. Its plan is cut by a checkpoint where a folder for
    one is configured. Null seeds and links are none.
    """
    frontier = seeds.where("seed is not null").select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth")).distinct()
    seen, step = frontier, 0
    cut = bool(seeds.sparkSession.conf.get("spark.checkpoint.dir", None))
    while depth is None or step < depth:
        step += 1
        found = frontier.join(links.select(F.col("src").alias("url"), "dst"), "url").where(in_scope(F.col("dst"), F.col("seed"))).select("seed", F.col("dst").alias("url")).distinct()
        frontier = found.join(seen, ["seed", "url"], "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(frontier)
        if cut:
            seen = seen.checkpoint()
            frontier = seen.where(F.col("depth") == step)
        if frontier.isEmpty():
            break
    if most is None:
        return seen
    place = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "url"))
    return seen.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def host(url: str) -> str:
    return urlsplit(url).netloc
