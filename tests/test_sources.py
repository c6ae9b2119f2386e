from pyspark.sql import functions as F

from quern.sources import files, html, media
from quern.streaming import sessions

PAGE = """<html><head><title>T &amp; U</title><style>x</style></head><body><nav><a href="/n">n</a></nav>
<article><h1>Head</h1><p>One <b>two</b></p><ul><li>item</li></ul><pre>code
  more</pre><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table>
<img alt="Auth flow" src="/i.png"><img src="/none.png"><a href="sub/page#frag">link</a></article><footer>f</footer></body></html>"""


def test_page_to_text():
    title, text, links = html.read_page("https://x.example/docs/", PAGE)
    assert title == "T & U"
    assert text.split("\n\n") == ["# Head", "One two", "- item", "```\ncode\n  more\n```", "| a | b\\|c |\n|---|---|\n| 1 | 2 |", "[Image: Auth flow] (https://x.example/i.png)"]
    assert links == ["https://x.example/n", "https://x.example/docs/sub/page"]
    assert html.read_page("u", "")[0] == "u"


def test_pages_and_images(spark):
    df = spark.createDataFrame([("https://x.example/docs/", PAGE), ("u", None)], "url string, html string")
    got = html.pages(df, "url", "html")
    assert got.count() == 1
    assert [tuple(r) for r in html.image_records(got, ["url"], "content").select("image_no", "alt_text", "image_url").collect()] == [(0, "Auth flow", "https://x.example/i.png")]


def test_crawl_stays_in_scope(spark):
    links = spark.createDataFrame([("https://h/a", "https://h/a/b"), ("https://h/a", "https://h/other"), ("https://h/a/b", "https://h/a/c"), ("https://h/a/b", "https://h/a"), ("https://h/a/c", "https://h/a/d")], "src string, dst string")
    got = html.crawl(links, spark.createDataFrame([("https://h/a",)], "seed string"), depth=2)
    assert sorted((r["url"], r["depth"]) for r in got.collect()) == [("https://h/a", 0), ("https://h/a/b", 1), ("https://h/a/c", 2)]


def test_crawl_goes_to_the_end_unless_it_is_bounded(spark):
    chain = [(f"https://h/a/{i}" if i else "https://h/a", f"https://h/a/{i + 1}") for i in range(5)] + [("https://h/a/5", "https://h/a"), (None, None)]
    links, seeds = spark.createDataFrame(chain, "src string, dst string"), spark.createDataFrame([("https://h/a",), (None,)], "seed string")
    deep = sorted((r["depth"], r["url"]) for r in html.crawl(links, seeds).collect())
    assert deep == [(0, "https://h/a")] + [(i, f"https://h/a/{i}") for i in range(1, 6)]
    assert sorted(r["depth"] for r in html.crawl(links, seeds, most=3).collect()) == [0, 1, 2]
    assert html.crawl(links, seeds.limit(0)).count() == 0



def test_markdown_and_lists(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# x\r\ny")
    got = files.read_markdown(spark, str(tmp_path)).first()
    assert (got["document_id"], got["content"]) == ("a.md", "# x\ny")
    assert [r["source_type"] for r in files.discover(spark, str(tmp_path)).collect()] == ["markdown"]
    lines = spark.createDataFrame([("",), ("# c",), ("crawl-js:https://a",), ("js:https://b",), ("https://c",)], "l string")
    assert [tuple(r) for r in files.url_modes(lines, "l").collect()] == [("https://a", True, True), ("https://b", False, True), ("https://c", False, False)]


def test_eval_lines_are_read_permissively(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("{bad",), ('{"question": ""}',), ('{"question": "q", "expected_document_ids": ["d"]}',)], "l string")
    got = files.eval_items(lines, "l").collect()
    assert [(r["question"], r["expected_document_ids"], r["expected_chunk_ids"]) for r in got] == [("q", ["d"], [])]


def test_repository_forms(spark):
    forms = ["https://github.example/o/n", "o/n", "https://github.example/o/n.git", "https://github.example/o/n/tree/dev/x", "[o/n](https://github.example/o/n)", "o"]
    df = spark.createDataFrame([(f,) for f in forms], "u string")
    got = [r[0] for r in df.select(files.repository(F.col("u"))).collect()]
    assert [(g["owner"], g["name"], g["branch"]) if g else None for g in got] == [("o", "n", None)] * 3 + [("o", "n", "dev/x"), ("o", "n", None), None]


def test_wanted_files(spark):
    df = spark.createDataFrame([("src/a.py", 10), ("node_modules/a.py", 10), ("a.py", 999999), ("yarn.lock", 1), ("x.bin", 1), ("Dockerfile", 5)], "p string, n int")
    assert [r[0] for r in df.where(files.wanted(F.col("p"), F.col("n"))).collect()] == ["src/a.py", "Dockerfile"]


def test_headings_and_activity(spark):
    df = spark.createDataFrame([("Title", "a"), ("Heading 9", "b"), ("Normal", "c")], "s string, t string")
    assert [r[0] for r in df.select(files.heading(F.col("s"), F.col("t"))).collect()] == ["# a", "###### b", "c"]
    assert spark.range(1).select(files.activity_text(F.lit(3), F.lit("t"), F.lit("closed"), F.lit(" "))).first()[0] == "# #3: t\nState: closed\n\n(no description provided)"


def test_windows_widen_for_long_files(spark):
    df = spark.createDataFrame([(1, 25.0), (2, 1200.0), (3, 0.0), (4, None)], "id int, d double")
    w = media.windows(df, "id", "d")
    assert [(r["start_seconds"], r["end_seconds"]) for r in w.where("id = 1").orderBy("window_no").collect()] == [(0, 10), (10, 20), (20, 25)]
    assert w.where("id = 2").count() == 60 and w.where("id > 2").count() == 0


def test_stream_sessions(spark, tmp_path):
    ev = spark.sql("select 1 as u, timestamp'2024-01-01 00:00:00' as t union all select 1, timestamp'2024-01-01 00:10:00' union all select 1, timestamp'2024-01-01 09:00:00' union all select 2, timestamp'2024-01-02 12:00:00'")
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    got = sessions.run_to_end(sessions.stream_sessions(stream, "u", "t"), "sess", str(tmp_path / "cp"))
    assert sorted((r["u"], r["events"]) for r in got.collect()) == [(1, 1), (1, 2)]
