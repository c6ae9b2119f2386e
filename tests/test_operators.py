import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import chunking, evaluation, filters, graph, maintenance, ranking, replies, routing, state


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


DOCS = [(1, "revenue revenue revenue quarterly report"), (2, "revenue mentioned once here"), (3, "unrelated content about weather"), (4, None), (5, "")]


def bm25(docs, query):
    """A plain fold of the same formula."""
    toks = {k: [w for w in __import__("re").findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1] for k, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    vocab = {w for t in toks.values() for w in t}
    df = {w: sum(w in t for t in toks.values()) for w in vocab}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for k, t in toks.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split() if w in t)
        if any(w in t for w in query.split()):
            out[k] = round(s, 6)
    return out


def test_bm25_against_a_fold(spark):
    d = spark.createDataFrame(DOCS, "id int, text string")
    q = spark.createDataFrame([(7, "revenue report revenue")], "q int, asked string")
    got = {r["id"]: r["score"] for r in ranking.bm25(d, "id", "text", q, "q", "asked").collect()}
    assert got == pytest.approx(bm25(DOCS, "revenue report revenue"), abs=2e-6)
    assert 3 not in got and ranking.bm25(d, "id", "text", q, "q", "asked", k=1).first()["id"] == 1


def test_bm25_scopes_do_not_leak(spark):
    d = spark.createDataFrame([("a", 1, "alpha beta"), ("b", 2, "alpha gamma"), ("b", 3, "gamma gamma")], "owner string, id int, text string")
    q = spark.createDataFrame([("a", 1, "alpha gamma")], "owner string, q int, asked string")
    assert rows(ranking.bm25(d, "id", "text", q, "q", "asked", scope=["owner"]), "owner", "id") == [("a", 1)]


def test_bm25_empty(spark):
    d = spark.createDataFrame([], "id int, text string")
    q = spark.createDataFrame([(1, "x y")], "q int, asked string")
    assert ranking.bm25(d, "id", "text", q, "q", "asked").count() == 0


def test_dense_ties_nulls_and_zero(spark):
    d = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "id int, v array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q int, w array<float>")
    got = [(r["id"], r["similarity"]) for r in ranking.dense(d, "id", "v", q, "q", "w", k=3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 1.0), (5, 0.0)]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "top", 1), (1, "f1", 2), (1, "both", 3)], "q int, id string, rank int")
    b = spark.createDataFrame([(1, "f2", 1), (1, "f1", 2), (1, "both", 3)], "q int, id string, rank int")
    got = [(r["id"], round(r["rrf"], 6)) for r in ranking.fuse([a, b], ["q"], ["id"]).orderBy("position").collect()]
    assert got == [("f1", 0.032258), ("both", 0.031746), ("top", 0.016393), ("f2", 0.016393)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=6, unique=True), st.lists(st.integers(0, 6), min_size=1, max_size=6, unique=True))
def test_fusion_scores_do_not_depend_on_the_lists_order(spark, x, y):
    make = lambda ids: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "q int, id int, rank int")
    assert rows(ranking.fuse([make(x), make(y)], ["q"], ["id"]), "id", "rrf") == rows(ranking.fuse([make(y), make(x)], ["q"], ["id"]), "id", "rrf")


def test_first_wins_keeps_rows_without_identity(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), (None, 1, 3), (None, 1, 4)], "doc string, idx int, pos int")
    assert rows(ranking.first_wins(df, ["doc", "idx"], ["pos"]), "pos") == [(1,), (3,), (4,)]


def test_completion(spark):
    hits = spark.createDataFrame([(1, 1, 11, "table_row", "t", 0.9), (1, 2, 12, "table_row", "t", 0.8), (1, 3, 13, "table_row", "gone", 0.7), (1, 4, 14, None, None, 0.6)], "q int, rank int, id int, content_type string, link string, similarity double")
    wholes = spark.createDataFrame([(99, "t")], "id int, link string")
    got = rows(ranking.complete(hits, wholes, ["q"], ["table_row"], "link"), "rank", "id", "completed")
    assert got == [(1, 99, True), (3, 13, False), (4, 14, False)]


def test_packing_keeps_the_first_and_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5000), (1, 2, 1), (2, 1, 6), (2, 2, 6), (2, 3, 1)], "q int, pos int, n int")
    assert rows(ranking.pack_budget(df, ["q"], ["pos"], "n", 10), "q", "pos") == [(1, 1), (2, 1)]


def test_where_grammar(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 3)], "owner string, kb string, n int")
    ids = lambda w: [r["n"] for r in filters.where(df, w).orderBy("n").collect()]
    assert ids(None) == [1, 2, 3]
    assert ids({"$and": [{"owner": "a"}, {"kb": {"$in": ["x", "z"]}}]}) == [1]
    assert ids({"$or": [{"kb": "y"}, {"n": 2}]}) == [2, 3]
    assert ids({"kb": {"$gt": "a"}}) == [] and ids({"missing": 1}) == [] and ids({"kb": {"$in": []}}) == []


def test_where_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "owner string, n int").write.parquet(str(tmp_path / "t"))
    plan = filters.where(spark.read.parquet(str(tmp_path / "t")), filters.scope("a"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(owner,a)" in plan


def test_top_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert "WindowGroupLimit" in ranking.top(df, ["g"], F.desc("id"), ["id"], 2)._jdf.queryExecution().executedPlan().toString()


def test_metrics(spark):
    got = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "a", 2), (2, "a", 3)], "item int, id string, rank int")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z")], "item int, id string")
    m = {r["item"]: r for r in evaluation.retrieval_metrics(got, want, "item", "id", k=10).collect()}
    assert (m[1]["mrr"], m[1]["ndcg"], m[1]["precision"], m[1]["recall"]) == (0.5, 0.693426, 0.666667, 1.0)
    assert m[2]["ndcg"] == 2.13093 and m[3]["hit_rate"] == 0.0 and m[3]["recall"] == 0.0


def test_verdicts(spark):
    v = spark.createDataFrame([(1, "correct"), (1, "correct"), (1, "correct"), (1, "incorrect"), (1, "incorrect"), (2, "partial"), (2, "incorrect"), (3, "incorrect")], "q int, g string")
    assert rows(evaluation.verdict(v, ["q"], "g"), "q", "overall") == [(1, "correct"), (2, "ambiguous"), (3, "incorrect")]


def test_verdict_replies(spark):
    good = '```json\n{"chunks": [{"index": 1, "relevance": "PARTIAL"}, {"index": 1, "relevance": "incorrect"}, {"index": 9, "relevance": "incorrect"}, {"index": "x"}]}\n```'
    df = spark.createDataFrame([(1, good, 2), (2, "no json", 1), (3, None, 0)], "q int, raw string, n int")
    assert rows(replies.verdicts(df, "q", "raw", "n"), "q", "index", "relevance") == [(1, 0, "correct"), (1, 1, "partial"), (2, 0, "correct")]


def test_variants_and_critique(spark):
    raw = '{"rewrite": "Q ", "is_complex": true, "sub_queries": ["a", "b", "c", "d", "e"], "paraphrases": ["A", "p", "r"]}'
    df = spark.createDataFrame([("q", raw)], "q string, raw string")
    assert df.select(replies.variants(F.col("q"), F.col("raw")).alias("v")).first()["v"] == ["q", "a", "b", "c", "d", "p"]
    bad = spark.createDataFrame([("oops",)], "raw string").select(replies.critique(F.col("raw")).alias("c")).first()["c"]
    assert (bad["faithfulness"], bad["least"], bad["low"]) == (0.5, 0.5, False)


def test_blocks_and_chunks():
    text = "intro\n\n# A\n\npara\n\n---\n\n| h | k |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n```\ncode\n\nmore\n```\n\n## B\nlast"
    kinds = [k for k, _ in chunking.blocks(text)]
    assert kinds == ["paragraph", "heading", "paragraph", "table", "code", "heading", "paragraph"]
    pieces = chunking.chunk_text(text, 50, 5)
    assert [p.content_type for p in pieces].count("table_row") == 2
    assert pieces[-1].section == "A > B" and pieces[0].section == ""
    assert {p.table for p in pieces if p.table} == {next(p.table for p in pieces if p.content_type == "table")}


def test_open_fence_runs_to_the_end_and_long_paragraphs_are_cut():
    assert [k for k, _ in chunking.blocks("```\na\n\nb")] == ["code"]
    pieces = chunking.chunk_text(" ".join(map(str, range(25))), 10, 2)
    assert [len(p.parts[0].split()) for p in pieces] == [10, 10, 9, 1]


def test_python_chunks():
    pieces = chunking.chunk_python("import os\n\nclass Foo:\n    def __init__(self):\n        pass\n    def bar(self):\n        pass\n\ndef free():\n    pass\n")
    assert [(p.content_type, p.section) for p in pieces[:4]] == [("class", "Foo"), ("method", "Foo.__init__"), ("method", "Foo.bar"), ("function", "free")]
    assert pieces[4].content_type == "module" and len({p.owner_class for p in pieces[:3]}) == 1
    assert chunking.chunk_python("def broken(:")[0].content_type is None


def test_chunk_documents_edges(spark):
    df = spark.createDataFrame([(1, "a b c", "x.md"), (2, None, "y.md"), (3, "", None)], "id long, t string, n string")
    assert rows(chunking.chunk_documents(df, "id", "t", "n", F.lit(False)), "document_key", "chunk_index") == [(1, 0)]
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, "id", "t", "n", F.lit(False), size=5, overlap=5)


@pytest.mark.parametrize(("text", "expect"), [("", []), ("Yes.", ["Yes."]), (" ".join(["w"] * 200) + ".", [200]), (" ".join([" ".join(["w"] * 31) + "."] * 5), [31] * 5)])
def test_sentence_windows(spark, text, expect):
    got = spark.createDataFrame([(text,)], "t string").select(chunking.sentence_windows(F.col("t")).alias("w")).first()["w"]
    assert got == expect or [len(x.split()) for x in got] == expect


def test_word_windows_cover_all_words(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(301))), (2, None)], "id int, t string")
    got = chunking.word_windows(df, "id", "t").orderBy("window_no").collect()
    assert [r["words"] for r in got] == [150, 150, 61] and {w for r in got for w in r["window"].split()} == {f"w{i}" for i in range(301)}


def test_parent_child(spark):
    df = spark.createDataFrame([("d", 0, "A b c d e. F g h i j.", None), ("d", 1, "class X", "class")], "doc string, chunk_index int, content string, content_type string")
    got = rows(chunking.parent_child(df, ["doc"]), "chunk_index", "chunk_role", F.coalesce("parent_chunk_index", F.lit(-1)))
    assert got == [(0, "parent", -1), (1, "parent", -1), (2, "child", 0)]


def test_graph(spark):
    f = spark.createDataFrame([("r", "a.py", "import os\nclass A(Base):\n    def m(self):\n        os.path.join(1)\n        os.path.join(2)\n"), ("r", "bad.py", "def ("), ("r", None, "x")], "repo string, path string, src string")
    e = graph.build_edges(f, "repo", "path", "src")
    assert e.where("kind = 'calls'").count() == 2 and e.where("kind = 'inherits'").first()["dst"] == "external:Base"
    n = graph.nodes(e)
    s = spark.createDataFrame([("JOIN",)], "symbol string")
    assert [r["id"] for r in graph.seeds(n, s, "symbol").collect()] == ["external:os.path.join"]
    start = spark.createDataFrame([("external:os.path.join",)], "id string")
    assert graph.hop(e, start, "id", "calls", "in").count() == 2
    q = spark.createDataFrame([("who extends Foo",), ("Router",)], "q string")
    assert [r[0] for r in q.select(graph.directions(F.col("q"))).collect()] == [["inherits:in", "inherits:out"], ["calls:in", "calls:out"]]


def test_routing(spark):
    q = spark.createDataFrame([("show me the function definition",), ("what values are in this table?",), (None,)], "q string")
    assert [r[0] for r in q.select(routing.labels(F.col("q"), routing.ROUTES)).collect()] == [["code"], ["table"], []]
    s = spark.createDataFrame([(1, "web", 1.0), (1, "docx", 0.3), (2, "web", 1.0), (2, "github", 0.85), (3, "pdf", 0.1)], "q int, kb string, score double")
    assert rows(routing.margin(s, ["q"], "kb", "score"), "q", "kb") == [(1, "web"), (2, "github"), (2, "web")]
    i = spark.createDataFrame([(1, "activity", 0.5, True), (1, "history", 0.49, True), (1, "visual", 0.9, False), (2, "visual", 0.5, False), (2, "history", 0.3, False)], "q int, intent string, score double, ruled boolean")
    assert rows(routing.intent(i, ["q"], "intent", "score", "ruled"), "q", "intent") == [(1, "history"), (2, "visual")]


def test_cache(spark):
    e = spark.createDataFrame([(1, 1, "a", None, [1.0, 0.0], ["x", "y"]), (2, 2, "a", None, [1.0, 0.0], ["x"]), (3, 3, "b", None, [1.0, 0.0], ["x"]), (4, 9, "a", None, [0.0, 1.0], ["x"])], "entry_id int, seq int, owner string, kb string, vector array<double>, members array<string>")
    ask = spark.createDataFrame([(10, 8, "a", None, [1.0, 0.1], ["x"])], "ask_id int, seq int, owner string, kb string, vector array<double>, members array<string>")
    assert rows(state.cache_lookup(e, ask, ["owner", "kb"]), "ask_id", "entry_id") == [(10, 1)]
    assert rows(state.cache_kept(e, ["owner"], ["seq"], size=2), "entry_id") == [(2,), (3,), (4,)]


def test_sessions_end_after_more_than_the_gap(spark):
    df = spark.sql("select 1 as u, timestamp'2024-01-01 00:00:00' as t union all select 1, timestamp'2024-01-01 00:30:00' union all select 1, timestamp'2024-01-01 01:00:01' union all select 1, null")
    assert rows(state.sessions(df, "u", "t"), "session_no", "events") == [(1, 2), (2, 1)]
    gone = state.abandoned(df.unionByName(spark.sql("select 2 as u, cast(null as timestamp) as t")), "u", "t")
    assert rows(gone, "u") == [(2,)]


def test_settings_and_log(spark):
    df = spark.createDataFrame([(1, {"a": "9"}), (2, None)], "id int, s map<string,string>")
    assert [dict(r[0]) for r in df.orderBy("id").select(state.settings(F.col("s"), {"a": "1", "b": "2"})).collect()] == [{"b": "2", "a": "9"}, {"a": "1", "b": "2"}]
    log = spark.createDataFrame([("k", 1, "add"), ("k", 2, "remove"), ("m", 1, "add")], "k string, at int, op string")
    assert rows(state.last_operation(log, ["k"], ["at"], "op", ["remove"]), "k") == [("m",)]


def test_upsert_delete_and_owner(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, at int, v string")
    assert rows(maintenance.upsert(old, new, ["k"], ["at"]), "k", "v") == [("a", "z"), ("b", "y")]
    assert rows(maintenance.without(old, new, ["k"]), "k") == [("b",)]
    d = spark.createDataFrame([("1", None), ("2", "bob")], "k string, owner string")
    first = maintenance.adopt(d, "owner", "k", "amy")
    assert rows(first, "k", "owner") == [("2", "bob"), ("amy::1", "amy")]
    assert rows(maintenance.adopt(first, "owner", "k", "amy"), "k", "owner") == rows(first, "k", "owner")


def test_tenants_with_the_same_ids_stay_apart(spark):
    c = spark.createDataFrame([("alice", 1, [1.0, 0.0], "alpha one"), ("bob", 1, [1.0, 0.0], "alpha two")], "owner string, id int, v array<float>, t string")
    q = spark.createDataFrame([("alice", 5, [1.0, 0.0], "alpha")], "owner string, q int, w array<float>, asked string")
    assert rows(ranking.dense(c, "id", "v", q, "q", "w", scope=["owner"]), "owner", "id") == [("alice", 1)]
    assert ranking.bm25(c, "id", "t", q, "q", "asked", scope=["owner"]).where("owner <> 'alice'").count() == 0
