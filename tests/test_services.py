"""The kept index, decisions, listings, deletes, histories and reports, on fixtures."""

import json

import pytest

from quern.operators import evaluation, graph, listing, maintenance, postings, ranking, routing
from quern.plans import pipelines
from quern.sources import files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


DOCS = [("a", 1, "alpha beta beta"), ("a", 2, "alpha"), ("b", 3, "beta gamma gamma"), ("b", 4, ""), ("b", 5, None)]


def test_kept_index_finds_what_bm25_finds_and_follows_the_version(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "owner string, id int, text string")
    q = spark.createDataFrame([(1, "beta alpha"), (2, "gamma"), (3, "nothing")], "q int, ask string")
    path, version = tmp_path.as_uri() + "/index", postings.version_of(docs, ["id", "text"])
    for scope, where in (([], "true"), (["owner"], "true"), ([], "owner = 'b'")):
        ix = postings.kept(docs, "id", "text", path, version, ["owner"], scope=scope, where=where)
        cols = [*scope, "q", "id", "score", "rank"]
        want = ranking.bm25(docs.where(where), "id", "text", q, "q", "ask", scope=scope)
        assert rows(postings.search(ix, q, "q", "ask"), *cols) == rows(want, *cols)
        assert rows(postings.search(postings.build(docs.where(where), "id", "text", scope=scope), q, "q", "ask"), *cols) == rows(want, *cols)
    more = docs.unionByName(spark.createDataFrame([("a", 9, "beta")], docs.schema))
    later = postings.version_of(more, ["id", "text"])
    assert later != version
    ix = postings.kept(more, "id", "text", path, later, ["owner"])
    assert 9 in {r["id"] for r in postings.search(ix, q, "q", "ask").collect()}
    assert [p.name for p in (tmp_path / "index").iterdir()] == [later]  # the older version is gone
    postings.invalidate(spark, path)
    assert not (tmp_path / "index").exists()


def test_no_document_vector_is_shuffled(spark):
    """One owner with half of all rows, and questions in several blocks: documents meet broadcast questions."""
    docs = spark.createDataFrame([("hot" if i % 2 else f"o{i}", i, [float(i % 7), 1.0]) for i in range(60)], "owner string, id int, v array<float>")
    q = spark.createDataFrame([("hot", i, [1.0, float(i)]) for i in range(9)], "owner string, q int, qv array<float>")
    got = ranking.dense(docs, "id", "v", q, "q", "qv", scope=["owner"], k=3, block=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not [x for x in plan.split("\n") if "hashpartitioning(owner" in x and "dv" in x]
    assert rows(got, "q", "id", "rank") == rows(ranking.dense(docs, "id", "v", q, "q", "qv", scope=["owner"], k=3), "q", "id", "rank") and got.count() == 27


def test_route_decision(spark):
    q = spark.createDataFrame([(1, "show the function of parse"), (2, "tell me"), (3, None)], "q int, text string")
    score = lambda *r: spark.createDataFrame(list(r), "q int, label string, score double")
    got = routing.decide(q, "q", "text", score((2, "image", 0.5), (1, "table", 0.3)), score((2, "web", 1.0), (2, "docx", 0.3), (2, "pdf", 0.8)))
    assert rows(got, "q", "routes", "bases", "method") == [(1, ["code", "general"], [], "rule"), (2, ["general", "image"], ["pdf", "web"], "semantic"), (3, ["general"], [], "neither")]


def test_one_intent_a_question(spark):
    q = spark.createDataFrame([(1, "who calls this, and the recent commit"), (2, "plain")], "query_id int, text string")
    s = spark.createDataFrame([(1, "structural", 0.9), (1, "visual", 1.0), (2, "visual", 0.5), (2, "activity", 0.3)], "query_id int, label string, score double")
    assert rows(pipelines.intents(q), "query_id", "intent") == [(1, "history")]
    assert rows(pipelines.intents(q, s), "query_id", "intent") == [(1, "structural"), (2, "visual")]


def test_hybrid_lists(spark):
    cols = "chunk_id int, owner string, kb string, document_id string, chunk_index int, content string, chunk_role string, parent_chunk_index int, embedding array<float>"
    c = spark.createDataFrame(
        [(1, "amy", "web", "d", 0, "parent text", "parent", None, [0.0, 1.0]), (2, "amy", "web", "d", 1, "child", "child", 0, [1.0, 0.0]), (3, "amy", "web", "e", 0, "draft words", None, None, [0.5, 0.5]), (4, "bob", "web", "d", 0, "parent text", "parent", None, [1.0, 0.0])], cols
    )
    q = spark.createDataFrame([("amy", 1, "zebra", [1.0, 0.0])], "owner string, query_id int, text string, vector array<float>")
    assert rows(pipelines.parent_hits(c, q, ["owner"]), "query_id", "chunk_id", "rank") == [(1, 1, 1)]
    other = lambda text: spark.createDataFrame([("amy", 1, text, [1.0, 0.0])], q.schema)
    plain = {r["chunk_id"]: r["rrf"] for r in pipelines.hybrid(c, q, ["owner"]).collect()}
    same = {r["chunk_id"]: r["rrf"] for r in pipelines.hybrid(c, q, ["owner"], variants=[other("ZEBRA")], drafts=other("too short")).collect()}
    more = {r["chunk_id"]: r["rrf"] for r in pipelines.hybrid(c, q, ["owner"], variants=[other("draft")], drafts=other("a drafted answer"), keywords=other("words"), parents=True).collect()}
    assert same == plain and set(plain) == {1, 2, 3}
    assert more[3] > plain[3] + 3 / 63 and more[1] > plain[1] + 1 / 62


def test_deletes_reach_every_table_of_the_owner(spark):
    chunks = spark.createDataFrame([("amy", "d", 1), ("amy", "d", 2), ("amy", "e", 3), ("bob", "d", 4), (None, "d", 5)], "owner string, document_id string, id int")
    images = spark.createDataFrame([("amy", "d", None, 1), ("amy", None, "d", 2), ("bob", "d", None, 3), ("amy", "x", "y", 4)], "owner string, page_url string, video_document_id string, id int")
    clips = spark.createDataFrame([("amy", "d", 1), ("amy", "e", 2)], "owner string, document_id string, id int")
    gone = spark.createDataFrame([("amy", "d"), ("amy", "d"), ("amy", "none")], "owner string, document_id string")
    left, removed = maintenance.delete_documents({"chunks": chunks, "images": images, "clips": clips}, gone)
    assert [rows(left[t], "id") for t in ("chunks", "images", "clips")] == [[(3,), (4,), (5,)], [(3,), (4,)], [(2,)]]
    assert rows(removed, "owner", "document_id", "removed") == [("amy", "d", 2)]
    repos = spark.createDataFrame([("amy", "r", "github", 1), ("amy", "r", "web", 2), ("bob", "r", "github", 3)], "owner string, repository string, kb string, id int")
    rest, n = maintenance.delete_repositories(repos, repos.where("owner = 'amy'"))
    assert rows(rest, "id") == [(2,), (3,)] and rows(n, "repository", "removed") == [("r", 1)]


def test_lookups_and_tables(spark):
    c = spark.createDataFrame([("amy", "d", "web", 2, "x"), ("amy", "d", "pdf", 9, "y"), ("bob", "d", "web", 1, "z")], "owner string, document_id string, kb string, i int, content string")
    asked = spark.createDataFrame([("amy", "d"), ("amy", "q")], "owner string, document_id string")
    assert rows(listing.first_chunks(c, asked, ["kb", "i"]), "owner", "content") == [("amy", "y")]
    t = spark.createDataFrame([(1, 2, "b|c"), (1, 1, None)], "g int, o int, v string")
    assert listing.markdown_tables(t, ["g"], ["o"], {"v": t["v"]}).first()["markdown"] == "| v |\n| --- |\n|  |\n| b\\|c |"
    pages = spark.createDataFrame([("https://A.test/Docs", "x"), (None, None), ("u", "docs.md")], "url string, file_name string")
    assert listing.inspect(pages, "DOCS").count() == 2 and listing.inspect(pages).count() == 3


def test_history_and_contents(spark):
    commits = spark.createDataFrame([("r", "aaaaaaaa1", "amy", "2024-01-02", "fix", ["src/a.py"]), ("r", "bbbbbbbb2", None, "2024-01-03", None, ["b.py"]), ("s", "c", "x", None, "m", [])], "repository string, sha string, author string, at string, message string, paths array<string>")
    q = spark.createDataFrame([(1, "r", "who changed a.py last"), (2, "r", "what changed"), (3, "none", "x")], "query_id int, repository string, text string")
    got = rows(files.history(commits, q, k=1), "query_id", "rank", "sha", "content")
    assert got == [(1, 1, "aaaaaaaa1", "Commit aaaaaaa by amy on 2024-01-02\n\nfix"), (2, 1, "bbbbbbbb2", "Commit bbbbbbb by unknown on 2024-01-03\n\n")]
    tree = spark.createDataFrame([("t", "root", None, 0, "T0", "Root"), ("t", "b", "root", 1, None, "group"), ("t", "a", "root", 0, "Ta", "A"), ("t", "c", "b", 0, "Tc", "C")], "tree string, node string, parent string, position int, topic string, label string")
    assert rows(files.topics(tree), "place", "topic") == [(0, "T0"), (1, "Ta"), (2, "Tc")]
    with pytest.raises(ValueError):
        files.topics(tree, most_levels=1)
    many = spark.createDataFrame([("r", f"f{i:03d}.py", 10) for i in range(5)] + [("r", "x.bin", 1)], "r string, path string, size int")
    assert files.repository_scan(many, "path", "size", ["r"], most=3).count() == 3


def test_graph_is_stored_by_repository(spark, tmp_path):
    e = spark.createDataFrame([("amy", "r", "a", "b", "calls"), ("amy", "s", "c", "d", "calls")], "owner string, repository string, src string, dst string, kind string")
    path = tmp_path.as_uri() + "/graph"
    assert graph.load(spark, path, "amy", "r") is None
    graph.save(e, path)
    graph.save(e.where("repository = 'r'").replace("b", "z"), path)
    assert rows(graph.load(spark, path, "amy", "r"), "src", "dst") == [("a", "z")] and rows(graph.load(spark, path, "amy", "s"), "src", "dst") == [("c", "d")]
    assert graph.load(spark, path, "bob", "r") is None


def test_runs_and_reports_keep_every_row(spark, tmp_path):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"]), (4, ["d"])], "item_id int, expected_document_ids array<string>")
    hits = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (3, "c", 1)], "item_id int, document_id string, rank int")
    results = spark.createDataFrame([(1, "yes", None), (3, None, "boom")], "item_id int, answer string, error string")
    got = {r["item_id"]: (r["hit_rate"], r["recall"], r["error"]) for r in evaluation.evaluation_run(items, hits, results).collect()}
    assert got == {1: (1.0, 0.5, None), 2: (None, None, "no answer"), 3: (None, None, "boom"), 4: (None, None, "no answer")}
    runs = spark.range(1500).selectExpr("concat('Run ', id) run_id", "cast(null as double) m")
    assert evaluation.report_markdown(runs, "R").count("\n") == 1504
    evaluation.write_report(runs, str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out" / "json").glob("part*") for x in f.read_text().splitlines()]
    assert len(lines) == 1500 and json.loads(lines[0])["run_id"].startswith("Run")
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "out" / "markdown").glob("part*")) == 1500
