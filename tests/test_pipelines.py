import pytest

from quern.operators.models import Models, first_sentences, hashed_vectors
from quern.plans import pipelines


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ladder_takes_each_query_first_attempt(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    a = spark.createDataFrame([(1, "a")], "query_id int, x string")
    b = spark.createDataFrame([(1, "b"), (2, "b"), (9, "b")], "query_id int, x string")
    assert rows(pipelines.ladder([a, b], q), "query_id", "x", "attempt") == [(1, "a", 0), (2, "b", 1)]


def test_corrective_retrieval(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 2)], "query_id int, chunk_id string, rank int")
    grades = spark.createDataFrame([(1, "a", "partial"), (1, "b", "correct"), (2, "c", "incorrect"), (2, "d", "correct")], "query_id int, chunk_id string, relevance string")
    again = spark.createDataFrame([(1, "z", 1), (2, "d", 1), (2, "e", 2)], "query_id int, chunk_id string, rank int")
    got = rows(pipelines.corrected(hits, grades, again), "query_id", "rank", "chunk_id", "pass")
    assert got == [(1, 1, "a", 0), (1, 2, "b", 0), (2, 1, "d", 0), (2, 2, "e", 1)]


def test_prompts_pack_context_and_the_newest_turns(spark):
    chunks = spark.createDataFrame([("a", " ".join(["w"] * 6), "f.md", "S", None), ("b", " ".join(["v"] * 6), None, "", 3)], "chunk_id string, content string, file_name string, section string, page_number int")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    q = spark.createDataFrame([(1, "why?"), (2, "no hits?")], "query_id int, text string")
    past = spark.createDataFrame([(1, 1, "old", "x y z"), (1, 2, "new", "u")], "query_id int, turn int, question string, answer string")
    got = {r["query_id"]: r["prompt"] for r in pipelines.prompts(hits, chunks, q, past, budget=10, history_budget=5).collect()}
    assert got[1] == "Conversation so far:\nQ: new\nA: u\n\nContext:\n[Source 1 — f.md, section: 'S']\n" + " ".join(["w"] * 6) + "\n\nQuestion: why?"
    assert got[2] == "Context:\n(none)\n\nQuestion: no hits?"


def test_ingest_upserts_by_key(spark):
    d = spark.createDataFrame([(1, "amy", "a.md", "markdown", "# H\n\none two three"), (2, "bob", "a.md", "odd", "four five"), (3, None, "b.md", "web", None)], "record_id long, owner string, document_id string, source_type string, content string")
    first = pipelines.ingest(d)
    assert rows(first, "key", "kb") == [("amy::a.md::chunk_0", "markdown"), ("bob::a.md::chunk_0", "markdown")]
    again = spark.createDataFrame([(9, "amy", "a.md", "markdown", "changed text")], "record_id long, owner string, document_id string, source_type string, content string")
    after = pipelines.ingest(again, first)
    assert rows(after, "key", "content") == [("amy::a.md::chunk_0", "changed text"), ("bob::a.md::chunk_0", "four five")]


def test_retrieval_searches_only_the_owner_and_the_named_base(spark):
    cols = "chunk_id int, owner string, kb string, document_id string, chunk_index int, content string, section string, file_path string, content_type string, table_id string, class_id string, file_name string, language string, function_name string, class_name string"
    base = [(1, "amy", "web", "d", 0, "alpha beta gamma"), (2, "amy", "pdf", "e", 0, "alpha beta delta"), (3, "bob", "web", "d", 0, "alpha beta gamma")]
    c = spark.createDataFrame([(*r, "", "", None, None, None, None, None, None, None) for r in base], cols)
    embed = hashed_vectors(16)
    c = embed(c.withColumnRenamed("content", "text")).withColumnsRenamed({"text": "content", "vector": "embedding"})
    q = embed(spark.createDataFrame([("amy", 7, "alpha beta in the website"), ("amy", 8, "alpha beta")], "owner string, query_id int, text string"))
    got = rows(pipelines.retrieve(c, q, models=Models(embed=embed)), "query_id", "chunk_id")
    assert got == [(7, 1), (8, 1), (8, 2)]
    assert rows(pipelines.adaptive(c, q), "query_id", "attempt")[0] == (7, 3)


@pytest.fixture(scope="module")
def repository(spark):
    """60 chunks that are nearer to every question than the two that a hint can name."""
    cols = "chunk_id int, content string, embedding array<float>, owner string, repository string, content_type string, file_path string, file_name string, language string, function_name string, class_name string"
    near = [(i, "find function alpha alpha alpha", [1.0, 0.0], "amy", "amy/r", "text", f"lib/f{i}.py", f"f{i}.py", "python", f"g{i}", None) for i in range(60)]
    far = [(90, "alpha and many other words that make this chunk long", [0.1, 1.0], "amy", "amy/r", "text", "app/store/util.py", "util.py", "python", "load_all", None), (91, "gamma", [0.0, 1.0], "amy", "amy/r", "text", "app/web/view.js", "view.js", "javascript", None, "ViewBase")]
    other = [(95, "alpha", [1.0, 0.0], "bob", "bob/r", "text", "app/store/util.py", "util.py", "python", "load_all", None)]
    return spark.createDataFrame(near + far + other, cols)


def questions(spark, *texts):
    return spark.createDataFrame([("amy", i, t, [1.0, 0.0]) for i, t in enumerate(texts)], "owner string, query_id int, text string, vector array<float>")


def test_hints_find_chunks_below_the_pool(spark, repository):
    q = questions(spark, "how does alpha work in util.py", "find function load_all alpha", "explain alpha in app/store/ please", "explain f3.py in lib/ please", "explain f3.py in app/store/ please")
    got = rows(pipelines.adaptive(repository, q), "query_id", "chunk_id", "attempt")
    assert [r for r in got if r[0] < 4] == [(0, 90, 1), (1, 90, 2), (2, 90, 1), (3, 3, 1)]
    assert all(r[2] != 1 for r in got if r[0] == 4) and len(got) > 4


def test_rungs_before_the_hybrid_search(spark, repository):
    q = questions(spark, "who calls load_all", "who calls alpha", "explain alpha", "find function alpha", "explain alpha in nothere.py please", "find function nothere_x alpha", "alpha")
    tried = lambda df: {r["query_id"]: r["attempt"] for r in df.collect()}
    assert tried(pipelines.adaptive(repository, q)) == {0: 3, 1: 3, 2: 5, 3: 6, 4: 5, 5: 6, 6: 3}
    lexical = questions(spark, "who calls load_all, alpha")
    assert rows(pipelines.adaptive(repository, lexical), "chunk_id", "attempt") == [(90, 2)]


def test_structural_questions_walk_the_graph(spark, repository):
    q = questions(spark, "who calls load_all, alpha", "who calls no_symbol, alpha").selectExpr("*", "'amy/r' repository")
    edges = [("amy", "amy/r", "function:app/store/util.py::load_all", "external:x"), ("amy", "amy/r", "method:app/web/view.js::ViewBase.show", "external:util.load_all"), ("bob", "amy/r", "function:lib/f1.py::g1", "external:load_all"), ("amy", "amy/q", "function:lib/f2.py::g2", "external:load_all")]
    e = spark.createDataFrame([(*r, "calls") for r in edges], "owner string, repository string, src string, dst string, kind string")
    got = rows(pipelines.adaptive(repository, q, e), "query_id", "rank", "chunk_id", "attempt")
    assert [r for r in got if r[0] == 0] == [(0, 1, 90, 4), (0, 2, 91, 4)]
    assert {r[3] for r in got if r[0] == 1} == {3}


def test_stand_ins(spark):
    df = spark.createDataFrame([("One. Two.",), (None,), ("...",)], "text string")
    assert [r["vector"] is None for r in hashed_vectors(8)(df).collect()] == [False, True, True]
    assert first_sentences(df).first()["answer"] == "One."
