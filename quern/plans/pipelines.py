"""Whole pipelines over batches of questions: every step is keyed by ``query_id``, so a batch runs as one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking, graph, maintenance, postings, ranking, routing
from quern.operators.models import Models

#: Candidates of each arm, of the fused list that is scored jointly, and of an answer.
POOL, SCORED, TOP = 40, 20, 5


def ladder(attempts: list[DataFrame], queries: DataFrame, key: str = "query_id") -> DataFrame:
    """The rows of each query's first attempt that has any, with the attempt's number.

    What a loop would test for emptiness, query by query, is the least number
    among a query's rows: every attempt is evaluated once, however many there are.
    """
    asked = queries.select(key).distinct()
    rows = reduce(DataFrame.unionByName, [attempt.join(asked, key, "left_semi").withColumn("attempt", F.lit(i)) for i, attempt in enumerate(attempts)])
    return rows.withColumn("_first", F.min("attempt").over(Window.partitionBy(key))).where("attempt = _first").drop("_first")


#: Children that are searched for their parents, and the bases whose chunks have children.
CHILD_POOL, CHILD_BASES = 60, ["github", "web"]
#: Least characters of a drafted answer that is searched with.
DRAFT_LEAST = 10


def parent_hits(chunks: DataFrame, queries: DataFrame, scope: list[str], *, k: int = CHILD_POOL) -> DataFrame:
    """(scope, query_id, chunk_id, rank): the parents of the ``k`` most similar children of each query, best child first. Only some bases have children."""
    own = chunks.where(F.col("kb").isin(CHILD_BASES))
    kids = own.where("chunk_role = 'child'")
    cols = [c for c in dict.fromkeys([*scope, "owner", "document_id"])]
    hits = ranking.dense(kids, "chunk_id", "embedding", queries, "query_id", "vector", scope=scope, k=k)
    placed = hits.select("query_id", "chunk_id", "rank").join(kids.select("chunk_id", *cols, "parent_chunk_index"), "chunk_id")
    parents = own.where("chunk_role = 'parent'").groupBy(*cols, "chunk_index").agg(F.max("chunk_id").alias("chunk_id"))
    keys = [c for c in cols if c != "document_id"]
    return ranking.parents_of(placed.drop("chunk_id"), parents, [*keys, "query_id"], ["document_id"], k).select(*scope, "query_id", "chunk_id", "rank")


def hybrid(chunks: DataFrame, queries: DataFrame, scope: list[str], *, k: int = SCORED, variants: list[DataFrame] | None = None, drafts: DataFrame | None = None, keywords: DataFrame | None = None, parents: bool = False, index: postings.Index | None = None) -> DataFrame:
    """Candidates of each query in its scope, fused: (scope, query_id, chunk_id, rrf, similarity, position).

    The lists, in this order: similarity and terms of the question, and of each of its ``variants`` whose text differs (whatever the case);
    similarity of drafted answers, ``drafts``, of some length; terms of ``keywords``; with ``parents`` the parents of similar
    children. All of these are tables like ``queries``, (scope, query_id, text, vector). ``index`` is a kept lexical index of the chunks in this scope.
    """
    near = lambda q: ranking.dense(chunks, "chunk_id", "embedding", q, "query_id", "vector", scope=scope, k=POOL)
    told = lambda q: postings.search(index, q, "query_id", "text", k=POOL) if index else ranking.bm25(chunks, "chunk_id", "content", q, "query_id", "text", scope=scope, k=POOL)
    dense = near(queries)
    lists = [dense, told(queries)]
    original = queries.select("query_id", F.lower("text").alias("_text"))
    for v in variants or []:
        other = v.join(original, "query_id").where(F.lower("text") != F.col("_text")).drop("_text")
        lists += [near(other), told(other)]
    if drafts is not None:
        lists.append(near(drafts.where(F.length("text") > DRAFT_LEAST)))
    if keywords is not None:
        lists.append(told(keywords))
    if parents:
        lists.append(parent_hits(chunks, queries, scope))
    fused = ranking.fuse(lists, [*scope, "query_id"], ["chunk_id"]).where(F.col("position") <= k)
    return fused.join(dense.select(*scope, "query_id", "chunk_id", "similarity"), [*scope, "query_id", "chunk_id"], "left").select(*scope, "query_id", "chunk_id", "rrf", "similarity", "position")


def targets(queries: DataFrame, populated: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """The bases that each query searches: those it names, those its similarity scores keep, else all that its owner has."""
    named = queries.select("owner", "query_id", F.explode(routing.labels(F.col("text"), routing.BASES)).alias("kb"))
    if scores is not None:
        named = named.unionByName(routing.margin(scores, ["query_id"], "kb", "score").join(queries.select("owner", "query_id"), "query_id").select("owner", "query_id", "kb")).distinct()
    rest = queries.select("owner", "query_id").join(named, ["owner", "query_id"], "left_anti").join(populated.select("owner", "kb").distinct(), "owner")
    return named.unionByName(rest.select("owner", "query_id", "kb"))


def retrieve(chunks: DataFrame, queries: DataFrame, *, models: Models | None = None, k: int = TOP) -> DataFrame:
    """The answer's chunks of each query (owner, query_id, text, vector): (query_id, chunk_id, score, rank).

    Hybrid candidates in each target base, scored jointly by the model, which
    chooses ``k`` a base; then all bases together, first occurrence of a chunk's
    place winning, by similarity and title; then parts are replaced by their wholes.
    """
    models = models or Models()
    where = targets(queries, chunks)
    asked = queries.join(where, ["owner", "query_id"])
    found = hybrid(chunks, asked, ["owner", "kb"], parents="chunk_role" in chunks.columns)
    full = found.join(chunks.select("chunk_id", "document_id", "chunk_index", "section", "file_path", "content_type", "table_id", "class_id", F.col("content").alias("text")), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    joint = models.score(full)
    best = ranking.top(joint, ["kb", "query_id"], "score", ["position", "chunk_id"], k, "base_rank")
    once = ranking.first_wins(best, ["query_id", "document_id", "chunk_index"], ["kb", "base_rank"])
    titled = once.withColumn("final", F.round(ranking.title_score(F.col("query"), F.col("similarity"), F.col("section"), F.col("file_path")), 6))
    hits = ranking.top(titled, ["query_id"], "final", ["kb", "base_rank", "chunk_id"], k).select("owner", "query_id", "rank", F.col("chunk_id").alias("id"), "content_type", "table_id", "class_id", F.col("final").alias("similarity"))
    for part, whole, link in (("table_row", "table", "table_id"), ("method", "class", "class_id")):
        tied = hits.withColumn("link", F.concat("owner", F.lit("::"), link))
        wholes = chunks.where(F.col("content_type") == whole).select(F.col("chunk_id").alias("id"), F.concat("owner", F.lit("::"), link).alias("link")).where("link is not null")
        done = ranking.complete(tied, wholes, ["query_id"], [part], "link").select("query_id", "rank", "id", "similarity")
        hits = done.join(chunks.select(F.col("chunk_id").alias("id"), "owner", "content_type", "table_id", "class_id"), "id")
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    return hits.select("query_id", F.col("id").alias("chunk_id"), F.col("similarity").alias("score"), F.row_number().over(w).alias("rank"))


def hinted(chunks: DataFrame, queries: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, chunk_id): the chunks of its owner that fit all hints of a query (owner, query_id, hints) in ``fields``; a query without such hints has none.

    Hints and chunks meet by an equi-join on owner, field and value. A symbol is the name of a function or class, a directory that of the file's path.
    """
    wanted = F.map_filter("hints", lambda f, _: f.isin(fields))
    asked = queries.select("owner", "query_id", F.size(wanted).alias("n"), F.explode(wanted).alias("field", "value"))
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    values = {"file_name": ["file_name"], "file_dir": [folder], "language": ["language"], "symbol_name": ["function_name", "class_name"]}
    held = F.array_distinct(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(c) if isinstance(c, str) else c).alias("value")) for f in fields for c in values[f]]))
    held = chunks.select("owner", "chunk_id", F.inline(held)).where("value is not null")
    return held.join(asked, ["owner", "field", "value"]).groupBy("query_id", "chunk_id", "n").agg(F.count("*").alias("fit")).where("fit = n").select("query_id", "chunk_id")


def related(chunks: DataFrame, queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the chunks of the files around the symbol that a query (owner, repository, query_id, text, hints) names.

    From the nodes of that name one step along the kinds of ``edges`` (owner, repository, src, dst, kind) that the question asks
    for; a node stands for its file, whose path is the chunks' ``file_path``. External nodes have no file.
    """
    base = F.concat_ws("\n", "owner", "repository").alias("repository")
    e = edges.where("owner is not null and repository is not null").select(base, "src", "dst", "kind")
    asked = queries.where("owner is not null and repository is not null").select("query_id", base, F.col("hints")["symbol_name"].alias("symbol"), F.explode(graph.directions(F.col("text"))).alias("way")).where("symbol is not null")
    starts = asked.join(graph.seeds(graph.nodes(e), asked, "symbol").select("repository", "symbol", "id"), ["repository", "symbol"])
    steps = [e.select("repository", F.col(near).alias("id"), F.col(far).alias("node"), F.concat("kind", F.lit(f":{way}")).alias("way")) for near, far, way in (("src", "dst", "out"), ("dst", "src", "in"))]
    reached = starts.join(steps[0].unionByName(steps[1]), ["repository", "id", "way"]).select("query_id", "repository", "node")
    nodes = reached.unionByName(starts.select("query_id", "repository", F.col("id").alias("node")))
    files = nodes.select("query_id", "repository", F.regexp_extract("node", r"^(?:file|class|function|method):(.*?)(?:::.*)?$", 1).alias("file_path")).where("file_path != ''").distinct()
    return chunks.where("owner is not null and repository is not null").select("chunk_id", base, "file_path").join(files, ["repository", "file_path"]).select("query_id", "chunk_id")


#: Numbers of the attempts, in the order in which they are made: activity, dense with hints, graph, lexical with hints, lexical, dense, hybrid.
ATTEMPTS = [0, 1, 4, 2, 6, 5, 3]


def intents(queries: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(query_id, intent): the one intent of each query, by rule and, with ``scores`` (query_id, label, score), by similarity; queries without one have no row."""
    ruled = queries.select("query_id", F.explode(routing.labels(F.col("text"), routing.INTENTS)).alias("label"), F.lit(True).alias("ruled"))
    if scores is None:
        rated = ruled.withColumn("score", F.lit(0.0))
    else:
        rated = ruled.join(scores, ["query_id", "label"], "full").select("query_id", "label", F.coalesce("ruled", F.lit(False)).alias("ruled"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return routing.intent(rated, ["query_id"], "label", "score", "ruled").select("query_id", "intent")


def adaptive(chunks: DataFrame, queries: DataFrame, edges: DataFrame | None = None, *, scores: DataFrame | None = None, index: postings.Index | None = None, k: int = TOP) -> DataFrame:
    """Chunks by the one intent of each question: its own strategy first, then what that falls back on.

    Activity is searched among issues and requests; explanations and places among what
    the hints name; structure along the graph and then lexically with the symbol; exact code lexically with
    the hints, all hints holding at once and the best taken among the chunks that fit them. Exact code and explanations then
    do without the hints; the rest, and questions without an intent, fall back
    on the hybrid search. The graph needs ``edges`` and a column ``repository`` of the questions. (query_id, chunk_id, rank, attempt), attempts as in ``ATTEMPTS``.
    """
    known = queries.join(intents(queries, scores), "query_id").withColumn("hints", T.metadata_hints(F.col("text")))
    is_ = lambda *names: known.where(F.col("intent").isin(*names))
    scope = ["owner"]
    dense = lambda c, q, only=None: ranking.dense(c, "chunk_id", "embedding", q, "query_id", "vector", scope=scope, only=only, k=POOL)
    told = index or postings.build(chunks, "chunk_id", "content", scope=scope)
    lexical = lambda q, only=None: postings.search(told, q, "query_id", "text", only=only, k=POOL)
    placed, structural = is_("explanation", "navigational"), is_("structural")
    named = hinted(chunks, structural, ["symbol_name"]).unionByName(hinted(chunks, is_("exact_code"), ["language", "symbol_name"]))
    around = structural.select("query_id").where("false").withColumn("chunk_id", F.lit(None)).withColumn("rank", F.lit(0))
    if edges is not None and "repository" in queries.columns:
        near = related(chunks, structural, edges)
        # chunks without a vector come last
        rated = near.join(dense(chunks, structural, near).select("query_id", "chunk_id", "similarity"), ["query_id", "chunk_id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(-2.0)))
        around = ranking.top(rated, ["query_id"], "similarity", ["chunk_id"], POOL)
    first = [
        dense(chunks.where(F.col("content_type").isin("issue", "pull_request", "discussion")), is_("activity")),
        dense(chunks, placed, hinted(chunks, placed, ["file_name", "file_dir", "language"])),
        around,
        lexical(is_("exact_code", "structural"), named),
        lexical(is_("exact_code")),
        dense(chunks, is_("explanation")),
    ]
    lists = [x.select("query_id", "chunk_id", "rank") for x in first]
    lists.append(hybrid(chunks, queries, scope, index=told).select("query_id", "chunk_id", F.col("position").alias("rank")))
    found = ladder(lists, queries).withColumn("attempt", F.get(F.array(*[F.lit(n) for n in ATTEMPTS]), "attempt"))
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "attempt")


def corrected(hits: DataFrame, grades: DataFrame, again: DataFrame, *, least: int = 2, k: int = TOP) -> DataFrame:
    """Hits that were graded of use; where fewer than ``least`` are left, with those of a second retrieval behind them.

    ``hits`` and ``again`` (query_id, chunk_id, rank), ``grades`` (query_id, chunk_id, relevance). A hit without a grade is kept.
    """
    graded = hits.join(grades, ["query_id", "chunk_id"], "left").where("coalesce(relevance, 'correct') in ('correct', 'partial')").select("query_id", "chunk_id", "rank", F.lit(0).alias("pass"))
    enough = graded.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
    more = again.join(enough, "query_id", "left_anti").select("query_id", "chunk_id", "rank", F.lit(1).alias("pass"))
    once = ranking.first_wins(graded.unionByName(more), ["query_id", "chunk_id"], ["pass", "rank"])
    w = Window.partitionBy("query_id").orderBy("pass", "rank", "chunk_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "pass")


def prompts(hits: DataFrame, chunks: DataFrame, queries: DataFrame, history: DataFrame | None = None, *, budget: int = 3000, history_budget: int = 800) -> DataFrame:
    """The prompt of each query: labelled sources to a budget of words, the last turns to another, the question.

    ``history`` (query_id, turn, question, answer); its newest turns are kept and shown oldest first.
    """
    full = hits.join(chunks.select("chunk_id", "content", "file_name", "section", "page_number"), "chunk_id").withColumn("n", T.word_count(F.col("content")))
    kept = ranking.pack_budget(full, ["query_id"], ["rank", "chunk_id"], "n", budget)
    label = F.concat(T.source_label(F.col("rank"), F.col("file_name"), F.col("page_number"), F.col("section")), F.lit("\n"), "content")
    joined = lambda df, order, body: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, body.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
    out = queries.select("query_id", F.col("text").alias("question")).join(joined(kept, "rank", label).withColumnRenamed("text", "context"), "query_id", "left")
    if history is not None:
        block = F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.lit("\nA: "), F.coalesce("answer", F.lit("")))
        turns = history.withColumn("b", block).withColumn("n", T.word_count(F.col("b"))).withColumn("back", -F.col("turn"))
        recent = ranking.pack_budget(turns, ["query_id"], ["back"], "n", history_budget)
        out = out.join(joined(recent, "turn", F.col("b")).withColumnRenamed("text", "turns"), "query_id", "left")
    else:
        out = out.withColumn("turns", F.lit(None).cast("string"))
    return out.select("query_id", F.concat_ws("\n\n", F.when(F.col("turns").isNotNull(), F.concat(F.lit("Conversation so far:\n"), "turns")), F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("(none)"))), F.concat(F.lit("Question: "), "question")).alias("prompt"))


def ingest(documents: DataFrame, stored: DataFrame | None = None, *, models: Models | None = None) -> DataFrame:
    """Documents (record_id, owner, document_id, source_type, content) to keyed, embedded chunks; into the stored ones, if given, by upsert."""
    models = models or Models()
    python = (F.col("source_type") == "code") & F.col("document_id").endswith(".py")
    pieces = chunking.chunk_documents(documents, "record_id", "content", "document_id", python).withColumnRenamed("document_key", "record_id")
    meta = documents.select("record_id", "owner", "document_id", "source_type")
    rows = pieces.join(meta, "record_id").withColumnRenamed("content", "text")
    made = models.embed(rows).withColumnsRenamed({"text": "content", "vector": "embedding"})
    keyed = made.withColumn("kb", maintenance.base_of(F.col("source_type"))).withColumn("key", maintenance.row_key(F.col("owner"), F.col("document_id"), F.col("page_number"), F.col("chunk_index")))
    if stored is None:
        return ranking.keep_last(keyed, ["key"], ["record_id"])
    return maintenance.upsert(stored, keyed, ["key"], ["record_id"])
