"""The catalogue: a query for each operator over the supplied tables, with the SQL that says the same where SQL can.

Every query runs over its whole tables. Floats are rounded in both languages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import chunking, evaluation, filters, graph, listing, maintenance, postings, ranking, replies, routing, state
from quern.plans import pipelines
from quern.session import shared_folder, spread, table
from quern.sources import files, html, media

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---- text

_STOP = _quoted(T.STOPWORDS)
_LEX = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 1)"
_SEARCH = f"list_sort(list_distinct(list_filter({_LEX}, lambda w: w NOT IN ({_STOP}))))"
_WS = r"case when trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')) = '' then [] else string_split(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), ' ') end"


@query(f"SELECT doc_id, CAST(len({_LEX.format('text')}) AS BIGINT) AS tokens FROM documents")
def tokenize_counts(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.when(F.col("text").isNotNull(), F.size(T.lexical_tokens(F.col("text"))).cast("bigint")).alias("tokens"))


@query(f"SELECT chunk_id, array_to_string({_SEARCH.format('content')}, ' ') AS tokens FROM chunks")
def search_tokens(spark, sf):
    return spread(table(spark, sf, "chunks").select("chunk_id", "content")).select("chunk_id", F.array_join(T.search_tokens(F.col("content")), " ").alias("tokens"))


@query(f"SELECT record_id, CAST(len({_WS.format('content')}) AS BIGINT) AS words FROM loaded_documents")
def unit_counts(spark, sf):
    return table(spark, sf, "loaded_documents").select("record_id", T.word_count(F.col("content")).cast("bigint").alias("words"))


@query("SELECT chunk_id, substring(sha256(substring(coalesce(content, ''), 1, 500)), 1, 16) AS h FROM chunks")
def chunk_identity(spark, sf):
    return table(spark, sf, "chunks").select("chunk_id", T.content_hash(F.col("content")).alias("h"))


@query("SELECT entry_id, sha256(coalesce(question, '') || '::' || coalesce(kb, '')) AS cache_key FROM cache_entries")
def cache_keys(spark, sf):
    return table(spark, sf, "cache_entries").select("entry_id", T.digest(F.col("question"), F.col("kb")).alias("cache_key"))


@query("SELECT chunk_id, substring(sha1(owner || '::' || document_id), 1, 16) || '_' || CAST(CAST(floor(chunk_index * 10.5 * 1000) AS BIGINT) AS VARCHAR) || '.jpg' AS name FROM chunks")
def media_names(spark, sf):
    return table(spark, sf, "chunks").select("chunk_id", T.media_name(F.col("owner"), F.col("document_id"), F.col("chunk_index") * 10.5).alias("name"))


@query(
    """SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS label
    FROM (SELECT event_id, CAST(floor(abs(value) * 60) AS BIGINT) AS s FROM events)"""
)
def timestamp_label(spark, sf):
    return table(spark, sf, "events").select("event_id", T.timestamp_label(F.abs("value") * 60).alias("label"))


@query("SELECT item_id, regexp_replace(regexp_replace(lower(question), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM eval_items")
def report_slugs(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", T.slug(F.col("question")).alias("slug"))


_CODE = " + ".join(f"CAST(coalesce(regexp_matches(content, '{p}'), false) AS INT)" for p in T.CODE_FORMS)


@query(f"SELECT record_id, {_CODE} >= {T.CODE_LEAST} AS code FROM loaded_documents")
def code_like_text(spark, sf):
    return table(spark, sf, "loaded_documents").select("record_id", T.looks_like_code(F.col("content")).alias("code"))


_QWORDS = "regexp_extract_all(lower(question), '[a-z0-9'']+')"


@query(
    f"""SELECT entry_id, coalesce(prior AND (len(list_intersect({_QWORDS}, [{_quoted(T.REFERENCE_WORDS)}])) > 0
      OR {' OR '.join(f"starts_with(trim(lower(question)), '{o}')" for o in T.CONTINUATIONS)} OR len({_QWORDS}) <= {T.STANDALONE_WORDS}), false) AS dependent
    FROM (SELECT entry_id, question, row_number() OVER (PARTITION BY owner ORDER BY seq, entry_id) > 1 AS prior FROM cache_entries)"""
)
def context_dependent(spark, sf):
    w = Window.partitionBy("owner").orderBy("seq", "entry_id")
    e = table(spark, sf, "cache_entries").withColumn("prior", F.row_number().over(w) > 1)
    return e.select("entry_id", T.context_dependent(F.col("question"), F.col("prior")).alias("dependent"))


@query(
    f"""SELECT entry_id, coalesce(len({_QWORDS}) > {T.SIMPLE_WORDS} OR length(question) > {T.SIMPLE_CHARS} OR len(list_intersect({_QWORDS}, [{_quoted(T.COMPLEX_WORDS)}])) > 0
      OR length(question) - length(replace(question, '?', '')) > 1, false) AS complex FROM cache_entries"""
)
def query_complexity(spark, sf):
    return table(spark, sf, "cache_entries").select("entry_id", T.complex_question(F.col("question")).alias("complex"))


_IDENT = f"list_filter(regexp_extract_all({{0}}, '\\b([A-Za-z][A-Za-z0-9_]{{{{3,}}}})\\b', 1), lambda w: (contains(w, '_') OR length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2) AND w NOT IN ({_quoted(T.NO_IDENTIFIERS)}))[1]"


@query(f"SELECT entry_id, {_IDENT.format('question')} AS symbol FROM cache_entries")
def identifiers(spark, sf):
    return table(spark, sf, "cache_entries").select("entry_id", T.identifier(F.col("question")).alias("symbol"))


_TEXT = "coalesce(file_path, '') || ' of a ' || coalesce(language, '') || ' file'"
_LANG = "CASE " + " ".join(f"WHEN contains(lower(t), '{p}') THEN '{lang}'" for p, lang in T.LANGUAGE_PHRASES.items()) + " END"


@query(
    f"""SELECT chunk_id, CASE WHEN p = '' THEN NULL ELSE string_split(p, '/')[-1] END AS file_name, nullif(regexp_extract(t, '{T.DIR_FORM}', 1), '') AS file_dir, {_LANG} AS language
    FROM (SELECT chunk_id, t, regexp_extract(t, '{T.PATH_FORM}', 1) AS p FROM (SELECT chunk_id, {_TEXT} AS t FROM chunks))"""
)
def metadata_hints(spark, sf):
    t = F.concat(F.coalesce("file_path", F.lit("")), F.lit(" of a "), F.coalesce("language", F.lit("")), F.lit(" file"))
    m = table(spark, sf, "chunks").select("chunk_id", T.metadata_hints(t).alias("m"))
    return m.select("chunk_id", *[F.col("m")[c].alias(c) for c in ("file_name", "file_dir", "language")])


@query("SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(trim(n_name), '|', '\\|') || ' | ' || CAST(n_nationkey AS VARCHAR) || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def md_table(spark, sf):
    return listing.markdown_tables(table(spark, sf, "nation"), ["n_regionkey"], ["n_nationkey"], {"name": F.col("n_name"), "key": F.col("n_nationkey")})


@query(
    """SELECT chunk_id, CASE WHEN a = '' THEN b WHEN b = '' THEN a ELSE '[OCR text]' || chr(10) || a || chr(10) || chr(10) || '[Vision description]' || chr(10) || b END AS reading
    FROM (SELECT chunk_id, trim(coalesce(section, '')) AS a, trim(coalesce(function_name, '')) AS b FROM chunks)"""
)
def combined_readings(spark, sf):
    return table(spark, sf, "chunks").select("chunk_id", T.combine_readings(F.col("section"), F.col("function_name")).alias("reading"))


@query(
    """SELECT chunk_id, '[Source ' || CAST(chunk_index AS VARCHAR) || CASE WHEN parts = '' THEN '' ELSE ' — ' || parts END || ']' AS label
    FROM (SELECT chunk_id, chunk_index, concat_ws(', ', nullif(file_name, ''), CASE WHEN page_number IS NOT NULL THEN 'page ' || CAST(page_number AS VARCHAR) WHEN coalesce(section, '') <> '' THEN 'section: ''' || section || '''' END) AS parts FROM chunks)"""
)
def source_labels(spark, sf):
    return table(spark, sf, "chunks").select("chunk_id", T.source_label(F.col("chunk_index"), F.col("file_name"), F.col("page_number"), F.col("section")).alias("label"))


# ---- filters and tenants


@query("SELECT chunk_id FROM chunks WHERE kb = 'web' AND (content_type IN ('table', 'table_row') OR language = 'en')")
def where_grammar(spark, sf):
    w = {"$and": [{"kb": "web"}, {"$or": [{"content_type": {"$in": ["table", "table_row"]}}, {"language": "en"}]}]}
    return filters.where(table(spark, sf, "chunks"), w).select("chunk_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('F') AND l_quantity = 10")
def where_lineitem(spark, sf):
    return filters.where(table(spark, sf, "lineitem"), {"$and": [{"l_returnflag": "R"}, {"l_linestatus": {"$in": ["F"]}}, {"l_quantity": 10}]}).select("l_orderkey", "l_linenumber")


@query("SELECT owner, count(*) AS n FROM chunks WHERE content_type IN ('table', 'class') AND owner = (SELECT min(owner) FROM chunks) GROUP BY owner")
def tenant_scope(spark, sf):
    c = table(spark, sf, "chunks")
    owner = c.agg(F.min("owner").alias("o")).first()["o"]
    return filters.where(c, filters.scope(owner or "", content_types=["table", "class"])).groupBy("owner").agg(F.count("*").alias("n"))


# ---- lexical retrieval


def _bm25_sql(docs: str, key: str, text: str, asked: str, query_key: str, k: int, scope: str = "") -> str:
    """``docs`` and ``asked`` are FROM clauses; ``scope`` a comma-separated list of the index's partition columns, with a trailing comma."""
    s = scope
    on = [c.strip() for c in s.split(",") if c.strip()]
    using = lambda *c: f"USING ({', '.join([*on, *c])})"
    cross = (lambda t: f"JOIN {t} {using()}") if on else (lambda t: f"CROSS JOIN {t}")
    group = f"GROUP BY {', '.join(on)}" if on else ""
    return f"""WITH d AS (SELECT {s} {key} AS k, {_LEX.format(text)} AS t FROM {docs}), tot AS (SELECT {s} count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM d {group}),
    tf AS (SELECT {s} k, dl, term, count(*) AS tf FROM (SELECT {s} k, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT {s} term, count(*) AS df FROM tf GROUP BY ALL),
    i0 AS (SELECT {s} term, ln(n - df + 0.5) - ln(df + 0.5) AS idf, avgdl FROM df {cross('tot')}), fl AS (SELECT {s} 0.25 * avg(idf) AS f FROM i0 {group}),
    i AS (SELECT {s} term, CASE WHEN idf < 0 THEN f ELSE idf END AS idf, avgdl FROM i0 {cross('fl')}),
    q AS (SELECT {query_key}, term, count(*) AS qtf FROM (SELECT {query_key}, unnest({_LEX.format('asked')}) AS term FROM {asked}) GROUP BY ALL),
    sc AS (SELECT {s} {query_key}, k, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN i {using('term')} JOIN q USING (term) GROUP BY ALL)
    SELECT {s} {query_key}, k AS {key}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {s} {query_key} ORDER BY score DESC, k) AS rank FROM sc) WHERE rank <= {k}"""


_INDEXED = {"documents": ("doc_id", "text", "arrived_at", ["lang"]), "chunks": ("chunk_id", "content", "ingested_at", ["owner", "kb"])}


def _index(spark: SparkSession, sf: str, name: str, scope: list[str] | None = None, where: str = "true") -> postings.Index:
    """The lexical index of a table: kept in the shared folder for as long as the table stays as it is, without one built for this query."""
    key, text, written, columns = _INDEXED[name]
    docs, folder = table(spark, sf, name), shared_folder(spark)
    if folder is None:
        return postings.build(docs.where(where), key, text, scope=scope)
    place = hashlib.sha256(f"{sf}|{name}".encode()).hexdigest()[:16]
    return postings.kept(docs, key, text, f"{folder}/quern-index/{place}", postings.version_of(docs, [key, written]), columns, scope=scope, where=where)


_ONE = "slow compact registry of the snapshot"


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, _ONE)], "query_id int, asked string")


@query(_bm25_sql("documents", "doc_id", "text", f"(SELECT 1 AS query_id, '{_ONE}' AS asked)", "query_id", 10))
def bm25_topk(spark, sf):
    return postings.search(_index(spark, sf, "documents"), _one(spark), "query_id", "asked", k=10)


@query(_bm25_sql("(SELECT * FROM documents WHERE lang = 'en')", "doc_id", "text", f"(SELECT 1 AS query_id, '{_ONE}' AS asked)", "query_id", 10))
def bm25_filtered(spark, sf):
    return postings.search(_index(spark, sf, "documents", where="lang = 'en'"), _one(spark), "query_id", "asked", k=10)


@query(_bm25_sql("chunks", "chunk_id", "content", f"(SELECT 1 AS query_id, '{_ONE}' AS asked)", "query_id", 3, "owner, kb,"))
def bm25_scoped(spark, sf):
    return postings.search(_index(spark, sf, "chunks", ["owner", "kb"]), _one(spark), "query_id", "asked", k=3)


@query(_bm25_sql("chunks", "chunk_id", "content", "(SELECT item_id, question AS asked FROM eval_items)", "item_id", 10))
def bm25_batch(spark, sf):
    asked = table(spark, sf, "eval_items").select("item_id", F.col("question").alias("asked"))
    return postings.search(_index(spark, sf, "chunks"), asked, "item_id", "asked", k=10)


@query(
    f"""SELECT owner, kb, CAST(count(*) AS BIGINT) AS n, round(avg(coalesce(len(t), 0)), 6) AS avgdl FROM (SELECT owner, kb, {_LEX.format('content')} AS t FROM chunks) GROUP BY owner, kb"""
)
def bm25_statistics(spark, sf):
    _, totals = ranking.corpus_statistics(table(spark, sf, "chunks"), "chunk_id", "content", ["owner", "kb"])
    return totals.select("owner", "kb", "n", F.round("avgdl", 6).alias("avgdl"))


@query(
    f"""WITH t AS (SELECT chunk_id, unnest({_SEARCH.format("coalesce(section, '')")}) AS term FROM chunks), df AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM chunks),
    q AS (SELECT item_id, unnest({_SEARCH.format('question')}) AS term FROM eval_items), w AS (SELECT item_id, term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM q LEFT JOIN df USING (term) CROSS JOIN n),
    s AS (SELECT item_id, sum(idf) AS total FROM w GROUP BY item_id), h AS (SELECT item_id, chunk_id, sum(idf) AS shared FROM t JOIN w USING (term) GROUP BY ALL)
    SELECT item_id, chunk_id, overlap, rank FROM (SELECT item_id, chunk_id, round(shared / total, 6) AS overlap, row_number() OVER (PARTITION BY item_id ORDER BY round(shared / total, 6) DESC, chunk_id) AS rank FROM h JOIN s USING (item_id)) WHERE rank <= 5"""
)
def idf_overlap_rerank(spark, sf):
    c = table(spark, sf, "chunks").select("chunk_id", F.coalesce("section", F.lit("")).alias("section"))
    got = ranking.idf_overlap(c, "chunk_id", "section", table(spark, sf, "eval_items").select("item_id", "question"), "item_id", "question")
    return ranking.top(got, ["item_id"], "overlap", ["chunk_id"], 5)


# ---- dense retrieval

_COS = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 6)"
_REAL = "{0} IS NOT NULL AND list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])) > 0"


@query(
    f"""SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format('e.embedding', 'q.embedding')} AS similarity
    FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id AND {_REAL.format('q.embedding')} AND {_REAL.format('e.embedding')})) WHERE rank <= 5"""
)
def dense_batch_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return ranking.dense(e, "vec_id", "embedding", e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "embedding", k=5, exclude_self=True)


@query(
    f"""SELECT owner, entry_id, chunk_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner, entry_id ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT c.owner, entry_id, chunk_id, {_COS.format('embedding', 'question_embedding')} AS similarity
    FROM chunks c JOIN cache_entries e ON c.owner = e.owner WHERE entry_id % 20 = 0 AND {_REAL.format('embedding')} AND {_REAL.format('question_embedding')})) WHERE rank <= 10"""
)
def dense_scoped(spark, sf):
    asked = table(spark, sf, "cache_entries").where("entry_id % 20 = 0").select("owner", "entry_id", "question_embedding")
    return ranking.dense(table(spark, sf, "chunks"), "chunk_id", "embedding", asked, "entry_id", "question_embedding", scope=["owner"], k=10)


_GROUPS = f"SELECT q.vec_id AS query_id, e.label, max({_COS.format('e.embedding', 'q.embedding')}) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id AND {_REAL.format('q.embedding')} AND {_REAL.format('e.embedding')} GROUP BY ALL"


def _group_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return ranking.group_similarity(e, "label", "embedding", e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "embedding", own="vec_id")


@query(_GROUPS)
def group_max_similarity(spark, sf):
    return _group_scores(spark, sf)


@query(f"SELECT query_id, label, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ({_GROUPS})) WHERE score >= 0.2 AND score >= 0.7 * best")
def route_margin(spark, sf):
    return routing.margin(_group_scores(spark, sf), ["query_id"], "label", "score")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= 40")
def deterministic_sample(spark, sf):
    return ranking.hash_sample(table(spark, sf, "embeddings"), ["label"], "vec_id", 40).select("label", "vec_id")


@query(f"SELECT a.entry_id, round(CASE WHEN len(a.m) = 0 OR len(b.m) = 0 THEN 0 ELSE len(list_intersect(a.m, b.m)) / least(len(a.m), len(b.m)) END, 6) AS overlap, {_COS.format('a.question_embedding', 'b.question_embedding')} AS similarity FROM (SELECT *, list_distinct(list_transform(coalesce(chunk_ids, []), lambda x: x.h)) AS m FROM cache_entries) a JOIN (SELECT owner, entry_id, question_embedding, list_distinct(list_transform(coalesce(chunk_ids, []), lambda x: x.h)) AS m FROM cache_entries QUALIFY row_number() OVER (PARTITION BY owner ORDER BY entry_id) = 1) b ON a.owner = b.owner WHERE {_REAL.format('a.question_embedding')} AND {_REAL.format('b.question_embedding')}")
def overlap_coefficient(spark, sf):
    e = table(spark, sf, "cache_entries").withColumn("m", F.coalesce(F.col("chunk_ids.h"), F.array().cast("array<string>")))
    first = ranking.first_wins(e, ["owner"], ["entry_id"]).select("owner", F.col("m").alias("m2"), F.col("question_embedding").alias("v2"))
    both = e.join(first, "owner").where((V.norm(F.col("question_embedding")) > 0) & (V.norm(F.col("v2")) > 0))
    return both.select("entry_id", F.round(V.overlap(F.col("m"), F.col("m2")), 6).alias("overlap"), F.round(V.cosine(F.col("question_embedding"), F.col("v2")), 6).alias("similarity"))


# ---- fusion, boosts, completion


def _hybrid_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, sf, "cache_entries").where("entry_id % 20 = 0").select("owner", "entry_id", "question", "question_embedding")
    chunks = table(spark, sf, "chunks")
    dense = ranking.dense(chunks, "chunk_id", "embedding", asked, "entry_id", "question_embedding", scope=["owner"], k=40)
    lexical = postings.search(_index(spark, sf, "chunks", ["owner"]), asked, "entry_id", "question", k=40)
    return dense, lexical


_DENSE40 = f"SELECT entry_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner, entry_id ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT c.owner, entry_id, chunk_id, {_COS.format('embedding', 'question_embedding')} AS similarity FROM chunks c JOIN cache_entries e ON c.owner = e.owner WHERE entry_id % 20 = 0 AND {_REAL.format('embedding')} AND {_REAL.format('question_embedding')})) WHERE rank <= 40"
_BM40 = _bm25_sql("chunks", "chunk_id", "content", "(SELECT owner, entry_id, question AS asked FROM cache_entries WHERE entry_id % 20 = 0)", "entry_id", 40, "owner,").replace("SELECT entry_id, term, count(*) AS qtf FROM (SELECT entry_id, unnest", "SELECT owner, entry_id, term, count(*) AS qtf FROM (SELECT owner, entry_id, unnest").replace("JOIN q USING (term)", "JOIN q USING (owner, term)")
def _rrf_sql(lists: list[str]) -> str:
    every = " UNION ALL ".join(f"SELECT {i} AS list, entry_id, chunk_id, rank FROM ({x})" for i, x in enumerate(lists))
    return f"""WITH l AS ({every}),
    f AS (SELECT entry_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(list) AS first_list, arg_min(rank, list) AS first_rank FROM l GROUP BY ALL)
    SELECT entry_id, chunk_id, CAST(rrf AS DOUBLE) AS rrf, position FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rrf DESC, first_list, first_rank, chunk_id) AS position FROM f) WHERE position <= 20"""


@query(_rrf_sql([_DENSE40, _BM40]))
def hybrid_search(spark, sf):
    fused = ranking.fuse(list(_hybrid_lists(spark, sf)), ["entry_id"], ["chunk_id"])
    return fused.where("position <= 20").select("entry_id", "chunk_id", "rrf", "position")


_TITLE = f"""CASE WHEN len(q) > 0 THEN len(list_intersect(q, s)) / len(q) + CASE WHEN over AND readme THEN 1 ELSE 0 END + CASE WHEN over AND readme AND NOT contains(section, ' > ') THEN 1 ELSE 0 END ELSE 0 END"""


@query(
    f"""SELECT entry_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT entry_id, chunk_id, round(similarity + {_TITLE}, 6) AS score FROM
    (SELECT entry_id, chunk_id, similarity, {_SEARCH.format('question')} AS q, coalesce(section, '') AS section, {_SEARCH.format("coalesce(section, '')")} AS s, len(list_intersect({_SEARCH.format('question')}, [{_quoted(ranking.OVERVIEW)}])) > 0 AS over,
      coalesce(lower(string_split(coalesce(file_path, ''), '/')[-1]) IN ({_quoted(ranking.READMES)}), false) AS readme
     FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY similarity DESC, chunk_id) AS r FROM (SELECT entry_id, chunk_id, question, section, file_path, {_COS.format('embedding', 'question_embedding')} AS similarity
       FROM chunks c JOIN cache_entries e ON c.owner = e.owner WHERE entry_id % 20 = 0 AND {_REAL.format('embedding')} AND {_REAL.format('question_embedding')})) WHERE r <= 40))) WHERE rank <= 5"""
)
def title_boost(spark, sf):
    asked = table(spark, sf, "cache_entries").where("entry_id % 20 = 0").select("owner", "entry_id", "question", "question_embedding")
    chunks = table(spark, sf, "chunks")
    hits = ranking.dense(chunks, "chunk_id", "embedding", asked, "entry_id", "question_embedding", scope=["owner"], k=40)
    full = hits.join(chunks.select("chunk_id", "section", "file_path"), "chunk_id").join(asked.select("entry_id", "question"), "entry_id")
    scored = full.select("entry_id", "chunk_id", F.round(ranking.title_score(F.col("question"), F.col("similarity"), F.col("section"), F.col("file_path")), 6).alias("score"))
    return ranking.top(scored, ["entry_id"], "score", ["chunk_id"], 5)


_PLACE = "row_number() OVER (PARTITION BY owner ORDER BY md5(CAST(chunk_id AS VARCHAR)), chunk_id)"


def _placed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.col("chunk_id").cast("string")), "chunk_id")))


def _complete_sql(part: str, whole: str, link: str) -> str:
    return f"""WITH h AS (SELECT owner, chunk_id, content_type, {link} AS link, {_PLACE} AS rank FROM chunks), w AS (SELECT owner || '::' || {link} AS link, min(chunk_id) AS whole FROM chunks WHERE content_type = '{whole}' AND {link} IS NOT NULL AND owner IS NOT NULL GROUP BY ALL),
    o AS (SELECT h.owner, rank, CASE WHEN {part} AND whole IS NOT NULL THEN whole ELSE chunk_id END AS id, coalesce({part} AND whole IS NOT NULL, false) AS completed FROM h LEFT JOIN w ON h.owner || '::' || h.link = w.link)
    SELECT owner, id, rank, completed FROM o QUALIFY row_number() OVER (PARTITION BY owner, id ORDER BY completed, rank) = 1"""


def _completed(spark: SparkSession, sf: str, parts: list[str], whole: str, link: str) -> DataFrame:
    c = table(spark, sf, "chunks").withColumn("link", F.concat("owner", F.lit("::"), link))
    hits = _placed(c, ["owner"]).select("owner", "rank", F.col("chunk_id").alias("id"), "content_type", "link", F.lit(1.0).alias("similarity"))
    wholes = c.where(F.col("content_type") == whole).where("link is not null").select(F.col("chunk_id").alias("id"), "link")
    return ranking.complete(hits, wholes, ["owner"], parts, "link").select("owner", "id", "rank", "completed")


@query(_complete_sql("content_type = 'table_row'", "table", "table_id"))
def row_to_table_completion(spark, sf):
    return _completed(spark, sf, ["table_row"], "table", "table_id")


@query(_complete_sql("content_type = 'method'", "class", "class_id"))
def method_to_class_completion(spark, sf):
    return _completed(spark, sf, ["method"], "class", "class_id")


@query(
    f"""WITH c AS (SELECT owner, document_id, parent_chunk_index, min(r) AS child_rank FROM (SELECT owner, document_id, parent_chunk_index, {_PLACE} AS r FROM chunks WHERE chunk_role = 'child') GROUP BY ALL),
    p AS (SELECT owner, document_id, chunk_index, max(chunk_id) AS chunk_id FROM chunks WHERE chunk_role = 'parent' GROUP BY ALL)
    SELECT owner, chunk_id, rank FROM (SELECT c.owner, p.chunk_id, row_number() OVER (PARTITION BY c.owner ORDER BY child_rank) AS rank FROM c JOIN p ON c.owner = p.owner AND c.document_id = p.document_id AND c.parent_chunk_index = p.chunk_index) WHERE rank <= 60"""
)
def child_to_parent(spark, sf):
    c = table(spark, sf, "chunks")
    kids = _placed(c.where("chunk_role = 'child'"), ["owner"])
    parents = c.where("chunk_role = 'parent'").groupBy("owner", "document_id", "chunk_index").agg(F.max("chunk_id").alias("chunk_id"))
    return ranking.parents_of(kids, parents, ["owner"], ["document_id"], 60).select("owner", "chunk_id", "rank")


@query("SELECT owner, document_id, chunk_index, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY owner, document_id, chunk_index ORDER BY kb, chunk_id) AS r FROM chunks) WHERE r = 1 OR owner IS NULL OR document_id IS NULL OR chunk_index IS NULL")
def first_wins_dedup(spark, sf):
    return ranking.first_wins(table(spark, sf, "chunks"), ["owner", "document_id", "chunk_index"], ["kb", "chunk_id"]).select("owner", "document_id", "chunk_index", "chunk_id")


@query(
    f"""SELECT owner, chunk_id, CAST(used AS BIGINT) AS used FROM (SELECT owner, chunk_id, sum(n) OVER (PARTITION BY owner ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY owner ORDER BY chunk_id) AS r
    FROM (SELECT owner, chunk_id, len({_WS.format('content')}) AS n FROM chunks)) WHERE r = 1 OR used <= 3000"""
)
def token_budget_pack(spark, sf):
    c = table(spark, sf, "chunks").select("owner", "chunk_id", T.word_count(F.col("content")).cast("bigint").alias("n"))
    return ranking.pack_budget(c, ["owner"], ["chunk_id"], "n", 3000).select("owner", "chunk_id", "used")


@query("SELECT owner, entry_id, turn FROM (SELECT owner, entry_id, row_number() OVER (PARTITION BY owner ORDER BY entry_id) AS turn FROM (SELECT owner, entry_id FROM cache_entries QUALIFY row_number() OVER (PARTITION BY owner ORDER BY entry_id DESC) <= 8))")
def last_n_turns(spark, sf):
    return ranking.last_n(table(spark, sf, "cache_entries"), ["owner"], "entry_id", 8).select("owner", "entry_id", "turn")


# ---- pipelines


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "cache_entries").where("entry_id % 20 = 0 and question is not null")
    return e.select("owner", F.col("entry_id").alias("query_id"), F.col("question").alias("text"), F.col("question_embedding").alias("vector"))


@query()
def adaptive_retrieve(spark, sf):
    return pipelines.adaptive(table(spark, sf, "chunks"), _asked(spark, sf), index=_index(spark, sf, "chunks", ["owner"]))


@query(
    f"""WITH h AS (SELECT entry_id AS query_id, chunk_id, rank FROM ({_DENSE40}) WHERE rank <= 5), g AS (SELECT query_id, chunk_id, rank, 0 AS pass FROM h WHERE chunk_id % 3 <> 0), b AS (SELECT entry_id AS query_id, chunk_id, rank FROM ({_BM40})),
    m AS (SELECT * FROM g UNION ALL SELECT query_id, chunk_id, rank, 1 FROM b WHERE query_id NOT IN (SELECT query_id FROM g GROUP BY query_id HAVING count(*) >= 4)), o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pass, rank) = 1)
    SELECT query_id, chunk_id, rank, pass FROM (SELECT query_id, chunk_id, pass, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank, chunk_id) AS rank FROM o) WHERE rank <= 5"""
)
def corrective_retrieve(spark, sf):
    dense, lexical = (x.withColumnRenamed("entry_id", "query_id").select("query_id", "chunk_id", "rank") for x in _hybrid_lists(spark, sf))
    hits = dense.where("rank <= 5")
    grades = hits.select("query_id", "chunk_id", F.when(F.col("chunk_id") % 3 == 0, "incorrect").otherwise("correct").alias("relevance"))
    return pipelines.corrected(hits, grades, lexical, least=4)


@query(
    f"""WITH q AS (SELECT owner, entry_id, question FROM cache_entries WHERE entry_id % 20 = 0 AND question IS NOT NULL),
    h AS (SELECT d.entry_id, d.rank, c.*, len({_WS.format('c.content')}) AS n FROM (SELECT entry_id, chunk_id, rank FROM ({_DENSE40}) WHERE rank <= 5) d JOIN chunks c USING (chunk_id)),
    k AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY entry_id ORDER BY rank, chunk_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY entry_id ORDER BY rank, chunk_id) AS place FROM h) WHERE place = 1 OR used <= 3000),
    l AS (SELECT entry_id, rank, '[Source ' || CAST(rank AS VARCHAR) || CASE WHEN parts = '' THEN '' ELSE ' — ' || parts END || ']' || chr(10) || content AS b FROM (SELECT *, concat_ws(', ', nullif(file_name, ''), CASE WHEN page_number IS NOT NULL THEN 'page ' || CAST(page_number AS VARCHAR) WHEN coalesce(section, '') <> '' THEN 'section: ''' || section || '''' END) AS parts FROM k)),
    x AS (SELECT entry_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM l GROUP BY entry_id),
    p AS (SELECT q.entry_id, t.entry_id AS turn, 'Q: ' || coalesce(t.question, '') || chr(10) || 'A: ' || coalesce(t.answer, '') AS b FROM q JOIN (SELECT owner, entry_id, question, answer, row_number() OVER (PARTITION BY owner ORDER BY entry_id DESC) AS back FROM cache_entries) t ON t.owner = q.owner AND back <= 8),
    pt AS (SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY turn) AS turn, b, len({_WS.format('b')}) AS n FROM p),
    pk AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY entry_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY entry_id ORDER BY turn DESC) AS place FROM pt) WHERE place = 1 OR used <= 800),
    tu AS (SELECT entry_id, string_agg(b, chr(10) || chr(10) ORDER BY turn) AS turns FROM pk GROUP BY entry_id)
    SELECT q.entry_id AS query_id, concat_ws(chr(10) || chr(10), 'Conversation so far:' || chr(10) || turns, 'Context:' || chr(10) || coalesce(context, '(none)'), 'Question: ' || question) AS prompt FROM q LEFT JOIN x USING (entry_id) LEFT JOIN tu USING (entry_id)"""
)
def packed_prompts(spark, sf):
    chunks = table(spark, sf, "chunks")
    dense, _ = _hybrid_lists(spark, sf)
    hits = dense.where("rank <= 5").select(F.col("entry_id").alias("query_id"), "chunk_id", "rank")
    asked = _asked(spark, sf)
    e = table(spark, sf, "cache_entries").select("owner", F.col("entry_id").alias("turn"), "question", "answer")
    past = ranking.last_n(e, ["owner"], "turn", 8).join(asked.select("owner", "query_id"), "owner")
    return pipelines.prompts(hits, chunks, asked, past.select("query_id", "turn", "question", "answer"))


@query()
def ingest_documents(spark, sf):
    d = table(spark, sf, "loaded_documents").where("document_id is not null")
    return pipelines.ingest(ranking.keep_last(d, ["owner", "document_id"], ["arrived_at", "record_id"]).select("record_id", "owner", "document_id", "source_type", "content")).drop("embedding", "block_types")


@query("SELECT chunk_id, coalesce(page_number = prev + 1 AND section = psec, false) AS continues FROM (SELECT chunk_id, page_number, section, lag(page_number) OVER w AS prev, lag(section) OVER w AS psec FROM chunks WHERE kb = 'pdf' AND page_number IS NOT NULL WINDOW w AS (PARTITION BY owner, document_id ORDER BY page_number, chunk_index, chunk_id))")
def page_continuations(spark, sf):
    c = table(spark, sf, "chunks").where("kb = 'pdf' and page_number is not null")
    return c.select("chunk_id", chunking.continues(["owner", "document_id"], "page_number", ["chunk_index", "chunk_id"], "section").alias("continues"))


@query("SELECT record_id FROM loaded_documents d WHERE source_type = 'web' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.owner = d.owner AND c.document_id = d.document_id)")
def not_yet_extracted(spark, sf):
    return maintenance.without(table(spark, sf, "loaded_documents").where("source_type = 'web'"), table(spark, sf, "chunks"), ["owner", "document_id"]).select("record_id")


# ---- routing


def _labels_sql(keywords: dict[str, list[str]]) -> str:
    one = lambda label, words: f"CASE WHEN {' OR '.join('contains(t, ' + _quoted([w]) + ')' for w in words)} THEN '{label}' END"
    return f"SELECT chunk_id, concat_ws(',', {', '.join(one(k, v) for k, v in keywords.items())}) AS labels FROM (SELECT chunk_id, ' ' || lower(coalesce(content, '')) || ' ' AS t FROM chunks)"


def _labels(spark: SparkSession, sf: str, keywords: dict[str, list[str]]) -> DataFrame:
    return spread(table(spark, sf, "chunks").select("chunk_id", "content")).select("chunk_id", F.array_join(routing.labels(F.col("content"), keywords), ",").alias("labels"))


@query(_labels_sql(routing.ROUTES))
def keyword_routes(spark, sf):
    return _labels(spark, sf, routing.ROUTES)


@query(_labels_sql(routing.BASES))
def keyword_bases(spark, sf):
    return _labels(spark, sf, routing.BASES)


@query(_labels_sql(routing.INTENTS))
def keyword_intents(spark, sf):
    return _labels(spark, sf, routing.INTENTS)


# ---- aggregates and listings


@query("SELECT kb, CAST(count(*) AS BIGINT) AS n FROM chunks GROUP BY ROLLUP (kb)")
def rollup_counts(spark, sf):
    return listing.counts(table(spark, sf, "chunks"), "kb")


@query("SELECT owner, kb, CASE WHEN kb = 'github' THEN repository ELSE document_id END AS document, count(*) AS n FROM chunks WHERE coalesce(CASE WHEN kb = 'github' THEN repository ELSE document_id END, '') <> '' GROUP BY ALL")
def list_documents(spark, sf):
    return listing.documents(table(spark, sf, "chunks"))


@query("SELECT DISTINCT owner, repository FROM chunks WHERE repository <> ''")
def list_repositories(spark, sf):
    return listing.repositories(table(spark, sf, "chunks"))


@query("SELECT owner, string_agg(kb, ',' ORDER BY kb) AS bases FROM (SELECT DISTINCT owner, kb FROM chunks WHERE kb IS NOT NULL) GROUP BY owner")
def populated_bases(spark, sf):
    return listing.populated(table(spark, sf, "chunks")).select("owner", F.array_join("bases", ",").alias("bases"))


@query("SELECT d.owner, d.document_id, CASE WHEN c.n IS NULL THEN 'pending' ELSE 'indexed' END AS status, coalesce(c.n, 0) AS chunks FROM (SELECT DISTINCT owner, document_id FROM loaded_documents WHERE owner IS NOT NULL AND document_id IS NOT NULL) d LEFT JOIN (SELECT owner, document_id, count(*) AS n FROM chunks GROUP BY ALL) c ON d.owner = c.owner AND d.document_id = c.document_id")
def source_summary(spark, sf):
    return listing.source_summary(table(spark, sf, "loaded_documents"), table(spark, sf, "chunks"))


_METRICS = ["latency_context_prep_s", "latency_generation_s", "latency_total_s", "doc_hit_rate", "doc_mrr", "doc_ndcg", "faithfulness", "answer_relevance"]


@query(f"SELECT run_id, count(*) AS items, count(error) AS failed, {', '.join(f'round(avg({m}), 3) AS mean_{m}, count({m}) AS n_{m}' for m in _METRICS)} FROM item_results GROUP BY run_id")
def eval_aggregate(spark, sf):
    return evaluation.mean_metrics(table(spark, sf, "item_results"), ["run_id"], _METRICS, "error")


@query(
    """SELECT run_id, CAST(graded AS BIGINT) AS graded, CAST(correct AS BIGINT) AS correct, CAST(kept AS BIGINT) AS kept, CASE WHEN correct / graded >= 0.6 THEN 'correct' WHEN kept >= 1 THEN 'ambiguous' ELSE 'incorrect' END AS overall FROM
    (SELECT run_id, count(*) AS graded, sum(CASE WHEN faithfulness >= 0.8 THEN 1 ELSE 0 END) AS correct, sum(CASE WHEN faithfulness >= 0.5 THEN 1 ELSE 0 END) AS kept FROM item_results GROUP BY run_id)"""
)
def crag_verdicts(spark, sf):
    grade = F.when(F.col("faithfulness") >= 0.8, "correct").when(F.col("faithfulness") >= 0.5, "partial").otherwise("incorrect")
    return evaluation.verdict(table(spark, sf, "item_results").withColumn("grade", grade), ["run_id"], "grade")


@query("SELECT result_id, round(least(doc_hit_rate, doc_mrr, doc_ndcg), 6) AS weakest, least(doc_hit_rate, doc_mrr, doc_ndcg) < 0.5 AS low FROM item_results WHERE doc_hit_rate IS NOT NULL AND doc_mrr IS NOT NULL AND doc_ndcg IS NOT NULL")
def weakest_dimension(spark, sf):
    r = table(spark, sf, "item_results").where("doc_hit_rate is not null and doc_mrr is not null and doc_ndcg is not null")
    w, low = evaluation.weakest("doc_hit_rate", "doc_mrr", "doc_ndcg")
    return r.select("result_id", F.round(w, 6).alias("weakest"), low.alias("low"))


@query(
    f"""WITH r AS (SELECT entry_id, c.document_id, row_number() OVER (PARTITION BY entry_id ORDER BY {_COS.format('embedding', 'question_embedding')} DESC, chunk_id) AS rank FROM chunks c JOIN cache_entries e ON c.owner = e.owner WHERE entry_id % 20 = 0 AND {_REAL.format('embedding')} AND {_REAL.format('question_embedding')}),
    x AS (SELECT DISTINCT entry_id, m.doc AS document_id FROM (SELECT entry_id, unnest(chunk_ids) AS m FROM cache_entries WHERE entry_id % 20 = 0)), n AS (SELECT entry_id, count(*) AS n_expected FROM x GROUP BY entry_id),
    h AS (SELECT r.entry_id, r.rank, r.document_id, x.entry_id IS NOT NULL AS m FROM r LEFT JOIN x ON r.entry_id = x.entry_id AND r.document_id = x.document_id WHERE rank <= 40),
    p AS (SELECT entry_id, count(*) FILTER (rank <= 10) AS n_top, count(*) FILTER (m AND rank <= 10) AS n_match, count(DISTINCT CASE WHEN m AND rank <= 10 THEN document_id END) AS n_found, min(CASE WHEN m THEN rank END) AS first, sum(CASE WHEN m AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY entry_id)
    SELECT n.entry_id, CASE WHEN coalesce(n_match, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, CAST(round(coalesce(1.0 / first, 0), 6) AS DOUBLE) AS mrr,
      round(CASE WHEN least(n_expected, coalesce(n_top, 0)) > 0 THEN dcg / list_sum(list_transform(range(1, least(n_expected, n_top) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg,
      round(CASE WHEN coalesce(n_top, 0) > 0 THEN n_match / n_top ELSE 0 END, 6) AS precision, round(coalesce(n_found, 0) / n_expected, 6) AS recall FROM n LEFT JOIN p USING (entry_id)"""
)
def retrieval_metrics(spark, sf):
    asked = table(spark, sf, "cache_entries").where("entry_id % 20 = 0")
    chunks = table(spark, sf, "chunks")
    got = ranking.dense(chunks, "chunk_id", "embedding", asked.select("owner", "entry_id", "question_embedding"), "entry_id", "question_embedding", scope=["owner"], k=40)
    got = got.join(chunks.select("chunk_id", "document_id"), "chunk_id")
    want = asked.select("entry_id", F.explode("chunk_ids.doc").alias("document_id"))
    return evaluation.retrieval_metrics(got, want, "entry_id", "document_id", k=10)


# ---- tables and their upkeep


@query("SELECT owner, document_id, chunk_index, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY owner, document_id, chunk_index ORDER BY ingested_at DESC NULLS LAST, chunk_id DESC) = 1")
def upsert_keep_last(spark, sf):
    c = table(spark, sf, "chunks").select("owner", "document_id", "chunk_index", "chunk_id", "ingested_at")
    return ranking.keep_last(c, ["owner", "document_id", "chunk_index"], ["ingested_at", "chunk_id"]).select("owner", "document_id", "chunk_index", "chunk_id")


_KEYSQL = "concat_ws('::', coalesce(owner, 'local'), document_id, CASE WHEN page_number IS NOT NULL THEN 'page_' || CAST(page_number AS VARCHAR) END, 'chunk_' || CAST(chunk_index AS VARCHAR))"


@query(f"SELECT chunk_id, CASE WHEN source_type IN ({_quoted(maintenance.KNOWN)}) THEN source_type ELSE 'markdown' END AS base, {_KEYSQL} AS key FROM chunks")
def chunk_keys(spark, sf):
    return table(spark, sf, "chunks").select("chunk_id", maintenance.base_of(F.col("source_type")).alias("base"), maintenance.row_key(F.col("owner"), F.col("document_id"), F.col("page_number"), F.col("chunk_index")).alias("key"))


@query("SELECT chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM loaded_documents d WHERE d.source_type = 'audio' AND d.owner = c.owner AND d.document_id = c.document_id)")
def delete_survivors(spark, sf):
    gone = table(spark, sf, "loaded_documents").where("source_type = 'audio'")
    return maintenance.without(table(spark, sf, "chunks"), gone, ["owner", "document_id"]).select("chunk_id")


@query("SELECT owner, repository, CAST(count(*) FILTER (kb = 'github') AS BIGINT) AS removed, CAST(count(*) FILTER (kb IS DISTINCT FROM 'github') AS BIGINT) AS left_over FROM chunks WHERE repository IS NOT NULL AND owner IS NOT NULL GROUP BY ALL")
def delete_counts(spark, sf):
    c = table(spark, sf, "chunks")
    gone = c.where("repository is not null and owner is not null").select("owner", "repository").distinct()
    rest, removed = maintenance.delete_repositories(c, gone)
    left = rest.where("repository is not null and owner is not null").groupBy("owner", "repository").agg(F.count("*").alias("left_over"))
    return gone.join(removed, ["owner", "repository"], "left").join(left, ["owner", "repository"], "left").fillna(0, ["removed", "left_over"])


@query("SELECT chunk_id, array_to_string(block_types, ', ') AS block_types, CAST(page_number AS VARCHAR) AS page_number, CAST((CASE WHEN block_types IS NULL THEN 0 ELSE 1 END + CASE WHEN page_number IS NULL THEN 0 ELSE 1 END + CASE WHEN section IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS kept FROM chunks")
def sanitised_metadata(spark, sf):
    c = table(spark, sf, "chunks")
    m = maintenance.sanitise({"block_types": F.array_join("block_types", ", "), "page_number": F.col("page_number").cast("int").cast("string"), "section": F.col("section")})
    return c.select("chunk_id", m.alias("m")).select("chunk_id", F.col("m")["block_types"].alias("block_types"), F.col("m")["page_number"].alias("page_number"), F.size("m").cast("bigint").alias("kept"))


@query("SELECT chunk_id, CASE WHEN c THEN 'parent' ELSE chunk_role END AS chunk_role, c AS changed FROM (SELECT *, coalesce(content_type IN ('image_ocr', 'image_code'), false) AND chunk_role IS NULL AS c FROM chunks)")
def backfill_role(spark, sf):
    return maintenance.backfill_role(table(spark, sf, "chunks")).select("chunk_id", "chunk_role", "changed")


@query("SELECT CASE WHEN o THEN 'admin::' || CAST(record_id AS VARCHAR) ELSE CAST(record_id AS VARCHAR) END AS key, CASE WHEN o THEN 'admin' ELSE owner END AS owner, o AS adopted FROM (SELECT record_id, owner, owner IS NULL OR owner = '' AS o FROM loaded_documents)")
def owner_migration(spark, sf):
    d = table(spark, sf, "loaded_documents").select(F.col("record_id").alias("key"), "owner")
    return maintenance.adopt(d, "owner", "key", "admin")


@query("SELECT d.owner, d.document_id, count(*) AS chunks FROM (SELECT DISTINCT owner, document_id FROM chunks WHERE function_name IS NOT NULL) d JOIN chunks c ON c.owner = d.owner AND c.document_id = d.document_id GROUP BY ALL")
def nodes_to_chunks(spark, sf):
    c = table(spark, sf, "chunks").select("owner", "document_id", "function_name")
    return graph.chunks_of(c.where("function_name is not null"), c, ["owner", "document_id"]).groupBy("owner", "document_id").agg(F.count("*").alias("chunks"))


# ---- chunking


@query(
    rf"""SELECT doc_id, CAST(i AS INT) AS window_no, CAST(len(w[i * 120 + 1 : i * 120 + 150]) AS INT) AS words, array_to_string(w[i * 120 + 1 : i * 120 + 150], ' ') AS "window"
    FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 120) AS BIGINT))) AS i FROM (SELECT doc_id, {_WS.format('text')} AS w FROM documents))"""
)
def word_windows(spark, sf):
    return chunking.word_windows(table(spark, sf, "documents"), "doc_id", "text")


@query(
    r"""SELECT record_id, CAST(i AS INT) AS block_no, trim(p[i + 1], e' \n\t\r') AS block FROM (SELECT record_id, p, unnest(range(len(p))) AS i FROM (SELECT record_id, list_filter(string_split_regex(content, '\n[ \t\r]*\n'), lambda x: trim(x, e' \n\t\r') <> '') AS p FROM loaded_documents WHERE content IS NOT NULL))"""
)
def paragraph_blocks(spark, sf):
    return chunking.paragraphs(table(spark, sf, "loaded_documents"), "record_id", "content")


@query(
    r"""SELECT record_id, CAST(len(list_filter(string_split(regexp_replace(trim(content), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS BIGINT) AS sentences FROM loaded_documents WHERE content IS NOT NULL"""
)
def sentence_counts(spark, sf):
    return table(spark, sf, "loaded_documents").where("content is not null").select("record_id", F.size(chunking.sentences(F.col("content"))).cast("bigint").alias("sentences"))


def _windows_sql(rows: str) -> str:
    """CTEs up to ``w`` (key, win, window) over ``rows`` (key, t): sentences filled to 40 words, a short last window dropped."""
    return rf"""t AS (SELECT key, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(t, ''), ' '), '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM ({rows})),
    e AS (SELECT key, unnest(range(1, len(s) + 1)) AS i, s FROM t), n AS (SELECT key, i, s[i] AS x, len(string_split(trim(regexp_replace(s[i], '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), ' ')) AS n FROM e),
    r AS (SELECT key, i, 0 AS win, n FROM n WHERE i = 1 UNION ALL SELECT n.key, n.i, CASE WHEN r.n > 0 AND r.n + n.n > 40 THEN r.win + 1 ELSE r.win END, CASE WHEN r.n > 0 AND r.n + n.n > 40 THEN n.n ELSE r.n + n.n END FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1),
    g AS (SELECT r.key, win, string_agg(x, ' ' ORDER BY r.i) AS "window", sum(n.n) AS words, max(win) OVER (PARTITION BY r.key) AS final FROM r JOIN n ON n.key = r.key AND n.i = r.i GROUP BY r.key, win),
    w AS (SELECT key, win, "window" FROM g WHERE words >= 5 OR win = 0 OR win < final)"""


@query(f"WITH RECURSIVE {_windows_sql('SELECT doc_id AS key, text AS t FROM documents')} SELECT key AS doc_id, CAST(win AS INT) AS window_no, \"window\" FROM w")
def sentence_windows(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(chunking.sentence_windows(F.col("text"))).alias("window_no", "window"))


@query(
    """SELECT chunk_id, CAST(i AS INT) AS row_no, l[1] || chr(10) || l[2] || chr(10) || l[i + 3] AS content FROM (SELECT chunk_id, l, unnest(range(0, len(l) - 2)) AS i FROM (SELECT chunk_id, string_split(content, chr(10)) AS l FROM chunks WHERE content_type = 'table') WHERE len(l) >= 3)"""
)
def table_rows(spark, sf):
    return chunking.table_rows(table(spark, sf, "chunks").where("content_type = 'table'"), ["chunk_id"], "content")


@query()
def chunk_documents(spark, sf):
    d = table(spark, sf, "loaded_documents")
    return chunking.chunk_documents(d, "record_id", "content", "document_id", (F.col("source_type") == "code") & F.col("file_name").endswith(".py"))


@query(
    f"""WITH RECURSIVE c AS (SELECT * FROM chunks WHERE coalesce(chunk_role, 'parent') = 'parent' QUALIFY row_number() OVER (PARTITION BY owner, document_id, chunk_index ORDER BY ingested_at DESC NULLS LAST, chunk_id DESC) = 1),
    {_windows_sql("SELECT chunk_id AS key, content AS t FROM c WHERE coalesce(content_type, '') NOT IN ('class', 'method', 'function', 'table', 'table_row')")}, p AS (SELECT owner, document_id, max(chunk_index) + 1 AS parents FROM c GROUP BY ALL)
    SELECT owner, document_id, chunk_index, content, 'parent' AS chunk_role, CAST(NULL AS INT) AS parent_chunk_index FROM c UNION ALL
    SELECT c.owner, c.document_id, CAST(parents + row_number() OVER (PARTITION BY c.owner, c.document_id ORDER BY c.chunk_index, win) - 1 AS INT), "window", 'child', c.chunk_index FROM w JOIN c ON c.chunk_id = w.key JOIN p ON p.owner = c.owner AND p.document_id = c.document_id"""
)
def parent_child(spark, sf):
    c = ranking.keep_last(table(spark, sf, "chunks").where("coalesce(chunk_role, 'parent') = 'parent'"), ["owner", "document_id", "chunk_index"], ["ingested_at", "chunk_id"])
    return chunking.parent_child(c, ["owner", "document_id"])


# ---- graphs


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """The fenced blocks of the code documents, each as a source file."""
    code = table(spark, sf, "loaded_documents").where("source_type = 'code'")
    blocks = code.select("record_id", "repository", F.coalesce("file_name", F.lit("file")).alias("file_name"), F.posexplode(F.regexp_extract_all("content", F.lit("(?s)```[a-z]*\n(.*?)```"), F.lit(1))).alias("no", "source"))
    return blocks.withColumn("path", F.concat_ws("#", F.concat_ws("/", "repository", "file_name"), F.concat(F.col("record_id").cast("string"), F.lit("-"), F.col("no").cast("string"))))


@query()
def code_graph(spark, sf):
    return graph.build_edges(_sources(spark, sf), "repository", "path", "source")


@query()
def chunk_python(spark, sf):
    return chunking.chunk_documents(_sources(spark, sf), "record_id", "source", "path", F.lit(True))


@query("SELECT start, node FROM (SELECT DISTINCT 'order:' || o_orderkey AS start, 'part:' || l_partkey AS node FROM orders JOIN lineitem ON o_orderkey = l_orderkey) UNION SELECT 'order:' || o_orderkey, 'order:' || o_orderkey FROM orders")
def graph_hop(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.lit("calls").alias("kind"))
    starts = table(spark, sf, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("start"))
    return graph.hop(edges, starts, "start", "calls", "out")


@query("SELECT start, node FROM (SELECT DISTINCT 'part:' || p_partkey AS start, 'order:' || l_orderkey AS node FROM part JOIN lineitem ON p_partkey = l_partkey) UNION SELECT 'part:' || p_partkey, 'part:' || p_partkey FROM part")
def graph_callers(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.lit("calls").alias("kind"))
    starts = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("start"))
    return graph.hop(edges, starts, "start", "calls", "in")


_DIR = ", ".join(f"CASE WHEN contains(t, '{p}') THEN '{':'.join(graph.DIRECTIONS[p])}' END" for p in sorted(graph.DIRECTIONS, key=lambda p: -len(p)))


@query(
    f"""SELECT entry_id, CASE WHEN len(f) = 0 THEN 'calls:in,calls:out' ELSE array_to_string(list_transform(list_filter(range(1, len(f) + 1), lambda i: list_position(f, f[i]) = i), lambda i: f[i]), ',') END AS directions
    FROM (SELECT entry_id, list_filter([{_DIR}], lambda x: x IS NOT NULL) AS f FROM (SELECT entry_id, lower(coalesce(question, '')) AS t FROM cache_entries))"""
)
def graph_directions(spark, sf):
    return table(spark, sf, "cache_entries").select("entry_id", F.array_join(graph.directions(F.coalesce("question", F.lit(""))), ",").alias("directions"))


@query(
    """WITH n AS (SELECT repository, 'function:' || file_path || '::' || function_name AS id, 'function' AS kind, function_name AS name FROM chunks WHERE file_path IS NOT NULL AND function_name IS NOT NULL UNION SELECT repository, 'external:' || class_name || '.' || function_name, 'external', class_name || '.' || function_name FROM chunks WHERE class_name IS NOT NULL AND function_name IS NOT NULL),
    s AS (SELECT DISTINCT unnest(regexp_extract_all(content, '`([a-z_]+[a-z0-9_]*)`', 1)) AS symbol FROM chunks UNION SELECT DISTINCT function_name FROM chunks WHERE function_name IS NOT NULL),
    h AS (SELECT n.*, symbol FROM n JOIN s ON lower(string_split(name, '.')[-1]) = lower(string_split(symbol, '.')[-1]) WHERE lower(name) = lower(symbol) OR ends_with(lower(name), '.' || lower(symbol)))
    SELECT repository, symbol, id, CAST(row_number() OVER (PARTITION BY repository, symbol ORDER BY kind = 'external', id) AS INT) AS rank FROM h"""
)
def symbol_seeds(spark, sf):
    """Nodes of the functions that chunks stand for, and external ones of the methods they name, by the symbols that contents quote."""
    c = table(spark, sf, "chunks").where("function_name is not null")
    own = c.where("file_path is not null").select("repository", F.concat(F.lit("function:"), "file_path", F.lit("::"), "function_name").alias("id"), F.lit("function").alias("kind"), F.col("function_name").alias("name"))
    method = F.concat("class_name", F.lit("."), "function_name")
    outer = c.where("class_name is not null").select("repository", F.concat(F.lit("external:"), method).alias("id"), F.lit("external").alias("kind"), method.alias("name"))
    quoted = table(spark, sf, "chunks").select(F.explode(F.regexp_extract_all("content", F.lit("`([a-z_]+[a-z0-9_]*)`"), F.lit(1))).alias("symbol"))
    named = quoted.unionByName(c.select(F.col("function_name").alias("symbol"))).distinct()
    return graph.seeds(own.unionByName(outer).distinct(), named, "symbol").select("repository", "symbol", "id", "rank")


# ---- state


@query(
    f"""SELECT ask_id, entry_id, seq, similarity, overlap FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY similarity DESC, seq, entry_id) AS r FROM (SELECT a.entry_id AS ask_id, e.entry_id, e.seq, {_COS.format('e.question_embedding', 'a.question_embedding')} AS similarity,
      round(CASE WHEN len(e.m) = 0 OR len(a.m) = 0 THEN 0 ELSE len(list_intersect(e.m, a.m)) / least(len(e.m), len(a.m)) END, 6) AS overlap FROM
      (SELECT *, list_distinct(list_transform(coalesce(chunk_ids, []), lambda x: x.doc || '#' || CAST(x.idx AS VARCHAR) || '#' || x.h)) AS m FROM cache_entries WHERE {_REAL.format('question_embedding')}) e JOIN
      (SELECT *, list_distinct(list_transform(coalesce(chunk_ids, []), lambda x: x.doc || '#' || CAST(x.idx AS VARCHAR) || '#' || x.h)) AS m FROM cache_entries WHERE entry_id % 20 = 0 AND {_REAL.format('question_embedding')}) a
      ON e.owner IS NOT DISTINCT FROM a.owner AND e.kb IS NOT DISTINCT FROM a.kb AND e.repository IS NOT DISTINCT FROM a.repository AND e.seq < a.seq) WHERE similarity >= 0.6 AND overlap >= 0.6) WHERE r = 1"""
)
def cache_lookup(spark, sf):
    members = F.transform(F.coalesce("chunk_ids", F.array()), lambda x: F.concat_ws("#", x["doc"], x["idx"].cast("string"), x["h"]))
    e = table(spark, sf, "cache_entries").where(V.norm(F.col("question_embedding")) > 0).select("owner", "kb", "repository", "entry_id", "seq", F.col("question_embedding").alias("vector"), members.alias("members"))
    asked = e.where("entry_id % 20 = 0").withColumnRenamed("entry_id", "ask_id")
    return state.cache_lookup(e, asked, ["owner", "kb", "repository"])


@query("SELECT owner, entry_id FROM cache_entries QUALIFY row_number() OVER (PARTITION BY owner ORDER BY seq DESC, entry_id DESC) <= 128")
def cache_fifo(spark, sf):
    return state.cache_kept(table(spark, sf, "cache_entries"), ["owner"], ["seq", "entry_id"]).select("owner", "entry_id")


@query("SELECT event_type, user_id, CAST(n AS BIGINT) AS accesses FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY max(ts) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) WHERE r <= 128")
def cache_lru(spark, sf):
    return state.lru_kept(table(spark, sf, "events"), ["event_type"], "user_id", "ts").select("event_type", "user_id", "accesses")


@query(
    """SELECT user_id, CAST(session_no AS BIGINT) AS session_no, epoch_us(min(ts)) AS begins, epoch_us(max(ts)) AS ends, count(*) AS events FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session_no FROM
    (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL)) GROUP BY ALL"""
)
def sessionize(spark, sf):
    s = state.sessions(table(spark, sf, "events"), "user_id", "ts")
    return s.select("user_id", "session_no", F.unix_micros(F.col("begins").cast("timestamp")).alias("begins"), F.unix_micros(F.col("ends").cast("timestamp")).alias("ends"), "events")


@query("SELECT user_id FROM events GROUP BY user_id HAVING max(ts) IS NULL OR epoch_us(max(ts)) < (SELECT epoch_us(max(ts)) FROM events) - 1800000000")
def abandoned_sessions(spark, sf):
    return state.abandoned(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts").select("user_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase'")
def pending_state(spark, sf):
    return state.last_operation(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", ["purchase"]).select("user_id", "event_id")


@query("SELECT c_custkey, coalesce(c_mktsegment, 'none') AS segment, 'false' AS crag FROM customer")
def settings_merge(spark, sf):
    stored = F.when(F.col("c_mktsegment").isNotNull(), F.create_map(F.lit("segment"), "c_mktsegment"))
    s = table(spark, sf, "customer").select("c_custkey", state.settings(stored, {"segment": "none", "crag": "false"}).alias("s"))
    return s.select("c_custkey", F.col("s")["segment"].alias("segment"), F.col("s")["crag"].alias("crag"))


# ---- sources


@query(
    """SELECT event_id, CAST(i AS INT) AS window_no, round(i * hop, 6) AS start_seconds, round(least(i * hop + 10, d), 6) AS end_seconds FROM (SELECT event_id, d, hop, unnest(range(0, greatest(CAST(ceil(d / hop) AS BIGINT), 1))) AS i FROM
    (SELECT event_id, d, greatest(10.0, d / 60) AS hop FROM (SELECT event_id, CAST(value AS DOUBLE) AS d FROM events WHERE value > 0)))"""
)
def clip_windows(spark, sf):
    return media.windows(table(spark, sf, "events"), "event_id", "value")


@query(
    """SELECT user_id, string_agg('[' || printf('%02d:%02d', CAST(floor(value) AS BIGINT) // 60, CAST(floor(value) AS BIGINT) % 60) || '] ' || event_type, chr(10) ORDER BY value, event_type, event_id) AS transcript FROM events WHERE value >= 0 AND value < 3600 GROUP BY user_id"""
)
def media_timeline(spark, sf):
    e = table(spark, sf, "events").where("value >= 0 and value < 3600").withColumn("source", F.struct("event_type", "event_id"))
    return media.timeline(e, ["user_id"], "value", "source", "event_type")


@query(
    r"""SELECT record_id, CAST(i - 1 AS INT) AS image_no, a[i] AS alt_text, u[i] AS image_url FROM (SELECT record_id, a, u, unnest(range(1, len(a) + 1)) AS i FROM (SELECT record_id, regexp_extract_all(t, '\[Image: ([^\]]*)\] \(([^)]*)\)', 1) AS a, regexp_extract_all(t, '\[Image: ([^\]]*)\] \(([^)]*)\)', 2) AS u
    FROM (SELECT record_id, '[Image: ' || coalesce(file_name, 'file') || '] (' || coalesce(url, 'local') || ') and [Image: page] (https://x.example/' || CAST(record_id AS VARCHAR) || ')' AS t FROM loaded_documents)))"""
)
def image_markers(spark, sf):
    t = F.concat(F.lit("[Image: "), F.coalesce("file_name", F.lit("file")), F.lit("] ("), F.coalesce("url", F.lit("local")), F.lit(") and [Image: page] (https://x.example/"), F.col("record_id").cast("string"), F.lit(")"))
    return html.image_records(table(spark, sf, "loaded_documents").select("record_id", t.alias("t")), ["record_id"], "t")


@query(
    f"""SELECT chunk_id, CASE {' '.join(f"WHEN n = '{k}' THEN '{v}'" for k, v in files.FILE_LANGUAGES.items())} ELSE CASE lower(regexp_extract(n, '[^.](\\.[^.]*)$', 1)) {' '.join(f"WHEN '{s}' THEN '{v}'" for s, v in files.LANGUAGES.items())} END END AS language,
    len(list_intersect(string_split(p, '/'), [{_quoted(files.EXCLUDED_DIRS)}])) > 0 AS excluded FROM (SELECT chunk_id, file_path AS p, string_split(file_path, '/')[-1] AS n FROM chunks WHERE file_path IS NOT NULL)"""
)
def repository_files(spark, sf):
    p = F.col("file_path")
    inside = F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(d) for d in files.EXCLUDED_DIRS]))
    return table(spark, sf, "chunks").where("file_path is not null").select("chunk_id", files.language_of(p).alias("language"), inside.alias("excluded"))


@query("SELECT CAST(entry_id AS BIGINT) AS entry_id, '# #' || CAST(entry_id AS VARCHAR) || ': ' || coalesce(question, '') || chr(10) || 'State: open' || chr(10) || chr(10) || CASE WHEN coalesce(trim(answer), '') = '' THEN '(no description provided)' ELSE trim(answer) END AS text FROM cache_entries")
def activity_text(spark, sf):
    return table(spark, sf, "cache_entries").select("entry_id", files.activity_text(F.col("entry_id"), F.col("question"), F.lit("open"), F.col("answer")).alias("text"))


@query("SELECT item_id, question, coalesce(len(expected_document_ids), 0) AS documents FROM eval_items WHERE trim(question) <> ''")
def eval_jsonl(spark, sf):
    line = F.to_json(F.struct("question", "kb", "expected_answer", "expected_document_ids", "expected_chunk_ids", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("notes")))
    items = files.eval_items(table(spark, sf, "eval_items").select(line.alias("line")), "line")
    return items.select(F.regexp_extract("notes", r"item (\d+)", 1).cast("int").alias("item_id"), "question", F.size("expected_document_ids").cast("bigint").alias("documents"))


@query("SELECT record_id, regexp_replace(url, '^(crawl-js|crawl|js):', '') AS url, record_id % 3 = 0 AS crawl, record_id % 3 = 1 AS browser FROM loaded_documents WHERE url IS NOT NULL")
def url_list(spark, sf):
    mark = F.when(F.col("record_id") % 3 == 0, "crawl:").when(F.col("record_id") % 3 == 1, "js:").otherwise("")
    lines = table(spark, sf, "loaded_documents").where("url is not null").select(F.concat(mark, F.col("url"), F.lit("#"), F.col("record_id").cast("string")).alias("line"))
    u = files.url_modes(lines, "line")
    return u.select(F.element_at(F.split("url", "#"), -1).cast("bigint").alias("record_id"), F.regexp_replace("url", r"#\d+$", "").alias("url"), "crawl", "browser")


# ---- replies of models


@query(
    """SELECT result_id, CAST(i AS INT) AS index, CASE WHEN i = 0 THEN CASE WHEN faithfulness >= 0.8 THEN 'correct' WHEN faithfulness >= 0.5 THEN 'partial' WHEN faithfulness IS NULL THEN 'correct' ELSE 'incorrect' END ELSE 'correct' END AS relevance, i = 0 AS graded FROM (SELECT result_id, faithfulness, unnest([0, 1, 2]) AS i FROM item_results)"""
)
def crag_parsing(spark, sf):
    grade = F.when(F.col("faithfulness") >= 0.8, "CORRECT").when(F.col("faithfulness") >= 0.5, "partial").when(F.col("faithfulness").isNull(), "unknown").otherwise("incorrect")
    raw = F.concat(F.lit('```json\n{"overall": "x", "chunks": [{"index": 0, "relevance": "'), grade, F.lit('"}, {"index": 0, "relevance": "incorrect"}, {"index": 9, "relevance": "incorrect"}]}\n```'))
    return replies.verdicts(table(spark, sf, "item_results").select("result_id", raw.alias("raw"), F.lit(3).alias("n")), "result_id", "raw", "n")


@query("SELECT entry_id, question || '|' || 'about ' || lower(question) AS variants FROM cache_entries WHERE question IS NOT NULL")
def query_variants(spark, sf):
    raw = F.to_json(F.struct(F.upper("question").alias("rewrite"), F.lit(False).alias("is_complex"), F.array(F.lit("unused")).alias("sub_queries"), F.array(F.concat(F.lit(" about "), F.lower("question")), F.col("question")).alias("paraphrases")))
    return table(spark, sf, "cache_entries").where("question is not null").select("entry_id", F.array_join(replies.variants(F.trim("question"), raw), "|").alias("variants"))


@query("SELECT result_id, round(CASE WHEN faithfulness IS NULL THEN 0.5 ELSE least(1, greatest(0, faithfulness * 2 - 0.5)) END, 6) AS faithfulness, round(least(CASE WHEN faithfulness IS NULL THEN 0.5 ELSE least(1, greatest(0, faithfulness * 2 - 0.5)) END, coalesce(answer_relevance, 0.5), 0.5), 6) AS least FROM item_results")
def critique_parsing(spark, sf):
    score = lambda c: F.concat(F.lit('{"score": '), F.coalesce(c.cast("string"), F.lit('"none"')), F.lit("}"))
    raw = F.concat(F.lit('{"faithfulness": '), score(F.col("faithfulness") * 2 - 0.5), F.lit(', "relevance": '), score(F.col("answer_relevance")), F.lit("}"))
    c = table(spark, sf, "item_results").select("result_id", replies.critique(raw).alias("c"))
    return c.select("result_id", F.round("c.faithfulness", 6).alias("faithfulness"), F.round("c.least", 6).alias("least"))


@query("SELECT entry_id, CASE WHEN entry_id % 2 = 0 AND question IS NOT NULL THEN 'resolved ' || question ELSE question END AS question FROM cache_entries")
def contextualised(spark, sf):
    raw = F.when(F.col("entry_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("resolved "), "question").alias("standalone_question")))).otherwise("no json")
    return table(spark, sf, "cache_entries").select("entry_id", replies.standalone(F.col("question"), raw).alias("question"))


@query("SELECT result_id, CASE WHEN error IS NOT NULL THEN 'Needs review' WHEN faithfulness IS NOT NULL THEN 'Verified' ELSE 'Unverified' END AS pill FROM item_results")
def insight_pill(spark, sf):
    r = table(spark, sf, "item_results")
    return r.select("result_id", replies.pill(F.lit(None).cast("string"), F.col("error").isNotNull(), F.col("faithfulness").isNotNull()).alias("pill"))


# ---- listings, lookups, deletes and sources


@query("SELECT owner, document_id, chunk_id, kb FROM (SELECT c.*, row_number() OVER (PARTITION BY c.owner, c.document_id ORDER BY c.kb, c.chunk_index, c.chunk_id) AS r FROM chunks c WHERE EXISTS (SELECT 1 FROM loaded_documents d WHERE d.owner = c.owner AND d.document_id = c.document_id)) WHERE r = 1")
def point_lookup(spark, sf):
    c = table(spark, sf, "chunks").select("owner", "document_id", "chunk_id", "kb", "chunk_index")
    return listing.first_chunks(c, table(spark, sf, "loaded_documents"), ["kb", "chunk_index", "chunk_id"]).select("owner", "document_id", "chunk_id", "kb")


@query("SELECT chunk_id FROM chunks WHERE content_type = 'table' AND owner = (SELECT min(owner) FROM chunks)")
def chunks_of_type(spark, sf):
    c = table(spark, sf, "chunks")
    return listing.of_type(c, c.agg(F.min("owner")).first()[0] or "", "table").select("chunk_id")


@query("SELECT record_id FROM loaded_documents WHERE contains(lower(url), 'docs') OR contains(lower(file_name), 'docs')")
def inspect_pages(spark, sf):
    return listing.inspect(table(spark, sf, "loaded_documents"), "Docs").select("record_id")


@query("SELECT coalesce(owner, 'local') || '::' || url AS key, max(record_id) AS record_id FROM loaded_documents WHERE url IS NOT NULL GROUP BY ALL")
def image_upsert(spark, sf):
    new = table(spark, sf, "loaded_documents").where("url is not null").select("owner", F.col("url").alias("image_url"), "record_id")
    half = F.col("record_id") % 2 == 0  # stored before, and written now
    return maintenance.upsert_images(maintenance.upsert_images(None, new.where(half), ["record_id"]), new.where(~half), ["record_id"]).select("key", "record_id")


@query("SELECT chunk_id, coalesce(owner, 'local') || '::' || document_id || '::clip_' || CAST(chunk_index * 10 AS VARCHAR) AS key FROM chunks WHERE document_id IS NOT NULL")
def clip_keys(spark, sf):
    return table(spark, sf, "chunks").where("document_id is not null").select("chunk_id", maintenance.clip_key(F.col("owner"), F.col("document_id"), F.col("chunk_index") * 10).alias("key"))


@query(
    """WITH g AS (SELECT DISTINCT owner, document_id FROM loaded_documents WHERE source_type = 'audio' AND owner IS NOT NULL AND document_id IS NOT NULL), i AS (SELECT owner, url, document_id AS video FROM loaded_documents)
    SELECT 'chunks' AS name, count(*) AS n FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.owner = c.owner AND g.document_id = c.document_id) UNION ALL
    SELECT 'images', count(*) FROM i WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.owner = i.owner AND g.document_id = i.video) AND NOT EXISTS (SELECT 1 FROM g WHERE g.owner = i.owner AND g.document_id = i.url) UNION ALL
    SELECT 'removed', count(*) FROM chunks c WHERE EXISTS (SELECT 1 FROM g WHERE g.owner = c.owner AND g.document_id = c.document_id)"""
)
def document_delete(spark, sf):
    d = table(spark, sf, "loaded_documents")
    images = d.select("owner", F.col("url").alias("page_url"), F.col("document_id").alias("video_document_id"))
    left, removed = maintenance.delete_documents({"chunks": table(spark, sf, "chunks"), "images": images}, d.where("source_type = 'audio'"))
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count(left["chunks"], "chunks").unionByName(count(left["images"], "images")).unionByName(removed.agg(F.lit("removed").alias("name"), F.coalesce(F.sum("removed"), F.lit(0)).alias("n")))


_FILES = f"""SELECT chunk_id, owner, repository, file_path, CASE {' '.join(f"WHEN n = '{k}' THEN '{v}'" for k, v in files.FILE_LANGUAGES.items())} ELSE CASE lower(regexp_extract(n, '[^.](\\.[^.]*)$', 1)) {' '.join(f"WHEN '{s}' THEN '{v}'" for s, v in files.LANGUAGES.items())} END END AS language
    FROM (SELECT *, string_split(file_path, '/')[-1] AS n FROM chunks WHERE file_path IS NOT NULL AND repository IS NOT NULL AND strlen(content) <= 200000 AND len(list_intersect(string_split(file_path, '/'), [{_quoted(files.EXCLUDED_DIRS)}])) = 0) WHERE n NOT IN ({_quoted(files.EXCLUDED_FILES)})"""


@query(f"SELECT chunk_id, language FROM ({_FILES}) WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner, repository ORDER BY file_path, chunk_id) <= 300")
def repository_scan(spark, sf):
    c = table(spark, sf, "chunks").where("file_path is not null and repository is not null").select("chunk_id", "owner", "repository", "file_path", F.octet_length("content").alias("size"))
    return files.repository_scan(c, "file_path", "size", ["owner", "repository"], tie="chunk_id").select("chunk_id", "language")


@query(
    r"""SELECT query_id, CAST(rank AS INT) AS rank, sha, 'Commit ' || substring(sha, 1, 7) || ' by ' || author || ' on ' || day || chr(10) || chr(10) || coalesce(answer, '') AS content FROM (SELECT q.entry_id AS query_id, e.*, row_number() OVER (PARTITION BY q.entry_id ORDER BY day DESC NULLS LAST, sha) AS rank FROM
    (SELECT min(entry_id) AS entry_id, repository FROM cache_entries WHERE repository IS NOT NULL GROUP BY repository) q JOIN (SELECT repository, md5(CAST(entry_id AS VARCHAR)) AS sha, coalesce(owner, 'unknown') AS author, coalesce(CAST(CAST(cached_at AS DATE) AS VARCHAR), 'unknown date') AS day, answer FROM cache_entries) e ON e.repository = q.repository) WHERE rank <= 5"""
)
def commit_history(spark, sf):
    e = table(spark, sf, "cache_entries")
    commits = e.select("repository", F.md5(F.col("entry_id").cast("string")).alias("sha"), F.col("owner").alias("author"), F.coalesce(F.to_date("cached_at").cast("string"), F.lit("unknown date")).alias("at"), F.col("answer").alias("message"), F.array().cast("array<string>").alias("paths"))
    asked = e.where("repository is not null").groupBy("repository").agg(F.min("entry_id").alias("query_id"), F.lit("what changed last").alias("text"))
    return files.history(commits, asked)


@query("SELECT 'world' AS tree, CAST(row_number() OVER (ORDER BY r_name, n_name NULLS FIRST) - 1 AS INT) AS place, CASE WHEN n_name IS NULL THEN 'r' || r_regionkey ELSE 'n' || n_nationkey END AS topic, coalesce(n_name, r_name) AS label FROM (SELECT r_regionkey, r_name, NULL AS n_name, NULL AS n_nationkey FROM region UNION ALL SELECT r_regionkey, r_name, n_name, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey)")
def topic_tree(spark, sf):
    place = lambda name: F.dense_rank().over(Window.orderBy(name))  # noqa: E731 -- a contents tree of thirty nodes
    node = lambda df, kind, key, parent, name: df.select(F.lit("world").alias("tree"), F.concat(F.lit(kind), key).alias("node"), parent.alias("parent"), place(name).alias("position"), F.concat(F.lit(kind), key).alias("topic"), F.col(name).alias("label"))
    top = node(table(spark, sf, "region"), "r", "r_regionkey", F.lit(None).cast("string"), "r_name")
    return files.topics(top.unionByName(node(table(spark, sf, "nation"), "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), "n_name")))


@query(
    """WITH r AS (SELECT item_id, answer, error FROM item_results QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY result_id) = 1), x AS (SELECT item_id, list_distinct(expected_document_ids) AS e, item_id % 2 = 0 AS got FROM eval_items),
    j AS (SELECT x.item_id, CASE WHEN answer IS NULL AND error IS NULL THEN 'no answer' ELSE error END AS error, CASE WHEN e IS NULL OR len(e) = 0 THEN NULL WHEN got THEN 1.0 ELSE 0.0 END AS s FROM x LEFT JOIN r USING (item_id))
    SELECT item_id, error, CAST(CASE WHEN error IS NULL THEN s END AS DOUBLE) AS hit_rate, CAST(CASE WHEN error IS NULL THEN s END AS DOUBLE) AS mrr, CAST(CASE WHEN error IS NULL THEN s END AS DOUBLE) AS recall FROM j"""
)
def evaluation_run(spark, sf):
    items = table(spark, sf, "eval_items").select("item_id", "expected_document_ids")
    got = items.where("item_id % 2 = 0").select("item_id", F.posexplode("expected_document_ids").alias("p", "document_id")).select("item_id", "document_id", (F.col("p") + 1).alias("rank"))
    first = ranking.first_wins(table(spark, sf, "item_results"), ["item_id"], ["result_id"]).select("item_id", "answer", "error")
    return evaluation.evaluation_run(items, got, first, k=1000).select("item_id", "error", "hit_rate", "mrr", "recall")


@query("SELECT regexp_replace(regexp_replace(lower(run_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, '| ' || run_id || ' | ' || n || ' | ' || coalesce(printf('%.3f', f), '—') || ' |' AS line FROM (SELECT run_id, count(*) AS n, round(avg(faithfulness), 6) AS f FROM item_results GROUP BY run_id)")
def report_lines(spark, sf):
    r = table(spark, sf, "item_results").groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg("faithfulness"), 6).alias("f"))
    return evaluation.report_rows(r, F.col("run_id"))


@query(
    f"""SELECT owner, entry_id, chunk_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner, entry_id ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT c.owner, entry_id, chunk_id, {_COS.format('embedding', 'question_embedding')} AS similarity
    FROM chunks c JOIN cache_entries e ON c.owner = e.owner WHERE c.kb = 'audio' AND entry_id % 20 = 0 AND {_REAL.format('embedding')} AND {_REAL.format('question_embedding')})) WHERE rank <= 3"""
)
def clip_topk(spark, sf):
    asked = table(spark, sf, "cache_entries").where("entry_id % 20 = 0").select("owner", "entry_id", "question_embedding")
    clips = filters.where(table(spark, sf, "chunks"), {"kb": "audio"})
    return ranking.dense(clips, "chunk_id", "embedding", asked, "entry_id", "question_embedding", scope=["owner"], k=3)


# ---- decisions and the search over three lists

_ROUTE_NAMES, _BASE_NAMES = [*routing.ROUTES], [*routing.BASES]


def _dealt(names: list[str], column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} % {len(names)} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _rules(keywords: dict[str, list[str]]) -> str:
    """The labels whose keywords occur in ``t``."""
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join('contains(t, ' + _quoted([w]) + ')' for w in ws)} THEN '{k}' END" for k, ws in keywords.items()) + "], lambda x: x IS NOT NULL)"


_SCORES = f"SELECT e.entry_id, l.label, max({_COS.format('l.embedding', 'e.question_embedding')}) AS score FROM embeddings l, cache_entries e WHERE e.entry_id % 20 = 0 AND {_REAL.format('l.embedding')} AND {_REAL.format('e.question_embedding')} GROUP BY ALL"


@query(
    f"""WITH s AS ({_SCORES}), rs AS (SELECT entry_id, {_dealt(_ROUTE_NAMES, 'label')} AS label, max(score) AS score FROM s GROUP BY ALL), bs AS (SELECT entry_id, {_dealt(_BASE_NAMES, 'label')} AS label, max(score) AS score FROM s GROUP BY ALL),
    q AS (SELECT entry_id, {_rules(routing.ROUTES)} AS rr, {_rules(routing.BASES)} AS rb FROM (SELECT entry_id, ' ' || lower(coalesce(question, '')) || ' ' AS t FROM cache_entries WHERE entry_id % 20 = 0)),
    nr AS (SELECT entry_id, list(label) AS n FROM rs WHERE score >= 0.4 GROUP BY entry_id), nb AS (SELECT entry_id, list(label) AS n FROM (SELECT *, max(score) OVER (PARTITION BY entry_id) AS best FROM bs) WHERE score >= 0.2 AND score >= 0.7 * best GROUP BY entry_id)
    SELECT q.entry_id, array_to_string(list_sort(list_distinct(list_concat(rr, coalesce(nr.n, []), ['general']))), ',') AS routes, array_to_string(list_sort(list_distinct(list_concat(rb, coalesce(nb.n, [])))), ',') AS bases,
      CASE WHEN len(rr) + len(rb) > 0 AND (nr.n IS NOT NULL OR nb.n IS NOT NULL) THEN 'both' WHEN len(rr) + len(rb) > 0 THEN 'rule' WHEN nr.n IS NOT NULL OR nb.n IS NOT NULL THEN 'semantic' ELSE 'neither' END AS method
    FROM q LEFT JOIN nr USING (entry_id) LEFT JOIN nb USING (entry_id)"""
)
def route_decision(spark, sf):
    """Routes and bases of questions; the exemplars of the routes and bases are the labelled embeddings, dealt out to them."""
    asked = table(spark, sf, "cache_entries").where("entry_id % 20 = 0")
    scores = ranking.group_similarity(table(spark, sf, "embeddings"), "label", "embedding", asked, "entry_id", "question_embedding")
    named = lambda names: scores.withColumn("label", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("label") % len(names) + 1)).groupBy("entry_id", "label").agg(F.max("score").alias("score"))
    d = routing.decide(asked, "entry_id", "question", named(_ROUTE_NAMES), named(_BASE_NAMES))
    return d.select("entry_id", F.array_join("routes", ",").alias("routes"), F.array_join("bases", ",").alias("bases"), "method")


_PLACES = "CASE label " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(routing.PRIORITY)) + " END"
_MADE = "round(CAST(CAST('0x' || substring(md5(CAST(entry_id AS VARCHAR) || label), 1, 4) AS INT) AS DOUBLE) / 65535.0, 3)"


@query(
    f"""WITH q AS (SELECT entry_id, {_rules(routing.INTENTS)} AS rules FROM (SELECT entry_id, ' ' || lower(coalesce(question, '')) || ' ' AS t FROM cache_entries)), c AS (SELECT entry_id, rules, unnest([{_quoted(routing.PRIORITY)}]) AS label FROM q),
    s AS (SELECT entry_id, label, list_contains(rules, label) AS ruled, len(rules) > 0 AS any_rule, {_MADE} AS score FROM c), k AS (SELECT *, score + CASE WHEN ruled THEN 0.15 ELSE 0 END AS rated FROM s WHERE CASE WHEN any_rule THEN ruled ELSE score >= 0.4 END),
    n AS (SELECT * FROM (SELECT *, max(rated) OVER (PARTITION BY entry_id) AS best FROM k) WHERE rated >= best - 0.03)
    SELECT entry_id AS query_id, label AS intent FROM n QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY CAST(ruled AS INT) DESC, {_PLACES}, label) = 1"""
)
def intent_decision(spark, sf):
    """One intent a question; similarities are made up of a digest, as there are no exemplars."""
    q = table(spark, sf, "cache_entries").select(F.col("entry_id").alias("query_id"), F.col("question").alias("text"))
    each = q.select("query_id", F.explode(F.array(*[F.lit(p) for p in routing.PRIORITY])).alias("label"))
    made = F.round(F.conv(F.substring(F.md5(F.concat(F.col("query_id").cast("string"), "label")), 1, 4), 16, 10).cast("int") / 65535.0, 3)
    return pipelines.intents(q, each.withColumn("score", made))


_KIDS60 = f"""SELECT entry_id, owner, document_id, parent_chunk_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner, entry_id ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT c.owner, c.document_id, c.parent_chunk_index, entry_id, chunk_id, {_COS.format('embedding', 'question_embedding')} AS similarity
    FROM chunks c JOIN cache_entries e ON c.owner = e.owner WHERE c.chunk_role = 'child' AND c.kb IN ('github', 'web') AND entry_id % 20 = 0 AND question IS NOT NULL AND {_REAL.format('embedding')} AND {_REAL.format('question_embedding')})) WHERE rank <= 60"""
_PARENTS = f"""SELECT entry_id, p.chunk_id, row_number() OVER (PARTITION BY entry_id ORDER BY child_rank) AS rank FROM (SELECT entry_id, owner, document_id, parent_chunk_index, min(rank) AS child_rank FROM ({_KIDS60}) GROUP BY ALL) k JOIN
    (SELECT owner, document_id, chunk_index, max(chunk_id) AS chunk_id FROM chunks WHERE chunk_role = 'parent' AND kb IN ('github', 'web') GROUP BY ALL) p ON p.owner = k.owner AND p.document_id = k.document_id AND p.chunk_index = k.parent_chunk_index"""


@query(f"SELECT entry_id AS query_id, chunk_id, rrf, position FROM ({_rrf_sql([_DENSE40, _BM40, _PARENTS])}) WHERE entry_id IN (SELECT entry_id FROM cache_entries WHERE question IS NOT NULL)")
def hybrid_parents(spark, sf):
    """Similarity, terms and the parents of similar children, fused."""
    got = pipelines.hybrid(table(spark, sf, "chunks"), _asked(spark, sf), ["owner"], parents=True, index=_index(spark, sf, "chunks", ["owner"]))
    return got.select("query_id", "chunk_id", "rrf", "position")


_SCOPED40 = _bm25_sql("chunks", "chunk_id", "content", "(SELECT owner, kb, entry_id, question AS asked FROM ask)", "entry_id", 40, "owner, kb,").replace("SELECT entry_id, term, count(*) AS qtf FROM (SELECT entry_id, unnest", "SELECT owner, kb, entry_id, term, count(*) AS qtf FROM (SELECT owner, kb, entry_id, unnest").replace("JOIN q USING (term)", "JOIN q USING (owner, kb, term)")


def _nearest_sql(extra: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, kb, entry_id ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT c.owner, c.kb, entry_id, chunk_id, document_id, parent_chunk_index, {_COS.format('embedding', 'question_embedding')} AS similarity
      FROM chunks c JOIN ask ON c.owner = ask.owner AND c.kb = ask.kb WHERE {extra} AND {_REAL.format('embedding')} AND {_REAL.format('question_embedding')})) WHERE rank <= {k}"""


def _whole_sql(hits: str, part: str, whole: str, link: str) -> str:
    return f"""(SELECT entry_id, id, rank, similarity FROM (SELECT h.entry_id, h.rank, CASE WHEN put THEN whole ELSE h.id END AS id, CASE WHEN put THEN NULL ELSE h.similarity END AS similarity, put FROM
      (SELECT h.*, w.whole, coalesce(c.content_type = '{part}' AND w.whole IS NOT NULL, false) AS put FROM {hits} h JOIN chunks c ON c.chunk_id = h.id LEFT JOIN (SELECT owner || '::' || {link} AS link, min(chunk_id) AS whole FROM chunks WHERE content_type = '{whole}' AND owner IS NOT NULL AND {link} IS NOT NULL GROUP BY ALL) w ON w.link = c.owner || '::' || c.{link}) h)
      QUALIFY row_number() OVER (PARTITION BY entry_id, id ORDER BY put, rank) = 1)"""


@query(
    f"""WITH qs AS (SELECT owner, entry_id, question, question_embedding, {_rules(routing.BASES)} AS named FROM (SELECT *, ' ' || lower(question) || ' ' AS t FROM cache_entries WHERE entry_id % 20 = 0 AND question IS NOT NULL)),
    tg AS (SELECT owner, entry_id, unnest(named) AS kb FROM qs UNION ALL SELECT qs.owner, entry_id, p.kb FROM qs JOIN (SELECT DISTINCT owner, kb FROM chunks) p ON p.owner = qs.owner WHERE len(named) = 0),
    ask AS (SELECT tg.owner, tg.kb, tg.entry_id, question, question_embedding FROM tg JOIN qs ON qs.entry_id = tg.entry_id AND qs.owner = tg.owner), near AS ({_nearest_sql('true', 40)}), told AS ({_SCOPED40}), kids AS ({_nearest_sql("c.chunk_role = 'child' AND c.kb IN ('github', 'web')", 60)}),
    pk AS (SELECT k.owner, k.kb, entry_id, p.chunk_id, row_number() OVER (PARTITION BY k.owner, k.kb, entry_id ORDER BY child_rank) AS rank FROM (SELECT owner, kb, entry_id, document_id, parent_chunk_index, min(rank) AS child_rank FROM kids GROUP BY ALL) k JOIN
      (SELECT owner, kb, document_id, chunk_index, max(chunk_id) AS chunk_id FROM chunks WHERE chunk_role = 'parent' AND kb IN ('github', 'web') GROUP BY ALL) p ON p.owner = k.owner AND p.kb = k.kb AND p.document_id = k.document_id AND p.chunk_index = k.parent_chunk_index),
    li AS (SELECT 0 AS list, owner, kb, entry_id, chunk_id, rank FROM near UNION ALL SELECT 1, owner, kb, entry_id, chunk_id, rank FROM told UNION ALL SELECT 2, owner, kb, entry_id, chunk_id, rank FROM pk),
    fu AS (SELECT owner, kb, entry_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(list) AS first_list, arg_min(rank, list) AS first_rank FROM li GROUP BY ALL),
    po AS (SELECT *, row_number() OVER (PARTITION BY owner, kb, entry_id ORDER BY rrf DESC, first_list, first_rank, chunk_id) AS position FROM fu QUALIFY position <= 20),
    full_ AS (SELECT po.*, near.similarity, c.document_id, c.chunk_index, coalesce(c.section, '') AS section, coalesce(c.file_path, '') AS file_path, {_SEARCH.format('question')} AS qt, {_SEARCH.format("coalesce(c.content, '')")} AS ct FROM po LEFT JOIN near USING (owner, kb, entry_id, chunk_id) JOIN chunks c ON c.chunk_id = po.chunk_id JOIN qs ON qs.entry_id = po.entry_id),
    best AS (SELECT *, row_number() OVER (PARTITION BY kb, entry_id ORDER BY CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / len(qt) ELSE 0.0 END DESC, position, chunk_id) AS base_rank FROM full_ QUALIFY base_rank <= 5),
    once AS (SELECT * FROM best QUALIFY document_id IS NULL OR chunk_index IS NULL OR row_number() OVER (PARTITION BY entry_id, document_id, chunk_index ORDER BY kb, base_rank) = 1),
    title AS (SELECT *, round(coalesce(similarity, 0) + CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, {_SEARCH.format('section')})) / len(qt) + CASE WHEN readme THEN 1 ELSE 0 END + CASE WHEN readme AND NOT contains(section, ' > ') THEN 1 ELSE 0 END ELSE 0 END, 6) AS final FROM
      (SELECT *, len(list_intersect(qt, [{_quoted(ranking.OVERVIEW)}])) > 0 AND lower(string_split(file_path, '/')[-1]) IN ({_quoted(ranking.READMES)}) AS readme FROM once)),
    hits AS (SELECT entry_id, chunk_id AS id, final AS similarity, row_number() OVER (PARTITION BY entry_id ORDER BY final DESC, kb, base_rank, chunk_id) AS rank FROM title QUALIFY rank <= 5),
    whole AS (SELECT * FROM {_whole_sql('hits', 'table_row', 'table', 'table_id')})
    SELECT entry_id AS query_id, id AS chunk_id, similarity AS score, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY rank, id) AS INT) AS rank FROM {_whole_sql('whole', 'method', 'class', 'class_id')}"""
)
def multi_base_retrieve(spark, sf):
    return pipelines.retrieve(table(spark, sf, "chunks"), _asked(spark, sf))
