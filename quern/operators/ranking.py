"""Ranked retrieval: lexical, dense, fused and re-ranked, all keyed by query so that a batch of queries is one job.

Every order ends in a unique key, so equal scores have one order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.session import spread

#: Okapi parameters: saturation, length, and the share of the mean idf that a negative idf is raised to.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Most query terms that are broadcast.
TERMS = 100_000
#: Most queries, about, that are sent out at a time.
BLOCK = 2000
#: Rank constant of the fusion.
RRF_K = 60


def top(df: DataFrame, by: list[str], score: str | Column, key: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` best rows of each group, ties by ``key``. Spark limits each partition before the shuffle."""
    order = [F.desc(score) if isinstance(score, str) else score, *key]
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def corpus_statistics(docs: DataFrame, key: str, text: str, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """``lengths`` (scope, key, dl) of every document, empty ones included, and ``totals`` (scope, n, avgdl)."""
    lengths = docs.select(*scope, key, F.coalesce(F.size(T.lexical_tokens(F.col(text))), F.lit(0)).alias("dl"))
    lengths = lengths.withColumn("dl", F.greatest("dl", F.lit(0)))
    totals = lengths.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return lengths, totals


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, *, scope: list[str] | None = None, only: DataFrame | None = None, k: int = 40) -> DataFrame:
    """Okapi BM25: (scope, query, document, score rounded to 6, rank) for the ``k`` best documents of each query.

    ``scope`` columns partition the index; statistics and queries stay within a
    scope (each query is asked in every scope of which ``queries`` has no columns).
    ``only`` (query, document), each pair once, says among which documents a query's best are taken; the statistics stay those of the scope.
    Only documents that share a term with the query are returned; a term repeated
    in the query counts again. The mean idf that floors negative ones is over the
    scope's whole vocabulary, so the vocabulary is counted in full; scores are
    only computed for postings of query terms.
    """
    scope = scope or []
    asked = queries.select(query_key, *[c for c in scope if c in queries.columns], F.explode(T.lexical_tokens(F.col(query_text))).alias("term"))
    asked = asked.groupBy(*asked.columns).agg(F.count("*").alias("qtf"))
    tokens = spread(docs.select(*scope, key, text)).select(*scope, key, T.lexical_tokens(F.col(text)).alias("tokens")).withColumn("dl", F.greatest(F.size("tokens"), F.lit(0)))
    totals = tokens.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # a document counts once for a term, so its distinct terms are counted where it stands: only terms are shuffled
    df = tokens.select(*scope, F.explode(F.array_distinct("tokens")).alias("term")).groupBy(*scope, "term").agg(F.count("*").alias("df"))
    both = (lambda a, b: a.join(b, scope) if scope else a.crossJoin(F.broadcast(b)))  # without a scope the totals are one row
    idf = both(df, totals).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.groupBy(*scope).agg((F.avg("idf") * EPSILON).alias("floor"))
    idf = both(idf, mean).withColumn("idf", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).select(*scope, "term", "idf", "avgdl")
    weight = asked.join(idf, ["term", *[c for c in scope if c in queries.columns]])
    # postings of the asked terms only; a small set of terms is sent to the documents, a large one joined
    terms = asked.select("term").distinct()
    if terms.limit(TERMS + 1).count() <= TERMS:
        terms = F.broadcast(terms)
    tf = tokens.select(*scope, key, "dl", F.explode("tokens").alias("term")).join(terms, "term").groupBy(*scope, key, "dl", "term").agg(F.count("*").alias("tf"))
    length = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    hits = tf.join(weight, [*scope, "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + length)
    scored = hits.groupBy(*scope, query_key, key).agg(F.round(F.sum(part), 6).alias("score"))
    if only is not None:
        scored = scored.join(only.select(query_key, key), [query_key, key], "left_semi")
    return top(scored, [*scope, query_key], "score", [key], k)


def in_blocks(rows: DataFrame, queries: DataFrame, query_key: str, scope: list[str], carried: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with each query of their scope: (columns of rows, query_key, carried).

    The queries are a stated set. They go out in blocks of about ``block`` rows, numbered by a hash, a scope's queries of a block in one row
    each, so that what is broadcast at a time is bounded, and the rows, of which one scope may hold a third, are not shuffled.
    """
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.select(*scope, query_key, *carried).withColumn("_block", F.pmod(F.xxhash64(query_key), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        asked = F.broadcast(numbered.where(F.col("_block") == b).groupBy(*scope).agg(F.collect_list(F.struct(query_key, *carried)).alias("_asked")))
        met = rows.join(asked, scope) if scope else rows.crossJoin(asked)
        parts.append(met.select(*rows.columns, F.inline("_asked")))
    return reduce(DataFrame.unionByName, parts)


def dense(docs: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, *, scope: list[str] | None = None, only: DataFrame | None = None, k: int = 40, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """Exact cosine search: (query, document, similarity rounded to 6, rank), the ``k`` best of each query.

    The queries are a stated set, held against all documents, with ``scope`` against those of
    their scope, in blocks: see :func:`in_blocks`. The documents are not shuffled and their partitions keep only their best. With ``only`` (query, document), each pair once,
    a query meets just these documents. Null and zero vectors take no part.
    """
    scope = scope or []
    d = spread(docs.select(*scope, key, F.col(vector).alias("dv"))).where(F.col("dv").isNotNull()).withColumn("dn", V.norm(F.col("dv"))).where("dn > 0")
    q = queries.select(*scope, query_key, F.col(query_vector).alias("qv")).where(F.col("qv").isNotNull()).withColumn("qn", V.norm(F.col("qv"))).where("qn > 0")
    if only is not None:
        pairs = d.join(only.select(query_key, key), key).join(q, [*scope, query_key])
    else:
        pairs = in_blocks(d, q, query_key, scope, ["qv", "qn"], block)
    if exclude_self:
        pairs = pairs.where(F.col(key) != F.col(query_key))
    scored = pairs.select(*scope, query_key, key, F.round(V.cosine(F.col("dv"), F.col("qv"), F.col("dn"), F.col("qn")), 6).alias("similarity"))
    return top(scored, [*scope, query_key], "similarity", [key], k)


def group_similarity(exemplars: DataFrame, label: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, *, own: str | None = None, block: int = BLOCK) -> DataFrame:
    """The greatest similarity of each query to the exemplars of each label: (query, label, score rounded to 6). ``own`` names a key that query and exemplar must differ in."""
    e = spread(exemplars.select(label, *([own] if own else []), F.col(vector).alias("dv"))).where(F.col("dv").isNotNull()).withColumn("dn", V.norm(F.col("dv"))).where("dn > 0")
    q = queries.select(query_key, F.col(query_vector).alias("qv")).where(F.col("qv").isNotNull()).withColumn("qn", V.norm(F.col("qv"))).where("qn > 0")
    pairs = in_blocks(e, q, query_key, [], ["qv", "qn"], block)
    if own:
        pairs = pairs.where(F.col(own) != F.col(query_key))
    return pairs.groupBy(query_key, label).agg(F.max(F.round(V.cosine(F.col("dv"), F.col("qv"), F.col("dn"), F.col("qn")), 6)).alias("score"))


def fuse(lists: list[DataFrame], by: list[str], key: list[str], *, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (by, key, rank): ``rrf`` rounded to 9, ``first_list`` and ``first_rank``, and ``position``.

    A row's score is the sum of 1 / (k + rank) over the lists that have it, its
    best rank in each. Ties go to the earlier list, then the better rank in it.
    """
    marked = [df.select(*by, *key, "rank", F.lit(i).alias("list")) for i, df in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, marked).groupBy(*by, *key, "list").agg(F.min("rank").alias("rank"))
    fused = rows.groupBy(*by, *key).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("rrf"), "first.list", "first.rank", *key)
    return fused.withColumn("position", F.row_number().over(order)).select(*by, *key, "rrf", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"), "position")


# Words of a question about a project as a whole.
OVERVIEW = ["repository", "repo", "project", "overview", "purpose", "summary"]
READMES = ["readme.md", "readme.rst", "readme.txt", "readme"]


def title_score(query: Column, similarity: Column, section: Column, file_path: Column) -> Column:
    """Similarity plus the share of the query's tokens in the section, plus one for a README and one for its beginning where the query asks for an overview."""
    asked = T.search_tokens(query)
    share = F.size(F.array_intersect(asked, T.search_tokens(F.coalesce(section, F.lit(""))))) / F.size(asked)
    name = F.lower(F.element_at(F.split(F.coalesce(file_path, F.lit("")), "/"), -1))
    readme = F.arrays_overlap(asked, F.array(*[F.lit(w) for w in OVERVIEW])) & name.isin(READMES)
    intro = readme & ~F.coalesce(section, F.lit("")).contains(" > ")
    return F.coalesce(similarity, F.lit(0.0)) + F.when(F.size(asked) > 0, share + readme.cast("double") + intro.cast("double")).otherwise(0.0)


def idf_overlap(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """Of each query and document that share a token: the shared tokens' idf over the query's, rounded to 6.

    idf = ln((n + 1) / (df + 1)) + 1 over the documents' distinct search tokens.
    """
    asked = queries.select(query_key, F.explode(T.search_tokens(F.col(query_text))).alias("term"))
    terms = asked.select("term").distinct()
    if terms.limit(TERMS + 1).count() <= TERMS:
        terms = F.broadcast(terms)
    # only asked terms have a weight: the others of a document are dropped where it stands
    tokens = spread(docs.select(key, text)).select(key, F.explode(T.search_tokens(F.col(text))).alias("term")).join(terms, "term", "left_semi")
    df = tokens.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    weight = asked.join(df, "term", "left").crossJoin(F.broadcast(n)).withColumn("idf", F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    total = weight.groupBy(query_key).agg(F.sum("idf").alias("total"))
    hit = tokens.join(weight.select(query_key, "term", "idf"), "term").groupBy(query_key, key).agg(F.sum("idf").alias("shared"))
    return hit.join(total, query_key).select(query_key, key, F.round(F.col("shared") / F.col("total"), 6).alias("overlap"))


def first_wins(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in ``order``; rows with a null in the key are all kept."""
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    first = df.where(named).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.unionByName(df.where(~named))


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``, as an upsert would leave it."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def complete(hits: DataFrame, wholes: DataFrame, by: list[str], part_types: list[str], link: str) -> DataFrame:
    """Hits that are a part replaced by their whole, once; parts whose whole was already found are dropped, others stay.

    ``hits`` (by, rank, id, content_type, link, similarity), ``wholes`` (id,
    link); the result has ``id``, ``rank``, ``similarity`` (null for a whole that was put in) and ``completed``.
    """
    whole = wholes.groupBy(link).agg(F.min("id").alias("whole_id"))
    is_part = F.col("content_type").isin(part_types) & F.col(link).isNotNull()
    joined = hits.join(whole, link, "left")
    put = is_part & F.col("whole_id").isNotNull()
    out = joined.select(*by, "rank", F.when(put, F.col("whole_id")).otherwise(F.col("id")).alias("id"), F.when(put, F.lit(None)).otherwise(F.col("similarity")).alias("similarity"), F.coalesce(put, F.lit(False)).alias("completed"))
    # a whole that was found by itself stands before one that is put in
    w = Window.partitionBy(*by, "id").orderBy(F.col("completed"), "rank")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def parents_of(children: DataFrame, parents: DataFrame, by: list[str], doc: list[str], k: int) -> DataFrame:
    """The parents of ranked child hits, each at its best child's place: inner, so children without a parent go."""
    best = children.groupBy(*by, *doc, "parent_chunk_index").agg(F.min("rank").alias("child_rank"))
    found = best.join(parents.withColumnRenamed("chunk_index", "parent_chunk_index"), [*[c for c in by if c in parents.columns], *doc, "parent_chunk_index"])
    w = Window.partitionBy(*by).orderBy("child_rank")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pack_budget(df: DataFrame, by: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """The rows of each group, in order, until the first that would overflow the budget; the first row is always kept."""
    w = Window.partitionBy(*by).orderBy(*order)
    # more rows of a token or more than the budget has cannot fit: partitions drop them before the shuffle
    counted = F.coalesce(F.col(tokens), F.lit(0)) > 0
    near = df.where(counted).withColumn("_near", F.row_number().over(w)).where(F.col("_near") <= budget + 1).drop("_near").unionByName(df.where(~counted))
    run = near.withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    return run.where((F.col("place") == 1) | (F.col("used") <= budget))


def last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group, numbered ``turn`` from the oldest kept."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    kept = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(order))).drop("_n")


def hash_sample(df: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """``n`` rows of each group in the order of a digest of their key: random, yet the same on every run."""
    return top(df.withColumn("_h", F.md5(F.col(key).cast("string"))), by, F.asc("_h"), [key], n, "_r").drop("_h", "_r")
