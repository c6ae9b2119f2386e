"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import binpacking, boilerplate, knn, leakage, neardup, pairs, pii, splitting
from quern.llm._base import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers with their questions."""
    items = table(spark, sf_dir, "eval_items")
    cache = table(spark, sf_dir, "cache_entries").select(F.lit("cache_entry").alias("record_kind"), F.col("entry_id").alias("record_id"), "question", "answer")
    asked = items.select("item_id", "question")
    result = table(spark, sf_dir, "item_results").join(asked, "item_id", "left").select(F.lit("item_result").alias("record_kind"), F.col("result_id").alias("record_id"), "question", "answer")
    own = items.select(F.lit("eval_item").alias("record_kind"), F.col("item_id").cast("bigint").alias("record_id"), "question", F.col("expected_answer").alias("answer"))
    return cache.unionByName(result).unionByName(own)


def p1_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its defect, if any."""
    return pairs.defects(_pairs(spark, sf_dir), "record_kind", "record_id", "question", "answer").withColumnsRenamed({"kind": "record_kind", "id": "record_id", "defect": "defect_type"})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose answer is no usable reply whatever was asked; an answer to another question is in p1_scored only."""
    return p1_scored(spark, sf_dir).where("defect_type <> 'swapped'").select("record_kind", "record_id", "defect_type")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of both record tables under one schema."""
    of = lambda kind, name, key: table(spark, sf_dir, name).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), "content")
    return of("document", "loaded_documents", "record_id").unionByName(of("chunk", "chunks", "chunk_id"))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.classes(_contents(spark, sf_dir), "record_kind", "record_id", "content", size=3, threshold=0.6, min_words=20, blocks=40, width=3)


def p1_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of each kind were judged, and how many of these have a question."""
    scored = p1_scored(spark, sf_dir).groupBy("record_kind").agg(F.count("*").alias("pairs"), F.count_distinct("record_id").alias("records"), F.count("score").alias("scores"))
    return scored


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share most of their three-word runs."""
    return neardup.pairs(*_near(spark, sf_dir)).select(F.col("kind").alias("record_kind"), "id_a", "id_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near duplicates of every record of at least 20 words, at the default of five words and 0.8."""
    members, links = neardup.classes(_contents(spark, sf_dir), "record_kind", "record_id", "content")
    return neardup.groups(members, links).withColumnsRenamed({"kind": "record_kind", "id": "record_id"})


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loaded_documents").where("source_type = 'web'")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of web pages that are the site's furniture."""
    lines = boilerplate.page_lines(_web(spark, sf_dir), "record_id", "url", "content")
    return lines.where("furniture").select(F.col("id").alias("record_id"), F.col("line_no").cast("bigint").alias("line_no"))


def p3_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of all web pages."""
    return boilerplate.articles(_web(spark, sf_dir), "record_id", "url", "content").withColumnRenamed("id", "record_id")


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every web record: its judged lines, the last of them, and whether article and furniture together are all of them, each once."""
    lines = boilerplate.page_lines(_web(spark, sf_dir), "record_id", "url", "content")
    per = lines.groupBy(F.col("id").alias("record_id")).agg(F.count("*").alias("lines"), F.max("line_no").cast("bigint").alias("last"), F.count_distinct("line_no").alias("distinct"), F.count("furniture").alias("judged"))
    return per.select("record_id", "lines", "last", ((F.col("distinct") == F.col("lines")) & (F.col("judged") == F.col("lines"))).alias("once"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every content of more than 1,200 characters."""
    return splitting.split_oversized(_contents(spark, sf_dir), "record_kind", "record_id", "content").withColumnsRenamed({"kind": "record_kind", "id": "record_id"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that are cut: those with a second boundary."""
    cut = splitting.boundaries(_contents(spark, sf_dir), "record_kind", "record_id", "content").where("piece_no = 1")
    return cut.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"))


def p4_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every cut record put together again: the text's digest, whether all fit the limit, and whether all repeat what they should."""
    whole = splitting.checked(splitting.split_oversized(_contents(spark, sf_dir), "record_kind", "record_id", "content"))
    return whole.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), F.col("longest").between(1, 1200).alias("within"), "sound", "digest")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every chunk vector."""
    return knn.neighbours(table(spark, sf_dir, "chunks"), "chunk_id", "embedding").withColumn("sim", F.round("sim", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the five nearest of the other."""
    parts = []
    for kind, name, key, vec in (("chunk", "chunks", "chunk_id", "embedding"), ("cache_entry", "cache_entries", "entry_id", "question_embedding")):
        pairs = knn.undirected(knn.neighbours(table(spark, sf_dir, name), key, vec))
        parts.append(pairs.select(F.lit(kind).alias("record_kind"), "id_a", "id_b"))
    return reduce(DataFrame.unionByName, parts)


def _vocabulary(spark: SparkSession) -> str:
    """The path of the tokenizer's rank file: the setting ``spark.quern.vocabulary``, else the installed public one."""
    given = spark.conf.get("spark.quern.vocabulary", None)
    if given:
        return given
    from public_tokenizers import path

    return path("byte_bpe_50k.tiktoken")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty document in a container of 2,048 tokens."""
    tokens = binpacking.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", _vocabulary(spark))
    return binpacking.pack(tokens, "id", "tokens").withColumnRenamed("id", "doc_id")


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every non-empty document whether its parts hold all of its tokens, whether it is whole unless it exceeds a container, and whether its containers hold what they say and no more than they may."""
    tokens = binpacking.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", _vocabulary(spark))
    packed = binpacking.pack(tokens, "id", "tokens")
    filled = packed.groupBy("container").agg((F.sum("tokens") == F.max("fill")).alias("true"), (F.max("fill") <= 2048).alias("fits"))
    parts = packed.join(filled, "container").groupBy("id").agg(F.sum("tokens").alias("held"), F.count("*").alias("parts"), F.bool_and(F.col("true") & F.col("fits")).alias("within"))
    joined = tokens.join(parts, "id", "left")
    return joined.select(F.col("id").alias("doc_id"), (F.col("held") == F.col("tokens")).alias("held"), ((F.col("parts") == 1) | (F.col("tokens") > 2048)).alias("whole"), "within")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each test field each document holds."""
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["question", "expected_answer"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that leaked into them: those of which tiles cover twelve words or more."""
    return p7_coverage(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in the documents, by place."""
    return pii.spans(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_list")).withColumnRenamed("id", "doc_id")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with placeholders for personal information."""
    return pii.redacted(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_list")).withColumnRenamed("id", "doc_id")


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document whether its text with the found places replaced is the redacted text, so that nothing else was touched."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    found = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "pii_type"))).alias("spans"))
    both = docs.join(p8_redacted(spark, sf_dir).withColumnRenamed("text", "redacted"), "doc_id").join(found, "doc_id", "left")
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), (s["start_char"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["pii_type"]), F.lit("]")).alias("out"), s["end_char"].alias("at"))
    none = F.array().cast("array<struct<start_char:bigint,end_char:bigint,pii_type:string>>")
    done = F.aggregate(F.coalesce("spans", none), F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step)
    rest = both.withColumn("done", done)
    return rest.select("doc_id", (F.concat(F.col("done.out"), F.expr("substring(text, cast(done.at + 1 as int))")) == F.col("redacted")).alias("untouched"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_scored, p1_judged, p2_found, p2_groups, p3_found, p3_articles, p3_lines, p4_found, p4_pieces, p4_checked, p5_found, p5_neighbours, p6_containers, p6_checked, p7_found, p7_coverage, p8_found, p8_redacted, p8_checked]
    return {f.__name__: f for f in own}


_CONTENTS = "(SELECT 'document' AS record_kind, record_id, content FROM loaded_documents UNION ALL SELECT 'chunk', chunk_id, content FROM chunks)"


def _vectors(name: str, key: str, vec: str) -> str:
    return f"(SELECT {key} AS id, CAST({vec} AS DOUBLE[]) AS v FROM {name} WHERE {vec} IS NOT NULL AND list_dot_product(CAST({vec} AS DOUBLE[]), CAST({vec} AS DOUBLE[])) > 0)"


def _nearest(kind: str, name: str, key: str, vec: str) -> str:
    v = _vectors(name, key, vec)
    return f"""SELECT '{kind}' AS record_kind, least(id, other) AS id_a, greatest(id, other) AS id_b FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) AS r
      FROM {v} a JOIN {v} b ON a.id <> b.id) WHERE r <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_judged": """SELECT record_kind, count(*) AS pairs, count(DISTINCT record_id) AS records, count(*) AS scores FROM (SELECT 'cache_entry' AS record_kind, entry_id AS record_id FROM cache_entries
          UNION ALL SELECT 'item_result', result_id FROM item_results UNION ALL SELECT 'eval_item', item_id FROM eval_items) GROUP BY record_kind""",
        "p2_groups": rf"""WITH RECURSIVE w AS (SELECT record_kind, record_id AS id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM {_CONTENTS} WHERE content IS NOT NULL), c AS (SELECT record_kind, id, w, md5(array_to_string(w, ' ')) AS h FROM w WHERE len(w) >= 20),
          s AS (SELECT record_kind, id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM c), e AS (SELECT record_kind, id, len(s) AS n, unnest(s) AS g FROM s),
          p AS (SELECT a.record_kind, a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, count(*) AS x FROM e a JOIN e b ON a.record_kind = b.record_kind AND a.g = b.g AND a.id <> b.id GROUP BY ALL),
          l AS MATERIALIZED (SELECT record_kind, a, b FROM p WHERE x / (n_a + n_b - x) >= 0.8), r AS (SELECT record_kind, id, id AS other FROM c UNION SELECT r.record_kind, r.id, l.b FROM r JOIN l ON l.record_kind = r.record_kind AND l.a = r.other),
          g AS (SELECT record_kind, id, min(other) AS group_id FROM r GROUP BY ALL), k AS (SELECT record_kind, h, min(id) AS class_id FROM c GROUP BY ALL), d AS (SELECT record_kind, a AS id, count(*) AS links FROM l GROUP BY ALL)
          SELECT c.record_kind, c.id AS record_id, class_id, group_id, coalesce(links, 0) AS links FROM c JOIN k USING (record_kind, h) JOIN g USING (record_kind, id) LEFT JOIN d USING (record_kind, id)""",
        "p3_lines": r"""SELECT record_id, count(*) AS lines, max(i) AS last, true AS once FROM (SELECT record_id, l[i] AS x, i FROM (SELECT record_id, string_split(content, chr(10)) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM loaded_documents WHERE source_type = 'web' AND content IS NOT NULL))
          WHERE regexp_matches(x, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') GROUP BY record_id""",
        "p5_neighbours": f"""SELECT id, other, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 12) AS sim FROM {_vectors('chunks', 'chunk_id', 'embedding')} a JOIN {_vectors('chunks', 'chunk_id', 'embedding')} b ON a.id <> b.id)) WHERE rank <= 5""",
        "p6_checked": "SELECT doc_id, true AS held, true AS whole, true AS within FROM documents WHERE text <> ''",
        "p8_checked": "SELECT doc_id, true AS untouched FROM documents WHERE text IS NOT NULL",
        "p2_found": rf"""WITH w AS (SELECT record_kind, record_id AS id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM {_CONTENTS} WHERE content IS NOT NULL),
          s AS (SELECT record_kind, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
          e AS (SELECT record_kind, id, len(s) AS n, unnest(s) AS g FROM s),
          p AS (SELECT a.record_kind, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, count(*) AS x FROM e a JOIN e b ON a.record_kind = b.record_kind AND a.g = b.g AND a.id < b.id GROUP BY ALL)
          SELECT record_kind, id_a, id_b FROM p WHERE x / (n_a + n_b - x) >= 0.6""",
        "p4_checked": f"SELECT record_kind, record_id, true AS within, true AS sound, md5(content) AS digest FROM {_CONTENTS} WHERE length(content) > 1200",
        "p4_found": f"SELECT record_kind, record_id FROM {_CONTENTS} WHERE length(content) > 1200",
        "p5_found": f"SELECT DISTINCT * FROM ({_nearest('chunk', 'chunks', 'chunk_id', 'embedding')} UNION ALL {_nearest('cache_entry', 'cache_entries', 'entry_id', 'question_embedding')})",
    }
