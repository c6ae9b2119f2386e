"""Routing of questions: by keywords, by similarity to labelled vectors, and the decisions drawn from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of the routes, knowledge bases and intents.
ROUTES = {
    "code": ["function", "method", " def ", "class ", "code", "implement", "algorithm", "variable", "parameter", "argument", "import ", "module", "exception", "return value", "refactor", "bug in"],
    "table": ["table", " row ", "column", "spreadsheet", "which row"],
    "image": ["image", "screenshot", "picture", "diagram", "figure", "photo", "graphic", "chart", "visual"],
    "sound": ["sounds like", "similar sound", "sound similar", "similar-sounding", "audio clip", "background noise", "sound effect"],
}
BASES = {
    "markdown": ["markdown", ".md file", "readme file"],
    "pdf": ["pdf", ".pdf"],
    "docx": ["docx", "word doc", "word document", ".docx"],
    "web": ["website", "web page", "webpage", "docs site", "documentation site", "online docs", "the url"],
    "github": ["github", "repository", "repo ", " repo", "codebase", "source code", "the code"],
    "audio": ["audio", "podcast", "recording", "the transcript"],
    "video": ["video", "the footage", "the clip", "screen recording"],
}
INTENTS = {
    "explanation": ["how does", "how do", "why does", "why is", "what does", "explain", "walk me through", "describe", "overview of", "purpose of"],
    "exact_code": ["find function", "find the function", "find class", "find the class", "find method", "grep", "locate", "definition of", "signature of", "call site", "declared in", "defined in"],
    "navigational": ["in file", "in the file", "in module", "in the module", "in directory", "in folder", "tests directory", "under app/"],
    "history": ["recent commit", "recent change", "who changed", "who wrote", "when was", "history of", "changelog", "last commit", "who added", "blame", "commit log", "commit history"],
    "activity": ["pull request", "pull requests", "merge request", "merge requests", "open issue", "open issues", "closed issue", "closed issues", "github issue", "github issues", "recent issue", "recent issues", "recent pull request", "recent pull requests", "latest issue", "latest issues", "latest pull request", "latest pull requests", "bug report", "bug reports", "feature request", "feature requests", "open pr", "open prs", "discussion thread", "discussion threads", "what issues", "which issues", "any issues", "list issues", "show issues", "what prs", "which prs", "any prs", "list prs", "list pull requests", "show pull requests"],
    "visual": ["diagram", "screenshot", "picture of", "image of", "architecture diagram", "flowchart", "visualize"],
    "structural": ["who calls", "what calls", "callers of", "used by", "who uses", "calls to", "calls from", "callees of", "dependencies of", "depends on", "depend on", "who imports", "importers of", "imports of", "subclasses of", "who extends", "who inherits", "inherits from", "extends", "base classes of", "parent class of", "override"],
}
# Thresholds of the decisions, and the order of intents that tie.
ROUTE_LEAST, BASE_LEAST, BASE_SHARE = 0.4, 0.2, 0.7
INTENT_LEAST, TIE, BONUS = 0.4, 0.03, 0.15
PRIORITY = ["history", "activity", "visual", "navigational", "structural", "exact_code", "explanation"]


def labels(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The labels of which a keyword occurs in the lower-case text between blanks, in the order given. Null text has none."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    hits = []
    for label, words in keywords.items():
        hit = padded.contains(words[0])
        for w in words[1:]:
            hit = hit | padded.contains(w)
        hits.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*hits))


def margin(scores: DataFrame, by: list[str], label: str, score: str, least: float = BASE_LEAST, share: float = BASE_SHARE) -> DataFrame:
    """The labels within ``share`` of their query's best score and at or over ``least``."""
    best = F.max(score).over(Window.partitionBy(*by))
    return scores.withColumn("_best", best).where((F.col(score) >= least) & (F.col(score) >= share * F.col("_best"))).drop("_best")


def decide(queries: DataFrame, query_key: str, text: str, route_scores: DataFrame, base_scores: DataFrame) -> DataFrame:
    """Of each query: ``routes`` (by rule, or similar enough, and always general), ``bases`` (by rule, or within the margin of the best), both sorted, and ``method``.

    ``route_scores`` and ``base_scores`` (query, label, score). The method says what spoke besides the default: rule, semantic, both or neither.
    """
    asked = queries.select(query_key, labels(F.col(text), ROUTES).alias("rule_routes"), labels(F.col(text), BASES).alias("rule_bases"))
    gather = lambda df, name: df.groupBy(query_key).agg(F.collect_set("label").alias(name))
    routes = gather(route_scores.where(F.col("score") >= ROUTE_LEAST), "near_routes")
    bases = gather(margin(base_scores, [query_key], "label", "score"), "near_bases")
    none = F.array().cast("array<string>")
    full = asked.join(routes, query_key, "left").join(bases, query_key, "left").withColumns({c: F.coalesce(c, none) for c in ("near_routes", "near_bases")})
    ruled, near = (F.size(f"{x}_routes") + F.size(f"{x}_bases") > 0 for x in ("rule", "near"))
    return full.select(
        query_key,
        F.array_sort(F.array_union(F.array_union("rule_routes", "near_routes"), F.array(F.lit("general")))).alias("routes"),
        F.array_sort(F.array_union("rule_bases", "near_bases")).alias("bases"),
        F.when(ruled & near, "both").when(ruled, "rule").when(near, "semantic").otherwise("neither").alias("method"),
    )


def intent(scores: DataFrame, by: list[str], label: str, score: str, ruled: str) -> DataFrame:
    """One intent a query: by score, with a bonus where a rule matches; near ties go to a matched one, then by priority.

    Where any rule matches only matched intents compete; otherwise those over the
    least score. Queries without a candidate have no row.
    """
    any_rule = F.max(F.col(ruled).cast("int")).over(Window.partitionBy(*by))
    kept = scores.withColumn("_any", any_rule).where(F.when(F.col("_any") == 1, F.col(ruled)).otherwise(F.col(score) >= INTENT_LEAST))
    rated = kept.withColumn("rated", F.col(score) + F.when(F.col(ruled), BONUS).otherwise(0.0))
    near = rated.withColumn("_best", F.max("rated").over(Window.partitionBy(*by))).where(F.col("rated") >= F.col("_best") - TIE)
    place = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col(label)), F.lit(99))
    w = Window.partitionBy(*by).orderBy(F.desc(F.col(ruled).cast("int")), place, label)
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*by, F.col(label).alias("intent"), F.round("rated", 6).alias("rated"))
