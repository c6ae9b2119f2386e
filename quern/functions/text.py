"""Column expressions over text. All are built-ins, so they stay inside code generation or a single projection.

Null texts give null, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the search tokeniser leaves out.
STOPWORDS = ["a", "an", "the", "is", "are", "was", "were", "to", "of", "on", "in", "for", "and", "or", "its", "it", "this", "that", "when", "if", "then", "with", "as", "by", "from", "at", "be", "been", "being", "has", "have", "had", "do", "does", "did", "not", "no", "so", "up", "out", "into", "than", "who", "what", "how"]

# What makes a question depend on the turn before it.
REFERENCE_WORDS = ["it", "its", "that", "this", "they", "them", "their", "those", "these", "he", "she", "him", "her"]
CONTINUATIONS = ["what about", "and ", "also", "what else", "how about", "same for", "same with", "what if", "why not", "or "]
STANDALONE_WORDS = 7

# What makes a question complex.
COMPLEX_WORDS = ["and", "also", "then", "vs", "versus", "compare", "both", "difference", "why", "how", "explain", "list"]
SIMPLE_WORDS, SIMPLE_CHARS = 5, 40

# Forms that code is told by, and how many of them make code.
CODE_FORMS = [r"\bconst\b", r"\bfunction\b", r"\breturn\b", r"\bclass\b", r"\bdef\b", r"\bimport\b", r"\bawait\b", r"=>", r"[{};]", r"\bif\s*\(", r"\bqueryAsync\b", r"\bpayload\b", r"\bcommand\b"]
CODE_LEAST = 3

# Names that look like identifiers and are none.
NO_IDENTIFIERS = ["GitHub", "OpenAI", "PDF", "URL", "URI", "JSON", "YAML", "HTML", "HTTP", "HTTPS", "API", "SDK", "CLI", "UI", "OS"]

# Phrases that name a language, in order of precedence.
LANGUAGE_PHRASES = {"python file": "python", "python code": "python", ".py file": "python", "javascript file": "javascript", "typescript file": "typescript", "markdown file": "markdown", "yaml file": "yaml", "json file": "json", "rust file": "rust", "go file": "go", "java file": "java"}
PATH_FORM = r"([A-Za-z0-9_./\-]+\.(?:py|md|txt|js|ts|tsx|jsx|json|yaml|yml|toml|rst|go|rs|java|c|cpp|h|hpp|cs))\b"
DIR_FORM = r"([A-Za-z0-9_\-]+(?:/[A-Za-z0-9_\-]+)*)/(?:\s|$)"


def lexical_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of more than one character, in order, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)


def search_tokens(text: Column) -> Column:
    """The distinct lexical tokens that are no stop-words, sorted."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_sort(F.array_distinct(F.array_except(lexical_tokens(text), stop)))


def words(text: Column) -> Column:
    """White-space separated words; an empty array for null or blank text."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null or blank text."""
    return F.size(words(text))


def timestamp_label(seconds: Column, hours: bool = True) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from one hour on; without ``hours`` minutes run on."""
    s = F.floor(seconds).cast("bigint")
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    if not hours:
        return short
    return F.when(s >= 3600, F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(short)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def digest(*parts: Column, separator: str = "::") -> Column:
    """SHA-256 of the parts joined by ``separator``; a null part counts as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the first 500 characters."""
    return F.substring(F.sha2(F.substring(F.coalesce(text, F.lit("")), 1, 500), 256), 1, 16)


def media_name(owner: Column, document: Column, seconds: Column) -> Column:
    """File name of a frame: 16 hex digits of a SHA-1 of its owner and document, and milliseconds."""
    return F.concat(F.substring(F.sha1(F.concat_ws("::", owner, document)), 1, 16), F.lit("_"), F.floor(seconds * 1000).cast("bigint").cast("string"), F.lit(".jpg"))


def looks_like_code(text: Column) -> Column:
    """At least three of the code forms occur. Null text is not code."""
    hits = sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in CODE_FORMS[1:]), F.coalesce(text.rlike(CODE_FORMS[0]), F.lit(False)).cast("int"))
    return hits >= CODE_LEAST


def _has_word(text: Column, choice: list[str]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), F.array(*[F.lit(w) for w in choice]))


def _question_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)))


def context_dependent(question: Column, has_history: Column) -> Column:
    """Whether a question needs the turns before it: there are some, and it refers, continues or is short."""
    text = F.trim(F.lower(question))
    opens = F.lit(False)
    for o in CONTINUATIONS:
        opens = opens | text.startswith(o)
    return F.coalesce(has_history & (_has_word(question, REFERENCE_WORDS) | opens | (_question_words(question) <= STANDALONE_WORDS)), F.lit(False))


def complex_question(question: Column) -> Column:
    """Whether a question is worth rewriting: long, compound or of several parts."""
    marks = F.length(question) - F.length(F.regexp_replace(question, r"\?", ""))
    return F.coalesce((_question_words(question) > SIMPLE_WORDS) | (F.length(question) > SIMPLE_CHARS) | _has_word(question, COMPLEX_WORDS) | (marks > 1), F.lit(False))


def identifier(text: Column) -> Column:
    """The first word that looks like a code identifier, or null."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9_]{3,})\b"), F.lit(1))
    deny = F.array(*[F.lit(w) for w in NO_IDENTIFIERS])
    fits = F.filter(found, lambda w: (w.contains("_") | (F.length(F.regexp_replace(w, "[^A-Z]", "")) >= 2)) & ~F.array_contains(deny, w))
    return F.try_element_at(fits, F.lit(1))


def language_hint(text: Column) -> Column:
    """The language of the first phrase that names one, or null."""
    out = F.lit(None).cast("string")
    for phrase, language in reversed(LANGUAGE_PHRASES.items()):
        out = F.when(F.lower(text).contains(phrase), language).otherwise(out)
    return out


def metadata_hints(text: Column) -> Column:
    """File name, directory, language and symbol that a question names, as a map without nulls."""
    path = F.nullif(F.regexp_extract(text, PATH_FORM, 1), F.lit(""))
    pairs = {
        "file_name": F.element_at(F.split(path, "/"), -1),
        "file_dir": F.nullif(F.regexp_extract(text, DIR_FORM, 1), F.lit("")),
        "language": language_hint(text),
        "symbol_name": identifier(text),
    }
    full = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def strip_fence(text: Column) -> Column:
    """A reply without the Markdown fence around it."""
    t = F.trim(text)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def clamp(value: Column, missing: float | None = None) -> Column:
    """A score between 0 and 1; what is no finite number gives ``missing``."""
    x = F.expr(f"try_cast({value} as double)") if isinstance(value, str) else value.try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(missing).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def combine_readings(ocr: Column, vision: Column) -> Column:
    """Two readings of an image: the one that is there, or both with labels."""
    a, b = F.trim(F.coalesce(ocr, F.lit(""))), F.trim(F.coalesce(vision, F.lit("")))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(F.lit("[OCR text]\n"), a, F.lit("\n\n[Vision description]\n"), b))


def pipe_row(*cells: Column) -> Column:
    """A row of a pipe table: cells trimmed, line breaks as blanks, pipes escaped, nulls empty."""
    clean = [F.replace(F.replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))


def source_label(number: Column, file: Column, page: Column, section: Column, similarity: Column | None = None) -> Column:
    """``[Source i — file, page p]``: the page if there is one, else the section; what is missing is left out."""
    place = F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string"))).when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("section: '"), section, F.lit("'")))
    parts = [F.nullif(file, F.lit("")), place]
    if similarity is not None:
        parts.append(F.when(similarity.isNotNull(), F.format_string("similarity: %.4f", similarity)))
    joined = F.concat_ws(", ", *parts)
    return F.concat(F.lit("[Source "), number.cast("string"), F.when(joined == "", "").otherwise(F.concat(F.lit(" — "), joined)), F.lit("]"))
