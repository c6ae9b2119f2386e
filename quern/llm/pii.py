"""Personal information in free text, found and replaced, by information-theoretic sanitisation.

What a term discloses is estimated from the whole corpus: how often it stands in a
protected relation, against how often it stands anywhere. Its disclosure, in bits, is the pointwise mutual
information between the term and that relation.

For names, terms are capitalised words and the relations are: beside a name of the address book with
an initial or particle between at most, behind a title, in a line whose email
address contains it. Terms that disclose a person by
themselves are replaced wherever they stand; terms of a lower disclosure, such
as given names that are common words, only jointly with another name.

Email addresses, phone numbers, identity numbers and street addresses have forms that
make them candidates. Their terms are the shapes they are written in, and the relation is the company of a person:
a name of the address book or a candidate of another type nearby. A shape is taken to disclose, as its form says,
unless the corpus has enough of it to show that it stands apart from persons, as part numbers do.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _base
from quern.session import spread

#: Most terms of the lexicon that are sent to every task; a larger one is joined instead.
SHIP = 200_000
#: Share of a term's occurrences in a protected relation from which on it discloses by itself, and jointly.
ALONE, JOINT = 0.35, 0.06
#: Occurrences in a protected relation, and bits of disclosure (or half of the most there can be), that a term outside the address book needs.
EVIDENCE, BITS = 3, 2.0
#: Occurrences of a shape from which on the corpus can clear it, and the bits under which it does; characters around it that count as its company.
SHAPE_EVIDENCE, SHAPE_BITS, COMPANY = 30, -2.0, 80

# ---- forms that give the entity away. The word lists are fixed values.
_AT = r"(?: ?[\[({] ?at ?[\])}] ?| ?@ ?)"
_SPELLED = r"(?: ?[\[({] ?dot ?[\])}] ?| dot )"
_DOT = rf"(?:{_SPELLED}|\.)"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_LOCAL = r"[\w%+-]+(?:(?: ?[\[({] ?dot ?[\])}] ?|\.)[\w%+-]+)*"
# endings of spelled-out domains; "dot" before another word is prose
_ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|dev|app|xyz|online|site|cloud|tech|store|test|example|invalid|local|localhost"
_EMAIL = re.compile(rf"(?<![\w.+%@/-]){_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}| at {_LABEL}(?:{_SPELLED}{_LABEL})*{_SPELLED}(?=(?:[a-z]{{2}}|{_ENDINGS})\b))[^\W\d_]{{2,24}}(?![\w@+])", re.I)
_REMOTE = re.compile(r":[\w.~-]+/|:\d+/")

_LONE = r"(?<![\w+./:@#-])"
_END = r"(?![\w@]|[-./:]\d)"
_EXT = r"(?: ?(?:,? ?(?:ext\.?|extension|x|Durchwahl|DW|poste|anexo)) ?\d{1,5})?"
_PHONE = re.compile(
    rf"{_LONE}(?:"
    r"\+\d{1,3}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d{1,6}(?:[ ./-]\d{1,6}){0,5}"
    r"|00[1-9]\d{0,2}[ -]\d{1,9}(?:[ -]\d{2,6}){0,4}"
    r"|1[ -]\d{3}[ -]\d{3}[ -]\d{4}"
    r"|\(\d{3}\) ?\d{3}[ -]\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2}-\d{3}-\d{4}|[2-9]\d{2}-\d{4}"
    r"|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{6}|0\d{2,4}/\d{5,9}|\(0\d{2,4}\) ?\d{3,5}(?: \d{2,4}){1,2}"
    r"|0\d(?:[ .]\d{2}){4}|[6-9]\d{2}[ .-]\d{3}[ .-]\d{3}"
    rf"){_EXT}{_END}"
)
_ID = re.compile(
    rf"{_LONE}(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}} \d{{2}} \d{{4}}|[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]|[A-Z]{{1,2}}\d{{7,8}}|\d{{8}}-?[A-Z]|\d{{2}} \d{{3}} \d{{3}} \d{{3}}){_END}"
)
_GAP = r"(?:,[ \t]*(?:\r?\n[ \t]*)?|[ \t]*\r?\n[ \t]*|[ \t]+)"
_CITY = r"(?:(?:New|Saint|St\.|San|Santa|Bad|Los|Las|Fort|Port|Mount|NEW|SAN|BAD) )?[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[^\W\d_]+)*"
_PROPER = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[ -][A-ZÀ-ÖØ-Þ][^\W\d_]+)?"
_WAYS = ("Street", "St", "Lane", "Ln", "Road", "Rd", "Avenue", "Ave", "Drive", "Dr", "Row", "Court", "Ct", "Boulevard", "Blvd", "Way", "Place", "Terrace", "Square", "Close", "Crescent")
_WAY = "(?:" + "|".join(w for x in _WAYS for w in (x, x.upper())) + r")\b\.?"
_UNIT = r"(?:Flat|FLAT|Apt|APT|Apartment|Unit|UNIT|Suite|SUITE)\.? ?#?\d+[A-Za-z]?"
_ADDRESS = re.compile(
    rf"(?<![\w#-])(?:"
    rf"(?:{_UNIT}{_GAP})?\d{{1,5}}[A-Za-z]? {_PROPER} {_WAY}(?:{_GAP}{_UNIT})?{_GAP}{_CITY}(?:,? [A-Z]{{2}}(?=\W))?(?:,?{_GAP}\d{{5}}(?:-\d{{4}})?)?"
    rf"|[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm|STRASSE|STRAßE|GASSE|WEG|PLATZ|ALLEE|RING) \d{{1,4}}[a-z]?{_GAP}\d{{5}} {_CITY}"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|place|boulevard|chemin|impasse|quai|allée|RUE|AVENUE|PLACE|BOULEVARD|CHEMIN) (?:(?:du|de la|des|de|DU|DE LA|DES|DE) |d'|de l')?{_PROPER}{_GAP}\d{{5}} {_CITY}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|CALLE|AVENIDA|PLAZA|PASEO|CAMINO) (?:(?:del|de la|de|DEL|DE) )?{_PROPER},? \d{{1,4}}{_GAP}\d{{5}} {_CITY}"
    r")"
)
_PARTICLE = r"(?:van der|van den|van de|van|von der|von|de la|de|der|den|del|della|di|da|du|la|le|ten|ter|zu|zum|bin|ibn|al|VAN|VON|DE|DER|DEN|DEL)"
_TITLE = re.compile(r"(?:\b(?:Dr|Mr|Mrs|Ms|Prof|Sr|Sra|Mme|M|DR|MR|MRS|PROF)\.|\b(?:Herr|Herrn|Frau|Señor|Señora|Madame|Monsieur)) ?$")
_GREET = re.compile(r"\b(?:Hi|Hello|Hey|Dear|Hallo|Liebe|Lieber|Bonjour|Hola|Salut|Cher|Chère|Estimado|Estimada)\s$")
_CAP = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]+")
_LEFT_INITIAL = re.compile(rf"(?<![^\W_])((?:[A-Z]\.[ -]?)+)(?:{_PARTICLE} )*$")
_LEFT_GIVEN = re.compile(rf"(?<![^\W_])([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?) (?:[A-Z]\. ?)*(?:{_PARTICLE} )*$")
_RIGHT_GIVEN = re.compile(rf", ([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?)(?: [A-Z]\.(?! [A-ZÀ-Þ]))*")
_RIGHT_FAMILY = re.compile(rf" (?:[A-Z]\. ?)*(?:{_PARTICLE} )*(?:(?:Mc|Mac|O['’])?([A-ZÀ-ÖØ-Þ][^\W\d_]+))")
_ENDS = re.compile(r"(?:^|[^\s\w.,-]\s?|\b[a-z]\w* |\n)([A-ZÀ-ÖØ-Þ][^\W\d_]+)$")
_MARKED = re.compile(rf"(?:(?<![^\W_])[A-Z]|(?:Dr|Mr|Mrs|Ms|Prof|Sr|Sra|Mme))\. (?:{_PARTICLE} )*([A-ZÀ-ÖØ-Þ][^\W\d_]+)")
_MARK = re.compile(r"[A-Z][a-z]{0,3}\. ")
_HYPHEN = re.compile(r"-(?:[A-ZÀ-ÖØ-Þ]['’])?[A-ZÀ-ÖØ-Þ][^\W\d_]+")


def _digits(s: str) -> int:
    return sum(map(str.isdigit, s))


# what each form cannot do without; the full patterns are tried around these places only
_AT_SIGN = re.compile(r"@|[\[({] ?[aA][tT] ?[\])}]| [aA][tT] (?=[\w-]+(?: [dD][oO][tT] | ?[\[({] ?[dD]))")
_RUN = re.compile(r"\d[\d ()./-]{4,}\d")
_BEFORE_CAPITAL = re.compile(r"\d[A-Za-z]? [A-ZÀ-ÖØ-Þ]")


def _around(trigger: re.Pattern, pattern: re.Pattern, text: str, back: int, ahead: int):
    """Matches of ``pattern`` that reach over a match of ``trigger``: as if searched in the whole text, but only there.

    The window around a trigger cuts no token, and one that a match begins or ends with is widened.
    """
    done, size = 0, len(text)
    for t in trigger.finditer(text):
        if t.start() < done:
            continue
        reach = back
        while True:
            low, high = max(done, t.start() - reach), min(size, t.end() + reach + ahead - back)
            while low > done and not text[low - 1].isspace() and text[low - 1] != "@":
                low -= 1
            while high < size and not text[high].isspace() and text[high] != "@":
                high += 1
            at, m = low, None
            while (m := pattern.search(text, at, high)) and m.end() <= t.start():
                at = m.end()
            if m and (m.start() == low > done or m.end() == high < size):
                reach *= 4
                continue
            break
        if m and m.start() <= t.start():
            yield m
            done = m.end()


def structured(text: str) -> list[tuple[str, int, int]]:
    """Emails, addresses, identity and phone numbers of a text: (type, start, end), not overlapping."""
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y in taken)

    for m in _around(_AT_SIGN, _EMAIL, text, 100, 120):
        taken.append(m.span())
        if "@" in m.group() and (_REMOTE.match(text, m.end()) or text[max(0, m.start() - 3) : m.start()] == "://"):
            continue  # the login of a code remote
        out.append(("email", *m.span()))
    for m in _around(_BEFORE_CAPITAL, _ADDRESS, text, 90, 120):
        if free(*m.span()):
            out.append(("address", *m.span()))
            taken.append(m.span())
    for run in _RUN.finditer(text):
        low, high = max(0, run.start() - 6), run.end() + 14
        for kind, pattern in (("id_number", _ID), ("phone", _PHONE)):
            for m in pattern.finditer(text, low, high):
                a, b = m.span()
                if b == high:
                    m = pattern.match(text, a)
                    if m is None:
                        continue
                    b = m.end()
                if kind == "phone" and not 7 <= _digits(text[a:b]) <= 20:
                    continue
                if free(a, b):
                    out.append((kind, a, b))
                    taken.append((a, b))
    return out


def _blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its structured entities blanked, so that no name is looked for in them."""
    for _, a, b in spans:
        text = text[:a] + "\0" * (b - a) + text[b:]
    return text


def _lines_with_emails(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """Start and end of each line with an email, and the lower-case local part."""
    return [(text.rfind("\n", 0, a) + 1, (text + "\n").index("\n", b), re.split(r"@| ?[\[({] ?at| at ", text[a:b].lower(), maxsplit=1)[0]) for kind, a, b in spans if kind == "email"]


def _left(text: str, at: int) -> str:
    """What stands before a place, back to the begin of a token."""
    low = max(0, at - 48)
    while low and not text[low - 1].isspace():
        low -= 1
    return text[low:at]


def _first(word: str) -> str:
    return word.split("-", 1)[0].lower()


_LETTERS = re.compile(r"[^\W\d_]+")


def _shape(kind: str, found: str) -> str:
    """The term that stands for how a candidate is written: an email's domain, else its digits and words as such."""
    if kind == "email":
        return f"\0email:{re.split(r'@| ?[\[({] ?at| at ', found.lower(), maxsplit=1)[-1]}"
    return f"\0{kind}:{re.sub(r'[0-9]', '9', found) if kind != 'address' else _LETTERS.sub('w', re.sub(r'[0-9]+', '9', found))}"


def _count(given: frozenset[str] | None, family: frozenset[str] | None):
    """Of each capitalised term and shape: occurrences, and those in a protected relation as given and as family name. Without an address book the rows hold their own terms of it."""

    def run(batches):
        for batch in batches:
            n, g, f = Counter(), Counter(), Counter()
            own = batch.column(2).to_pylist() if given is None else [None] * batch.num_rows
            for text, terms in zip(batch.column(1).to_pylist(), own, strict=True):
                first = given if terms is None and given is not None else {t["term"] for t in terms or () if t["in_given"]}
                last = family if terms is None and family is not None else {t["term"] for t in terms or () if t["in_family"]}
                _count_text(text, first, last, n, g, f)
            words = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([min(c[w], n[w]) for w in words], pa.int64()) for c in (n, g, f)]], ["term", "n", "given", "family"])

    return run


def _count_text(text: str, given: frozenset[str] | set[str], family: frozenset[str] | set[str], n: Counter, g: Counter, f: Counter) -> None:
    spans = structured(text)
    blank = _blank(text, spans) if spans else text
    words = []
    for kind, a, b in spans:
        shape = _shape(kind, text[a:b])
        n[shape] += 1
        low, high = a - COMPANY, b + COMPANY
        if any(k != kind and x < high and low < y for k, x, y in spans) or any((w := c.lower()) in given or w in family for c in _CAP.findall(blank, max(0, low), high)):
            g[shape] += 1
    for m in _CAP.finditer(blank):
        low = m.group().lower()
        words.append(low)
        if low in family:
            a, b = m.span()
            before = _left(blank, a)
            turned = _RIGHT_GIVEN.match(blank, b)
            if turned and not _RIGHT_FAMILY.match(blank, turned.end()):
                if _ENDS.search(before + m.group()):
                    g[_first(turned.group(1))] += 1
            if (r := _LEFT_GIVEN.search(before)) and not (turned and _first(turned.group(1)) in given):
                g[_first(r.group(1))] += 1
            if _LEFT_INITIAL.search(before) or _TITLE.search(before):
                f[low] += 1
        if low in given:
            a, b = m.span()
            if r := _RIGHT_FAMILY.match(blank, b):
                f[r.group(1).lower()] += 1
            elif blank[a - 2 : a] == ", " and (r := _ENDS.search(_left(blank, a - 2))):
                f[r.group(1).lower()] += 1
    n.update(words)
    for at in _MARK.finditer(blank):  # behind an initial or a title
        if (m := _MARKED.match(blank, at.start())) and (low := m.group(1).lower()) not in family:
            f[low] += 1
    for start, stop, local in _lines_with_emails(text, spans):
        for m in _CAP.finditer(blank, start, stop):
            low = m.group().lower()
            if len(low) >= 4 and low in local and low not in given and low not in family:
                if _RIGHT_FAMILY.match(blank, m.end()):
                    g[low] += 1
                elif _LEFT_GIVEN.search(_left(blank, m.start())):
                    f[low] += 1


def _with_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``texts`` (id, text) with ``terms``, the rows of a table (term, ...) too large to send out whose term stands in them."""
    keyed = texts.withColumn("uid", F.xxhash64("id", "text"))
    found = _base.spread_join(keyed.select("uid", "text").mapInArrow(_terms_of, "uid bigint, term string").distinct(), terms, ["term"], ["uid"])
    own = found.groupBy("uid").agg(F.collect_list(F.struct(*terms.columns)).alias("terms"))
    return keyed.join(own, "uid", "left").select("id", "text", "terms")


def disclosure(texts: DataFrame, names: DataFrame, name_col: str, kind_col: str, ship: int = SHIP) -> DataFrame:
    """The lexicon: ``term``, ``given`` and ``family`` (2 discloses by itself, 1 jointly, 0 not), ``bits``; shapes that disclose nobody have -1.

    ``texts`` (id, text); counts are over all of them. An address book of over ``ship`` terms is joined to
    the texts instead of sent to every task. Without any evidence in the corpus the address book's terms disclose jointly.
    """
    book = names.select(F.lower(F.trim(F.col(f"`{name_col}`").cast("string"))).alias("term"), F.lower(F.col(f"`{kind_col}`").cast("string")).alias("kind")).where("term <> ''").distinct()
    listed = book.groupBy("term").agg(*[F.max(F.when(F.col("kind") == c, 1).otherwise(0)).alias(f"in_{c}") for c in ("given", "family")])
    if listed.limit(ship + 1).count() <= ship:
        held = listed.toArrow().to_pylist()
        given, family = (frozenset(r["term"] for r in held if r[c]) for c in ("in_given", "in_family"))
        counted = texts.mapInArrow(_count(given, family), "term string, n bigint, given bigint, family bigint")
        listed = F.broadcast(listed)
    else:
        counted = _with_terms(texts, listed).mapInArrow(_count(None, None), "term string, n bigint, given bigint, family bigint")
    total = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("given").alias("g"), F.sum("family").alias("f"))
    total = _base.stage(total, "pii-terms")
    shape = F.col("term").startswith("\0")
    sums = {r["shape"]: (r["e"] or 0, r["n"] or 0) for r in total.groupBy(shape.alias("shape")).agg(F.sum(F.col("g") + F.col("f")).alias("e"), F.sum("n").alias("n")).collect()}
    rate, company = (max(e / max(n, 1), 1e-6) for e, n in (sums.get(x, (0, 0)) for x in (False, True)))
    both = total.where(~shape).join(listed, "term", "left").fillna(0, ["in_given", "in_family"])
    share = lambda c: F.col(c) / F.col("n")
    bits = F.log2(((F.col("g") + F.col("f") + 0.5 * rate) / (F.col("n") + 0.5)) / rate)

    def level(c: str, own: str, other: str):
        known = (F.col(own) == 1) & (F.col(other) == 0)
        learned = (F.col(c) >= EVIDENCE) & (bits >= min(BITS, -math.log2(rate) / 2)) & (share(c) >= JOINT)
        by_itself = (share(c) >= ALONE) & (known | learned)
        return F.when(by_itself, 2).when(known | learned, 1).otherwise(0)

    words = both.select("term", level("g", "in_given", "in_family").alias("given"), level("f", "in_family", "in_given").alias("family"), bits.alias("bits")).where("given > 0 or family > 0")
    apart = F.log2(((F.col("g") + 0.5 * company) / (F.col("n") + 0.5)) / company)
    cleared = total.where(shape & (F.col("n") >= SHAPE_EVIDENCE)).select("term", F.lit(-1).alias("given"), F.lit(-1).alias("family"), apart.alias("bits")).where(F.col("bits") < SHAPE_BITS)
    return words.unionByName(cleared)


def names_in(blank: str, lexicon: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of persons' names, initials and particles included, titles not."""
    out: list[tuple[int, int]] = []
    end = -1
    for m in _CAP.finditer(blank):
        a, b = m.span()
        if a < end:
            continue
        got = lexicon.get(m.group().lower())
        if got is None or (a and (blank[a - 1].isalnum() or blank[a - 1] in "@#_")):
            continue
        g, f = got
        span = None
        if g and (r := _RIGHT_FAMILY.match(blank, b)):
            other = lexicon.get(r.group(1).lower())
            if other and other[1]:
                span = [a, r.end()]
        if span is None and g and (h := _HYPHEN.match(blank, b)) and (r := _RIGHT_FAMILY.match(blank, h.end())) and (lexicon.get(r.group(1).lower()) or (0, 0))[1]:
            span = [a, r.end()]
        if span is None and f:
            before = _left(blank, a)
            hy = _HYPHEN.match(blank, b)
            stop = hy.end() if hy else b
            if (r := _RIGHT_GIVEN.match(blank, stop)) and (lexicon.get(r.group(1).split("-")[0].lower()) or (0, 0))[0] and not ((q := _RIGHT_FAMILY.match(blank, r.end(1))) and (lexicon.get(q.group(1).lower()) or (0, 0))[1]):
                span = [a, r.end()]
            elif r := _LEFT_INITIAL.search(before):
                span = [a - (len(before) - r.start()), stop]
            elif f == 2 or _TITLE.search(before):
                span = [a, stop]
        if span is None and g:
            alone = blank[b : b + 1] not in ("-", "'", "’")
            if alone and (g == 2 or _GREET.search(blank[max(0, a - 12) : a])):
                span = [a, b]
        if span is None:
            continue
        if span[1] >= b:
            while hy := _HYPHEN.match(blank, span[1]):
                span[1] = hy.end()
        out.append((span[0], span[1]))
        end = span[1]
    return out


def find(text: str, lexicon: dict[str, tuple[int, int]]) -> list[tuple[str, int, int]]:
    spans = [s for s in structured(text) if _shape(s[0], text[s[1] : s[2]]) not in lexicon]
    blank = _blank(text, spans)
    return sorted(spans + [("name", a, b) for a, b in names_in(blank, lexicon)], key=lambda s: s[1:])


def _apply(lexicon: dict[str, tuple[int, int]] | None, redact: bool):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = batch.column(2).to_pylist() if lexicon is None else [None] * len(ids)
            if redact:
                done = []
                for text, terms in zip(texts, own, strict=True):
                    words = lexicon if terms is None and lexicon is not None else {t["term"]: (t["given"], t["family"]) for t in terms or ()}
                    parts, at = [], 0
                    for kind, a, b in find(text, words):
                        parts += [text[at:a], f"[{kind.upper()}]"]
                        at = b
                    done.append("".join([*parts, text[at:]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["id", "text"])
                continue
            out: dict[str, list] = {n: [] for n in ("id", "pii_type", "start_char", "end_char")}
            for key, text, terms in zip(ids, texts, own, strict=True):
                words = lexicon if terms is None and lexicon is not None else {t["term"]: (t["given"], t["family"]) for t in terms or ()}
                for kind, a, b in find(text, words):
                    for n, v in zip(out, (key, kind, a, b), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("pii_type", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64())]))

    return run


def _terms_of(batches):
    for batch in batches:
        ids, terms = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {w.lower() for w in _CAP.findall(text)} | {_shape(k, text[a:b]) for k, a, b in structured(text)}
            ids += [key] * len(own)
            terms += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string())], ["uid", "term"])


def _run(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str, kind_col: str, redact: bool, ship: int) -> DataFrame:
    texts = _base.unit(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    texts = spread(texts)
    lexicon = _base.stage(disclosure(texts.where("text <> ''"), names, name_col, kind_col, ship).select("term", "given", "family"), "pii-lexicon")
    schema = "id bigint, text string" if redact else "id bigint, pii_type string, start_char bigint, end_char bigint"
    if lexicon.limit(ship + 1).count() <= ship:
        held = {r["term"]: (r["given"], r["family"]) for r in lexicon.toArrow().to_pylist()}
        return texts.mapInArrow(_apply(held, redact), schema)
    return _with_terms(texts, lexicon).mapInArrow(_apply(None, redact), schema)


def spans(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str = "name", kind_col: str = "name_kind", *, ship: int = SHIP) -> DataFrame:
    """Every piece of personal information: ``id``, ``pii_type``, ``start_char``, ``end_char`` (code points, the end exclusive).

    Types are email, phone, id_number, address and name; spans of a text do not
    overlap. Null ids, null and empty texts have no rows, a repeated id has rows
    for each of its texts; an empty table gives an empty result.
    """
    return _run(df, id_col, text_col, names, name_col, kind_col, False, ship)


def redacted(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str = "name", kind_col: str = "name_kind", *, ship: int = SHIP) -> DataFrame:
    """``id`` and ``text`` with every span of :func:`spans` replaced by its type in brackets, the rest unchanged."""
    return _run(df, id_col, text_col, names, name_col, kind_col, True, ship)
