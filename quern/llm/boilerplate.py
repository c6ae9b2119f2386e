"""The article of a web page without the site's furniture, by boosted trees over the nodes of the page.

A page's lines are the leaves of a tree: page, region (the lines under one
heading or the page's head), block (lines of one kind in a row) and line. Each
line is described by attribute tokens, depth, position, the density of its block
and region, its siblings, and by how many different articles of the same site,
and of all sites, hold the same line, as counts and as shares. Those are taken over all pages;
copies of one article count once, told by their title and by minimum hashes of
their words, also where other sites took the article over. Blocks and regions are
described by their lines' features and have trees of their own.

There are no labelled pages, so the trees are fitted on lines whose kind the
shares or the line's form give away, in a bounded sample of pages; half of the
training lines are shown with their counts hidden, so that the trees also learn
what furniture looks like where a site has few pages. Decoding is hierarchical, over the scores of all nodes:
each block and region is furniture with all below it, article with all below it, or
left to its children, whichever is worth most, so
that no ancestor and descendant contradict each other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat
from operator import ne
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _base
from quern.session import spread
from quern.llm.gbt import Boosted
from quern.llm.text import Hashes, mix, shingles, word_hashes

#: Most pages, and lines of them, that the trees are fitted on.
SAMPLE, LINES = 800, 14_000
#: Cost, in log odds, of a change of label between two lines of a block.
SWITCH = 1.0
#: Least share of a site's articles that hold a line of its furniture, and most that hold a line of an article by chance.
OFTEN, RARE = 0.03, 0.01

_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_SEPARATOR = re.compile(r"\s[|›»>/·•]\s|\s::\s|\s{3,}\S")
_BULLET = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_END = re.compile(r"[.!?:;。！？…][\"')\]”’»*_`]*$")
_CONTROL = re.compile(r"\[[^\]\n]{1,40}\]|[▾▼▲►→←↑↓×✕©®™]|\b\d+ min\b")
_KINDS = ("text", "heading", "list", "table", "fence", "code", "separated")
_KIND_NO = {k: i for i, k in enumerate(_KINDS)}


def host_of(url: str | None) -> str:
    if not url:
        return ""
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def slug_of(url: str | None) -> set[str]:
    if not url:
        return set()
    try:
        path = urlsplit(url).path
    except ValueError:
        return set()
    return {w.lower() for w in _WORD.findall(path.rsplit("/", 1)[-1])}


def _digits(s: str) -> int:
    return sum(map(s.count, "0123456789"))


def _separators(s: str) -> int:
    """Separators, looked for only where there is a mark of one."""
    return len(_SEPARATOR.findall(s)) if "|" in s or "/" in s or ">" in s or "·" in s or "•" in s or "›" in s or "»" in s or "::" in s or "   " in s else 0


def _controls(s: str) -> int:
    return len(_CONTROL.findall(s)) if "[" in s or " min" in s or not s.isascii() else 0


def _key(line: str) -> int:
    """A line's identity, blanks, case, bullets and numbers aside."""
    m = _BULLET.match(line)
    plain = " ".join((line[m.end() :] if m else line).lower().split())
    return xxhash.xxh64_intdigest(_DIGITS.sub("0", plain) if _digits(plain) else plain) >> 1


def kinds(lines: list[str]) -> list[str]:
    """The kind of each line; lines between code fences are code."""
    out, fenced = [], False
    for line in lines:
        s = line.strip()
        if s.startswith(("```", "~~~")):
            out.append("fence")
            fenced = not fenced
        elif fenced:
            out.append("code")
        elif s.startswith("#") and s.lstrip("#").startswith(" "):
            out.append("heading")
        elif s.startswith("|") and s.count("|") >= 2:
            out.append("table")
        elif _BULLET.match(line):
            out.append("list")
        elif not _END.search(s[-12:]) and _separators(line):
            out.append("separated")
        else:
            out.append("text")
    return out


def _page_lines(content: str) -> tuple[list[int], list[str]]:
    nos, lines = [], []
    for i, line in enumerate(content.split("\n"), 1):
        if line.strip():
            nos.append(i)
            lines.append(line.rstrip("\r"))
    return nos, lines


def _title(lines: list[str], slug: set[str]) -> str:
    """The first heading, else the line most like the address."""
    fenced = False
    for line in lines:
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and line.startswith("#"):
            return " ".join(w.lower() for w in _WORD.findall(line))
    best, most = "", 0.0
    if slug:
        for line in lines:
            w = set(_WORD.findall(line.lower()))
            s = len(slug & w) / len(slug | w)
            if s > most:
                best, most = " ".join(sorted(w)), s
    return best


def _prints(lines: list[str], cache: Hashes) -> tuple[int, int]:
    """Two minimum hashes of the word triples of a page's long lines, which edited copies mostly share."""
    words = [w for line in lines if len(line) >= 80 for w in line.lower().split()]
    runs = shingles(word_hashes(words, cache), 3) >> np.uint64(1)
    if not len(runs):
        return 0, 0
    return int(runs.min()), int((mix(runs) >> np.uint64(1)).min())


def _leads(lines: list[str], kind: list[str], out: Counter) -> None:
    """Counts the words that begin a heading, list item or long line (marked #), and a short bare line (marked ~)."""
    for line, k in zip(lines, kind, strict=True):
        if k in ("heading", "list", "text") and (m := _WORD.search(line)):
            out[("~" if k == "text" and len(line) < 110 else "#") + m.group().lower()] += 1


def _lead_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


#: Line numbers of rows that are no lines: one a page for the site's count, and the counts of lead words of a batch.
_SITE, _LEAD = 0, -1


def _line_rows(batches):
    """Of each page: its lines' keys with what tells its article from others; and lead words, counted."""
    cache = Hashes()
    for batch in batches:
        uid, urls, texts = (batch.column(i).to_pylist() for i in range(3))
        out = {n: [] for n in ("uid", "line_no", "host", "key", "title", "print1", "print2")}
        leads: Counter = Counter()
        for u, url, text in zip(uid, urls, texts, strict=True):
            nos, lines = _page_lines(text)
            if not lines:
                continue
            title = xxhash.xxh64_intdigest(_title(lines, slug_of(url))) >> 1
            first, second = _prints(lines, cache)
            _leads(lines, kinds(lines), leads)
            n = len(lines) + 1
            out["uid"] += [u] * n
            out["line_no"] += [_SITE, *nos]
            out["host"] += [host_of(url)] * n
            out["key"] += [0, *map(_key, lines)]
            out["title"] += [title] * n
            out["print1"] += [first] * n
            out["print2"] += [second] * n
        n = len(leads)
        out["uid"] += leads.values()
        out["line_no"] += [_LEAD] * n
        out["host"] += [""] * n
        out["key"] += map(_lead_key, leads)
        for c in ("title", "print1", "print2"):
            out[c] += [0] * n
        yield pa.RecordBatch.from_pydict(out, pa.schema([("uid", pa.int64()), ("line_no", pa.int32()), ("host", pa.string()), *[(c, pa.int64()) for c in ("key", "title", "print1", "print2")]]))


def features(pages: list[tuple[list[str], list[str], set[str]]], counts: np.ndarray, words_odds: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines of some pages (lines, kinds, words of the address), and each line's block and region.

    ``counts``: a row per line of the site's articles with it, the site's lines
    like it, the site's articles, the sites and the articles of all sites with it. Blocks and regions are
    numbered through all pages and do not cross from one to the next.
    """
    own, code, page = [], [], []
    get_odds = words_odds.get
    for no, (lines, kind, slug) in enumerate(pages):
        n_slug = len(slug) or 1
        for line, k in zip(lines, kind, strict=True):
            s = line.strip()
            ws = _WORD.findall(s)
            low = " ".join(ws).lower().split(" ") if ws else []
            o = list(map(get_odds, low, repeat(0.0)))
            n = len(ws) or 1
            distinct = set(low) if slug else slug
            shared = len(slug & distinct)
            own.append(
                (
                    len(s), len(ws), bool(_END.search(s[-12:])), _separators(line), _controls(s), s.count("`"),
                    sum(map(ne, ws, low)) / n, s.isupper(), _digits(s) / len(s),
                    shared / n_slug, shared / ((len(slug) + len(distinct) - shared) or 1), sum(o) / n, max(o, default=0.0), get_odds("^" + low[0], 0.0) if low else 0.0, get_odds("#" + low[0], 0.0) if low else 0.0, get_odds("~" + low[0], 0.0) if low else 0.0,
                )
            )
            code.append(_KIND_NO[k])
            page.append(no)
    own, code, page = np.array(own, float).reshape(-1, 16), np.array(code, np.int64), np.array(page, np.int64)
    n = len(own)
    size, odds = own[:, 0], own[:, 11]
    prose = (size >= 90) & ((code == 0) | (code == 2))
    heading = code == 1
    solid = prose | heading | (code == 3) | (code == 4) | (code == 5)
    group = np.where(heading, 2, np.where(solid, 1, 0))
    new_page = np.concatenate([[True], page[1:] != page[:-1]])
    cut = new_page | np.concatenate([[True], group[1:] != group[:-1]]) | heading
    block = np.cumsum(cut) - 1
    region = np.cumsum(new_page | heading) - 1
    support = np.log2(1 + counts[:, 0])
    b_first = np.nonzero(cut)[0]
    b_len = np.diff(np.concatenate([b_first, [n]]))
    mean = lambda x: (np.add.reduceat(x, b_first) / b_len)[block]
    p_first = np.nonzero(new_page)[0]
    p_len = np.diff(np.concatenate([p_first, [n]]))
    at = np.arange(n) - p_first[page]
    left = p_len[page] - 1 - at
    far = np.where(solid, np.arange(n), n)
    first = np.minimum.reduceat(far, p_first)
    first = np.where(first < n, first, p_first)
    last = np.maximum.reduceat(np.where(solid, np.arange(n), -1), p_first)
    last = np.where(last >= 0, last, p_first + p_len - 1)
    tail = np.concatenate([new_page[1:], [True]])

    def before(x, missing):
        return np.where(new_page, missing, np.concatenate([[missing], x[:-1]]))

    def after(x, missing):
        return np.where(tail, missing, np.concatenate([x[1:], [missing]]))

    in_block = np.arange(n) - b_first[block]
    columns = [
        support, np.log2(1 + counts[:, 1]), counts[:, 0] / np.maximum(counts[:, 1], 1), counts[:, 0] / np.maximum(counts[:, 2], 1), np.log2(1 + counts[:, 3]), np.log2(1 + counts[:, 2]), counts[:, 4] / np.maximum(counts[:, 3], 1),
        code, *own.T,
        np.minimum(at, 40), np.minimum(left, 40), np.arange(n) - first[page], last[page] - np.arange(n), at / np.maximum(p_len[page], 1),
        np.minimum(b_len[block], 40), mean(size), mean(odds), in_block, b_len[block] - 1 - in_block,
        before(size, 0), after(size, 0), before(odds, 0), after(odds, 0), before(prose, False), after(prose, False), before(heading, False), after(code, 0), before(code, 0),
        mean(support), before(support, 0), after(support, 0),
    ]
    return np.stack([np.asarray(c, float) for c in columns], 1), block, region


def nodes(F_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of blocks or regions that begin at the lines ``first``: means of their lines', their density and size."""
    size = np.diff(np.concatenate([first, [len(F_)]]))
    mean = np.add.reduceat(F_, first, axis=0) / size[:, None]
    spread_ = np.stack([np.minimum.reduceat(F_[:, c], first) for c in (0, 3)] + [np.maximum.reduceat(F_[:, c], first) for c in (0, 3)], 1)
    return np.concatenate([mean, spread_, size[:, None]], 1)


def weak_labels(lines: list[str], kind: list[str], slug: set[str], counts: np.ndarray, leads: dict[str, float]) -> np.ndarray:
    """1 furniture, 0 article, -1 unknown, where shares or form give it away."""
    out = np.full(len(lines), -1)
    solid = [i for i, (x, k) in enumerate(zip(lines, kind, strict=True)) if k in ("table", "fence", "code", "heading") or (len(x) >= 120 and k in ("text", "list"))]
    first, last = (solid[0], solid[-1]) if solid else (len(lines), -1)
    # a line of furniture is held by a share of its site's articles, or by many articles of each of many sites; what articles share by chance is not
    rare = (counts[:, 0] <= np.maximum(1, RARE * counts[:, 2])) & (counts[:, 4] < 2 * np.maximum(counts[:, 3], 1))
    for i, (line, k, c) in enumerate(zip(lines, kind, counts, strict=True)):
        w = {x.lower() for x in _WORD.findall(line)}
        like = len(slug & w) / len(slug | w) if slug else 0.0
        repeated = ((c[0] >= 3 and c[0] >= OFTEN * c[2]) or (c[3] >= 4 and c[4] >= 2 * c[3])) and c[0] >= 0.4 * c[1]
        if k in ("table", "fence", "code", "heading"):
            out[i] = 0
        elif like >= 0.7 and k == "text":
            out[i] = 0
        elif repeated and (c[0] >= 3 or len(line) < 160):
            out[i] = 1
        elif k == "separated" and slug and len(slug & w) / len(slug) >= 0.7:
            out[i] = 1  # the way to the page: its title after others
        elif k == "list" and rare[i] and c[2] >= 10:
            out[i] = 0  # the lists of a site's furniture are the same on many of its pages
        elif rare[i] and first <= i <= last and (len(line) >= 110 or (k == "list" and i > first)):
            out[i] = 0
        elif rare[i] and k == "text" and len(line) < 110 and (m := _WORD.search(line)):
            lead = m.group().lower()
            if leads.get("#" + lead, 0) < 1 and leads.get("~" + lead, 0) > 2.5:
                out[i] = 1  # a form with a blank: its first words begin no heading, list item or paragraph
            elif leads.get("#" + lead, 0) >= 1.5 and first < i < last and rare[i - 1] and c[2] >= 5:
                out[i] = 0  # a heading without a mark
    return out


def decode(line: np.ndarray, block: np.ndarray, region: np.ndarray, of_block: np.ndarray, of_region: np.ndarray) -> np.ndarray:
    """Furniture or not for each line: the labelling of the page's tree that is worth most.

    ``line``, ``of_block`` and ``of_region`` are log odds for furniture of the lines and of the nodes
    above them; ``block`` and ``region`` say, by number from 0, where each line belongs. A node that is furniture is worth its own
    log odds and those of all below it, a node that is article nothing; a node that is
    neither is worth what its children are, for lines less ``SWITCH`` for each change of label within the block.
    """
    line, of_block, of_region = np.clip(line, -8, 8), np.clip(of_block, -4, 4), np.clip(of_region, -4, 4)
    out = np.zeros(len(line), bool)
    first = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1])
    total = np.add.reduceat(line, first)
    stop = np.concatenate([first[1:], [len(line)]])
    whole = total + of_block  # of each block as furniture
    worth = np.maximum(whole, 0.0)
    for b in range(len(first)):
        lo, hi = first[b], stop[b]
        out[lo:hi] = whole[b] > 0
        s = line[lo:hi]
        if hi - lo == 1 or (s > 0).all() or (s <= 0).all():
            continue
        stay, back = np.array([0.0, s[0]]), []
        for x in s[1:]:
            swap = stay[::-1] - SWITCH
            back.append(swap > stay)
            stay = np.maximum(stay, swap) + np.array([0.0, x])
        if stay.max() > worth[b]:
            worth[b] = stay.max()
            label = int(stay[1] > stay[0])
            path = [label]
            for b_ in reversed(back):
                label = 1 - label if b_[label] else label
                path.append(label)
            out[lo:hi] = np.array(path[::-1], bool)
    own = region[first]
    for r in np.unique(own):
        at = np.nonzero(own == r)[0]
        lo, hi = first[at[0]], stop[at[-1]]
        mixed, all_ = worth[at].sum(), whole[at].sum() + of_region[r]
        if all_ > 0 and all_ >= mixed:
            out[lo:hi] = True
        elif of_region[r] < 0 and mixed <= -of_region[r] and 0 < mixed:
            out[lo:hi] = False  # what its children would gain is less than what the region speaks against
    return out


def _odds(shapes: list[tuple], label: np.ndarray) -> dict[str, float]:
    """Log odds for furniture of each word, and of each as a line's first (marked ^), from lines with a label."""
    tally = {0: Counter(), 1: Counter()}
    at = 0
    for lines, kind, _ in shapes:
        for line, k in zip(lines, kind, strict=True):
            y = label[at]
            at += 1
            if y >= 0 and k not in ("code", "fence"):
                low = [w.lower() for w in _WORD.findall(line)]
                tally[int(y)].update(set(low))
                if low:
                    tally[int(y)]["^" + low[0]] += 1
    n1, n0 = sum(tally[1].values()) + 1, sum(tally[0].values()) + 1
    common = [w for w, c in (tally[0] + tally[1]).items() if c >= 3]
    return {w: max(-4.0, min(4.0, math.log((tally[1][w] + 0.3) / n1) - math.log((tally[0][w] + 0.3) / n0))) for w in common}


class Model:
    """Word odds and the trees of lines, blocks and regions; without trees everything is article."""

    def __init__(self) -> None:
        self.odds: dict[str, float] = {}
        self.trees: list[Boosted | None] = [None, None, None]

    def score(self, F_: np.ndarray, block: np.ndarray, region: np.ndarray) -> list[np.ndarray]:
        """Log odds of the lines, blocks and regions."""
        out = []
        for trees, of in zip(self.trees, (None, block, region), strict=True):
            X = F_ if of is None else nodes(F_, np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1]))
            out.append(trees.score(X) if trees is not None else np.full(len(X), -1.0 if of is None else 0.0))
        return out


def _read(pages: list[tuple[str | None, str, dict[int, tuple]]]) -> tuple[list[tuple], list[np.ndarray]]:
    """Lines, kinds and address words of each page that has lines, and their counts (``by_line``: those of other pages too, and under 0 the site's)."""
    shapes, counts = [], []
    for url, text, by_line in pages:
        nos, lines = _page_lines(text)
        if lines:
            site = by_line[_SITE][0] if _SITE in by_line else 1
            counts.append(np.array([(*c[:2], site, *c[2:]) if (c := by_line.get(no)) else (1, 1, site, 1, 1) for no in nos], float))
            shapes.append((lines, kinds(lines), slug_of(url)))
    return shapes, counts


def _fit(shapes: list[tuple], counts: list[np.ndarray], leads: dict[str, float], seed: int = 5) -> Model:
    """A model from the pages of a sample.

    A first one is fitted on the lines whose kind is given away; it labels those
    of the others that it is sure of, and the second is fitted on both. Blocks and regions learn from lines that agree.
    """
    model = Model()
    if not shapes:
        return model
    label = np.concatenate([weak_labels(*shape, own, leads) for shape, own in zip(shapes, counts, strict=True)])
    counts = np.concatenate(counts)
    rng = np.random.default_rng(seed)
    for rounds in (25, 60):
        known = np.nonzero(label >= 0)[0]
        if len(set(label[known])) < 2:
            return model
        model.odds = _odds(shapes, label) | leads
        if len(known) > LINES:
            known = np.sort(rng.choice(known, LINES, replace=False))
        shown, block, region = features(shapes, counts, model.odds)
        hidden, _, _ = features(shapes, np.ones_like(counts), model.odds)
        model.trees[0] = Boosted(trees=rounds).fit(np.concatenate([shown[known], hidden[known]]), np.concatenate([label[known]] * 2).astype(float))
        sure = model.trees[0].score(shown)
        label = np.where((label < 0) & (np.abs(sure) > 1.0), (sure > 0).astype(int), label)
    for i, of in ((1, block), (2, region)):
        first = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1])
        some, most = (np.maximum.reduceat(np.where(label >= 0, x, -1), first) for x in (1 - label, label))
        one = np.nonzero((some >= 0) & (some != most))[0]  # all its known lines are of one kind
        y = most[one].astype(float)
        if len(set(y)) == 2:
            model.trees[i] = Boosted(trees=30).fit(np.concatenate([nodes(x, first)[one] for x in (shown, hidden)]), np.concatenate([y, y]))
    return model


def _classify(model: Model):
    def run(batches):
        for batch in batches:
            key, urls, texts, stats = (batch.column(i).to_pylist() for i in range(1, 5))
            pages = [(url, text, {s["line_no"]: (s["articles"], s["pages"], s["sites"], s["all"]) for s in st or ()}) for url, text, st in zip(urls, texts, stats, strict=True)]
            shapes, counts = _read(pages)
            if not shapes:
                continue
            lines = [_page_lines(text)[0] for text in texts]
            f, block, region = features(shapes, np.concatenate(counts), model.odds)
            line, of_block, of_region = model.score(f, block, region)
            label, at = [], 0
            for shape in shapes:
                end = at + len(shape[0])
                b, r = block[at:end], region[at:end]
                label.append(decode(line[at:end], b - b[0], r - r[0], of_block[b[0] : b[-1] + 1], of_region[r[0] : r[-1] + 1]))
                at = end
            ids = [k for k, nos in zip(key, lines, strict=True) for _ in nos]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([no for nos in lines for no in nos], pa.int32()), pa.array(np.concatenate(label)), pa.array(line)], ["id", "line_no", "furniture", "score"])

    return run


def _prepared(df: DataFrame, id_col: str, url_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Pages with, for each line that others share, how widely it is shared; and the counts of lead words (key, n)."""
    pages = _base.unit(df, id=id_col, url=url_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), F.col("url").cast("string").alias("url"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    pages = pages.withColumn("uid", F.xxhash64("id", "url", "text"))
    pages = pages.dropDuplicates(["uid"])
    rows = _base.stage(pages.select("uid", "url", "text").mapInArrow(_line_rows, "uid bigint, line_no int, host string, key bigint, title bigint, print1 bigint, print2 bigint"), "page-lines")
    leads = _base.stage(rows.where(F.col("line_no") == _LEAD).groupBy("key").agg(F.sum("uid").alias("n")), "page-leads")
    lines = rows.where(F.col("line_no") != _LEAD)
    # Articles with a line: by title and by two fingerprints, whichever are fewest. The counts are exact at any size: each
    # value is first made distinct under its own key, then counted in parts, so no key gathers its pages. Lines found once
    # in all pages have nothing to count and are left out first. A line that a third of all pages hold is joined in parts.
    often = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key = 0").select("key")
    shared = _base.stage(_base.spread_join(lines, often, ["key"], ["uid"]), "shared-lines")
    _base.discard(rows)
    narrow = shared.groupBy("host", "key").agg(F.count("*").alias("pages"), *[F.count_distinct(c).alias(c) for c in ("title", "print1", "print2")])
    narrow = narrow.select("host", "key", "pages", F.when(F.col("key") == 0, F.col("title")).otherwise(F.least("title", "print1", "print2")).alias("articles"))
    sites = shared.where("key != 0").groupBy("key").agg(*[F.count_distinct(c).alias(c) for c in ("host", "title", "print1")]).where("host > 1")
    sites = sites.select("key", F.least("host", "title", "print1").alias("sites"), F.least("title", "print1").alias("all"))
    wide = _base.spread_join(narrow, sites, ["key"], ["host"], "left").withColumns({"sites": F.coalesce("sites", F.lit(1)), "all": F.coalesce("all", "articles")}).where("pages > 1 or sites > 1 or key = 0")
    known = _base.spread_join(shared.select("uid", "line_no", "host", "key"), wide, ["host", "key"], ["uid"]).groupBy("uid").agg(F.collect_list(F.struct("line_no", "articles", "pages", "sites", "all")).alias("stats"))
    out = _base.stage(pages.join(known, "uid", "left").select("uid", "id", "url", "text", "stats"), "pages")
    _base.discard(shared)
    return out, leads


def page_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, *, sample: int = SAMPLE) -> DataFrame:
    """Every non-blank line of every page: ``id``, ``line_no`` (from 1, blank lines counted), ``furniture``, ``score``.

    Pages with a null id or a null text have no rows; a null url is a site of its
    own; equal rows count once, a repeated id with other contents has rows for each. An empty table gives an
    empty result; where no line of the sample can be told (a handful of pages), all lines count as article.
    """
    pages, leads = _prepared(df, id_col, url_col, text_col)
    rows = pages.orderBy(F.hash("uid"), "uid").limit(sample).select("url", "text", "stats").toArrow().to_pylist()
    shapes, counts = _read([(r["url"], r["text"], {s["line_no"]: (s["articles"], s["pages"], s["sites"], s["all"]) for s in r["stats"] or ()}) for r in rows])
    # how often the sample's lead words lead in all pages, in a sample's worth of pages
    own: Counter = Counter()
    for lines, kind, _ in shapes:
        _leads(lines, kind, own)
    by_key = {_lead_key(w): w for w in own}
    held = leads.join(F.broadcast(df.sparkSession.createDataFrame([(k,) for k in by_key] or [(0,)], "key bigint")), "key").toArrow().to_pylist()
    share = min(1.0, sample / max(pages.count(), 1))
    model = _fit(shapes, counts, {by_key[r["key"]]: math.log2(1 + share * r["n"]) for r in held if r["key"] in by_key})
    return spread(pages).mapInArrow(_classify(model), "id bigint, line_no int, furniture boolean, score double")


def articles(df: DataFrame, id_col: str, url_col: str, text_col: str, *, sample: int = SAMPLE) -> DataFrame:
    """``id`` and ``article``, the page's lines that are not furniture, in order. Pages without any have an empty article."""
    lines = page_lines(df, id_col, url_col, text_col, sample=sample).where("not furniture").select("id", "line_no")
    text = _base.unit(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text").where("id is not null and text is not null").dropDuplicates(["id"])
    kept = lines.groupBy("id").agg(F.array_sort(F.collect_set("line_no")).alias("kept"))
    split = F.split("text", "\n", -1)
    return text.join(kept, "id", "left").select("id", F.coalesce(F.array_join(F.transform("kept", lambda i: F.element_at(split, i)), "\n"), F.lit("")).alias("article"))
