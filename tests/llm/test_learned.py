"""Answer defects, page articles and personal information: held-out accuracy and odd inputs."""

import random

import numpy as np
import pytest

from quern.llm import boilerplate, gbt, pairs, pii

SUBJECTS = ["registry", "archive", "planner", "resolver", "gateway", "bucket", "cursor", "ledger", "parser", "stemmer"]
VERBS = ["sorts", "keeps", "reads", "merges", "drops", "hashes", "splits", "moves"]
GERMAN = ["Der Dienst sortiert die Einträge nach der Zeit und löscht den Rest.", "Ein Knoten liest die Felder nicht, weil der Index sie zählt.", "Wir prüfen alle Protokolle mit dem Auftrag und speichern den Bericht."]


def sentence(rng):
    return f"The {rng.choice(SUBJECTS)} {rng.choice(VERBS)} the {rng.choice(SUBJECTS)} before the {rng.choice(SUBJECTS)} {rng.choice(VERBS)} it in under {rng.randint(2, 90)} seconds."


def question(rng):
    return f"How does the {rng.choice(SUBJECTS)} of Kelmor {rng.randint(1, 999)} work with the {rng.choice(SUBJECTS)}?"


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    rows = []
    add = lambda q, a, d: rows.append(("k", len(rows), q, a, d))
    for i in range(400):
        add(question(rng), " ".join(sentence(rng) for _ in range(rng.randint(2, 4))), None)
        if i % 8 == 0:
            q = f"Wie sortiert der Dienst die Einträge von Kelmor {i} und warum?"
            add(q, " ".join(rng.sample(GERMAN, 2)), None)
    for _ in range(40):
        q = question(rng)
        full = " ".join(sentence(rng) for _ in range(3))
        add(q, full[: full.rindex("before") + 9], "truncated")
        add(q, q, "copies_question")
        add(q, "I'm sorry, but I cannot answer this question.", "refusal")
        add(q, " ".join(rng.sample(GERMAN, 2)), "other_language")
        add(q, rng.choice(["", " ", "N/A", None, "...", "​"]), "empty")
        add(q, sentence(rng) + ' It prints "Sorry, I cannot open this" and goes on.', None)
        add(q, q + " " + sentence(rng) + " " + sentence(rng), None)
    df = spark.createDataFrame(rows, "kind string, id long, q string, a string, want string")
    got = {r["id"]: r["defect"] for r in pairs.defects(df.drop("want"), "kind", "id", "q", "a").collect()}
    assert len(got) == len(rows)
    return [(r[4], got[r[1]]) for r in rows]


@pytest.mark.parametrize("defect", pairs.DEFECTS[:-1])
def test_defects_are_found(judged, defect):
    hit = sum(w == g == defect for w, g in judged)
    assert hit >= 0.9 * sum(w == defect for w, _ in judged)
    assert hit >= 0.85 * sum(g == defect for _, g in judged)


def test_refusals_of_families_that_training_never_saw(monkeypatch):
    """Half of the statements and of the grammar are held out; what they say must still be told from usable answers."""
    rng = random.Random(3)
    rows = [(question(rng), " ".join(sentence(rng) for _ in range(rng.randint(1, 5)))) for _ in range(500)]
    base, pre, post = pairs._REFUSALS["en"]
    unseen = [(q, x.replace("{x}", "this").replace("{n}", "Kelmor")) for x in base[1::2] for q, _ in rows[:8]]
    monkeypatch.setitem(pairs._REFUSALS, "en", (base[::2], pre, post))
    monkeypatch.setitem(pairs._GRAMMAR, "en", pairs._GRAMMAR["en"][::2])
    model = pairs.train(rows, {})
    got = lambda some: model.decide(model.predict(*(lambda f: ([x[0] for x in f], np.array([x[1] for x in f])))([pairs.features(q, a, (0, 0)) for q, a in some])))[0]
    assert np.mean([d == "refusal" for d in got(unseen)]) >= 0.7
    assert np.mean([d == "refusal" for d in got([(question(rng), " ".join(sentence(rng) for _ in range(3))) for _ in range(200)])]) <= 0.02


def test_a_refusal_far_behind_a_preamble_and_a_swapped_answer():
    rng = random.Random(4)
    rows = [(question(rng), " ".join(sentence(rng) for _ in range(rng.randint(1, 5)))) for _ in range(500)]
    model = pairs.train(rows, {})
    q = "How does the registry of Kelmor 7 work with the planner?"
    long = "You asked how the registry of Kelmor works with the planner. " * 14
    f = [pairs.features(q, a, (0, 0)) for a in (long + "Sorry, but I cannot answer this question.", long + " ".join(sentence(rng) for _ in range(4)))]
    assert model.decide(model.predict([x[0] for x in f], np.array([x[1] for x in f])))[0] == ["refusal", None]
    one, two = (pairs.features(q, long + end, (0, 0))[0] for end in ("nothing of use here.", "everything of use there."))
    assert not np.array_equal(one, two)
    assert pairs.last_word("so it ends in " + "x" * 500) == "x" * 500 and pairs.last_word("-" * 300) == ""


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([("k", 1, None, None), ("k", 2, "q?", ""), (None, None, "q?", "Yes.")], "kind string, id long, q string, a string")
    got = {r["id"]: r["defect"] for r in pairs.defects(df, "kind", "id", "q", "a").collect()}
    assert got == {1: "empty", 2: "empty", None: None}
    assert pairs.defects(df.limit(0), "kind", "id", "q", "a").count() == 0


def test_boosted_trees_learn_an_exclusive_or():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(3000, 4))
    y = ((X[:, 0] > 0) ^ (X[:, 1] > 0.3)).astype(float)
    m = gbt.Boosted(trees=40, depth=3).fit(X[:2000], y[:2000])
    assert ((m.score(X[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert len(m.score(X[:0])) == 0


@pytest.fixture(scope="module")
def site_pages():
    rng = random.Random(6)
    pages, furniture = [], set()
    for site in range(6):
        nav = [f"* {w}" for w in rng.sample(["Home", "Docs", "Pricing", "Blog", "Search", "Login"], 4)]
        foot = [f"© 2024 Site{site}. All rights reserved.", "Terms · Privacy · Imprint"]
        for p in range(25):
            name = f"{rng.choice(SUBJECTS)}-{rng.choice(SUBJECTS)}-{site}{p}"
            title = "# " + name.replace("-", " ")
            body = [" ".join(f"The {rng.choice(SUBJECTS)} w{rng.randint(0, 9999)}x {rng.choice(VERBS)} q{rng.randint(0, 9999)}y." for _ in range(6)) for _ in range(rng.randint(2, 5))]
            lines = ["We use cookies to improve your visit. Accept all or change your settings.", *nav, title, *body[:1], "- " + sentence(rng)[:-1], f"- one {rng.choice(SUBJECTS)} of {rng.choice(SUBJECTS)} and {rng.choice(SUBJECTS)}", *body[1:], "```", "call(x)", "```", *foot]
            key = site * 100 + p
            pages.append((key, f"https://s{site}.example/{name}", "\n".join(lines)))
            furniture |= {(key, i) for i in range(1, 6)} | {(key, len(lines) - 1), (key, len(lines))}
    return pages, furniture


def test_articles_of_pages(spark, site_pages):
    pages, furniture = site_pages
    df = spark.createDataFrame(pages, "id long, url string, text string")
    rows = boilerplate.page_lines(df, "id", "url", "text").collect()
    got = {(r["id"], r["line_no"]) for r in rows if r["furniture"]}
    assert len(got & furniture) >= 0.97 * len(furniture) and len(got & furniture) >= 0.97 * len(got)
    assert len(rows) == sum(len([x for x in p[2].split("\n") if x.strip()]) for p in pages)
    text = {r["id"]: r["article"] for r in boilerplate.articles(df, "id", "url", "text").collect()}
    assert "# " in text[0] and "cookies" not in text[0]


def test_counts_of_a_large_site_have_no_ceiling(spark):
    n = 4_200
    word = "translate(cast({} as string), '0123456789', 'abcdefghij')"
    body = ", ' ', ".join(word.format(f"id * 100 + {i}") for i in range(40))
    text = f"concat_ws('\\n', concat('# page ', {word.format('id')}), concat({body}), 'Share this page')"
    df = spark.range(n).selectExpr("id", f"concat('https://large.example/', {word.format('id')}) url", f"{text} text")
    pages, leads = boilerplate._prepared(df, "id", "url", "text")
    stats = pages.selectExpr("inline(stats)").where("line_no in (0, 3)").select("line_no", "articles", "pages", "sites", "all").distinct().collect()
    assert sorted(tuple(r) for r in stats) == [(0, n, n, 1, n), (3, n, n, 1, n)]
    assert {r["key"]: r["n"] for r in leads.collect()}[boilerplate._lead_key("~share")] == n


def test_a_line_is_one_line_at_any_length():
    for size in (5, 300, 5000):
        a, b = (f"- {'Terms of ' * size} in Force since {year}" for year in (2019, 2024))
        assert boilerplate._key(a) == boilerplate._key(b.upper().replace("- ", "* ", 1)) != boilerplate._key(a + " x")


def test_decoding_leaves_no_contradiction():
    zero = np.zeros(1, int)
    one = lambda *s: np.array(s, float)
    blocks, region = np.array([0, 1, 2]), np.zeros(3, int)
    # a region that speaks for article, or for furniture, as a whole takes its lines along
    assert boilerplate.decode(one(-1, 1, -1), blocks, region, one(0, 0, 0), one(-3)).tolist() == [False] * 3
    assert boilerplate.decode(one(1, -0.5, 1), blocks, region, one(1, 0, 1), one(3)).tolist() == [True] * 3
    # with strong blocks it is left to them
    assert boilerplate.decode(one(-5, 5, -5), blocks, region, one(-4, 4, -4), one(0)).tolist() == [False, True, False]
    # a block is one or is cut where that is worth more than the change
    assert boilerplate.decode(one(0.3, -0.2, 0.3), np.zeros(3, int), region, one(1), one(0)).tolist() == [True] * 3
    assert boilerplate.decode(one(6, 6, -6), np.zeros(3, int), region, one(0), one(0)).tolist() == [True, True, False]
    assert boilerplate.decode(one(2), zero, zero, one(1), one(0)).tolist() == [True]


def test_pages_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "\n\n \n"), (2, "not a url", "one line"), (3, "https://x.example/a", None), (None, "u", "x"), (2, "not a url", "one line")], "id long, url string, text string")
    got = boilerplate.page_lines(df, "id", "url", "text").collect()
    assert [(r["id"], r["line_no"], r["furniture"]) for r in got] == [(2, 1, False)]
    assert boilerplate.page_lines(df.limit(0), "id", "url", "text").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b+c@mail.x.test, please", [("email", "a.b+c@mail.x.test")]),
        ("mail joe (at) post (dot) test now", [("email", "joe (at) post (dot) test")]),
        ("write to joe_x at mail dot post dot test before", [("email", "joe_x at mail dot post dot test")]),
        ("clone git@forge.example:own/repo.git first", []),
        ("maps at Goband dot product 30, stopword@2.5.3", []),
        ("call +44 20 7946 0940.", [("phone", "+44 20 7946 0940")]),
        ("tel 1 503 555 0132 ext. 57 x", [("phone", "1 503 555 0132 ext. 57")]),
        ("llama al 900-735-444 o al 0034 900520554", [("phone", "900-735-444"), ("phone", "0034 900520554")]),
        ("(415) 555 0183, 312.555.0175 and 030/23125143", [("phone", "(415) 555 0183"), ("phone", "312.555.0175"), ("phone", "030/23125143")]),
        ("checksum 7305394766, range 126000-735999, host 192.0.2.246:8066, Build 2024-8672, 940.8854 joules", []),
        ("SSN 946-60-6558, QQ 08 23 43 C and X87684134", [("id_number", "946-60-6558"), ("id_number", "QQ 08 23 43 C"), ("id_number", "X87684134")]),
        ("at Flat 4, 406 Kestrel Road, Tarnwick 48547; new", [("address", "Flat 4, 406 Kestrel Road, Tarnwick 48547")]),
        ("to 716 Ferry Street\nWesterlund, NX 57730 and", [("address", "716 Ferry Street\nWesterlund, NX 57730")]),
        ("Anschrift: Embergasse 100, 66471 Tarnwick.", [("address", "Embergasse 100, 66471 Tarnwick")]),
        ("Adresse : 67 rue du Cinder, 44203 Pellbridge.", [("address", "67 rue du Cinder, 44203 Pellbridge")]),
        ("Case 57 Lane 9 covers 654 Orchard Index rows on Vigreix Street", []),
    ],
)
def test_forms(text, want):
    assert [(k, text[a:b]) for k, a, b in sorted(pii.structured(text), key=lambda s: s[1])] == want


def people(spark):
    rng = random.Random(2)
    given, family = ["Maris", "Elwin", "Katla"], ["Ashenholt", "Brackby", "Drayford"]
    docs = []
    for i in range(150):
        g, f = rng.choice([*given, "Tovel", "Mark"]), rng.choice([*family, "Quillwater"])
        docs.append(f"Reported by {g} {f}. The {rng.choice(SUBJECTS)} was closed. Mark the {rng.choice(SUBJECTS)} as done.")
        docs.append(f"Kelmor Harbor {rng.choice(VERBS)} the {rng.choice(SUBJECTS)}; Contact {f}, {g} at once. Contact the office.")
    docs += [f"Unless Vigreix Scout {rng.choice(VERBS)} the {rng.choice(SUBJECTS)}, Kelmor Harbor {rng.choice(VERBS)} it. By design, Nostam waits. In Waniv Atlas, Siawerk reads on." for _ in range(500)]  # most capitals are no names
    probe = ["Hi Katla, the Kelmor Harbor is up. Mark the page.", "According to Dr. Brackby, yes.", "Tovel van Quillwater-Brackby signed.", "M. Quillwater and ELWIN ASHENHOLT agreed.", "Quillwater, Tovel <x@y.test>", "Hi Mark, see Contact."]
    rows = [(i, t) for i, t in enumerate(docs)] + [(1000 + i, t) for i, t in enumerate(probe)] + [(2000, None), (2001, ""), (None, "Maris Brackby")]
    names = spark.createDataFrame([(n, "given") for n in [*given, "Mark"]] + [(n, "family") for n in family], "name string, name_kind string")
    return spark.createDataFrame(rows, "id long, text string"), names, dict(rows)


@pytest.mark.parametrize("ship", [pii.SHIP, 0])
def test_names_by_disclosure(spark, ship):
    df, names, text = people(spark)
    got = {}
    for r in pii.spans(df, "id", "text", names, ship=ship).where("pii_type = 'name' and id >= 1000").orderBy("id", "start_char").collect():
        got.setdefault(r["id"], []).append(text[r["id"]][r["start_char"] : r["end_char"]])
    assert got == {1000: ["Katla"], 1001: ["Brackby"], 1002: ["Tovel van Quillwater-Brackby"], 1003: ["M. Quillwater", "ELWIN ASHENHOLT"], 1004: ["Quillwater, Tovel"], 1005: ["Mark"]}


@pytest.mark.parametrize("size", [64, 100, 130, 400, 5000])
def test_long_tokens_are_found_whole(size):
    local = "ab.c" * (size // 4)
    for text in (f"mail {local}@mail.x.test now", f"mail x@{local}.test now", f"write to {' dot '.join(['ab'] * (size // 8))} at mail dot x dot test"):
        got = pii.structured(text)
        assert [k for k, _, _ in got] == ["email"] and len(got[0:1]) == 1
    a, b = pii.structured(f"mail {local}@mail.x.test now")[0][1:]
    assert (a, b) == (5, 5 + len(local) + 12)
    given = "M" + "a" * size
    assert pii.names_in(f"by {given} Quillwater", {given.lower(): (2, 0), "quillwater": (0, 2)}) == [(3, 3 + len(given) + 11)]
    assert pii._left(f"x {given}-b ", len(given) + 5).startswith(given)


def test_an_address_book_too_large_to_send(spark):
    df, names, text = people(spark)
    large = names.unionByName(spark.range(250_000).selectExpr("concat('zz', translate(cast(id as string), '0123456789', 'abcdefghij')) name", "'family' name_kind"))
    key = lambda rows: sorted((r["id"], r["pii_type"], r["start_char"]) for r in rows.collect())
    assert key(pii.spans(df, "id", "text", large)) == key(pii.spans(df, "id", "text", names))


@pytest.mark.parametrize("ship", [pii.SHIP, 0])
def test_shapes_that_stand_apart_from_persons_are_cleared(spark, ship):
    """A part number shaped like a phone number, always in plain company, is none; the shape of the phone beside names stays."""
    rows = [(i, f"The part 212.555.{i:04d} fits the rack and the cable of the older frame in every case that is known so far.") for i in range(60)]
    rows += [(100 + i, f"Call Tovel Quillwater (mail t.quill{i}@x.test) on +44 20 7946 {i:04d} today.") for i in range(60)]
    names = spark.createDataFrame([("Tovel", "given"), ("Quillwater", "family")], "name string, name_kind string")
    got = pii.spans(spark.createDataFrame(rows, "id long, text string"), "id", "text", names, ship=ship).where("pii_type = 'phone'").collect()
    assert sorted(r["id"] for r in got) == list(range(100, 160))


def test_redaction_leaves_the_rest(spark):
    df, names, text = people(spark)
    got = {r["id"]: r["text"] for r in pii.redacted(df, "id", "text", names).collect()}
    assert got[1004] == "[NAME] <[EMAIL]>" and got[2001] == "" and 2000 not in got
    spans = {}
    for r in pii.spans(df, "id", "text", names).collect():
        spans.setdefault(r["id"], []).append((r["start_char"], r["end_char"], r["pii_type"]))
    for i, t in got.items():
        out, at = "", 0
        for a, b, k in sorted(spans.get(i, [])):
            out += text[i][at:a] + f"[{k.upper()}]"
            at = b
        assert out + text[i][at:] == t


def test_no_names_and_no_documents(spark):
    df, names, _ = people(spark)
    assert pii.spans(df.limit(0), "id", "text", names).count() == 0
    assert pii.spans(df, "id", "text", names.limit(0)).where("pii_type = 'name'").count() == 0
