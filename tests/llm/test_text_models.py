"""Operators 2, 5, 8 and 9: held-out accuracy, brute force and round trips."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import html_extract, language_id, toxicity, winnowing
from tabloom.llm.common import table

SF = "/root/testdata/sf0.01"


# ---- language ----------------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_rows(spark):
    got = language_id.op2_language_id(spark, SF).where("held_out")
    j = got.join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    n, right = j.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 250 and right / n >= 0.99


def test_language_of_odd_rows(spark, documents, odd):
    model = language_id.learn(documents([(i, "the cat and the dog and the bird") for i in range(20)]))
    got = {}
    for r in language_id.identify(documents(odd), model).collect():
        got[r.doc_id] = r
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 4))
    assert got[7].lang_pred == "en" and 0 <= got[7].score <= 1
    empty = language_id.learn(documents([]))
    assert {r.lang_pred for r in language_id.identify(documents(odd), empty).collect()} == {"und"}
    assert language_id.identify(documents([]), model).count() == 0


def test_slots_hold_every_trigram_of_each_language():
    r = np.random.default_rng(1)
    grams = r.integers(0, 2**62, 5000).astype(np.uint64)
    owners = r.integers(0, 3, 5000)
    f = language_id.LanguageFilter(["a", "b", "c"], grams, owners, "a")
    masks = None
    for at in f._places(grams):
        masks = f.slots[at] if masks is None else masks & f.slots[at]
    assert ((masks[:, 0] >> owners.astype(np.uint8)) & 1).all()
    assert (f.false_rate < 0.01).all()


# ---- toxicity ----------------------------------------------------------------------------------------------------------


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1]


def test_automata_find_what_edit_distance_finds():
    r = random.Random(3)
    terms = [("idiot", False), ("moron", False), ("worthless", False), ("bad", False), ("patheti", True)]
    m = toxicity.Matcher(terms)
    for _ in range(3000):
        base = r.choice(terms)[0]
        w = list(base + r.choice(["", "", "s", "cally"]))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "x", "o", "1"])
        word = "".join(w)
        if not word:
            continue
        want = {}
        for i, (t, stem) in enumerate(terms):
            ends = range(1, len(word) + 1) if stem and word[0] == t[0] else [len(word)]
            e = min(edits(t, word[:n]) for n in ends)
            if e <= toxicity.distance_for(t):
                want[i] = e
        least = min(want.values(), default=None)
        assert dict(m.match(word)) == {i: e for i, e in want.items() if e == least}, word


def test_quotation_and_masking_are_told_apart():
    m = toxicity.Matcher([("idiot", False)])
    kinds = lambda t: {k for i, k, _ in toxicity.features(t, m) if i >= 0}
    assert kinds("you idiot, go") == {0}
    assert kinds("you idoit1 go") == set() and kinds("you ideot go") == {1}
    assert kinds("you id1ot go") == {3} and kinds("you idi*t go") == {3}
    assert kinds('they said "you idiot" and left') == {2}
    assert kinds(None) == set() == kinds("")
    # only the window counts: a stray mark before or after, marks far away, marks between
    assert kinds('a 5" pipe broke, then they said "you idiot" and left') == {2} == kinds('they said "you idiot" and left with a 5" pipe')
    assert kinds('a 5" pipe, you idiot, and a 6" one') == {0} and kinds('you idiot " go') == {0}
    far = "word " * 20
    assert kinds(f'"{far}you idiot {far}"') == {0} and kinds(f'"so" you idiot "there"') == {0}
    # an insult beside the quotation speaks against it, a word of attribution for it
    assert kinds('"idiot" indeed, you idiot') == {0} and kinds('he said "idiot" to the idiot') == {2, 0}


def test_context_decides_between_quotation_and_abuse(spark, documents):
    """The same word in every text; only its window tells the toxic ones."""
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    filler = [f"w{i % 17} x{i % 23} y{i % 5}" for i in range(400)]
    train = documents([(i, f"{filler[i]} " + (f"you idiot go {i}" if i % 2 else f'they said "you idiot" once {i}' if i % 4 else f"nothing at all {i}")) for i in range(400)])
    s = toxicity.learn(toxicity.labelled_rows(train, labels), min_odds=0.5)
    assert any(t == "idiot" or "idiot".startswith(t) for t, _ in s.terms)
    by = {r.doc_id: r.score for r in toxicity.score(documents([(1, "oh you idiot leave us"), (2, 'they wrote "such an idiot" there'), (3, "a fine day")]), s).collect()}
    assert by[1] > 0.5 > by[2] and by[1] > by[3]


def test_odd_column_names_are_carried(spark, documents):
    names = ("score", "Score_", "lang_pred", "t", "z", "c_text", "x", "s")
    docs = documents([(1, "some text"), (2, None)]).withColumns({c: F.lit(f"own {c}") for c in names})
    for out in (toxicity.score(docs, toxicity.Scorer([], -1.0, {}), carry=tuple(docs.columns), out="_score"), language_id.identify(docs, language_id.learn(docs), carry=tuple(docs.columns), out=("_l", "_s"))):
        assert out.columns[: len(docs.columns)] == docs.columns and all(r[c] == f"own {c}" for r in out.collect() for c in names)


def test_languages_equal_plain_sets(spark):
    """The sliced filter's corrected counts are those of sets of trigrams, but for its few false positives."""
    docs = table(spark, SF, "documents")
    model = language_id.learn(docs)
    r = random.Random(4)
    words = ["the", "und", "que", "les", "haus", "casa", "maison", "house", "ñandú", "straße"]
    sets = [{a for a in words if r.random() < 0.5} for _ in range(3)]
    grams = [sorted({int(g) for w in s for g in language_id.trigrams(w)}) for s in sets]
    f = language_id.LanguageFilter(["a", "b", "c"], np.array([g for own in grams for g in own], np.uint64), np.array([i for i, own in enumerate(grams) for _ in own]), "a")
    for _ in range(200):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 30)))
        counts, n = f.counts(text)
        want = [sum(int(g) in set(own) for g in language_id.trigrams(text)) for own in grams]
        assert np.abs(counts - want).max() <= 0.01 * n + 1e-6
        best = max(range(3), key=lambda i: (want[i], -i))
        if sum(want) and sorted(want)[-2] < max(want):
            assert f.judge(text)[0] == "abc"[best]
    assert set(model.languages) == {"de", "en", "es", "fr"}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"  # enough labels of each language
    got = toxicity.op5_toxicity(spark, sf)
    j = got.where("held_out").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    n, right, fine = j.agg(F.count("*"), F.count_if(F.col("toxic") == F.col("predicted")), F.avg((F.col("score").between(0, 1)).cast("int"))).first()
    assert right / n >= 0.95 and fine == 1


def test_toxicity_of_odd_rows(spark, documents, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)], "doc_id bigint, quality int, toxic int")
    train = documents([(i, f"text {i} with {'slur' * (i % 2)} in it") for i in range(100)])
    s = toxicity.learn(toxicity.labelled_rows(train, labels))
    got = toxicity.score(documents([*odd, (50, "what a slur"), (51, "nothing here")]), s).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(odd) + 2 and by[50] > 0.9 > 0.1 > by[51] and by[1] == by[2] == by[3]
    none = toxicity.learn(toxicity.labelled_rows(train, labels.where("false")))
    assert {round(r.score, 3) for r in toxicity.score(documents(odd), none).collect()} == {0.0}
    assert toxicity.score(documents([]), s).count() == 0


# ---- winnowing ---------------------------------------------------------------------------------------------------------


def brute_winnow(text, k, w):
    k = min(k, len(text))
    n = len(text) - k + 1 if text else 0
    hashes = [int(winnowing.winnow(text[i : i + k], k, 1)[0][0]) for i in range(n)]
    picked = []
    for s in range(max(1, n - w + 1) if n else 0):
        part = hashes[s : s + w]
        at = s + max(i for i, h in enumerate(part) if h == min(part))
        if not picked or picked[-1] != at:
            picked.append(at)
    return [(hashes[i], i) for i in picked]


def test_winnowing_picks_rightmost_minima():
    r = random.Random(7)
    for _ in range(150):
        t = "".join(r.choice("ab é🙂") for _ in range(r.randint(0, 60)))
        k, w = r.randint(1, 5), r.randint(1, 7)
        h, p = winnowing.winnow(t, k, w)
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == brute_winnow(t, k, w)


def test_a_shared_passage_gives_a_shared_mark():
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    for _ in range(50):
        a, b = ("".join(r.choice("abcdefgh ") for _ in range(90)) + passage + "".join(r.choice("abcdefgh ") for _ in range(70)) for _ in "ab")
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edits_use_the_successor_across_partitions(spark, documents, odd, parts):
    r = random.Random(parts)
    cases = sorted([(i, t) for i, t in odd if i not in (None, 6)] + [(10 * i, "".join(r.choice("abc dé") for _ in range(r.randint(0, 90)))) for i in range(1, 120)])
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {x.doc_id: x for x in winnowing.edited_fingerprints(documents(cases).repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(cases)
    for n, (i, t) in enumerate(cases):
        t, following = t or "", cases[(n + 1) % len(cases)][1] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(t) and 0 <= got[i].near_edited <= 1
        assert got[i].edited_fingerprint == winnowing.digest(*winnowing.winnow(edited))
        assert got[i].near_next == pytest.approx(winnowing.likeness(np.unique(winnowing.winnow(t)[0]), np.unique(winnowing.winnow(following)[0])))


def test_fingerprints_of_few_and_equal_rows(spark, documents, odd):
    assert winnowing.edited_fingerprints(documents([])).count() == 0
    (one,) = winnowing.edited_fingerprints(documents([(5, "just one text, and nothing else")])).collect()
    assert one.near_next == 1.0
    got = winnowing.edited_fingerprints(documents(odd)).collect()
    assert len(got) == len(odd) and len({x.fingerprint for x in got if x.doc_id in (6, 7)}) == 1
    marks = winnowing.fingerprints(documents([(1, "some text that is long enough"), (2, None)])).collect()
    assert {x.doc_id: bool(x.marks) for x in marks} == {1: True, 2: False}


# ---- HTML --------------------------------------------------------------------------------------------------------------


def test_minimum_cut_is_minimal():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 7)
        s, t = ([r.randint(0, 9) for _ in range(n)] for _ in "st")
        e = [(a, b, r.randint(0, 6)) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda on: sum(t[i] if on[i] else s[i] for i in range(n)) + sum(c for a, b, c in e if on[a] != on[b])  # noqa: B023, E731
        assert cost(html_extract.minimum_cut(s, t, e)) == min(map(cost, itertools.product([True, False], repeat=n)))


def test_extraction_of_the_test_pages(spark):
    import html
    import re

    got = {r.page_id: r for r in html_extract.op9_html_extraction(spark, SF).collect()}
    for p in table(spark, SF, "pages").collect():
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"<p>|<h1>", article))
        assert got[p.page_id].text == "\n\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


LONG = "This sentence of the article is long enough to be told from a menu, and it ends as sentences do. " * 2


@pytest.mark.parametrize(
    "extra",
    [
        "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>", "<header><p>The site's name and its long slogan, as ever.</p></header>", "<footer><p>All rights are reserved by the owner of this site.</p></footer>",
        "<aside><p>A sidebar with a long text that also has sentences. Yes.</p></aside>", '<div class="cookie-notice"><p>We use cookies to do things. Please agree to that now.</p></div>', '<div class="ad">Buy this now, it is very good and cheap.</div>',
        "<form><p>Give us your address, so that we can write to you.</p><input><button>Go</button></form>", "<script>var a = '</p><p>no';</script>", "<style>p { color: red }</style>", "<!-- <p>a comment of the markup</p> -->",
        '<section id="comments"><p>A reader says that this is a great article, really great.</p></section>', '<p hidden>This can not be seen by anyone who reads the page.</p>',
    ],
)
def test_what_is_not_the_article_goes(extra):
    for page in (f"<body>{extra}<main><h1>Title</h1><p>{LONG}</p></main></body>", f"<body><article><h1>Title</h1><p>{LONG}</p>{extra}</article></body>", f"<div><h1>Title</h1><p>{LONG}</p></div>{extra}"):
        if "<header>" in extra and "<article>" in page:
            continue  # a header within the article may be part of it
        assert html_extract.main_text(page) == f"Title\n\n{LONG.strip()}"


def test_the_articles_own_parts_stay():
    tagged = f'<article><p>{LONG}</p><div class="story-tags"><p>{LONG}</p></div><div class="tags"><a href=a>one</a> <a href=b>two</a></div></article>'
    assert html_extract.main_text(tagged) == f"{LONG.strip()}\n\n{LONG.strip()}"
    formula = f"<article><p>{LONG} It is <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a = 2</annotation></math> here.</p></article>"
    assert html_extract.main_text(formula) == f"{LONG.strip()} It is a=2 here."


def test_the_cut_corrects_blocks_of_pages_without_telling_markup(spark):
    """Tags, classes and roles that tell what a block is are renamed: only text and neighbours are left."""
    import re

    pages = table(spark, SF.replace("0.001", "0.01"), "pages")
    weights = html_extract.learn(pages)
    assert weights is not html_extract.DEFAULT_TEXT and weights[1, 2] < -2  # blocks of links
    right = {False: 0, True: 0}
    total = wrongly_flipped = 0
    for (source,) in pages.select("html").collect():
        truth = set(html_extract.main_text(source, weights).split("\n\n"))
        plain = re.sub(r"<(/?)(article|nav|footer|aside|header|main|section|form|figure|dialog|menu)\b([^>]*)>", r"<\1div>", source)
        found = html_extract.blocks(re.sub(r'\s(class|id|role|aria-\w+|itemprop)="[^"]*"', "", plain))
        for b, kept in zip(found, html_extract.label(found, weights), strict=True):
            alone, wanted = html_extract.evidence(b, weights) > 0, b.text in truth
            right[False] += alone == wanted
            right[True] += kept == wanted
            wrongly_flipped += kept != alone == wanted
            total += 1
    assert right[True] > right[False] + 10 and wrongly_flipped <= 2 and right[True] / total > 0.9


def test_text_weights_without_labels_of_both_kinds(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None)], "page_id bigint, url string, html string")
    assert html_extract.learn(pages) is html_extract.DEFAULT_TEXT and html_extract.learn(pages.where("false")) is html_extract.DEFAULT_TEXT


def test_broken_and_odd_html(spark):
    f = html_extract.main_text
    assert f(None) == f("") == f("   ") == f("<p></p>") == f("<script>never closed") == ""
    assert f(f"<article><p>{LONG}<p>a &lt;b&gt; &amp;&nbsp;c\n\t d. {LONG}</div></article") == f"{LONG.strip()}\n\na <b> & c d. {LONG.strip()}"
    assert f(f"<p>{LONG}</p><p title='a > b'>{LONG}</p><p title=\"unclosed") == f"{LONG.strip()}\n\n{LONG.strip()}"
    assert f("<" * 20_000) is not None and f("<a href='" * 3000) is not None
    assert f(f"<article>{'<div>' * 3000}<p>{LONG}</p></article>") == LONG.strip()
    pages = spark.createDataFrame([(None, None, None), (1, "u", f"<article><p>{LONG * 2000}</p></article>"), (1, "u", "")], "page_id bigint, url string, html string")
    assert sorted(r.n_chars for r in html_extract.extract(pages).collect()) == [0, 0, len((LONG * 2000).strip())]
    assert html_extract.extract(pages.where("false")).count() == 0
