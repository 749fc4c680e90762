"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

Lexicon. From labelled rows (at most TRAIN_ROWS, chosen by a hash of the id; equal texts count once): words, and word beginnings for inflected
stems, that MIN_SHARE of the toxic documents have and whose log odds against the clean ones reach MIN_ODDS. There are at
most 1 / MIN_SHARE times the words of a document of them, whatever the corpus. Of a word and its beginnings the one that
tells most stays.

Matching. The Levenshtein automaton of the allowed distance (0 under 5 letters, 1 up to 8, 2 beyond) runs on all terms at
once: a state is the set of (trie node, edits so far), intersecting automaton and trie, and is made deterministic when
first reached. A stem matches when it is the start of a word. Most words reach the empty state after a few letters.

Density. A unit counts for a document of the lexicon's statistics, and a match for its score, by how large a share of the
words it is: in a long text some chance matches are nothing, in a short one they are much.

Context. Every match has a score of its window, the WINDOW words before and after it: MARKS if quotation marks open before
and close after it there, without another mark of the other kind between, ATTRIBUTED if a word of attribution is there
("said", "wrote"), and COMPANY for each match in the window that no marks enclose, up to two. A match that reaches QUOTED is
quotation, any other is abuse: so a stray mark elsewhere changes nothing, and an insult beside the quotation speaks against
it. Quoted, exact, misspelled and masked matches have weights of their own, learned as log likelihood ratios of their
presence in toxic and clean rows, as has the number of matches in a window; where labels have no quotation, a quoted term
weighs QUOTED_SHARE of the term itself.

Defined cases: null and empty texts score as texts without a match; null labels and labels of unknown documents are left
out; of repeated labels the toxic one counts; with no toxic or no clean row to learn from every score is the prior
(0 without any label); equal texts score alike; extra columns stay out.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import learn_rows, map_rows, table, work_table

TRAIN_ROWS, MIN_SHARE, MIN_ODDS, SHRINK = 30_000, 0.03, 3.0, 50.0
THRESHOLD, WINDOW = 0.3, 12
#: one in so many words: what makes a unit count at all, and the bounds of the density classes
UNIT_DENSITY, DENSITIES = 300, (400, 150, 60)
STEMS = range(4, 8)
_EDGE = "\"'“”„«»‹›‘’()[]{}<>.,;:!?…-–—*_~`"
_QUOTES = "\"“”„«»‹›"
#: the score of a match's window
MARKS, ATTRIBUTED, COMPANY, QUOTED, QUOTED_SHARE = 1.0, 0.5, -0.5, 1.0, 0.25
ATTRIBUTION = frozenset(
    "said says say saying wrote writes written called calls quoted quotes quote word words term phrase insult claimed reported sagte sagt schrieb schreibt nannte wort zitat dijo dice"
    " escribió escribe llamó palabra cita dit disait écrit écrivait appelé mot citation".split()
)
#: what a worker keeps of words without a match, of MAX_RUN characters at most (some 50 MB), and of automaton states
_MAX_CLEAN, _MAX_RUN, _MAX_STATES = 200_000, 64, 50_000


def distance_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) <= 8 else 2


class Matcher:
    """terms: (text, is a stem). States are made when first reached."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.words: list[list[int]] = [[]]
        self.reach = [0]  # the largest distance allowed to a term at or below a node
        for i, (term, _) in enumerate(terms):
            node, d = 0, distance_for(term)
            self.reach[0] = max(self.reach[0], d)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.words.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], d)
            self.words[node].append(i)
        self.letters = {c for x in self.children for c in x}
        self.clean: set[str] = set()
        self._reset()

    def _reset(self) -> None:
        start = self._closed({0: 0})
        self.ids = {start: 0}
        self.states = [start]
        self.steps: list[dict[str, int]] = [{}]
        self.hits = [self._ends(start)]

    def _closed(self, at: dict[int, int]) -> frozenset:
        """Letters of a term may be missing in the word: follow them at a cost of one each."""
        todo = list(at)
        while todo:
            node = todo.pop()
            e = at[node] + 1
            for child in self.children[node].values():
                if e <= self.reach[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        return frozenset(at.items())

    def _ends(self, state: frozenset) -> list[tuple[int, int]]:
        return [(i, e) for node, e in state for i in self.words[node] if e <= distance_for(self.terms[i][0])]

    def _step(self, state: int, c: str) -> int:
        to: dict[int, int] = {}
        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.reach[child] and cost < to.get(child, 99):
                    to[child] = cost
            if e + 1 <= self.reach[node] and e + 1 < to.get(node, 99):
                to[node] = e + 1
        closed = self._closed(to)
        n = self.ids.get(closed)
        if n is None:
            n = self.ids[closed] = len(self.states) if closed else -1
            if closed:
                self.states.append(closed)
                self.steps.append({})
                self.hits.append(self._ends(closed))
        self.steps[state][c] = n
        return n

    def match(self, word: str) -> list[tuple[int, int]]:
        """(term, distance) of the terms that the word, or for stems its start, is near to; the nearest only."""
        best: dict[int, int] = {}
        state, letters = 0, self.letters
        for n, c in enumerate(word, 1):
            if c not in letters:
                c = "\0"
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            for i, e in self.hits[state]:
                if e < best.get(i, 99) and (n == len(word) or self.terms[i][1] and word[0] == self.terms[i][0][0]):
                    best[i] = e
        if not best:
            return []
        least = min(best.values())
        return [(i, e) for i, e in best.items() if e == least]

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(word number, term, distance) of the matches of a lower-cased text, in order."""
        if len(self.states) > _MAX_STATES:
            self._reset()
        runs = text.split()
        hits = {}
        for run in set(runs).difference(self.clean):
            word = run.strip(_EDGE)
            if word and (found := self.match(word)):
                hits[run] = found
            elif len(run) <= _MAX_RUN:
                self.clean.add(run)
        if len(self.clean) > _MAX_CLEAN:
            self.clean.clear()
        return [(n, i, e) for n, run in enumerate(runs) if run in hits for i, e in hits[run]] if hits else []


def _density(count: int, words: int) -> int:
    """The share of the words in four classes."""
    return sum(count * per > words for per in DENSITIES)


def features(text: str | None, matcher: Matcher) -> set[tuple[int, int, int]]:
    """(term, kind, density class) of the matches: kind 0 exact, 1 misspelled, 2 quoted, 3 masked (misspelled with other characters than
    letters, or with letters thrice in a row); (-1, c, 0) for c matches but plainly misspelled ones in one window, 3 at most."""
    if not text:
        return set()
    lowered = text.lower()
    found = matcher.find(lowered)
    if not found:
        return set()
    runs = lowered.split()
    out: set[tuple[int, int, int]] = set()
    counts: Counter = Counter()
    quoted = _quoted(runs, sorted({n for n, *_ in found}))
    kinds = [(n, i, 0 if not e else 3 if _masked(runs[n].strip(_EDGE)) else 1) for n, i, e in found]
    firm = sorted({n for n, _, kind in kinds if kind != 1})
    for n, i, kind in kinds:
        if n in quoted:
            counts[i, 2] += 1
            continue
        counts[i, kind] += 1
        if kind != 1:
            near = bisect.bisect_right(firm, n + WINDOW) - bisect.bisect_left(firm, n - WINDOW)
            out.add((-1, min(3, near), 0))
    return out | {(i, kind, _density(c, len(runs))) for (i, kind), c in counts.items()}


def _marks(run: str) -> tuple[bool, bool]:
    """Whether quotation marks stand before and after the word of a run; a run without a word has none."""
    word = run.strip(_EDGE)
    at = run.find(word) if word else 0
    return any(c in _QUOTES for c in run[:at]), bool(word) and any(c in _QUOTES for c in run[at + len(word) :])


def _quoted(runs: list[str], at: list[int]) -> set[int]:
    """The matches (word numbers, sorted) that their windows tell to be quotation."""
    enclosed = set()
    for n in at:
        opens = closes = False
        for j in range(n, max(-1, n - WINDOW - 1), -1):
            before, after = _marks(runs[j])
            if j < n and after:
                break
            if before:
                opens = True
                break
        for j in range(n, min(len(runs), n + WINDOW + 1)) if opens else ():
            before, after = _marks(runs[j])
            if j > n and before:
                break
            if after:
                closes = True
                break
        if closes:
            enclosed.add(n)
    free = [n for n in at if n not in enclosed]
    out = set()
    for n in at:
        company = bisect.bisect_right(free, n + WINDOW) - bisect.bisect_left(free, n - WINDOW) - (n not in enclosed)
        told = any(r.strip(_EDGE) in ATTRIBUTION for r in runs[max(0, n - WINDOW) : n + WINDOW + 1])
        if MARKS * (n in enclosed) + ATTRIBUTED * told + COMPANY * min(2, company) >= QUOTED:
            out.add(n)
    return out


def _masked(word: str) -> bool:
    return not word.isalpha() or any(word[i] == word[i + 1] == word[i + 2] for i in range(len(word) - 2))


class Scorer:
    def __init__(self, terms: list[tuple[str, bool]], prior: float, weights: dict[tuple[int, int, int], float]) -> None:
        self.terms, self.prior, self.weights = terms, prior, weights
        self.matcher: Matcher | None = None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "prior": self.prior, "weights": self.weights, "matcher": None}

    def score(self, text: str | None) -> float:
        if self.matcher is None:
            self.matcher = Matcher(self.terms)
        found = features(text, self.matcher) if self.terms else ()
        z = self.prior + sum(self.weights.get(f, 0.0) for f in found)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _units(text: str) -> set[tuple[str, bool]]:
    """The words and word beginnings that are a share of the text's words."""
    runs = text.lower().split()
    words: Counter = Counter()
    for r, n in Counter(runs).items():
        words[r.strip(_EDGE)] += n
    units: Counter = Counter()
    for w, n in words.items():
        if w:
            units[w, False] += n
            for k in STEMS:
                if len(w) >= k:
                    units[w[:k], True] += n
    return {u for u, n in units.items() if n * UNIT_DENSITY >= len(runs)}


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS, min_share: float = MIN_SHARE, min_odds: float = MIN_ODDS) -> Scorer:
    """labelled: (doc_id, text, toxic)."""
    rows = labelled.where(F.col("toxic").isNotNull() & F.col("text").isNotNull()).select("text", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return Scorer([], 30.0 if n_bad else -30.0, {})

    def counted(df: DataFrame, wanted: set | None) -> dict[tuple[str, bool], int]:
        def make():
            def apply(batch: dict) -> dict:
                c: Counter = Counter()
                for t in batch["text"]:
                    units = _units(t)
                    c.update(units if wanted is None else units & wanted)
                return {"unit": [u for u, _ in c], "stem": [s for _, s in c], "n": list(c.values())}

            return apply

        out = map_rows(df, make, "unit string, stem boolean, n bigint").groupBy("unit", "stem").agg(F.sum("n").alias("n"))
        if wanted is None:
            out = out.where(F.col("n") >= max(4, min_share * n_bad))
        return {(u, s): n for u, s, n in out.collect()}  # bounded by the share, or by those wanted

    bad = counted(rows.where("toxic = 1").select("text"), None)
    good = counted(rows.where("toxic = 0").select("text"), set(bad))
    odds = {u: math.log((n + 0.5) / (n_bad - n + 0.5)) - math.log((good.get(u, 0) + 0.5) / (n_good - good.get(u, 0) + 0.5)) for u, n in bad.items()}
    terms: list[tuple[str, bool]] = []
    # of a stem and its words the one that tells more toxic documents stays; of equals whole words, then longer stems
    for unit in sorted((u for u in odds if odds[u] >= min_odds), key=lambda u: (-round(bad[u] * odds[u], 6), u[1], -len(u[0]), u[0])):
        if not any(unit[0].startswith(t) or t.startswith(unit[0]) for t, _ in terms):
            terms.append(unit)
    if not terms:
        return Scorer([], math.log(n_bad / n_good), {})

    def make_found():
        matcher = Matcher(terms)

        def apply(batch: dict) -> dict:
            c: Counter = Counter()
            for t, toxic in zip(batch["text"], batch["toxic"], strict=True):
                found = features(t, matcher)
                c.update((toxic, *f) for f in found or {(-2, 0, 0)})
            return {"toxic": [k[0] for k in c], "term": [k[1] for k in c], "kind": [k[2] for k in c], "density": [k[3] for k in c], "n": list(c.values())}

        return apply

    per = map_rows(rows, make_found, "toxic int, term int, kind int, density int, n bigint").groupBy("toxic", "term", "kind", "density").agg(F.sum("n").alias("n"))
    seen = {tuple(r[:4]): r[4] for r in per.collect()}  # a few rows for each term
    none = lambda t: seen.get((t, -2, 0, 0), 0)
    prior = math.log((none(1) + 0.5) / (none(0) + 0.5))  # documents without a match
    weights = {}
    total = lambda t, k, d: sum(n for (u, i, kind, e), n in seen.items() if u == t and kind == k and e == d and i >= 0) / len(terms)
    for k in range(4):
        for d in range(len(DENSITIES) + 1):  # each term's rates are shrunk towards those of all terms
            b_all, g_all = (total(1, k, d) + 0.05) / n_bad, (total(0, k, d) + 0.05) / n_good
            for i in range(len(terms)):
                b, g = seen.get((1, i, k, d), 0), seen.get((0, i, k, d), 0)
                weights[i, k, d] = math.log((b + SHRINK * b_all) / (n_bad + SHRINK)) - math.log((g + SHRINK * g_all) / (n_good + SHRINK))
                if k == 3 and not b and not g:  # a masked term that was never seen counts half of the term itself
                    weights[i, k, d] = 0.5 * max(0.0, weights[i, 0, d])
                if k == 2 and not total(1, 2, d) and not total(0, 2, d):
                    weights[i, k, d] = QUOTED_SHARE * max(0.0, weights[i, 0, d])
    ratio = lambda c: math.log((seen.get((1, -1, c, 0), 0) + 0.5) / (n_bad + 1)) - math.log((seen.get((0, -1, c, 0), 0) + 0.5) / (n_good + 1))
    for c in range(1, 4):  # what company adds to a single match, which its own weight tells
        weights[-1, c, 0] = max(0.0, ratio(c) - ratio(1)) if c > 1 else 0.0
    return Scorer(terms, prior, weights)


def labelled_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most about train_rows labelled rows, chosen by a hash of the id."""
    truth = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = truth.count()
    share = min(1.0, train_rows / max(1, n))
    truth = truth.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # as the sample is bounded, so is its broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(truth), "doc_id")
    # copies are one observation, else the words of a copied document pass for toxic terms
    return work_table(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "labelled")


def score(docs: DataFrame, scorer: Scorer, carry: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The carried columns with the score of every whole text as ``out``; only the text is looked at."""
    kinds = dict(docs.dtypes)
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # terms and weights

    def make():
        one = held.value.score
        return lambda rows: {**{f"c_{c}": rows[f"c_{c}"] for c in carry}, "z": [one(t) for t in rows["t"]]}

    # names of our own on the way, so that carried columns may have any
    given = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in carry], F.col("text").alias("t"))
    found = map_rows(given, make, ", ".join([*(f"`c_{c}` {kinds[c]}" for c in carry), "z double"]))
    return found.select(*[F.col(f"`c_{c}`").alias(c) for c in carry], F.col("z").alias(out))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learnable = table(spark, sf_dir, "documents"), learn_rows(F.col("doc_id"), 4, 2)
    scorer = learn(labelled_rows(docs, table(spark, sf_dir, "labels").where(learnable)))
    out = score(docs, scorer)
    return out.select("doc_id", (~learnable).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
