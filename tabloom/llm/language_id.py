"""Language ID with a bit-sliced Bloom filter of character trigrams.

Learning: trigrams of letters (case folded, other characters as spaces, none with a space in the middle) are counted by
language. A trigram belongs to a language if at least MIN_SHARE of the language's trigrams are it and this share is at
least RATIO of its largest share in any language; so a language has 1 / MIN_SHARE trigrams at most, whatever the corpus.
A Bloom filter whose slots hold a bit for each language (the filters of all languages, sliced by slot) stores them: the
bitwise and of a trigram's slots gives all languages that contain it, in one look.

Deciding: over all trigrams of a text each language's bits are counted; the expected false positives of its slice (fill
rate to the power of the hashes) are taken off; the largest corrected count wins, score is its share of all counts.

Learning uses at most TRAIN_ROWS labelled rows, chosen by a hash of the id; texts are read whole, and the rows to judge
are all rows. Defined cases: null text or one without a letter is ``und`` with score 0; a text none of whose trigrams is
known gets the most frequent language with score 0; null labels are not learned from; with no labelled row everything is
``und``; ties go to the language first in code point order; repeated rows repeat; extra columns stay out.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import learn_rows, map_rows, table

MIN_SHARE, RATIO = 2e-5, 0.4
SLOTS, HASHES = 1 << 20, 3
TRAIN_ROWS = 60_000
UNKNOWN = "und"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """One integer for each trigram of the text: 21 bits a code point."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 32).astype(np.uint64)
    middle = codes[1:-1]
    grams = (codes[:-2] << np.uint64(42)) | (middle << np.uint64(21)) | codes[2:]
    return grams[middle != 32]


class LanguageFilter:
    """languages: names in order; known: (trigram, language number) pairs; fallback: the most frequent language."""

    def __init__(self, languages: list[str], grams: np.ndarray, owners: np.ndarray, fallback: str) -> None:
        self.languages, self.fallback = languages, fallback
        words = -(-len(languages) // 64)
        self.slots = np.zeros((SLOTS, words), np.uint64)
        bits = np.uint64(1) << (owners % 64).astype(np.uint64)
        for at in self._places(grams):
            np.bitwise_or.at(self.slots, (at, owners // 64), bits)
        fill = [np.count_nonzero(self.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS for i in range(len(languages))]
        self.false_rate = np.asarray(fill) ** HASHES
        if len(languages) <= 8:
            self.slots = self.slots.astype(np.uint8)

    @staticmethod
    def _places(grams: np.ndarray) -> list[np.ndarray]:
        return [((grams ^ (grams >> np.uint64(29))) * o >> np.uint64(64 - 20)).astype(np.int64) for o in _ODD[:HASHES]]

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """(corrected count of each language, trigrams)."""
        grams = trigrams(text)
        masks = None
        for at in self._places(grams):
            masks = self.slots[at] if masks is None else masks & self.slots[at]
        one = self.slots.dtype.type(1)
        raw = np.array([np.count_nonzero(masks[:, i // 64] >> self.slots.dtype.type(i % 64) & one) for i in range(len(self.languages))], np.float64)
        return np.maximum(0.0, (raw - len(grams) * self.false_rate) / (1 - self.false_rate)), len(grams)

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        counts, n = self.counts(text)
        if not n:
            return UNKNOWN, 0.0
        total = counts.sum()
        if not total:
            return self.fallback, 0.0
        best = int(np.argmax(counts))
        return self.languages[best], float(counts[best] / total)


def learn(labelled: DataFrame, min_share: float = MIN_SHARE, ratio: float = RATIO, train_rows: int = TRAIN_ROWS) -> LanguageFilter:
    """labelled: (doc_id, text, lang); null langs are left out."""
    labelled = labelled.where(F.col("lang").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return LanguageFilter([], np.empty(0, np.uint64), np.empty(0, np.int64), UNKNOWN)
    share = min(1.0, train_rows / sum(sizes.values()))
    sample = labelled.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) < int(share * 1_000_000))

    def make():
        def apply(rows: dict) -> dict:
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            for lang in set(rows["lang"]):
                parts = [trigrams(t) for t, x in zip(rows["text"], rows["lang"], strict=True) if x == lang and t]
                if parts:
                    grams, n = np.unique(np.concatenate(parts), return_counts=True)
                    out["lang"] += [lang] * len(grams)
                    out["gram"] += grams.astype(np.int64).tolist()
                    out["n"] += n.tolist()
            return out

        return apply

    counts = map_rows(sample.select("lang", "text"), make, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= min_share * F.col("total"))  # one row a language
    rows = shares.select("lang", "gram", (F.col("n") / F.col("total")).alias("p")).toPandas()  # at most languages / min_share
    languages = sorted(sizes)
    top = rows.groupby("gram").p.transform("max")
    rows = rows[rows.p >= ratio * top]
    owners = rows.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    return LanguageFilter(languages, rows.gram.to_numpy(np.int64).astype(np.uint64), owners, min(languages, key=lambda x: -sizes[x]))


def identify(docs: DataFrame, model: LanguageFilter, carry: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The carried columns with language and score of every whole text, named by ``out``; only the text is looked at."""
    kinds = dict(docs.dtypes)
    held = docs.sparkSession.sparkContext.broadcast(model)  # the slots: a fixed size, whatever the corpus

    def make():
        judge = held.value.judge

        def apply(rows: dict) -> dict:
            found = [judge(t) for t in rows["t"]]
            return {**{f"c_{c}": rows[f"c_{c}"] for c in carry}, "x": [x for x, _ in found], "s": [s for _, s in found]}

        return apply

    # names of our own on the way, so that carried columns may have any
    given = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in carry], F.col("text").alias("t"))
    found = map_rows(given, make, ", ".join([*(f"`c_{c}` {kinds[c]}" for c in carry), "x string, s double"]))
    return found.select(*[F.col(f"`c_{c}`").alias(c) for c in carry], F.col("x").alias(out[0]), F.col("s").alias(out[1]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(learn_rows(F.col("doc_id"), 3, 1)))
    out = identify(docs, model)
    return out.select("doc_id", (~learn_rows(F.col("doc_id"), 3, 1)).alias("held_out"), "lang_pred", "score")
