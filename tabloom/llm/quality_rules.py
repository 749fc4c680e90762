"""Quality rules whose cutoffs are chosen under risk control (DataFrame functions only).

A rule rejects a document when an integer ratio of its counts exceeds a cutoff; a level gives every rule a cutoff, and
levels go from the loosest to the strictest, so what a level rejects the next one rejects too. For each stratum and level
the labelled holdout gives n good documents and k of them that any rule rejects. A level is *safe* when the exact
binomial test rejects "false-rejection rate >= alpha": P[Bin(n, alpha) <= k] <= delta / strata, which is the same as the
Clopper-Pearson upper bound lying under the rate. Levels are tested in their fixed order, up to the first that is not safe,
so no error is shared out among them; strata share delta (Bonferroni). As k only grows, the safe levels are all up to the
last safe one. With probability 1 - delta every safe level of every stratum loses less than alpha of its good documents, so
any may be taken: the one that rejects the most bad documents beyond the good ones it rejects, the loosest of equals, if
there are any; else the stratum's base rules stand alone.

Defined cases: null or empty text has no words, so it fails the base rules; a null stratum is a stratum of its own;
null labels and labels of unknown documents are left out; repeated labels of a document count once, as bad if any says
so; an empty label table gives no cutoffs; further columns of the inputs are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, small, words_of, work_table

#: rule -> (numerator, denominator, cutoffs in per cent of the denominator at each level, loosest first)
RULES = {
    "symbols": ("n_symbols", "n_words", (200, 150, 100, 75, 50, 30, 20, 10)),
    "repeats": ("n_repeat_words", "n_words", (45, 45, 40, 35, 30, 30, 25, 20)),
    "lines": ("n_dup_lines", "n_lines", (80, 80, 60, 50, 40, 40, 30, 20)),
    "word_length": ("word_chars", "n_words", (2000, 2000, 1500, 1200, 1200, 1000, 900, 800)),
}
LEVELS = 8
ALPHA, DELTA = 0.04, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_WINDOW = 3


def text_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (bigint), without text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    # each array is a column of its own, so that no lambda evaluates it again for each element
    split = docs.select(*rest, text.alias("_t"), words_of(F.col("text")).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.size("_w") < _WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice("_w", 1, F.size("_w") - (_WINDOW - 1)), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    )
    counted = split.select(
        *rest,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_l"),
        windows.alias("_h"),
    )
    return counted.select(
        *rest, "n_words", "word_chars", "n_symbols",
        F.col("_l.n").cast("bigint").alias("n_lines"),
        (F.col("_l.n") - F.col("_l.d")).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(_covered("_h")).cast("bigint").alias("n_repeat_words"),
    )


def _covered(hashes: str) -> Column:
    """Words under windows whose hash occurs twice or more: windows are sorted, equal neighbours give positions,
    and each position adds the words that the one before it did not cover."""
    ordered = F.array_sort(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(s, j - 1)["h"])
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-_WINDOW).alias("last"))
    return F.aggregate(
        let(ordered, positions),
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(_WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1 by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    return series - F.log(product)


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P[Bin(n, rate) <= k] exactly, for k below the mean (1.0 otherwise): terms from k downward, in log space.
    Beyond 40 deviations under k a term is below 1e-300 of the first, so that the sum is whole to the last bit."""
    n, k = n.cast("double"), k.cast("double")
    first = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    steps = F.least(k, F.ceil(40 * F.sqrt(n * rate)) + 100).cast("int")
    odds = (1 - rate) / rate
    ratio = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, j: let(a["t"] * (k - j + 1.0) / (n - k + j) * odds, lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"))),
        lambda a: a["s"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(first) * ratio)


def _hit(rule: str, level: int) -> Column:
    top, bottom, grid = RULES[rule]
    return 100 * F.col(top) > grid[level] * F.col(bottom)


def levels(labelled: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, level, n, k, bad): the level taken in each stratum that takes one.

    ``labelled`` has the counts, the stratum and ``quality``; only documents that pass the base rules matter."""
    tests = F.array(*[F.struct(F.lit(t).alias("level"), _any(_hit(r, t) for r in RULES).alias("hit")) for t in range(LEVELS)])
    good = F.col("quality") == 1
    counts = (
        labelled.where(~base_failed()).select(F.col(stratum).alias("stratum"), "quality", F.explode(tests).alias("t"))
        .groupBy("stratum", "t.level")
        .agg(F.count_if(good).alias("n"), F.count_if(good & F.col("t.hit")).alias("k"), F.count_if((F.col("quality") == 0) & F.col("t.hit")).alias("bad"))
        .where("n > 0")
    )
    name = F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit("null"))
    # the window runs over strata x levels, not documents
    tested = counts.withColumn("strata", F.size(F.collect_set(name).over(Window.partitionBy(F.lit(1)))))
    safe = tested.where((binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / F.col("strata")) & (F.col("bad") > F.col("k")))
    best = safe.groupBy("stratum").agg(F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), (-F.col("level")).alias("loose"), "n", "k", "bad")).alias("b"))
    return best.select("stratum", (-F.col("b.loose")).alias("level"), "b.n", "b.k", "b.bad")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id and the stratum with the counts, base_failed, level (null without one), rejected_by (array of rule names) and kept."""
    keep = docs.select("doc_id", F.col(stratum).alias("_s"), "text")
    counts = work_table(text_counts(keep), "counts")
    truth = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = work_table(levels(counts.join(truth, "doc_id"), "_s", alpha, delta), "levels")
    out = counts.join(small(chosen.select("stratum", "level")), F.col("_s").eqNullSafe(F.col("stratum")), "left")
    at = lambda grid: F.element_at(F.array(*[F.lit(c) for c in grid]), F.col("level") + 1)
    hits = F.array(*[F.when(100 * F.col(t) > at(grid) * F.col(b), F.lit(r)) for r, (t, b, grid) in RULES.items()])
    return out.select(
        "doc_id", F.col("_s").alias(stratum), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        base_failed().alias("base_failed"), "level", F.array_compact(hits).alias("rejected_by"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    grid = ", ".join(f"({t}, {', '.join(str(g[t]) for *_, g in RULES.values())})" for t in range(LEVELS))
    hit = " OR ".join(f"100 * {top} > c_{r} * {bottom}" for r, (top, bottom, _) in RULES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
f AS (SELECT d.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.n - lines.u, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN lines ON lines.rid = d.rid LEFT JOIN cov ON cov.rid = d.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
g AS (SELECT b.*, l.quality FROM b JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l
      ON l.doc_id = b.doc_id WHERE NOT base_failed),
grid(level, {", ".join(f"c_{r}" for r in RULES)}) AS (VALUES {grid}),
c AS (SELECT lang, level, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 1 AND ({hit})) AS k,
             count(*) FILTER (WHERE quality = 0 AND ({hit})) AS bad FROM g, grid GROUP BY ALL HAVING count(*) FILTER (WHERE quality = 1) > 0),
p AS (SELECT *, CASE WHEN k >= n * {ALPHA!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1)
      - lgamma(n - i + 1) + i * ln({ALPHA!r}) + (n - i) * ln(1 - {ALPHA!r})))) END AS tail,
      (SELECT count(*) FROM (SELECT DISTINCT lang FROM c)) AS strata FROM c),
s AS (SELECT lang, level FROM p WHERE tail <= {DELTA} / strata AND bad > k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY bad - k DESC, level) = 1),
bad AS (SELECT DISTINCT rid FROM b JOIN s ON s.lang IS NOT DISTINCT FROM b.lang JOIN grid USING (level) WHERE {hit})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept
FROM b LEFT JOIN bad ON bad.rid = b.rid"""


ORACLE_SQL = _oracle()
