"""Exact order statistics and ranks of columns of any size: no sort of all rows, no list of all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
_MAX_PASSES = 200


def order_statistics(df: DataFrame, x: Column, picks) -> tuple[int, list[float | None]]:
    """(n, values): ``picks(n)`` names 0-based indices into the n sorted non-null values.

    A pass counts rows by equal-width buckets of the bracket that holds an index and narrows it to the values of one
    bucket; it ends when the bracket is a single value. All indices share a pass. Only bucket counts reach the driver."""
    rows = df.select(x.alias("x")).where("x IS NOT NULL")
    n, lo, hi = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return 0, [None for _ in picks(0)]
    wanted = [max(0, min(n - 1, i)) for i in picks(n)]
    found: dict[int, float] = {}
    brackets = {(lo, hi): [(i, i) for i in sorted(set(wanted))]}  # bracket -> (index, index within the bracket)
    for _ in range(_MAX_PASSES):
        for a, b in [k for k in brackets if k[0] == k[1]]:
            found |= {i: a for i, _ in brackets.pop((a, b))}
        if not brackets:
            break
        order = list(brackets)
        cells = F.array(*[F.when(F.col("x").between(a, b), F.struct(F.lit(k).alias("k"), _bucket(F.col("x"), a, b).alias("cell"))) for k, (a, b) in enumerate(order)])
        counted = rows.select("x", F.explode(F.array_compact(cells)).alias("c")).groupBy("c.k", "c.cell").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by: dict[int, list] = {}
        for k, _, m, a, b in counted.orderBy("k", "lo").collect():  # BUCKETS rows for each index at most
            by.setdefault(k, []).append((m, a, b))
        following: dict[tuple, list] = {}
        for k, bracket in enumerate(order):
            for index, within in brackets[bracket]:
                for m, a, b in by[k]:
                    if within < m:
                        following.setdefault((a, b), []).append((index, within))
                        break
                    within -= m
        brackets = following
    else:
        raise RuntimeError("order statistics did not settle")
    return n, [found[i] for i in wanted]


def _bucket(x: Column, lo: float, hi: float) -> Column:
    half = F.lit(hi / 2 - lo / 2)  # halves do not overflow
    return F.least(F.lit(BUCKETS - 1), F.floor((x / 2 - lo / 2) / half * BUCKETS)).cast("int")


def cumulative(values: DataFrame, x: str, weight: str, parts: int = 64) -> DataFrame:
    """values (one row for each distinct x) with ``below``: the weight of all smaller x. Ranges of x are summed on their
    own and shifted by the sums of the ranges before, so no window runs over everything."""
    cuts = sorted({c for c in values.approxQuantile(x, [i / parts for i in range(1, parts)], 0.5 / parts)})
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col(x) > F.lit(c)).cast("int")
    placed = values.withColumn("_part", part)
    sums = dict(placed.groupBy("_part").agg(F.sum(weight)).collect())  # ``parts`` rows
    shift, run = [], 0
    for p in range(len(cuts) + 1):
        shift.append(run)
        run += sums.get(p) or 0
    w = Window.partitionBy("_part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    before = F.element_at(F.array(*[F.lit(s) for s in shift]), F.col("_part") + 1)
    return placed.withColumn("below", F.coalesce(F.sum(weight).over(w), F.lit(0)) + before).drop("_part")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation over the rows that have both; null if either does not vary (``corr`` divides by zero then)."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def rank_auc(df: DataFrame, score: Column, label: Column) -> float | None:
    """Area under the ROC curve with ties averaged; null without both classes. Rows are counted by score first."""
    rows = df.select(score.alias("x"), label.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    per = rows.groupBy("x").agg(F.count("*").alias("c"), F.sum("y").alias("p"))
    ranked = cumulative(per, "x", "c")
    pos, n, ranks = ranked.agg(F.sum("p"), F.sum("c"), F.sum(F.col("p") * (F.col("below") + (F.col("c") + 1) / 2))).first()
    if not n or not pos or pos == n:
        return None
    return float((ranks - pos * (pos + 1) / 2) / (pos * (n - pos)))
