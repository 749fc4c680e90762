"""Exploratory reports: every chart is an aggregation whose result is bounded by bins, grid points or top-k."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import cat, num
from ..functions.order import correlation, order_statistics
from .profile import ColumnProfile, profile


def histogram(df: DataFrame, column: str, bins: int = 16) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins between the extremes; a constant column has one bin."""
    x = num(column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (hi - lo) / bins or 1.0
    b = F.least(F.lit(bins - 1), F.floor((x - lo) / width)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "n")


def kde(df: DataFrame, column: str, grid: int = 64, fine: int = 512) -> list[tuple[float, float]]:
    """Gaussian density on a grid with Silverman's bandwidth. Rows are counted in ``fine`` cells first, and the density is
    the one of the cells' centres, so rows never meet grid points."""
    n, std = df.select(num(column).alias("x")).agg(F.count("x"), F.stddev_samp("x")).first()
    cells = [(r["lo"] + r["hi"], r["n"]) for r in histogram(df, column, fine).collect()]
    if not n or not std:
        return []
    centres, weights = np.array([c / 2 for c, _ in cells]), np.array([w for _, w in cells], float)
    h = 1.06 * std * n ** (-0.2)
    at = np.linspace(centres.min() - 3 * h, centres.max() + 3 * h, grid)
    density = (np.exp(-0.5 * ((at[:, None] - centres) / h) ** 2) * weights).sum(axis=1) / (n * h * math.sqrt(2 * math.pi))
    return list(zip(at.tolist(), density.tolist(), strict=True))


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, by passes that count rows in buckets: no task holds the values."""
    at = lambda n: [(n - 1) * q for q in shares]
    n, found = order_statistics(df, num(column), lambda n: [i for x in at(n) for i in (math.floor(x), math.ceil(x))])
    if not n:
        return [None] * len(shares)
    return [lo + (hi - lo) * (x - math.floor(x)) for x, lo, hi in zip(at(n), found[::2], found[1::2], strict=True)]


def outliers(df: DataFrame, column: str) -> dict[str, float]:
    """Tukey's fences and the rows outside them."""
    x = num(column)
    q1, q2, q3 = quantiles(df, column, [0.25, 0.5, 0.75])
    if q1 is None:
        return {}
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    below, above = df.agg(F.count_if(x < lo), F.count_if(x > hi)).first()
    return {"q1": q1, "median": q2, "q3": q3, "low_fence": lo, "high_fence": hi, "below": below, "above": above}


#: pairs of columns in one aggregation
_PAIRS = 200


def correlations(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """(a, b, r) of all pairs of the columns, a few hundred in one aggregation; ``limit`` takes the first columns only, for
    callers who say so."""
    cols = columns[:limit]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    out = None
    for k in range(0, len(pairs), _PAIRS):
        some = pairs[k : k + _PAIRS]
        row = df.agg(*[correlation(num(a), num(b)).alias(f"_{i}") for i, (a, b) in enumerate(some)])
        part = row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(some)])))
        out = part if out is None else out.unionByName(part)
    return out


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.select(cat(column).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.select(cat(target).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    total = Window.partitionBy(F.lit(1))  # over classes, not rows
    return counts.withColumn("share", F.col("n") / F.sum("n").over(total))


def ridgeline(df: DataFrame, column: str, by: str, bins: int = 16, groups: int = 6) -> DataFrame:
    """(value, bin, n): a histogram for each of the most frequent groups, on common bins."""
    x = num(column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    width = ((hi or 0) - (lo or 0)) / bins or 1.0
    top = [r[0] for r in top_values(df, by, groups).collect()]
    rows = df.select(cat(by).alias("value"), F.least(F.lit(bins - 1), F.floor((x - F.lit(lo)) / width)).cast("int").alias("bin"))
    return rows.where(F.col("value").isin(*top) & F.col("bin").isNotNull()).groupBy("value", "bin").agg(F.count("*").alias("n"))


# ---- time series: the series is aggregated to one row a day, which bounds what is windowed ------------------------------


def daily(df: DataFrame, time: str, value: str) -> DataFrame:
    return df.groupBy(F.to_date(time).alias("day")).agg(F.avg(num(value)).alias("v")).where("v IS NOT NULL")


def autocorrelation(series: DataFrame, lags: int = 24) -> list[float]:
    """Of a daily series, which is small: one row a day."""
    v = np.array([r[0] for r in series.orderBy("day").select("v").collect()], float)
    v = v - v.mean() if len(v) else v
    total = float(v @ v)
    return [float(v[k:] @ v[:-k]) / total if total and k < len(v) else 0.0 for k in range(1, lags + 1)]


def trend(series: DataFrame) -> dict[str, float | None]:
    """Slope a day and correlation with time."""
    day = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("double")
    slope, r = series.agg(F.regr_slope("v", day), correlation(F.col("v"), day)).first()
    return {"slope": slope, "r": r}


def seasonality(series: DataFrame, periods: range = range(2, 25)) -> dict[int, float]:
    """Share of the variance that the mean of each phase explains, for each period of days, in one aggregation a period
    over one row a day."""
    rows = series.orderBy("day").select("v").collect()
    v = np.array([r[0] for r in rows], float)
    total = v.var() if len(v) else 0.0
    out = {}
    for p in periods:
        if len(v) < 2 * p or not total:
            continue
        means = np.array([v[i::p].mean() for i in range(p)])
        out[p] = float(((means[np.arange(len(v)) % p] - v.mean()) ** 2).mean() / total)
    return out


def column_role(p: ColumnProfile, target: str | None = None) -> str:
    if p.name == target:
        return "target"
    if "constant" in p.findings:
        return "constant"
    roles = {"identifier": "identifier", "datetime": "time", "boolean": "flag", "free_text": "text", "count": "count", "percentage_like": "share", "currency_like": "measure", "continuous_numeric": "measure"}
    return roles.get(p.semantic, "category")


#: fixed values: charts of each role
CHARTS = {"measure": ("histogram", "kde", "outliers"), "count": ("histogram", "outliers"), "share": ("histogram",), "category": ("top_values",), "flag": ("top_values",), "time": ("trend",), "target": ("class_balance",), "text": (), "identifier": (), "constant": ()}


def build_report(df: DataFrame, target: str | None = None, time: str | None = None) -> dict:
    """Profiles, roles, the charts of each role, correlations, and for a time column the series analysis of each measure."""
    profiles = profile(df)
    roles = {p.name: column_role(p, target) for p in profiles}
    charts: dict[str, dict] = {}
    for name, role in roles.items():
        made = {}
        for chart in CHARTS[role]:
            if chart == "histogram":
                made[chart] = [tuple(r) for r in histogram(df, name).orderBy("bin").collect()]
            elif chart == "kde":
                made[chart] = kde(df, name)
            elif chart == "outliers":
                made[chart] = outliers(df, name)
            elif chart in ("top_values", "class_balance"):
                made[chart] = [tuple(r) for r in (top_values(df, name) if chart == "top_values" else class_balance(df, name)).collect()]
        charts[name] = made
    measures = [n for n, r in roles.items() if r in ("measure", "count", "share")]
    series = {}
    if time:
        for m in measures[:4]:
            d = daily(df, time, m)
            series[m] = {"acf": autocorrelation(d), "trend": trend(d), "seasonality": seasonality(d)}
    pairs = sorted((tuple(r) for r in correlations(df, measures).collect()), key=lambda t: -abs(t[2] or 0.0))
    insights = [f"{a} and {b} correlate at {r:.2f}" for a, b, r in pairs if r is not None and abs(r) >= 0.8]
    insights += [f"{p.name}: {f}" for p in profiles for f in p.findings]
    return {"profiles": profiles, "roles": roles, "charts": charts, "correlations": pairs, "series": series, "insights": insights}


def difficulty(profiles: list[ColumnProfile], target: str, baseline: float, best: float) -> float:
    """0 (easy) to 1 (hard): size, width, missingness, cardinality, imbalance of the target, and the room over a baseline."""
    rows, width = profiles[0].rows, len(profiles)
    t = next(p for p in profiles if p.name == target)
    parts = [
        1 / (1 + math.log10(max(10, rows))), min(1.0, width / max(1, rows)), sum(p.null_fraction for p in profiles) / width,
        sum(p.semantic == "high_cardinality_categorical" for p in profiles) / width, t.mode_share, 1 - max(0.0, min(1.0, best - baseline)),
    ]
    return sum(parts) / len(parts)
