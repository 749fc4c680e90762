"""Numeric operators with a state learned on training rows: the state is a few numbers, applied as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import normal_quantile, num
from ..functions.order import cumulative, order_statistics
from .registry import Operator, register


def _register(name: str, fit, value, **defaults) -> None:
    def apply(df: DataFrame, columns: list[str], params: dict, state, out: str) -> DataFrame:
        return df.withColumn(out, value(num(columns[0]), state))

    register(Operator(name, "numeric", ("continuous_numeric",), "continuous_numeric", shape="fitted", fit=fit, apply=apply, defaults=defaults, leakage="L1"))


def _fit_standardize(df: DataFrame, columns: list[str], params: dict) -> tuple[float, float]:
    n, mean, std = df.select(num(columns[0]).alias("x")).agg(F.count("x"), F.avg("x"), F.stddev_pop("x")).first()
    return (mean or 0.0), (std if n >= 2 and std else 1.0)


def _fit_robust(df: DataFrame, columns: list[str], params: dict) -> tuple[float, float]:
    _, v = order_statistics(df, num(columns[0]), lambda n: [(n - 1) // 2, n // 2, n // 4, 3 * n // 4])
    if v[0] is None:
        return 0.0, 1.0
    return (v[0] + v[1]) / 2, (v[3] - v[2]) or 1.0


def _fit_minmax(df: DataFrame, columns: list[str], params: dict) -> tuple[float, float]:
    lo, hi = df.select(num(columns[0]).alias("x")).agg(F.min("x"), F.max("x")).first()
    return (0.0, 1.0) if lo is None else (lo, hi)


def _minmax(x: Column, state: tuple[float, float]) -> Column:
    lo, hi = state
    return F.when(x.isNotNull(), F.lit(0.5)) if lo == hi else (x - lo) / (hi - lo)


def _fit_winsorize(df: DataFrame, columns: list[str], params: dict) -> tuple[float | None, float | None]:
    lower, upper = params.get("lower", 0.01), params.get("upper", 0.99)
    _, v = order_statistics(df, num(columns[0]), lambda n: [int(lower * (n - 1)), int(upper * (n - 1))])
    return v[0], v[1]


def _winsorize(x: Column, state: tuple) -> Column:
    lo, hi = state
    return x if lo is None else F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


_register("standardize", _fit_standardize, lambda x, s: (x - s[0]) / s[1])
_register("robust_scale", _fit_robust, lambda x, s: (x - s[0]) / s[1])
_register("minmax_scale", _fit_minmax, _minmax)
_register("winsorize", _fit_winsorize, _winsorize, lower=0.01, upper=0.99)


def _fit_quantile(df: DataFrame, columns: list[str], params: dict) -> DataFrame:
    """(_q, _m): how often each training value occurs."""
    return df.select((num(columns[0]) + 0.0).alias("_q")).where("_q IS NOT NULL").groupBy("_q").agg(F.count("*").alias("_m"))


def _apply_quantile(df: DataFrame, columns: list[str], params: dict, state: DataFrame, out: str) -> DataFrame:
    """The values to map join the training values with weight 0, so that one cumulative sum ranks both."""
    base = df.withColumn("_x", num(columns[0]) + 0.0)
    n = state.agg(F.sum("_m")).first()[0]
    if not n:
        return base.withColumn(out, F.lit(None).cast("double")).drop("_x")
    new = base.select(F.col("_x").alias("_q")).where("_q IS NOT NULL").distinct().withColumn("_m", F.lit(0).cast("bigint"))
    both = state.unionByName(new).groupBy("_q").agg(F.sum("_m").alias("_m"))
    ranks = cumulative(both, "_q", "_m").select("_q", normal_quantile((F.col("below") + 0.5) / n).alias("_v"))
    return base.join(ranks, F.col("_x") == F.col("_q"), "left").select(*df.columns, F.col("_v").alias(out))


register(Operator("quantile_normal", "numeric", ("continuous_numeric",), "continuous_numeric", shape="fitted", fit=_fit_quantile, apply=_apply_quantile, leakage="L1"))
