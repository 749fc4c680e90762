"""Aggregates of a value by an entity key: fitted on training rows, joined back on the key.

A null key gives null, a key unseen in training gives ``default``. The join is a plain equi-join: the optimizer broadcasts
the state table while it is small and splits skewed keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import cat, num
from .registry import Operator, register


def _aggregate(name: str):
    def make(raw: Column) -> Column:
        x = num(raw)
        return {
            "group_count": lambda: F.count("*").cast("double"),
            "group_mean": lambda: F.avg(x),
            "group_std": lambda: F.stddev_pop(x),
            "group_min": lambda: F.min(x),
            "group_max": lambda: F.max(x),
            "group_median": lambda: F.median(x),
            "group_nunique": lambda: F.count_distinct(F.when(~_missing(raw), raw.cast("string"))).cast("double"),
            "group_missing_rate": lambda: F.avg(_missing(raw).cast("double")),
        }[name]()

    return make


def _missing(raw: Column) -> Column:
    text = raw.cast("string")
    return text.isNull() | (text == "NaN")


def fit_groups(df: DataFrame, key: str, wanted: dict[str, tuple[str, str]], default: float = 0.0) -> DataFrame:
    """One state table for many features of a key: ``wanted`` maps an output to (operator, value column)."""
    k = cat(key)
    aggregates = [F.coalesce(_aggregate(op)(F.col(value) if value else F.lit(1)), F.lit(default)).alias(out) for out, (op, value) in wanted.items()]
    return df.where(k.isNotNull()).groupBy(k.alias("_key")).agg(*aggregates)


def apply_groups(df: DataFrame, key: str, state: DataFrame, default: float = 0.0) -> DataFrame:
    outs = [c for c in state.columns if c != "_key"]
    joined = df.withColumn("_k", cat(key)).join(state, F.col("_k") == F.col("_key"), "left")
    return joined.select(*df.columns, *[F.when(F.col("_k").isNotNull(), F.coalesce(o, F.lit(default))).alias(o) for o in outs])


def _register(name: str, inputs: tuple[str, ...]) -> None:
    def fit(df: DataFrame, columns: list[str], params: dict) -> DataFrame:
        return fit_groups(df, columns[0], {"_v": (name, columns[1] if len(columns) > 1 else "")}, params.get("default", 0.0))

    def apply(df: DataFrame, columns: list[str], params: dict, state: DataFrame, out: str) -> DataFrame:
        return apply_groups(df, columns[0], state.withColumnRenamed("_v", out), params.get("default", 0.0))

    register(Operator(name, "group_aggregate", inputs, "continuous_numeric", shape="fitted", fit=fit, apply=apply, defaults={"default": 0.0}, leakage="L1"))


_register("group_count", ("entity_key",))
for _name in ("group_mean", "group_std", "group_min", "group_max", "group_median", "group_nunique", "group_missing_rate"):
    _register(_name, ("entity_key", "continuous_numeric"))
