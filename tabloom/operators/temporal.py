"""Operators over an entity's rows in time order. ``build(x, window, **params)`` gets the ordered window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .registry import Operator, register

EPS = 1e-12


def _op(name: str, build, output: str = "continuous_numeric", inputs: tuple[str, ...] = ("continuous_numeric",), **more) -> None:
    register(Operator(name, "temporal", inputs, output, shape="window", build=build, **more))


def _rolling(aggregate):
    def build(x: Column, w: WindowSpec, window: int = 3, min_periods: int | None = None) -> Column:
        r = w.rowsBetween(-(window - 1), 0)
        return F.when(F.count(x).over(r) >= (window if min_periods is None else min_periods), aggregate(x).over(r))

    return build


def _unique(x: Column, w: WindowSpec, window: int = 3, min_periods: int | None = None) -> Column:
    r = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(r) >= (window if min_periods is None else min_periods), F.size(F.collect_set(x).over(r)))


def _pct_change(x: Column, w: WindowSpec, periods: int = 1, eps: float = EPS) -> Column:
    b = F.lag(x, periods).over(w)
    return F.when(F.abs(b + eps) > eps, (x - b) / (b + eps))


def _expanding_mean(x: Column, w: WindowSpec, min_periods: int = 1) -> Column:
    r = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(x).over(r) >= min_periods, F.avg(x).over(r))


def _gap(t: Column, w: WindowSpec) -> Column:
    g = t - F.lag(t).over(w)
    return F.when(g >= 0, g)


_op("lag", lambda x, w, periods=1: F.lag(x, periods).over(w), defaults={"periods": 1})
_op("lead", lambda x, w, periods=1: F.lead(x, periods).over(w), defaults={"periods": 1}, uses_future=True)
_op("diff", lambda x, w, periods=1: x - F.lag(x, periods).over(w), defaults={"periods": 1})
_op("pct_change", _pct_change, defaults={"periods": 1, "eps": EPS})
_op("rolling_mean", _rolling(F.avg), defaults={"window": 3})
_op("rolling_sum", _rolling(F.sum), defaults={"window": 3})
_op("rolling_std", _rolling(F.stddev_pop), defaults={"window": 3})
_op("rolling_max", _rolling(F.max), defaults={"window": 3})
_op("rolling_min", _rolling(F.min), defaults={"window": 3})
_op("rolling_count", lambda x, w, window=3: F.count(x).over(w.rowsBetween(-(window - 1), 0)), "count", defaults={"window": 3}, null_policy="defined")
_op("rolling_unique", _unique, "count", defaults={"window": 3})
_op("expanding_mean", _expanding_mean)
_op("time_since_previous", _gap, inputs=("datetime",))
_op("time_since_first", lambda t, w: t - F.first(t, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), inputs=("datetime",))


def seconds(ts: Column) -> Column:
    """A naive timestamp as seconds since 1970."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def ewma(df: DataFrame, value: Column, entity: list[str], order: list[str], out: str, alpha: float = 0.3) -> DataFrame:
    """df with s = alpha * x + (1 - alpha) * s, seeded by the first value; null carries the state on.

    Rows stream through sorted partitions with one number of state, so an entity of any length needs no memory of its own."""
    prepared = df.withColumn(out, value).repartition(*entity).sortWithinPartitions(*entity, *order)
    schema = prepared.schema
    names = prepared.columns
    keys = [names.index(e) for e in entity]
    at = names.index(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = object(), None
        for b in batches:
            result = []
            for *key, x in zip(*(b.column(k).to_pylist() for k in keys), b.column(at).to_pylist(), strict=True):
                if key != now:
                    now, s = key, None
                if x is not None:
                    s = x if s is None else alpha * x + (1 - alpha) * s
                result.append(s)
            columns = [b.column(i) for i in range(b.num_columns)]
            columns[at] = pa.array(result, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return prepared.mapInArrow(run, schema)


register(Operator("ewma", "temporal", ("continuous_numeric",), "continuous_numeric", shape="stream", apply=ewma, defaults={"alpha": 0.3}))
