"""Features over streams. Scalars and joins with fitted states run on a streaming DataFrame as they are; this module adds
windowed aggregates with watermarks and the stateful moving average."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(df: DataFrame, time: str, keys: list[str], value: str, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Count, sum, mean and extremes by key and event-time window; rows later than ``late`` are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = df.withWatermark(time, late).groupBy(w.alias("w"), *keys)
    return grouped.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean", "low", "high")


def ewma_stream(df: DataFrame, key: str, time: str, value: str, alpha: float = 0.3) -> DataFrame:
    """(key, time, value, ewma): one number of state a key. Within a batch rows are taken in time order; the result equals
    the batch operator's when batches arrive in time order."""
    kinds = dict(df.dtypes)
    schema = f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, `{value}` double, ewma double"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(time)
        out = []
        for x in rows[value]:
            if not pd.isna(x):
                s = x if s is None else alpha * x + (1 - alpha) * s
            out.append(s)
        if s is not None:
            state.update((float(s),))
        yield rows[[key, time, value]].assign(ewma=pd.Series(out, index=rows.index, dtype="float64"))

    return df.select(key, time, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(update, schema, "s double", "append", GroupStateTimeout.NoTimeout)
