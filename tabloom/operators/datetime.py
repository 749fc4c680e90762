"""Calendar parts of a naive timestamp."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .registry import Operator, register


def _part(name: str, build, output: str = "low_cardinality_categorical") -> None:
    register(Operator(name, "datetime", ("datetime",), output, build=build))


_part("year", lambda d: F.year(d))
_part("month", lambda d: F.month(d))
_part("quarter", lambda d: F.quarter(d))
_part("day_of_week", lambda d: F.weekday(d))
_part("day_of_month", lambda d: F.dayofmonth(d))
_part("hour", lambda d: F.hour(d))
_part("is_weekend", lambda d: F.weekday(d) >= 5, "boolean")
_part("is_month_start", lambda d: F.dayofmonth(d) == 1, "boolean")
_part("is_month_end", lambda d: F.dayofmonth(d) == F.dayofmonth(F.last_day(d)), "boolean")
_part("week_of_year", lambda d: F.weekofyear(d))
_part("day_of_year", lambda d: F.dayofyear(d))
_part("minute", lambda d: F.minute(d))
_part("cyclical_month", lambda d: F.sin(2 * math.pi * F.month(d) / 12), "continuous_numeric")
_part("cyclical_dow", lambda d: F.sin(2 * math.pi * F.weekday(d) / 7), "continuous_numeric")

#: companions outside the catalogue
EXTRAS = {
    "cyclical_month_cos": lambda d: F.cos(2 * math.pi * F.month(d) / 12),
    "cyclical_dow_cos": lambda d: F.cos(2 * math.pi * F.weekday(d) / 7),
}
