"""Row-wise numeric operators and pairwise interactions, on cleaned doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Operator, register

EPS = 1e-12
SQUARE_BOUND, CUBE_BOUND = 1e154, 1e102  # beyond these the power overflows


def _one(name: str, build, output: str = "continuous_numeric", **more) -> None:
    register(Operator(name, "numeric", ("continuous_numeric",), output, build=build, **more))


def _pair(name: str, build, commutative: bool = False, **more) -> None:
    register(Operator(name, "numeric_interaction", ("continuous_numeric",) * 2, "continuous_numeric", build=build, commutative=commutative, **more))


def _both(x: Column, y: Column, value: Column) -> Column:
    """least and greatest skip nulls; the operators do not."""
    return F.when(x.isNotNull() & y.isNotNull(), value)


register(Operator("identity", "numeric", ("any",), "any", build=lambda x: x))
_one("log1p", lambda x: F.when(x > -1, F.log1p(x)))
_one("signed_log1p", lambda x: F.signum(x) * F.log1p(F.abs(x)))
_one("sqrt", lambda x: F.when(x >= 0, F.sqrt(x)))
_one("cbrt", lambda x: F.cbrt(x))
_one("square", lambda x: F.when(F.abs(x) <= SQUARE_BOUND, x * x))
_one("cube", lambda x: F.when(F.abs(x) <= CUBE_BOUND, x * x * x))
_one("abs", lambda x: F.abs(x))
_one("sign", lambda x: F.signum(x).cast("int"), "low_cardinality_categorical")
_one("reciprocal", lambda x, eps=EPS: F.when(F.abs(x) > eps, F.lit(1.0) / x), defaults={"eps": EPS})
_one("exp_clip", lambda x, lo=-20.0, hi=20.0: F.when(x.isNotNull(), F.exp(F.least(F.lit(hi), F.greatest(F.lit(lo), x)))), defaults={"lo": -20.0, "hi": 20.0})
_one("zero_indicator", lambda x: x == 0, "boolean")
_one("positive_indicator", lambda x: x > 0, "boolean")
register(Operator("missing_indicator", "numeric", ("any",), "boolean", build=lambda x: x.isNull(), null_policy="defined"))
register(Operator("finite_indicator", "numeric", ("any",), "boolean", build=lambda x: x.isNotNull() & F.coalesce(F.abs(x) != float("inf"), F.lit(False)), null_policy="defined"))

_pair("sum", lambda x, y: x + y, True)
_pair("difference", lambda x, y: x - y)
_pair("product", lambda x, y: F.when(F.abs(x * y) <= SQUARE_BOUND, x * y), True)
_pair("safe_ratio", lambda x, y, eps=EPS: F.when(F.abs(y) > eps, x / y), defaults={"eps": EPS})
_pair("relative_difference", lambda x, y, eps=EPS: (x - y) / (F.abs(y) + F.lit(eps)), defaults={"eps": EPS})
_pair("min_pair", lambda x, y: _both(x, y, F.least(x, y)), True)
_pair("max_pair", lambda x, y: _both(x, y, F.greatest(x, y)), True)
_pair("mean_pair", lambda x, y: (x + y) / 2, True)
_pair("harmonic_mean_pair", lambda x, y: F.when((x > 0) & (y > 0), 2 * x * y / (x + y)), True)
_pair("geometric_mean_pair", lambda x, y: F.when((x >= 0) & (y >= 0), F.sqrt(x * y)), True)
_pair("euclidean_norm_pair", lambda x, y: F.hypot(x, y), True)
_pair("absolute_difference", lambda x, y: F.abs(x - y), True)

#: share of rows that a static check rejects an operator for, before anything is computed: (bad rows, limit)
DOMAIN_CHECKS = {
    "log1p": (lambda x: x < -1, 0.50),
    "sqrt": (lambda x: x < 0, 0.05),
    "safe_ratio": (lambda x, y: F.abs(y) <= EPS, 0.30),
    "harmonic_mean_pair": (lambda x, y: (x <= 0) | (y <= 0), 0.30),
}
