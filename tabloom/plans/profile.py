"""One-pass profiles: statistics of all columns in one aggregation, then types, findings and meta-features on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parallel import spread

#: fixed values: tokens read as missing, and values that are only suspicious
MISSING_TOKENS = ("NA", "N/A", "null", "NULL", "None", "NaN")
SUSPICIOUS = ("-999", "-9999", "9999", "99999", "-1", "1900-01-01", "1970-01-01")
#: fixed values: name hints, at token boundaries
PERCENT_HINTS = ("pct", "percent", "ratio", "rate", "share")
CURRENCY_HINTS = ("price", "cost", "amount", "revenue", "salary", "fee", "payment")
COUNT_HINTS = (
    "count", "cnt", "num", "qty", "quantity", "visits", "sessions", "clicks", "views", "orders", "items", "events", "frequency", "freq", "tally", "total", "points",
    "purchases", "transactions", "tickets", "downloads", "calls", "complaints", "errors", "failures", "refunds", "disputes",
)
ID_HINTS = ("id", "uuid", "guid", "key", "record")

INTEGER, FLOAT = r"^[+-]?\d+$", r"^[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?$"
DATE, TIMESTAMP = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


@dataclass
class ColumnProfile:
    name: str
    physical: str
    semantic: str
    rows: int
    missing: dict[str, int]
    distinct: int
    null_fraction: float
    mode_share: float
    numeric: dict[str, float | None] | None
    lengths: dict[str, float]
    findings: list[str] = field(default_factory=list)

    @property
    def distinct_ratio(self) -> float:
        seen = self.rows - sum(self.missing[k] for k in ("true_null", "empty", "whitespace", "token"))
        return self.distinct / seen if seen else 0.0


def _value(name: str, kind: str) -> tuple[Column, Column]:
    """(trimmed text of the value or null if it is missing in any way, whether it is a missing token)."""
    t = F.trim(F.col(f"`{name}`").cast("string"))
    token = t.isin(*MISSING_TOKENS) if kind in ("string", "double", "float") else F.lit(False)
    return F.when((t != "") & ~token, t), token


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _stats(name: str, kind: str, exact: bool) -> list[Column]:
    """The aggregates of one column; typed columns need none of those that parse text."""
    c = F.col(f"`{name}`")
    s = c.cast("string")
    distinct_of: Column
    if kind in _NUMBERS:
        x = c.cast("double")
        token = F.isnan(c) if kind in ("float", "double") else F.lit(False)
        x, distinct_of = F.when(~token, x), c
        named = {"true_null": F.count_if(c.isNull()), "token": F.count_if(token), "nan": F.count_if(token), "suspicious": F.count_if(x.isin(*[float(v) for v in SUSPICIOUS if "-" not in v[1:]]))}
    else:
        t = F.trim(s)
        v, token = _value(name, kind)
        distinct_of = v
        named = {"true_null": F.count_if(s.isNull()), "length": F.avg(F.length(v)), "length_std": F.stddev_pop(F.length(v)), "tokens": F.avg(F.floor(F.length(v) / 4))}
        if kind == "string":
            x = v.try_cast("double")
            x = F.when(~F.isnan(x), x)
            named |= {
                "empty": F.count_if(s == ""), "whitespace": F.count_if((s != "") & (t == "")), "token": F.count_if(token), "suspicious": F.count_if(v.isin(*SUSPICIOUS)),
                "integers": F.count_if(v.rlike(INTEGER)), "floats": F.count_if(v.rlike(FLOAT)), "dates": F.count_if(v.rlike(DATE)), "timestamps": F.count_if(v.rlike(TIMESTAMP)),
                "booleans": F.count_if(F.lower(v).isin("true", "false", "yes", "no", "t", "f", "y", "n")), "uuids": F.count_if(F.length(v) - F.length(F.replace(v, F.lit("-"), F.lit(""))) == 4),
            }
        else:
            x = None
    if x is not None:
        finite = F.when(F.abs(x) != float("inf"), x)
        named |= {
            "numeric": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(finite), "std": F.stddev_samp(finite), "zeros": F.count_if(x == 0), "negative": F.count_if(x < 0),
            "inf": F.count_if(F.abs(x) == float("inf")), "skew": F.skewness(finite), "kurtosis": F.kurtosis(finite),
        }
    if not exact:  # exact ones are counted with the modes
        named["distinct"] = F.approx_count_distinct(distinct_of, 0.02)
    named["signature"] = F.bit_xor(F.xxhash64(F.coalesce(s, F.lit("\0")), F.xxhash64(*_rowkey(name))))
    return [f.alias(f"{name}\0{k}") for k, f in named.items()]


#: what a column's kind does not count
_ABSENT = dict.fromkeys(("true_null", "empty", "whitespace", "token", "suspicious", "numeric", "zeros", "negative", "inf", "nan", "integers", "floats", "dates", "timestamps", "booleans", "uuids", "distinct"), 0) | dict.fromkeys(
    ("min", "max", "mean", "std", "skew", "kurtosis", "length", "length_std", "tokens")
)


def _rowkey(name: str) -> list[Column]:
    """The rest of the row makes a signature depend on where a value stands; set by profile()."""
    return [F.col("_row")]


def profile(df: DataFrame, exact: bool = True) -> list[ColumnProfile]:
    """Profiles of all columns: one aggregation over the data and one that counts their values, for tables of any size.

    ``exact=False`` sketches the distinct counts; the most frequent values are counted all the same."""
    names, kinds = df.columns, dict(df.dtypes)
    flat = spread(df).select(*[F.col(f"`{c}`").cast("string").alias(c) if kinds[c].startswith(("array", "map", "struct", "binary")) else F.col(f"`{c}`") for c in names])
    flat = flat.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in names]))
    kinds = dict(flat.dtypes)
    row = flat.agg(F.count("*").alias("_n"), *[f for c in names for f in _stats(c, kinds[c], exact)]).first().asDict()
    counted = {c: (n, most) for c, n, most in _value_counts(flat, kinds)}
    if exact:
        row |= {f"{c}\0distinct": counted.get(c, (0, 0))[0] for c in names}
    modes = {c: most for c, (_, most) in counted.items()}
    out = [_column(c, kinds[c], row, modes) for c in names]
    for i, a in enumerate(out):
        twins = [b.name for b in out[:i] if row[f"{a.name}\0signature"] == row[f"{b.name}\0signature"] and row["_n"]]
        a.findings += [f"duplicate_of:{b}" for b in twins[:1]]
    return out


def _value_counts(df: DataFrame, kinds: dict[str, str]) -> list[tuple[str, int, int]]:
    """[(column, distinct values, count of the most frequent one)]: the values of all columns are counted in one shuffle,
    combined before it."""
    pairs = F.array(*[F.when(_value(c, k)[0].isNotNull(), F.struct(F.lit(c).alias("c"), F.xxhash64(_value(c, k)[0]).alias("h"))) for c, k in kinds.items() if c != "_row"])
    counts = df.select(F.explode(F.array_compact(pairs)).alias("p")).groupBy("p.c", "p.h").agg(F.count("*").alias("n"))
    return [tuple(r) for r in counts.groupBy("c").agg(F.count("*"), F.max("n")).collect()]


def _column(name: str, kind: str, row: dict, modes: dict[str, int]) -> ColumnProfile:
    g = _ABSENT | {k.split("\0")[1]: v for k, v in row.items() if k.startswith(f"{name}\0")}
    n = row["_n"]
    missing = {k: g[k] for k in ("true_null", "empty", "whitespace", "token", "suspicious")}
    gone = sum(missing[k] for k in ("true_null", "empty", "whitespace", "token"))
    seen = n - gone
    physical = physical_type(kind, g, seen)
    numeric = {k: g[k] for k in ("min", "max", "mean", "std", "zeros", "negative", "inf", "nan", "skew", "kurtosis")} | {"count": g["numeric"]} if physical in ("integer", "float") else None
    lengths = {"mean": g["length"] or 0.0, "std": g["length_std"] or 0.0, "tokens": g["tokens"] or 0.0, "uuid": g["uuids"] / seen if seen else 0.0}
    p = ColumnProfile(name, physical, "", n, missing, g["distinct"], gone / n if n else 0.0, modes.get(name, 0) / seen if seen else 0.0, numeric, lengths)
    p.semantic = semantic_type(p)
    p.findings = findings(p)
    return p


def physical_type(kind: str, g: dict, seen: int) -> str:
    if kind == "boolean":
        return "boolean"
    if kind.startswith("timestamp"):
        return "timestamp"
    if kind == "date":
        return "date"
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "float"
    if not seen:
        return "string"
    if g["booleans"] == seen:
        return "boolean"
    if g["integers"] == seen:
        return "integer"
    if g["floats"] == seen:
        return "float"
    if g["dates"] == seen:
        return "date"
    return "timestamp" if g["dates"] + g["timestamps"] == seen else "string"


def _hinted(name: str, hints: tuple[str, ...]) -> bool:
    parts = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()))
    return any(h in parts for h in hints)


def semantic_type(p: ColumnProfile) -> str:
    """The rules in order, first match wins."""
    if p.physical in ("date", "timestamp"):
        return "datetime"
    if p.physical == "boolean":
        return "boolean"
    if p.numeric is not None:
        lo, hi = p.numeric["min"], p.numeric["max"]
        if p.distinct <= 1 or lo is None:
            return "continuous_numeric"
        if _hinted(p.name, PERCENT_HINTS) and lo >= 0 and hi <= 100:
            return "percentage_like"
        if _hinted(p.name, CURRENCY_HINTS):
            return "currency_like"
        if p.physical == "float" or lo < 0:
            return "continuous_numeric"
        if p.distinct == 2 and (lo, hi) == (0, 1):
            return "boolean"
        if _hinted(p.name, COUNT_HINTS) or p.numeric["count"] < 10:
            return "count"
        skewed = p.distinct_ratio <= 0.5 and hi > 0 and (p.numeric["mean"] or 0) / hi <= 0.3
        return "count" if skewed else "continuous_numeric"
    if p.distinct_ratio > 0.95 and p.distinct > 16 and p.lengths["mean"] <= 64:
        fixed = p.lengths["std"] < 0.01 and p.lengths["mean"] >= 8
        if p.lengths["uuid"] > 0.8 or fixed or _hinted(p.name, ID_HINTS):
            return "identifier"
    if p.lengths["mean"] > 40 or p.lengths["tokens"] > 6:
        return "free_text"
    if p.distinct <= 50 or p.distinct_ratio <= 0.05:
        return "low_cardinality_categorical"
    return "high_cardinality_categorical" if p.distinct_ratio >= 0.9 or p.distinct > 10_000 else "low_cardinality_categorical"


def findings(p: ColumnProfile) -> list[str]:
    out = []
    if p.null_fraction >= 0.95:
        out.append("excessive_missingness")
    if p.distinct == 1:
        out.append("constant")
    elif p.mode_share >= 0.995:
        out.append("near_constant")
    if p.rows and (p.missing["token"] + p.missing["suspicious"]) / p.rows >= 0.01:
        out.append("disguised_missing")
    if p.numeric and p.numeric["count"] and p.numeric["zeros"] / p.numeric["count"] >= 0.9:
        out.append("excess_zeros")
    if p.semantic == "identifier":
        out.append("likely_identifier")
    return out


def meta_features(profiles: list[ColumnProfile]) -> dict[str, float]:
    """What experience retrieval compares data sets by."""
    n, k = (profiles[0].rows if profiles else 0), len(profiles)
    share = lambda test: sum(map(test, profiles)) / k if k else 0.0
    numeric = [p for p in profiles if p.numeric]
    mean = lambda values: sum(values) / len(values) if values else 0.0
    return {
        "log_rows": math.log1p(n), "log_columns": math.log1p(k), "rows_per_column": math.log1p(n / k) if k else 0.0, "missing": mean([p.null_fraction for p in profiles]),
        "numeric": share(lambda p: p.numeric is not None), "categorical": share(lambda p: p.semantic.endswith("categorical")), "datetime": share(lambda p: p.semantic == "datetime"),
        "text": share(lambda p: p.semantic == "free_text"), "cardinality": mean([p.distinct_ratio for p in profiles]), "skew": mean([abs(p.numeric["skew"] or 0.0) for p in numeric]),
        "kurtosis": mean([p.numeric["kurtosis"] or 0.0 for p in numeric]), "zeros": mean([p.numeric["zeros"] / p.numeric["count"] for p in numeric if p.numeric["count"]]),
    }


def fingerprint(df: DataFrame) -> str:
    """A hash of schema and content that does not depend on the order of rows, nor on that of a map's entries."""
    import hashlib

    def hashable(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("map<") and "map<" not in kind[4:]:
            return F.array_sort(F.map_entries(c))
        return F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c  # maps within others, as they are written

    h = F.xxhash64(*[hashable(c, k) for c, k in df.dtypes])
    n, x, s = df.select(h.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"ds_{hashlib.sha256(f'{df.schema.json()}|{n}|{x}|{s}'.encode()).hexdigest()[:24]}"
