"""The cast layer: every operator sees doubles without NaN, trimmed non-blank strings, and naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: date patterns tried in this order after ISO
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def num(c: Column | str) -> Column:
    """double; text that is no number, booleans in text and NaN become null, infinities pass."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def cat(c: Column | str) -> Column:
    """trimmed string; blank becomes null."""
    s = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(s != "", s)


def txt(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def dt(c: Column | str, kind: str = "timestamp") -> Column:
    """timestamp without zone. ``kind`` is the column's type: timestamps and dates pass, strings are parsed, numbers are
    seconds since 1970 in UTC."""
    c = F.col(c) if isinstance(c, str) else c
    if kind.startswith(("timestamp", "date")):
        return c.cast("timestamp_ntz")
    if kind == "string":
        s = F.regexp_replace(F.trim(c), "Z$", "")
        return F.coalesce(s.try_cast("timestamp_ntz"), *[F.try_to_timestamp(s, F.lit(p)).cast("timestamp_ntz") for p in DATE_PATTERNS])
    return F.timestamp_micros((c.cast("double") * 1_000_000).cast("bigint")).cast("timestamp_ntz")


def md5_bucket(text: Column, n: int) -> Column:
    """md5 of the text as an unsigned 128-bit number modulo n: four 32-bit digits, folded from the left."""
    digest = F.md5(text)
    if n <= 1 << 32 and n & (n - 1) == 0:  # a power of two: the last digits decide
        return F.conv(F.substring(digest, 25, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(n - 1).cast("bigint"))
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        digit = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        acc = F.pmod(acc * ((1 << 32) % n) + digit, F.lit(n))
    return acc


def word_tokens(t: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def char_ngrams(t: Column, n: int) -> Column:
    low = F.lower(t)
    starts = F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution by the rational approximation 26.2.23 of Abramowitz and Stegun, +-6 at the bounds."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    # fixed values of the approximation
    c0, c1, c2, d1, d2, d3 = 2.515517, 0.802853, 0.010328, 1.432788, 0.189269, 0.001308
    z = t - (c0 + c1 * t + c2 * t * t) / (1 + d1 * t + d2 * t * t + d3 * t * t * t)
    return F.when(p <= 0, -6.0).when(p >= 1, 6.0).when(p > 0.5, z).otherwise(-z)
