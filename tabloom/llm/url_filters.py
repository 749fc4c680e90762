"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join (DataFrame functions only).

A listed entry is a host and a path prefix with a verdict; it fits its host and all subdomains when the path starts with
the prefix. Each distinct URL is expanded into the (host suffix, path prefix) keys an entry could have; the filter, a
table of 256-bit blocks joined by block number, passes possible hits; an equi-join with the list drops false positives;
the longest entry wins (rules before plain list entries, then code point order). URLs no entry fits get ``default``.

Rules are compared with host and path as they are written. Plain entries, and URLs when they are looked up among them,
are made canonical first (``canonical_host``, ``canonical_path``): user info, port and trailing dots go, percent-encoded
letters, digits, ``-._~`` and UTF-8 bytes are decoded once, dot segments are resolved. An empty path stays empty, so an
entry of path ``/`` does not fit it; names in punycode and in letters are not the same host.

The filter takes 16 bits an entry and is broadcast only while the list is under BROADCAST_ROWS; a longer list is joined
by shuffling. The number of keys of a URL is bounded by its labels times the distinct prefix lengths of the list.

Defined cases: a null URL or one without ``://`` has an empty host and path and gets ``default``; repeated rows each
get their own result row; an empty list gives ``default`` everywhere; further columns of the pages are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, work_table

#: host, path prefix, verdict: the production rules
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: hosts listed as unwanted, made by a rule: two different words with a hyphen between, before one of the endings. They decide
#: where no rule fits. A list with a source comes as a table, see ``unwanted``
UNWANTED_WORDS = ("ads", "adult", "bets", "casino", "cheap", "farm", "free", "lotto", "pills", "poker", "porn", "slots", "spam", "track", "win", "x")
UNWANTED_ENDINGS = ("com", "net", "org", "info", "biz", "example.com", "example.net", "example.org")
LISTED = tuple((f"{a}-{b}.{end}", "/", "block") for a in UNWANTED_WORDS for b in UNWANTED_WORDS if a != b for end in UNWANTED_ENDINGS)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS, _SALT = 4, 7919


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _decoded(part: Column) -> Column:
    """``part`` with its percent-encoded unreserved characters and UTF-8 bytes decoded once; other escapes in capitals."""
    held = F.regexp_replace(part, r"%(?!2[DdEe]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee]|[89A-Fa-f][0-9A-Fa-f])", "%25")
    out = F.url_decode(F.replace(held, F.lit("+"), F.lit("%2B")))
    for x in "abcdef":
        out = F.regexp_replace(out, f"%([0-7]){x}", f"%$1{x.upper()}")
    return F.when(F.contains(part, F.lit("%")), out).otherwise(part)


def canonical_host(host: Column) -> Column:
    """``host`` without user info, port and trailing dots, decoded, ASCII letters small."""
    name = F.translate(_decoded(F.regexp_replace(host, r"(?s)^.*@", "")), UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(name, r":[0-9]*$", ""), r"\.+$", "")


def canonical_path(path: Column) -> Column:
    """``path`` decoded, with dot segments resolved."""
    path = _decoded(path)
    parts = F.split(path, "/", -1)
    nothing = F.array().cast("array<string>")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), nothing,
        lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)),
    )
    # a dot segment at the end names the folder
    ends = F.when(path.rlike(r"/\.\.?$"), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(ends, "/"))).otherwise(path)


def unwanted(urls: DataFrame, verdict: str = "block") -> DataFrame:
    """(host, path, verdict, rank): the plain entries of a table of unwanted URLs (column ``url``); rows without a host go.

    For use beside rules: ``listing(spark, listed=()).unionByName(unwanted(urls))``."""
    parts = urls.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = parts.select(canonical_host(F.col("host")).alias("host"), canonical_path(F.col("path")).alias("path")).where("host != ''").distinct()
    return out.select("host", "path", F.lit(verdict).alias("verdict"), F.lit(0).alias("rank"))


def listing(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """(host, path, verdict, rank): rank 1 for rules, 0 for plain entries. For lists that a program holds; longer ones are
    tables from the start."""
    rows = [(*r, 1) for r in rules] + [(*r, 0) for r in listed]
    lists = [F.array(*[F.lit(x) for x in column]) for column in zip(*rows, strict=True)] if rows else [F.array().cast(k) for k in ("array<string>",) * 3 + ("array<int>",)]
    return spark.range(1).select(F.inline(F.arrays_zip(*[c.alias(n) for c, n in zip(lists, ("host", "path", "verdict", "rank"), strict=True)])))


def _masks(key: Column) -> list[Column]:
    """The bits that a key sets in each word of its block: two of 64 in each of the four words."""
    bits = F.xxhash64(key, F.lit(_SALT))
    one = F.lit(1).cast("bigint")
    out = []
    for j in range(_WORDS):
        a = F.shiftrightunsigned(bits, 12 * j).bitwiseAND(F.lit(63)).cast("int")
        b = F.shiftrightunsigned(bits, 12 * j + 6).bitwiseAND(F.lit(63)).cast("int")
        out.append(F.call_function("shiftleft", one, a).bitwiseOR(F.call_function("shiftleft", one, b)))
    return out


def bloom_blocks(entries: DataFrame, n_blocks: int) -> DataFrame:
    """(block, m0..m3): the blocked Bloom filter of column ``key``; blocks without an entry have no row."""
    key = F.col("key")
    keyed = entries.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[m.alias(f"m{j}") for j, m in enumerate(_masks(key))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"m{j}") for j in range(_WORDS)])


def _key(rank: Column, host: Column, path: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit("\n"), host, F.lit("\n"), path)


def url_verdicts(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, entry, verdict, rank) for the distinct non-null URLs that an entry fits; entry is host and path."""
    plain = F.col("rank") == 0
    entries = entries.dropna(subset=["host", "path", "verdict"])
    entries = entries.withColumns({"host": F.when(plain, canonical_host(F.col("host"))).otherwise(F.col("host")), "path": F.when(plain, canonical_path(F.col("path"))).otherwise(F.col("path"))})
    entries = work_table(entries.withColumn("key", _key(F.col("rank"), F.col("host"), F.col("path"))), "entries")
    # of equal entries one decides: the strictest
    listed = work_table(entries.groupBy("key").agg(F.max(F.struct("rank", "verdict", "host", "path")).alias("e")), "listed")
    n = listed.count()
    n_blocks = max(1, -(-n * 16 // 256))
    lengths = sorted(tuple(r) for r in listed.select("e.rank", F.length("e.path")).distinct().collect())  # at most the longest path for each rank
    blocks = small(work_table(bloom_blocks(listed, n_blocks), "bloom"))
    labels = F.split(F.col("host"), r"\.", -1)
    each = urls.where(F.col("url").isNotNull()).select("url").distinct()
    each = each.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''")
    sides = [F.struct(F.lit(1).alias("rank"), "host", "path"), F.struct(F.lit(0).alias("rank"), canonical_host(F.col("host")).alias("host"), canonical_path(F.col("path")).alias("path"))]
    each = each.select("url", F.inline(F.array(*sides))).where("host != ''")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    prefixes = F.filter(F.array(*[F.when((F.col("rank") == r) & (F.length("path") >= x), F.substring("path", 1, x)) for r, x in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    keys = each.withColumn("labels", labels).select("url", "rank", F.explode(suffixes).alias("s"), prefixes.alias("p"))
    keys = keys.select("url", F.explode(F.transform("p", lambda p: _key(F.col("rank"), F.col("s"), p))).alias("key"))
    probes = keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    hit = None
    for j, m in enumerate(_masks(F.col("key"))):
        test = F.col(f"m{j}").bitwiseAND(m) == m
        hit = test if hit is None else hit & test
    possible = probes.join(blocks, "block").where(hit).select("url", "key")
    exact = possible.join(small(listed), "key")
    best = exact.groupBy("url").agg(F.max(F.struct(F.col("e.rank"), F.length("key").alias("n"), F.col("e.host"), F.col("e.path"), F.col("e.verdict"))).alias("b"))
    return best.select("url", F.concat("b.host", "b.path").alias("entry"), "b.verdict", "b.rank")


def url_filter(pages: DataFrame, entries: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """(key, url, host, path, rule, verdict, listed): rule is the rule that fits (else null), listed the plain entry."""
    pages = pages.select(key, "url")
    found = url_verdicts(pages, entries)
    out = pages.join(found, "url", "left")
    return out.select(
        key, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(F.col("rank") == 1, F.col("entry")).alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("rank") == 0, F.col("entry")).alias("listed"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(table(spark, sf_dir, "pages"), listing(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}', {r})" for e, r in ((RULES, 1), (LISTED, 0)) for h, p, v in e)
    return rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id,
                  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
e(h, x, v, r) AS (VALUES {rows}),
m AS (SELECT rid, max_by(struct_pack(rule := h || x, v := v, r := r), r * 1000000 + length(h) + length(x)) AS b
      FROM p JOIN e ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY rid)
SELECT page_id, host, path, CASE WHEN b.r = 1 THEN b.rule END AS rule, coalesce(b.v, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)"""


ORACLE_SQL = _oracle()
