"""Registered queries of the engine, one for each operator, and their DuckDB counterparts.

``BASES`` names small projections of the test tables that both engines build from the same expressions; nulls, zeros and
blanks are derived there, as the tables have none. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.clean import cat, dt, num, txt
from .functions.parallel import spread
from .operators import get
from .operators.datetime import EXTRAS
from .operators.model import residual_interactions
from .operators.temporal import seconds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASES: dict[str, tuple[str, list[str]]] = {
    "numbers": (
        "customer",
        [
            "c_custkey AS k",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS x",
            "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS y",
        ],
    ),
    "dates": ("orders", ["o_orderkey AS k", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS d"]),
    "events_t": ("events", ["event_id AS k", "user_id AS e", "ts AS t", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x"]),
    "orders_g": (
        "orders",
        [
            "o_orderkey AS k",
            "CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR(20)) END AS g",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x",
            "o_orderkey % 5 AS fold",
        ],
    ),
    "parts_c": (
        "part",
        [
            "p_partkey AS k",
            "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN ' ' ELSE concat(' ', p_type, ' ') END AS c",
            "CASE WHEN p_partkey % 5 = 0 THEN 'a|b' ELSE p_brand END AS b",
            "p_name AS n",
        ],
    ),
    "orders_y": (
        "orders",
        [
            "o_orderkey AS k",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS c",
            "o_totalprice AS x",
            "CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y",
            "o_orderkey % 5 AS fold",
        ],
    ),
    "texts": ("documents", ["doc_id AS k", "text AS t"]),
    "items": ("lineitem", ["l_orderkey AS k", "l_partkey AS k2", "l_suppkey AS k3", "l_linenumber AS k4", "l_quantity AS a", "l_extendedprice AS b", "l_discount AS c", "l_tax AS d"]),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = BASES[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*expressions)
    return spread(df) if name == "texts" else df


def sql(name: str) -> str:
    source, expressions = BASES[name]
    return f"(SELECT {', '.join(expressions)} FROM {source})"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


#: added before rounding on both sides: quotients of cents fall on midpoints, where the engines round differently
SHIFT = 2.3e-9


def _rounded(c: Column, rounds: bool) -> Column:
    return F.round(c + SHIFT, 6) + F.lit(0.0) if rounds else c


def _scalar(name: str, table: str, inputs: Callable[[], list[Column]], oracle: str, rounds: bool = True, params: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base(spark, sf_dir, table).select("k", _rounded(get(name).build(*inputs(), **(params or {})), rounds).alias("v"))

    v = f"round({oracle} + {SHIFT}, 6) + 0.0" if rounds else oracle
    _add(f"op_{name}", run, f"SELECT k, {v} AS v FROM {sql(table)}")


# ---- numeric and interactions ----------------------------------------------------------------------------------------

_ONE = {
    "identity": "x",
    "log1p": "CASE WHEN x > -1 THEN ln(1 + x) END",
    "signed_log1p": "sign(x) * ln(1 + abs(x))",
    "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END",
    "cbrt": "cbrt(x)",
    "square": "x * x",
    "cube": "x / 1000 * (x / 1000) * (x / 1000)",
    "abs": "abs(x)",
    "reciprocal": "CASE WHEN abs(x) > 1e-12 THEN 1 / x END",
    "exp_clip": "CASE WHEN x IS NOT NULL THEN exp(least(20.0, greatest(-20.0, x / 2000))) END",
}
for _n, _s in _ONE.items():
    if _n == "exp_clip":
        _scalar(_n, "numbers", lambda: [num("x") / 2000], _s)
    elif _n == "cube":
        _scalar(_n, "numbers", lambda: [num("x") / 1000], _s)
    else:
        _scalar(_n, "numbers", lambda: [num("x")], _s)
for _n, _s in {"sign": "sign(x)::INT", "zero_indicator": "x = 0", "positive_indicator": "x > 0", "missing_indicator": "x IS NULL", "finite_indicator": "x IS NOT NULL"}.items():
    _scalar(_n, "numbers", lambda: [num("x")], _s, rounds=False)
_PAIR = {
    "sum": "x + y",
    "difference": "x - y",
    "product": "x * y",
    "safe_ratio": "CASE WHEN abs(y) > 1e-12 THEN x / y END",
    "relative_difference": "(x - y) / (abs(y) + 1e-12)",
    "min_pair": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END",
    "max_pair": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END",
    "mean_pair": "(x + y) / 2",
    "harmonic_mean_pair": "CASE WHEN x > 0 AND y > 0 THEN 2 * x * y / (x + y) END",
    "geometric_mean_pair": "CASE WHEN x >= 0 AND y >= 0 THEN sqrt(x * y) END",
    "euclidean_norm_pair": "sqrt(x * x + y * y)",
    "absolute_difference": "abs(x - y)",
}
for _n, _s in _PAIR.items():
    if _n == "relative_difference":  # a zero denominator gives 1e15: beyond six exact places
        _scalar(_n, "numbers", lambda: [num("x"), F.nullif(num("y"), F.lit(0.0))], "(x - nullif(y, 0)) / (abs(nullif(y, 0)) + 1e-12)")
    else:
        _scalar(_n, "numbers", lambda: [num("x"), num("y")], _s)

# ---- datetime --------------------------------------------------------------------------------------------------------

_PARTS = {
    "year": "year(d)::INT",
    "month": "month(d)::INT",
    "quarter": "quarter(d)::INT",
    "day_of_week": "(isodow(d) - 1)::INT",
    "day_of_month": "day(d)::INT",
    "hour": "hour(d)::INT",
    "is_weekend": "isodow(d) >= 6",
    "is_month_start": "day(d) = 1",
    "is_month_end": "day(d) = day(last_day(d))",
    "week_of_year": "week(d)::INT",
    "day_of_year": "dayofyear(d)::INT",
    "minute": "minute(d)::INT",
}
for _n, _s in _PARTS.items():
    _scalar(_n, "dates", lambda: [dt("d")], _s, rounds=False)
_scalar("cyclical_month", "dates", lambda: [dt("d")], "sin(2 * pi() * month(d) / 12)")
_scalar("cyclical_dow", "dates", lambda: [dt("d")], "sin(2 * pi() * (isodow(d) - 1) / 7)")
for _n, _s in {"cyclical_month_cos": "cos(2 * pi() * month(d) / 12)", "cyclical_dow_cos": "cos(2 * pi() * (isodow(d) - 1) / 7)"}.items():
    _add(
        f"op_{_n}",
        lambda spark, sf, n=_n: base(spark, sf, "dates").select("k", _rounded(EXTRAS[n](dt("d")), True).alias("v")),
        f"SELECT k, round({_s} + {SHIFT}, 6) + 0.0 AS v FROM {sql('dates')}",
    )

# ---- temporal --------------------------------------------------------------------------------------------------------

_W = "PARTITION BY e ORDER BY t, k"
_R = f"({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def _guard(value: str, least: int = 3) -> str:
    return f"CASE WHEN count(x) OVER {_R} >= {least} THEN {value} OVER {_R} END"


_TEMPORAL = {
    "lag": (f"lag(x) OVER ({_W})", True),
    "lead": (f"lead(x) OVER ({_W})", True),
    "diff": (f"x - lag(x) OVER ({_W})", True),
    "pct_change": (f"CASE WHEN abs(lag(x) OVER ({_W}) + 1e-12) > 1e-12 THEN (x - lag(x) OVER ({_W})) / (lag(x) OVER ({_W}) + 1e-12) END", True),
    "rolling_mean": (_guard("avg(x)"), True),
    "rolling_sum": (_guard("sum(x)"), True),
    "rolling_std": (_guard("stddev_pop(x)"), True),
    "rolling_max": (_guard("max(x)"), True),
    "rolling_min": (_guard("min(x)"), True),
    "rolling_count": (f"count(x) OVER {_R}", False),
    "rolling_unique": (f"(CASE WHEN count(x) OVER {_R} >= 3 THEN count(DISTINCT x) OVER {_R} END)::INT", False),
    "expanding_mean": (f"avg(x) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", True),
    "time_since_previous": (f"CASE WHEN epoch(t) - lag(epoch(t)) OVER ({_W}) >= 0 THEN epoch(t) - lag(epoch(t)) OVER ({_W}) END", True),
    "time_since_first": (f"epoch(t) - first_value(epoch(t)) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", True),
}


def _temporal(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        window = Window.partitionBy("e").orderBy("t", "k")
        value = seconds(F.col("t")) if name.startswith("time_since") else num("x")
        return base(spark, sf_dir, "events_t").select("k", _rounded(get(name).build(value, window), _TEMPORAL[name][1]).alias("v"))

    return run


for _n, (_s, _r) in _TEMPORAL.items():
    _add(f"op_{_n}", _temporal(_n), f"SELECT k, {f'round({_s} + {SHIFT}, 6) + 0.0' if _r else _s} AS v FROM {sql('events_t')}")
_add(
    "op_ewma",
    lambda spark, sf: get("ewma").apply(base(spark, sf, "events_t"), num("x"), ["e"], ["t", "k"], "_v").select("k", _rounded(F.col("_v"), True).alias("v")),
    f"""SELECT k, round(CASE WHEN len(l) > 0 THEN list_reduce(l, lambda s, x: 0.3 * x + 0.7 * s) END + 2.3e-9, 6) + 0.0 AS v
FROM (SELECT k, list(x) FILTER (WHERE x IS NOT NULL) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM {sql("events_t")})""",
)

# ---- fitted: learned on folds other than 0, applied to all rows ------------------------------------------------------


def _fitted(name: str, table: str, columns: list[str], oracle: str, rounds: bool = True, params: dict | None = None, train: str = "k % 5 <> 0", select: Callable[[Column], Column] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, op, p = base(spark, sf_dir, table), get(name), {**get(name).defaults, **(params or {})}
        state = op.fit(df.where(train), columns, p)
        v = F.col("v") if select is None else select(F.col("v"))
        return op.apply(df, columns, p, state, "v").select("k", _rounded(v, rounds).alias("v"))

    _add(f"op_{name}", run, oracle.format(b=sql(table), t=f"(SELECT * FROM {sql(table)} WHERE {train})"))


_fitted("standardize", "numbers", ["x"], "SELECT k, round((x - m) / s + 2.3e-9, 6) + 0.0 AS v FROM {b}, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM {t})")
_fitted(
    "robust_scale",
    "numbers",
    ["x"],
    "SELECT k, round((x - m) / (q3 - q1) + 2.3e-9, 6) + 0.0 AS v FROM {b}, (SELECT median(x) AS m, list_sort(list(x) FILTER (WHERE x IS NOT NULL))[count(x) // 4 + 1] AS q1,"
    " list_sort(list(x) FILTER (WHERE x IS NOT NULL))[3 * count(x) // 4 + 1] AS q3 FROM {t})",
)
_fitted("minmax_scale", "numbers", ["x"], "SELECT k, round((x - lo) / (hi - lo) + 2.3e-9, 6) + 0.0 AS v FROM {b}, (SELECT min(x) AS lo, max(x) AS hi FROM {t})")
_fitted(
    "winsorize",
    "numbers",
    ["x"],
    "SELECT k, round(CASE WHEN x IS NOT NULL THEN least(hi, greatest(lo, x)) END + 2.3e-9, 6) + 0.0 AS v FROM {b}, (SELECT list_sort(list(x) FILTER (WHERE x IS NOT NULL))[floor(0.01 * (count(x) - 1))::INT + 1] AS lo,"
    " list_sort(list(x) FILTER (WHERE x IS NOT NULL))[floor(0.99 * (count(x) - 1))::INT + 1] AS hi FROM {t})",
)
_PPF = "(sqrt(-2 * ln(q)) - (2.515517 + 0.802853 * sqrt(-2 * ln(q)) + 0.010328 * (-2 * ln(q))) / (1 + 1.432788 * sqrt(-2 * ln(q)) + 0.189269 * (-2 * ln(q)) + 0.001308 * pow(-2 * ln(q), 1.5)))"
_fitted(
    "quantile_normal",
    "numbers",
    ["x"],
    f"SELECT k, round(CASE WHEN p >= 1 THEN 6.0 WHEN p <= 0 THEN -6.0 WHEN p > 0.5 THEN {_PPF} ELSE -{_PPF} END + 2.3e-9, 6) + 0.0 AS v FROM (SELECT *, CASE WHEN p > 0 AND p < 1 THEN least(p, 1 - p) END AS q FROM"
    " (SELECT k, CASE WHEN x IS NOT NULL THEN ((SELECT count(*) FROM {t} u WHERE u.x < b.x) + 0.5) / (SELECT count(x) FROM {t}) END AS p FROM {b} b))",
)

_GROUP = {
    "group_count": "count(*)::DOUBLE",
    "group_mean": "avg(x)",
    "group_std": "stddev_pop(x)",
    "group_min": "min(x)",
    "group_max": "max(x)",
    "group_median": "median(x)",
    "group_nunique": "count(DISTINCT x)::DOUBLE",
    "group_missing_rate": "avg((x IS NULL)::INT)",
}
for _n, _s in _GROUP.items():
    _fitted(
        _n,
        "orders_g",
        ["g", "x"],
        f"SELECT k, round(CASE WHEN trim(g) <> '' THEN coalesce(a, 0) END + 2.3e-9, 6) + 0.0 AS v FROM {{b}} LEFT JOIN (SELECT trim(g) AS h, {_s} AS a FROM {{t}} WHERE trim(g) <> '' GROUP BY 1) ON h = trim(g)",
        train="fold <> 0",
    )

_C = "nullif(trim(c), '')"
_COUNTS = f"(SELECT {_C} AS h, count(*) AS m FROM {{t}} WHERE {_C} IS NOT NULL GROUP BY 1)"
_scalar("hash_encode", "parts_c", lambda: [cat("c")], f"(('0x' || md5('0:' || {_C}))::UHUGEINT % 16)::BIGINT", rounds=False)
_scalar(
    "ordinal_true_scale",
    "parts_c",
    lambda: [cat("b")],
    "CASE b WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 WHEN 'a|b' THEN 2 END",
    rounds=False,
    params={"order": ("Brand#11", "Brand#12", "a|b")},
)
_scalar("category_cross", "parts_c", lambda: [cat("c"), cat("b")], f"replace({_C}, '|', '\\|') || '|' || replace(trim(b), '|', '\\|')", rounds=False)
_fitted(
    "one_hot",
    "parts_c",
    ["c"],
    f"SELECT k, array_to_string(list_transform(l, lambda z: CASE WHEN coalesce(z = {_C}, false) THEN '1' ELSE '0' END), '') AS v FROM {{b}}, (SELECT list(h ORDER BY m DESC, h) AS l FROM (SELECT * FROM {_COUNTS} ORDER BY m DESC, h LIMIT 4))",
    rounds=False,
    params={"max_categories": 4},
    select=lambda v: F.array_join(F.transform(v, lambda z: F.when(z, "1").otherwise("0")), ""),
)
_fitted(
    "ordinal_encode",
    "parts_c",
    ["c"],
    f"SELECT k, CASE WHEN {_C} IS NOT NULL THEN coalesce(r, -1) END::INT AS v FROM {{b}} LEFT JOIN (SELECT h, row_number() OVER (ORDER BY m DESC, h) - 1 AS r FROM {_COUNTS}) ON h = {_C}",
    rounds=False,
)
_fitted("frequency_encode", "parts_c", ["c"], f"SELECT k, round(CASE WHEN {_C} IS NOT NULL THEN coalesce(m / (SELECT count(*) FROM {{t}}), 0.0) END + 2.3e-9, 6) + 0.0 AS v FROM {{b}} LEFT JOIN {_COUNTS} ON h = {_C}")
_fitted("count_encode", "parts_c", ["c"], f"SELECT k, CASE WHEN {_C} IS NOT NULL THEN coalesce(m, 0) END AS v FROM {{b}} LEFT JOIN {_COUNTS} ON h = {_C}", rounds=False)
_fitted("rare_group", "parts_c", ["n"], "SELECT k, CASE WHEN m >= 30 THEN trim(n) ELSE '__RARE__' END AS v FROM {b} LEFT JOIN (SELECT trim(n) AS h, count(*) AS m FROM {t} GROUP BY 1) ON h = trim(n)", rounds=False, params={"min_count": 30})

_PRIOR = "(SELECT avg(y) AS g, sum(y) AS ap, sum(1 - y) AS an FROM {t})"
_SUMS = "(SELECT c AS h, count(*) AS n, sum(y) AS s FROM {t} WHERE c IS NOT NULL GROUP BY 1)"
_fitted("target_mean_crossfit", "orders_y", ["c", "y"], f"SELECT k, round((s + 10 * g) / (n + 10) + 2.3e-9, 6) + 0.0 AS v FROM {{b}} LEFT JOIN {_SUMS} ON h = c, {_PRIOR}", train="fold <> 0")
_fitted(
    "woe_crossfit",
    "orders_y",
    ["c", "y"],
    f"SELECT k, round(ln(((s + 10) / (ap + 20)) / ((n - s + 10) / (an + 20))) + 2.3e-9, 6) + 0.0 AS v FROM {{b}} LEFT JOIN {_SUMS} ON h = c, {_PRIOR}",
    train="fold <> 0",
)
_BIN = "greatest(0, least(floor((x - lo) / (hi - lo) * 5), 4))"
_fitted(
    "numeric_to_cat_target",
    "orders_y",
    ["x", "y"],
    f"WITH r AS (SELECT min(x) AS lo, max(x) AS hi, avg(y) AS g FROM {{t}}), p AS (SELECT {_BIN} AS h, count(*) AS n, sum(y) AS s FROM {{t}}, r GROUP BY 1)"
    f" SELECT k, round((s + 10 * g) / (n + 10) + 2.3e-9, 6) + 0.0 AS v FROM (SELECT k, {_BIN} AS q, g FROM {{b}}, r) LEFT JOIN p ON h = q",
    train="fold <> 0",
)

# ---- text ------------------------------------------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')"
_scalar("text_length_chars", "texts", lambda: [txt("t")], "length(t)::INT", rounds=False)
_scalar("text_length_tokens", "texts", lambda: [txt("t")], f"len({_TOKENS})::INT", rounds=False)
_scalar("text_digit_ratio", "texts", lambda: [txt("t")], r"len(regexp_extract_all(t, '\p{Nd}')) / greatest(length(t), 1)")
_scalar("text_upper_ratio", "texts", lambda: [txt("t")], r"CASE WHEN t IS NOT NULL THEN coalesce(len(regexp_extract_all(t, '\p{Lu}')) / nullif(len(regexp_extract_all(t, '\p{L}')), 0), 0.0) END")
_scalar("text_punctuation_ratio", "texts", lambda: [txt("t")], r"len(regexp_extract_all(t, '[[:punct:]]')) / greatest(length(t), 1)")
_add(
    "op_text_hashing",
    lambda spark, sf: base(spark, sf, "texts").select("k", F.array_join(get("text_hashing").build(txt("t")), ",").alias("v")),
    f"""WITH w AS (SELECT k, unnest({_TOKENS}) AS w FROM {sql("texts")} WHERE t IS NOT NULL),
h AS (SELECT k, (('0x' || md5('0:' || w))::UHUGEINT % 16)::INT AS b, CASE WHEN ('0x' || md5('s:0:' || w))::UHUGEINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM w),
g AS (SELECT k, b, sum(s)::BIGINT AS s FROM h GROUP BY k, b)
SELECT k, string_agg(coalesce(s, 0)::VARCHAR, ',' ORDER BY b) AS v FROM (SELECT k, unnest(range(16))::INT AS b FROM {sql("texts")}) LEFT JOIN g USING (k, b) GROUP BY k""",
)


def _tfidf(name: str, unit: str, column: str, table: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, op = base(spark, sf_dir, table), get(name)
        p = {**op.defaults, "max_features": 20}
        state = op.fit(df.where("k % 5 <> 0"), [column], p)
        long = op.apply(df, [column], p, state, "_v").select("k", F.posexplode("_v").alias("i", "v"))
        return long.where("v > 0").select("k", "i", F.round("v", 6).alias("v"))

    units = unit.format(c=column)
    _add(
        f"op_{name}",
        run,
        f"""WITH d AS (SELECT k, {units} AS l FROM {sql(table)} WHERE {column} IS NOT NULL), t AS (SELECT * FROM d WHERE k % 5 <> 0),
f AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(l)) AS w FROM t) GROUP BY w ORDER BY n DESC, w LIMIT 20),
v AS (SELECT w, (row_number() OVER (ORDER BY n DESC, w) - 1)::INT AS i, ln((1.0 + (SELECT count(*) FROM t)) / (1.0 + n)) + 1 AS idf FROM f),
c AS (SELECT k, w, count(*) / any_value(m) AS tf FROM (SELECT k, unnest(l) AS w, len(l) AS m FROM d) GROUP BY k, w)
SELECT k, i, round(tf * idf, 6) AS v FROM c JOIN v USING (w)""",
    )


_tfidf("tfidf_word", r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')", "t", "texts")
_tfidf("tfidf_char", "list_transform(range(1, greatest(1, length({c}) - 1)), lambda i: substr(lower({c}), i, 3))", "n", "parts_c")

# ---- dimensionality, cluster, model-informed: no SQL form, tested against numpy -----------------------------------------


def _modelled(name: str, table: str, columns: list[str], keys: list[str], params: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, op, p = base(spark, sf_dir, table), get(name), {**get(name).defaults, **(params or {})}
        return op.apply(df, columns, p, op.fit(df, columns, p), "v").select(*keys, "v")

    _add(f"op_{name}", run)


_ITEM = ["k", "k2", "k3", "k4"]
for _n in ("pca", "truncated_svd", "kmeans_label", "kmeans_distances"):
    _modelled(_n, "items", ["a", "b", "c", "d"], _ITEM)
_modelled("text_svd", "texts", ["t"], ["k"])
_modelled("tree_leaf_oof", "orders_y", ["x", "y"], ["k"])
_add(
    "op_residual_interaction_proposal",
    lambda spark, sf: residual_interactions(base(spark, sf, "items").withColumn("r", F.col("b") - 1500 * F.col("a")), ["a", "b", "c", "d"], "r").select("column", F.round("score", 6).alias("score")),
    "SELECT u.c AS column, round(u.s, 6) AS score FROM (SELECT unnest([{'c': 'a', 's': abs(corr(a, abs(r))) + 0.5 * abs(corr(a, r))}, {'c': 'b', 's': abs(corr(b, abs(r))) + 0.5 * abs(corr(b, r))},"
    " {'c': 'c', 's': abs(corr(c, abs(r))) + 0.5 * abs(corr(c, r))}, {'c': 'd', 's': abs(corr(d, abs(r))) + 0.5 * abs(corr(d, r))}]) AS u FROM"
    f" (SELECT *, b - 1500 * a AS r FROM {sql('items')})) WHERE u.s > 0.01 ORDER BY u.s DESC LIMIT 5",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars, a group aggregate and a window over lineitem in one plan."""
    from .operators.group import apply_groups, fit_groups

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    features = items.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity",
        get("log1p").build(num("l_extendedprice")).alias("log_price"),
        get("safe_ratio").build(num("l_extendedprice"), num("l_quantity")).alias("unit_price"),
        get("lag").build(num("l_quantity"), w).alias("previous_quantity"),
    )
    state = fit_groups(items, "l_returnflag", {"flag_mean": ("group_mean", "l_quantity")})
    return apply_groups(features, "l_returnflag", state).drop("l_returnflag", "l_quantity")


_add(
    "flagship",
    lambda spark, sf: flagship(spark, sf).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.round(F.col(c) + SHIFT, 6).alias(c) for c in ("log_price", "unit_price", "previous_quantity", "flag_mean")]
    ),
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(ln(1 + l_extendedprice) + 2.3e-9, 6) AS log_price, round(l_extendedprice / l_quantity + 2.3e-9, 6) AS unit_price,
round(lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice) + 2.3e-9, 6) AS previous_quantity,
round(avg(l_quantity) OVER (PARTITION BY l_returnflag) + 2.3e-9, 6) AS flag_mean FROM lineitem""",
)

from . import plan_queries  # noqa: E402

QUERIES |= plan_queries.QUERIES
ORACLES |= plan_queries.ORACLES
