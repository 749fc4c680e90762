"""Registered queries of profiling, splits, leakage, scores, selection and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.clean import num
from .functions.order import order_statistics, rank_auc
from .operators.categorical import out_of_fold_mean
from .operators.model import tree_leaf_by_fold
from .plans import problem, report
from .plans.learn import learn
from .plans.profile import profile
from .streaming.features import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_ORDERS = ["o_orderkey AS k", "o_totalprice AS x", "CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y", "o_orderpriority AS c", "o_orderkey % 5 AS fold", "(o_orderkey % 97) / CAST(97 AS DOUBLE) AS p"]
_O = f"(SELECT {', '.join(_ORDERS)} FROM orders)"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders").selectExpr(*_ORDERS)


_MESSY = "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN '  ' WHEN p_partkey % 17 = 0 THEN 'NA' WHEN p_partkey % 19 = 0 THEN '-999' ELSE p_brand END"


@_query(
    f"""SELECT 'm' AS name, count(*) AS n, count(*) FILTER (WHERE m IS NULL) AS true_null, count(*) FILTER (WHERE m = '') AS empty, count(*) FILTER (WHERE m <> '' AND trim(m) = '') AS whitespace,
count(*) FILTER (WHERE m = 'NA') AS token, count(*) FILTER (WHERE m = '-999') AS suspicious, count(DISTINCT CASE WHEN trim(m) <> '' AND m <> 'NA' THEN m END) AS distinct_values FROM (SELECT {_MESSY} AS m FROM part)"""
)
def profile_missingness(spark: SparkSession, sf: str) -> DataFrame:
    p = profile(_table(spark, sf, "part").selectExpr(f"{_MESSY} AS m"))[0]
    row = (p.name, p.rows, *[p.missing[k] for k in ("true_null", "empty", "whitespace", "token", "suspicious")], p.distinct)
    return spark.createDataFrame([row], "name string, n bigint, true_null bigint, empty bigint, whitespace bigint, token bigint, suspicious bigint, distinct_values bigint")


_NUMERIC = ("c_acctbal", "c_nationkey", "c_custkey")


@_query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) AS n, count(DISTINCT {c}) AS distinct_values, round(min({c})::DOUBLE, 6) + 0.0 AS lo, round(max({c})::DOUBLE, 6) + 0.0 AS hi, round(avg({c}) + 2.3e-9, 6) AS mean, round(stddev_samp({c}) + 2.3e-9, 6) AS std,"
        f" count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negative FROM customer"
        for c in _NUMERIC
    )
)
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for p in profile(_table(spark, sf, "customer").select(*_NUMERIC)):
        s = p.numeric
        rows.append((p.name, p.rows, p.distinct, float(s["min"]), float(s["max"]), float(s["mean"]), float(s["std"]), s["zeros"], s["negative"]))
    df = spark.createDataFrame(rows, "name string, n bigint, distinct_values bigint, lo double, hi double, mean double, std double, zeros bigint, negative bigint")
    return df.select("name", "n", "distinct_values", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round(F.col("mean") + 2.3e-9, 6).alias("mean"), F.round(F.col("std") + 2.3e-9, 6).alias("std"), "zeros", "negative")


@_query()
def profile_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(t, p.name, p.physical, p.semantic, ",".join(p.findings)) for t in ("customer", "orders", "part", "events", "documents") for p in profile(_table(spark, sf, t))]
    return spark.createDataFrame(rows, "source string, name string, physical string, semantic string, findings string")


@_query("SELECT list_sort(list(o_totalprice))[1] AS v0, list_sort(list(o_totalprice))[count(*) // 4 + 1] AS v1, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS v2, max(o_totalprice) AS v3, count(*) AS n FROM orders")
def order_statistics_exact(spark: SparkSession, sf: str) -> DataFrame:
    n, v = order_statistics(_table(spark, sf, "orders"), num("o_totalprice"), lambda n: [0, n // 4, n // 2, n - 1])
    return spark.createDataFrame([(*v, n)], "v0 double, v1 double, v2 double, v3 double, n bigint")


# ---- splits ----------------------------------------------------------------------------------------------------------


@_query("SELECT o_orderpriority AS y, 5 AS folds, true AS balanced, count(*) AS n FROM orders GROUP BY 1")
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """Class counts of a fold differ by one at most."""
    s = problem.stratified_kfold(_table(spark, sf, "orders"), "o_orderpriority", ["o_orderkey"])
    per = s.groupBy(F.col("o_orderpriority").alias("y"), "fold").count()
    return per.groupBy("y").agg(F.count("*").cast("int").alias("folds"), (F.max("count") - F.min("count") <= 1).alias("balanced"), F.sum("count").alias("n"))


@_query("SELECT count(DISTINCT o_custkey) AS customers, 1 AS folds_of_a_customer, count(*) AS n FROM orders")
def split_group(spark: SparkSession, sf: str) -> DataFrame:
    s = problem.group_kfold(_table(spark, sf, "orders"), "o_custkey")
    per = s.groupBy("o_custkey").agg(F.count_distinct("fold").alias("f"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("customers"), F.max("f").cast("int").alias("folds_of_a_customer"), F.sum("n").alias("n"))


@_query("SELECT count(*) AS n, 5 AS folds, true AS ordered FROM events")
def split_time(spark: SparkSession, sf: str) -> DataFrame:
    """No row of a fold is before a row of an earlier fold."""
    per = problem.time_folds(_table(spark, sf, "events"), "ts").groupBy("fold").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
    after = per.select(F.col("fold").alias("g"), F.col("lo").alias("next"))
    late = per.join(after, F.col("g") == F.col("fold") + 1, "left")
    return late.agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("folds"), F.bool_and(F.col("next").isNull() | (F.col("hi") < F.col("next"))).alias("ordered"))


@_query("SELECT count(*) AS n, true AS near FROM orders")
def split_holdout(spark: SparkSession, sf: str) -> DataFrame:
    s = problem.make_splits(_table(spark, sf, "orders"), ["o_orderkey"])
    return s.agg(F.count("*").alias("n"), F.avg(F.col("is_holdout").cast("double")).between(0.17, 0.23).alias("near"))


# ---- leakage ---------------------------------------------------------------------------------------------------------

_AUC = "(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y))"
_RANKED = "(SELECT y, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r FROM {t})"


@_query(f"SELECT round({_AUC}, 9) AS auc FROM {_RANKED.format(s='x', t=_O)}")
def leak_rank_auc(spark: SparkSession, sf: str) -> DataFrame:
    auc = rank_auc(_orders(spark, sf), num("x"), num("y"))
    return spark.createDataFrame([(auc,)], "auc double").select(F.round("auc", 9).alias("auc"))


_PLANTS = ["o_orderkey AS k", "o_orderstatus AS target_text", "CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS y", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS same", "CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS opposite", "o_totalprice AS clean"]


@_query(
    f"""WITH t AS (SELECT {', '.join(_PLANTS)} FROM orders), n AS (SELECT *, (y = 'yes')::INT AS b FROM t)
SELECT * FROM (SELECT 'same' AS name, 'target_copy' AS kind, 'HARD_REJECT' AS severity, round(avg((same = b)::INT), 6) AS score FROM n
UNION ALL SELECT 'opposite', 'inverted_target', 'HARD_REJECT', round(avg((opposite = 1 - b)::INT), 6) FROM n
UNION ALL SELECT 'clean', 'target_copy', 'HARD_REJECT', round(avg((clean = b)::INT), 6) FROM n) WHERE score >= 0.99"""
)
def leak_deterministic(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "orders").selectExpr(*_PLANTS)
    found = problem.deterministic_leaks(df, ["same", "opposite", "clean"], "y")
    return spark.createDataFrame([(f.column, f.kind, f.severity, round(f.score, 6)) for f in found], "name string, kind string, severity string, score double")


@_query(
    """WITH t AS (SELECT o_orderpriority AS f, (o_orderstatus = 'F')::INT AS y FROM orders), c AS (SELECT f, y, count(*)::DOUBLE AS n FROM t GROUP BY f, y),
m AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY f) AS nf, sum(n) OVER (PARTITION BY y) AS ny FROM c)
SELECT round(sum(n / total * log2(n * total / (nf * ny))) / (SELECT -sum(p * log2(p)) FROM (SELECT sum(n) / any_value(total) AS p FROM m GROUP BY y)), 9) AS mi FROM m"""
)
def leak_information(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    return spark.createDataFrame([(round(problem.normalised_information(o, F.col("c"), F.col("y")), 9),)], "mi double")


_SEPARATED = "(SELECT y, y * 10 + (k % 7) / 10.0 AS s, c, x FROM t)"


@_query(
    f"""WITH t AS (SELECT * FROM {_O}), a AS (SELECT 'separated' AS name, {_AUC} AS v FROM {_RANKED.format(s='s', t=_SEPARATED)} UNION ALL SELECT 'x', {_AUC} FROM {_RANKED.format(s='x', t='t')}),
l AS (SELECT 'separated' AS name, s::VARCHAR AS f, y FROM {_SEPARATED} UNION ALL SELECT 'c', c, y FROM t), n AS (SELECT name, f, y, count(*)::DOUBLE AS n FROM l GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY name) AS total, sum(n) OVER (PARTITION BY name, f) AS nf, sum(n) OVER (PARTITION BY name, y) AS ny FROM n),
i AS (SELECT name, sum(n / total * log2(n * total / (nf * ny))) / (SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY y)) AS v FROM m GROUP BY name),
g AS (SELECT abs(avg(CASE WHEN y = 1 THEN 0.0 END) - avg(CASE WHEN y = 0 THEN 1.0 END)) AS v FROM t)
SELECT name, 'separation' AS kind, 'L4' AS level, round(v, 6) AS score FROM a WHERE v >= 0.98 UNION ALL SELECT name, 'information', 'L4', round(v, 6) FROM i WHERE v >= 0.9
UNION ALL SELECT 'gone', 'missingness', 'L4', round(v, 6) FROM g WHERE v >= 0.9"""
)
def leak_statistical(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).withColumn("separated", F.col("y") * 10 + F.pmod("k", F.lit(7)) / 10).withColumn("gone", F.when(F.col("y") == 1, F.col("x")))
    found = problem.statistical_leaks(o, ["separated", "gone", "x", "c"], "y")
    return spark.createDataFrame([(f.column, f.kind, f.level, round(f.score, 6)) for f in found], "name string, kind string, level string, score double")


# ---- cross-fitting and scores -----------------------------------------------------------------------------------------


@_query(
    f"""WITH t AS (SELECT * FROM {_O}) SELECT a.k, round((coalesce(s, 0) + 1.0 * g) / (coalesce(n, 0) + 1.0) + 2.3e-9, 6) AS v FROM t a
JOIN (SELECT f.fold, avg(y) AS g FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY 1) USING (fold)
LEFT JOIN (SELECT c, f.fold, count(*) AS n, sum(y) AS s FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY 1, 2) u ON u.c = a.c AND u.fold = a.fold"""
)
def crossfit_target_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = out_of_fold_mean(_orders(spark, sf), "c", "y", "fold", "v")
    return out.select("k", F.round(F.col("v") + 2.3e-9, 6).alias("v"))


@_query()
def crossfit_tree_leaf(spark: SparkSession, sf: str) -> DataFrame:
    return tree_leaf_by_fold(_orders(spark, sf).select("k", "x", "p", "y", "fold"), ["x", "p", "y"], "fold", "leaf").select("k", "leaf")


@_query(f"SELECT round(avg((p - y) * (p - y)), 9) AS brier, round(-avg(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))), 9) AS log_loss FROM {_O}")
def score_brier_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    return spark.createDataFrame([(round(problem.brier(o, "p", "y"), 9), round(problem.log_loss(o, "p", "y"), 9))], "brier double, log_loss double")


@_query(
    f"SELECT round(p, 9) AS threshold, sum(s) OVER w AS tp, (sum(c) OVER w - sum(s) OVER w)::DOUBLE AS fp, sum(s) OVER () AS pos FROM (SELECT p, count(*) AS c, sum(y) AS s FROM {_O} GROUP BY p) WINDOW w AS (ORDER BY p DESC)"
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return problem.threshold_table(_orders(spark, sf), "p", "y").select(F.round("threshold", 9).alias("threshold"), "tp", "fp", "pos")


@_query(f"SELECT round(greatest(a, 1 - a), 9) AS auc FROM (SELECT {_AUC} AS a FROM {_RANKED.format(s='x', t=f'(SELECT x, (fold = 0)::INT AS y FROM {_O})')})")
def shift_separation(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    return spark.createDataFrame([(round(problem.shift_auc(o.where("fold <> 0"), o.where("fold = 0"), "x"), 9),)], "auc double")


@_query()
def calibration_points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(problem.calibrate(_orders(spark, sf), "p", "y"), "score double, probability double")


# ---- reports ---------------------------------------------------------------------------------------------------------

_BIN = "least(15, floor((x - lo) / ((hi - lo) / 16)))::INT"


@_query(f"SELECT {_BIN} AS bin, count(*) AS n FROM {_O}, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def eda_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return report.histogram(_orders(spark, sf), "x").select("bin", "n")


@_query(
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)"
    " SELECT round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS med, round(any_value(q3), 6) AS q3, count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1)) AS below, count(*) FILTER (WHERE o_totalprice > q3 + 1.5 * (q3 - q1)) AS above FROM orders, q"
)
def eda_outliers(spark: SparkSession, sf: str) -> DataFrame:
    o = report.outliers(_orders(spark, sf), "x")
    return spark.createDataFrame([(round(o["q1"], 6), round(o["median"], 6), round(o["q3"], 6), o["below"], o["above"])], "q1 double, med double, q3 double, below bigint, above bigint")


_ITEMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@_query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for i, a in enumerate(_ITEMS) for b in _ITEMS[i + 1 :]))
def eda_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return report.correlations(_table(spark, sf, "lineitem"), list(_ITEMS)).select("a", "b", F.round("r", 9).alias("r"))


@_query("SELECT trim(p_type) AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 4")
def eda_top_values(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_values(_table(spark, sf, "part"), "p_type", 4)


@_query("SELECT o_orderstatus AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS share FROM orders GROUP BY 1")
def eda_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return report.class_balance(_table(spark, sf, "orders"), "o_orderstatus").select("value", "n", F.round("share", 9).alias("share"))


@_query(
    f"""WITH r AS (SELECT min(x) AS lo, max(x) AS hi FROM {_O}), g AS (SELECT c FROM {_O} GROUP BY c ORDER BY count(*) DESC, c LIMIT 3)
SELECT c AS value, {_BIN} AS bin, count(*) AS n FROM {_O}, r WHERE c IN (SELECT c FROM g) GROUP BY 1, 2"""
)
def eda_ridgeline(spark: SparkSession, sf: str) -> DataFrame:
    return report.ridgeline(_orders(spark, sf), "x", "c", groups=3)


@_query(
    "SELECT round(regr_slope(v, d), 9) AS slope, round(corr(v, d), 9) AS r FROM (SELECT avg(value) AS v, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE AS d FROM events GROUP BY ts::DATE)"
)
def eda_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = report.trend(report.daily(_table(spark, sf, "events"), "ts", "value"))
    return spark.createDataFrame([(round(t["slope"], 9), round(t["r"], 9))], "slope double, r double")


@_query(
    """WITH d AS (SELECT ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1), m AS (SELECT row_number() OVER (ORDER BY day) AS i, v - avg(v) OVER () AS c FROM d WHERE v IS NOT NULL)
SELECT k::INT AS lag, round(coalesce(sum(a.c * b.c) / (SELECT sum(c * c) FROM m), 0) + 2.3e-9, 6) AS r FROM range(1, 25) AS t(k) LEFT JOIN m a ON true LEFT JOIN m b ON b.i = a.i + k GROUP BY k"""
)
def eda_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    acf = report.autocorrelation(report.daily(_table(spark, sf, "events"), "ts", "value"))
    return spark.createDataFrame(list(enumerate(acf, 1)), "lag int, r double").select("lag", F.round(F.col("r") + 2.3e-9, 6).alias("r"))


# ---- streams and the whole -------------------------------------------------------------------------------------------


@_query(
    "SELECT date_trunc('day', ts) AS start, event_type, count(value) AS n, round(sum(value), 4) AS total, round(min(value), 4) AS low, round(max(value), 4) AS high FROM events GROUP BY 1, 2"
)
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming aggregation on a bounded input, where it is the batch aggregation."""
    events = _table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = windowed(events, "at", ["event_type"], "value", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@_query()
def learn_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """The features that the whole funnel selects to predict a total that prices, quantities and dates make."""
    total = "l_extendedprice * sqrt(l_quantity) / 50 - 40 * l_discount * l_quantity + 100 * month(l_shipdate) AS total"
    items = _table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate", total)
    found = learn(items, "total", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], size=4, candidates=("ridge",))
    return spark.createDataFrame([(i, f.name, float(g)) for i, (f, g) in enumerate(found.selection.chosen)], "position int, feature string, gain double")
