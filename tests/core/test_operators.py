"""The catalogue: golden vectors, null policies, fitted states, and invariants over all operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.clean import cat, char_ngrams, dt, md5_bucket, num, word_tokens
from tabloom.functions.order import cumulative, order_statistics, rank_auc
from tabloom.operators import all_operators, families, get
from tabloom.operators.categorical import out_of_fold_mean
from tabloom.operators.group import apply_groups, fit_groups
from tabloom.operators.model import residual_interactions
from tabloom.operators.numeric import DOMAIN_CHECKS
from tabloom.operators.temporal import ewma


def test_catalogue():
    assert len(all_operators()) == 95 and len(families()) == 13
    assert all(o.leakage in ("L0", "L1", "L2") for o in all_operators())
    with pytest.raises(KeyError):
        get("no such operator")


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)


def run(spark, name, values, **params):
    df = column(spark, values)
    return [r[0] for r in df.select("i", get(name).build(num("x"), **params).alias("v")).orderBy("i").select("v").collect()]


@pytest.mark.parametrize(
    ("name", "values", "want"),
    [
        ("log1p", [0, 1, 10, None, 100, -1, -2], [0, 0.6931471805599453, 2.3978952727983707, None, 4.61512051684126, None, None]),
        ("signed_log1p", [-1.0, 0.0, 1.0, None], [-math.log(2), 0, math.log(2), None]),
        ("sqrt", [4.0, -1.0, None, float("nan")], [2, None, None, None]),
        ("cbrt", [-8.0, 27.0], [-2, 3]),
        ("square", [3.0, 1e155, None], [9, None, None]),
        ("cube", [2.0, 1e103], [8, None]),
        ("abs", [-3.0, None], [3, None]),
        ("sign", [-2.0, 0.0, 5.0, None], [-1, 0, 1, None]),
        ("reciprocal", [2.0, 0.0, 1e-13], [0.5, None, None]),
        ("exp_clip", [0.0, 100.0, -100.0, None], [1, math.exp(20), math.exp(-20), None]),
        ("zero_indicator", [0.0, 1.0, None], [True, False, None]),
        ("positive_indicator", [0.0, 1.0, None, float("nan")], [False, True, None, None]),
        ("missing_indicator", [0.0, None, float("nan")], [False, True, True]),
        ("finite_indicator", [0.0, None, float("inf"), float("nan")], [True, False, False, False]),
    ],
)
def test_scalars(spark, name, values, want):
    got = run(spark, name, [None if v is None else float(v) for v in values])
    assert [g if g is None or isinstance(g, bool) else pytest.approx(g) for g in got] == want


@pytest.mark.parametrize(
    ("name", "pairs", "want"),
    [
        ("sum", [(1, 2), (1, None)], [3, None]), ("difference", [(1, 2)], [-1]), ("product", [(1e100, 1e100), (2, 3)], [None, 6]), ("safe_ratio", [(1, 0), (1, 2)], [None, 0.5]),
        ("relative_difference", [(3, 1)], [2]), ("min_pair", [(1, 2), (1, None)], [1, None]), ("max_pair", [(1, 2), (None, 2)], [2, None]), ("mean_pair", [(1, 2)], [1.5]),
        ("harmonic_mean_pair", [(1, 1), (-1, 1)], [1, None]), ("geometric_mean_pair", [(2, 8), (-1, 1)], [4, None]), ("euclidean_norm_pair", [(3, 4)], [5]), ("absolute_difference", [(1, 4)], [3]),
    ],
)
def test_pairs(spark, name, pairs, want):
    df = spark.createDataFrame([(i, *[None if v is None else float(v) for v in p]) for i, p in enumerate(pairs)], "i int, x double, y double")
    got = [r.v for r in df.select("i", get(name).build(num("x"), num("y")).alias("v")).orderBy("i").collect()]
    assert [g if g is None else pytest.approx(g) for g in got] == want


def test_date_strings(spark):
    texts = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.123456", "2024-13-01", "", None, " 2024-02-29 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r.y, r.h) for r in df.select("i", get("month").build(dt("t", "string")).alias("y"), get("hour").build(dt("t", "string")).alias("h")).orderBy("i").collect()]
    assert got == [(1, 0), (1, 3), (1, 3), (None, None), (None, None), (None, None), (2, 0)]
    row = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 10:20:00' AS d").select(*[get(n).build(F.col("d")).alias(n) for n in families()["datetime"]]).first().asDict()
    assert row["day_of_week"] == 6 and row["is_weekend"] and row["is_month_end"] and row["quarter"] == 1 and row["week_of_year"] == 13 and row["day_of_year"] == 91 and row["minute"] == 20
    assert row["cyclical_month"] == pytest.approx(math.sin(2 * math.pi * 3 / 12)) and row["cyclical_dow"] == pytest.approx(math.sin(2 * math.pi * 6 / 7))


@pytest.mark.parametrize(
    ("name", "values", "params", "want"),
    [
        ("lag", [1, 2, 3, 4], {}, [None, 1, 2, 3]), ("lag", [10, 20, 30, 40, 50], {"periods": 2}, [None, None, 10, 20, 30]), ("lag", [1, None, 3, 4], {}, [None, 1, None, 3]), ("lead", [1, 2, 3, 4], {}, [2, 3, 4, None]),
        ("diff", [10, 15, 7, 20], {}, [None, 5, -8, 13]), ("diff", [10, None, 7], {}, [None, None, None]), ("rolling_mean", [1, 2, 3, 4, 5], {}, [None, None, 2, 3, 4]), ("rolling_sum", [1, 2, 3, 4], {"window": 2}, [None, 3, 5, 7]),
        ("rolling_max", [3, 1, 4, 1, 5], {}, [None, None, 4, 4, 5]), ("rolling_min", [3, 1, 4, 1, 5], {}, [None, None, 1, 1, 1]), ("rolling_std", [2, 2, 2, 2], {"window": 2}, [None, 0, 0, 0]),
        ("rolling_count", [1, None, 3, None], {"window": 2}, [1, 1, 1, 1]), ("rolling_unique", [1, 1, 2], {"window": 2}, [None, 1, 2]), ("expanding_mean", [1, None, 3], {}, [1, 1, 2]),
        ("pct_change", [1, 2, 0, 5], {}, [None, 1, -1, None]), ("time_since_previous", [1, 4, 2], {}, [None, 3, None]), ("time_since_first", [None, 4, 6], {}, [None, 0, 2]), ("lag", [1], {"periods": 3}, [None]),
    ],
)
def test_windows(spark, name, values, params, want):
    df = column(spark, [None if v is None else float(v) for v in values]).withColumn("e", F.lit(1))
    w = Window.partitionBy("e").orderBy("i")
    got = [r.v for r in df.select("i", get(name).build(num("x"), w, **params).alias("v")).orderBy("i").collect()]
    assert [g if g is None else pytest.approx(g, rel=1e-6) for g in got] == want


def test_ewma_carries_over_nulls_and_entities(spark):
    rows = [(e, i, v) for e in ("a", "b") for i, v in enumerate([1.0, 2.0, None, 4.0])] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "e string, i int, x double").repartition(3)
    got = {(r.e, r.i): r.s for r in ewma(df, num("x"), ["e"], ["i"], "s").collect()}
    assert [got["a", i] for i in range(4)] == pytest.approx([1, 1.3, 1.3, 2.11]) and got["c", 0] is None and len(got) == 9


def fitted(spark, name, train, rows, schema, columns, **params):
    op = get(name)
    p = {**op.defaults, **params}
    state = op.fit(spark.createDataFrame(train, schema), columns, p)
    return [r.v for r in op.apply(spark.createDataFrame(rows, schema).withColumn("i", F.monotonically_increasing_id()), columns, p, state, "v").orderBy("i").collect()]


def test_numeric_states(spark):
    ten, schema = [(float(i),) for i in range(10)], "x double"
    new = [(0.0,), (20.0,), (None,), (float("nan"),)]
    assert fitted(spark, "standardize", ten, new, schema, ["x"]) == [pytest.approx(-4.5 / math.sqrt(8.25)), pytest.approx(15.5 / math.sqrt(8.25)), None, None]
    assert fitted(spark, "standardize", [(3.0,)], new[:1], schema, ["x"]) == [-3]
    assert fitted(spark, "robust_scale", ten, new, schema, ["x"]) == [-0.9, 3.1, None, None]
    assert fitted(spark, "minmax_scale", ten, new, schema, ["x"]) == [0, pytest.approx(20 / 9), None, None]
    assert fitted(spark, "minmax_scale", [(4.0,)], new, schema, ["x"]) == [0.5, 0.5, None, None]
    assert fitted(spark, "winsorize", ten, new, schema, ["x"], lower=0.25, upper=0.75) == [2, 6, None, None]
    low, high, *_ = fitted(spark, "quantile_normal", ten, new, schema, ["x"])
    assert low == pytest.approx(-1.6452, abs=1e-3) and high == 6.0
    assert fitted(spark, "quantile_normal", ten[:0], new[:1], schema, ["x"]) == [None]


def test_group_states(spark):
    schema = "k string, x double"
    train = [("a", 10.0), ("a", 20.0), (" b ", 30.0), (None, 5.0), ("m", None)]
    rows = [("a", 0.0), ("b", 0.0), ("c", 0.0), (None, 0.0), (" ", 0.0)]
    assert fitted(spark, "group_mean", train, rows, schema, ["k", "x"]) == [15, 30, 0, None, None]
    assert fitted(spark, "group_count", train, rows, schema, ["k"])[:3] == [2, 1, 0]
    assert fitted(spark, "group_std", train, rows, schema, ["k", "x"])[:2] == [5, 0]
    assert fitted(spark, "group_missing_rate", [("a", 1.0), ("a", None), ("b", None), ("b", 4.0)], rows, schema, ["k", "x"])[:2] == [0.5, 0.5]
    df = spark.createDataFrame(train, schema)
    both = apply_groups(df, "k", fit_groups(df, "k", {"lo": ("group_min", "x"), "u": ("group_nunique", "x")}))
    assert both.columns == ["k", "x", "lo", "u"] and both.where("trim(k) = 'a'").first()[2:] == (10.0, 2.0)


def test_category_states(spark):
    schema = "c string"
    train = [(v,) for v in ["x", "x", "x", "y", "y", "z", None, " "]]
    rows = [("x",), (" y",), ("new",), (None,), ("",)]
    assert fitted(spark, "ordinal_encode", train, rows, schema, ["c"]) == [0, 1, -1, None, None]
    assert fitted(spark, "count_encode", train, rows, schema, ["c"]) == [3, 2, 0, None, None]
    assert fitted(spark, "frequency_encode", train, rows, schema, ["c"]) == [3 / 8, 2 / 8, 0, None, None]
    assert fitted(spark, "rare_group", train, rows, schema, ["c"], min_count=2) == ["x", "y", "__RARE__", None, None]
    assert fitted(spark, "one_hot", train, rows, schema, ["c"], max_categories=2) == [[True, False], [False, True], [False] * 2, [False] * 2, [False] * 2]
    df = spark.createDataFrame([("a|b", "x")], "a string, b string")
    assert df.select(get("category_cross").build(cat("a"), cat("b"))).first()[0] == "a\\|b|x"
    import hashlib

    words = ["alpha", "é", "x y"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "c string").select(get("hash_encode").build(cat("c"), n_buckets=37, seed=3)).collect()]
    assert got == [int(hashlib.md5(f"3:{w}".encode()).hexdigest(), 16) % 37 for w in words]
    assert spark.range(1).select(md5_bucket(F.lit("abc"), 16)).first()[0] == int(hashlib.md5(b"abc").hexdigest(), 16) % 16


def test_target_states(spark):
    schema = "c string, y double"
    train = [("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("a", None)]
    rows = [("a", None), ("b", None), ("z", None), (None, None)]
    assert fitted(spark, "target_mean_crossfit", train, rows, schema, ["c", "y"], smoothing=1.0) == [pytest.approx(2.5 / 3), pytest.approx(0.5 / 3), None, None]
    a, b, *none = fitted(spark, "woe_crossfit", train, rows, schema, ["c", "y"])
    assert a == pytest.approx(math.log((12 / 22) / (10 / 22))) == -b and none == [None, None]
    xs = [(float(i), float(i >= 5)) for i in range(10)]
    assert fitted(spark, "numeric_to_cat_target", xs, [(0.0, None), (99.0, None), (None, None)], "x double, y double", ["x", "y"], smoothing=0.0) == [0, 1, None]


def test_out_of_fold_means_do_not_see_their_fold(spark):
    r = random.Random(1)
    rows = [(i, r.choice("abc"), float(r.random() < 0.4), i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, c string, y double, fold int")
    got = {x.i: x.v for x in out_of_fold_mean(df, "c", "y", "fold", "v", 2.0).collect()}
    for i, c, _, f in rows:
        others = [y for _, d, y, g in rows if g != f and d == c]
        prior = np.mean([y for _, _, y, g in rows if g != f])
        assert got[i] == pytest.approx((sum(others) + 2 * prior) / (len(others) + 2))
    changed = spark.createDataFrame([(i, c, 1 - y if f == 0 else y, f) for i, c, y, f in rows], df.schema)
    again = {x.i: x.v for x in out_of_fold_mean(changed, "c", "y", "fold", "v", 2.0).collect()}
    assert all(again[i] == got[i] for i, *_, f in rows if f == 0)


def test_text(spark):
    df = spark.createDataFrame([(0, "Hello, Wörld_1 42!"), (1, ""), (2, None)], "i int, t string").coalesce(1)
    row = df.select(*[get(n).build(F.col("t")).alias(n) for n in families()["text"]]).collect()
    assert row[0].text_length_chars == 18 and row[0].text_length_tokens == 3 and row[0].text_digit_ratio == pytest.approx(3 / 18) and row[0].text_upper_ratio == pytest.approx(2 / 10)
    assert row[0].text_punctuation_ratio == pytest.approx(3 / 18) and row[1].text_upper_ratio == 0 and row[2].text_length_chars is None
    assert sum(map(abs, row[0].text_hashing)) <= 3 and len(row[0].text_hashing) == 16 and row[2].text_hashing == [0] * 16
    assert df.select(word_tokens("t")).first()[0] == ["hello", "wörld_1", "42"]
    assert df.select(char_ngrams(F.lit("AbcD"), 3)).first()[0] == ["abc", "bcd"]
    docs = [("a b a",), ("b c",), (None,), ("",)]
    idf = lambda n: math.log(4 / (1 + n)) + 1
    got = fitted(spark, "tfidf_word", docs, docs, "t string", ["t"], max_features=2)
    assert got == [pytest.approx([idf(2) / 3, idf(1) * 2 / 3]), pytest.approx([idf(2) / 2, 0]), [0, 0], [0, 0]]


def test_projections_and_clusters(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 3)) @ np.diag([5.0, 2.0, 0.1]) + 7
    schema = "a double, b double, c double"
    rows = [tuple(map(float, v)) for v in x]
    got = np.array(fitted(spark, "pca", rows, rows, schema, ["a", "b", "c"]))
    centred = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:2].T), atol=1e-6)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(np.array(fitted(spark, "truncated_svd", rows, rows, schema, ["a", "b", "c"]))), np.abs(x @ vt[:2].T), atol=1e-6)
    two = [(0.0, 0.0), (0.1, 0.0), (9.0, 9.0), (9.1, 9.0)]
    labels = fitted(spark, "kmeans_label", two, two, "a double, b double", ["a", "b"], n_clusters=2)
    assert labels == [0, 0, 1, 1]
    d = fitted(spark, "kmeans_distances", two, two, "a double, b double", ["a", "b"], n_clusters=2)
    assert d[0][0] == pytest.approx(0.05) and d[0][1] > 12
    t = fitted(spark, "text_svd", [("a b",), ("a c",), ("b c",)], [("a a b",), (None,)], "t string", ["t"])
    assert len(t[0]) == 2 and t[1] == [0, 0]
    leaves = fitted(spark, "tree_leaf_oof", [(float(i), float(i > 50)) for i in range(100)], [(1.0, None), (99.0, None)], "x double, y double", ["x", "y"])
    assert leaves[0] != leaves[1]


def test_residual_proposals(spark):
    df = spark.range(200).select((F.col("id") * 1.0).alias("a"), F.pmod("id", F.lit(7)).cast("double").alias("b"), (F.col("id") * 2.0).alias("r"))
    assert [x.column for x in residual_interactions(df, ["a", "b"], "r").collect()][0] == "a"


@pytest.mark.parametrize("seed", range(4))
def test_order_statistics_and_ranks(spark, seed):
    r = random.Random(seed)
    values = [r.choice([r.gauss(0, 1e6), float(r.randint(0, 5)), 1e-300, -1e300]) for _ in range(r.choice([1, 2, 500]))] + [None]
    df = column(spark, values)
    live = sorted(v for v in values if v is not None)
    n, got = order_statistics(df, num("x"), lambda n: list(range(0, n, max(1, n // 7))) + [n - 1])
    assert n == len(live) and got == [live[i] for i in [*range(0, n, max(1, n // 7)), n - 1]]
    per = df.where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("c"))
    for x in cumulative(per, "x", "c").collect():
        assert x.below == sum(v < x.x for v in live)


def test_auc(spark):
    r = random.Random(9)
    rows = [(float(r.randint(0, 9)), float(r.random() < 0.5)) for _ in range(300)]
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "x double, y double")
    assert rank_auc(df, num("x"), num("y")) == pytest.approx(want)
    assert rank_auc(df.where("y = 1"), num("x"), num("y")) is None


def test_domain_checks_name_operators():
    assert all(get(n).inputs for n in DOMAIN_CHECKS)
