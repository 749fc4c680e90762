"""Pipelines, profiles, splits, leakage, selection, models, reports, export, experience, sources, streams."""

import io
import json
import math
import sqlite3

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from tabloom import plan_queries
from tabloom.functions.parallel import spread
from tabloom.operators import get
from tabloom.plans import codegen, experience, models, problem, report, selection
from tabloom.plans.features import Feature, FeatureEstimator, FeatureGraph, FeaturePipeline, check_domains, fold_identity
from tabloom.plans.learn import learn
from tabloom.plans.profile import fingerprint, meta_features, profile
from tabloom.plans.selection import Grams, f0_preconditions, nested_cv, progressive_cv, propose, run_funnel, select_portfolio
from tabloom.sources import SourceError, open_source, readers, sniff
from tabloom.sources.readers import assert_public, read_api, read_csv, read_sqlite
from tabloom.streaming.features import ewma_stream, windowed


@pytest.fixture(scope="module")
def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


FEATURES = [
    Feature.of("log1p", "o_totalprice"), Feature.of("month", "o_orderdate"), Feature.of("sum", "o_totalprice", "o_custkey"), Feature.of("lag", "o_totalprice", entity=("o_custkey",), order=("o_orderdate", "o_orderkey")),
    Feature.of("group_mean", "o_custkey", "o_totalprice"), Feature.of("frequency_encode", "o_orderpriority"), Feature.of("hash_encode", "o_orderpriority"), Feature.of("standardize", "o_totalprice"),
    Feature.of("ewma", "o_totalprice", entity=("o_custkey",), order=("o_orderdate", "o_orderkey")),
]


def test_one_pipeline_of_all_shapes(orders, spark, tmp_path):
    p = FeaturePipeline(FEATURES, ["o_orderkey"]).fit(orders)
    made = p.transform(orders)
    assert made.columns == ["o_orderkey", *[f.name for f in FEATURES]] and made.count() == orders.count()
    p.save(str(tmp_path / "state"), spark)
    again = FeaturePipeline.load(str(tmp_path / "state"), spark)
    assert codegen.differing_rows(made, again.transform(orders), made.columns) == 0
    assert FeatureEstimator(FEATURES[:2]).fit(orders).transform(orders).columns[-2:] == [f.name for f in FEATURES[:2]]


def test_identity_and_graph():
    assert Feature.of("sum", "b", "a") == Feature.of("sum", "a", "b") and Feature.of("difference", "b", "a") != Feature.of("difference", "a", "b")
    x0 = Feature.of("sum", "x", "zero")
    assert fold_identity(x0, {"zero": 0.0}).op == "identity" and fold_identity(x0, {"zero": 0.0, "x": 0.0}) is x0
    g = FeatureGraph()
    a = g.add(Feature.of("log1p", "x"))
    b = g.add(Feature.of("sqrt", "x"), (a,))
    assert g.add(Feature.of("log1p", "x")) == a and g.order() == [a, b]
    with pytest.raises(KeyError):
        g.add(Feature.of("sqrt", "x"), ("nope",))
    g.nodes[a] = (g.nodes[a][0], (b,))
    with pytest.raises(ValueError, match="cycle"):
        g.order()


def test_domains(spark):
    df = spark.createDataFrame([(-5.0, 0.0), (-5.0, 1.0), (1.0, 0.0)], "x double, y double")
    bad = check_domains(df, [Feature.of("log1p", "x"), Feature.of("safe_ratio", "x", "y"), Feature.of("sqrt", "y")])
    assert set(bad) == {"log1p(x)", "safe_ratio(x_y)"}


def test_profiles(spark):
    n = 200
    rows = [(f"u{i:04}", 20 + i % 40, ["a", "b", "c", None][i % 4], f"2024-01-{1 + i % 28:02}", i % 3 and "NA" or str(i), 1, float(i % 50 == 0), "word " * 20 + str(i), float("nan") if i % 2 else 1.5 * i) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, age int, city string, joined string, messy string, same int, rare double, body string, x double").withColumn("age_again", F.col("age"))
    by = {p.name: p for p in profile(df)}
    assert {k: p.semantic for k, p in by.items()} == {
        "id": "identifier", "age": "continuous_numeric", "city": "low_cardinality_categorical", "joined": "datetime", "messy": "continuous_numeric", "same": "continuous_numeric", "rare": "continuous_numeric",
        "body": "free_text", "x": "continuous_numeric", "age_again": "continuous_numeric",
    }
    assert by["city"].null_fraction == 0.25 and by["joined"].physical == "date" and by["x"].numeric["nan"] == 100
    assert "constant" in by["same"].findings and "excess_zeros" in by["rare"].findings and "disguised_missing" in by["messy"].findings and "duplicate_of:age" in by["age_again"].findings
    sketched = {p.name: p for p in profile(df, exact=False)}
    assert abs(sketched["id"].distinct - n) <= 0.1 * n
    assert 0 < meta_features(list(by.values()))["numeric"] < 1
    assert fingerprint(df.drop("x")) == fingerprint(df.drop("x").orderBy(F.rand(3))) != fingerprint(df.drop("x").limit(10))
    assert profile(df.where("false"))[0].rows == 0


def test_profiles_of_large_tables_count_values(spark):
    df = spark.range(1_000_001).selectExpr("CASE WHEN id < 10 THEN 'b' ELSE 'a' END AS near", "concat('u', lpad(id, 9, '0')) AS record_id")
    by = {p.name: p for p in profile(df)}
    assert "near_constant" in by["near"].findings and by["near"].mode_share == 999_991 / 1_000_001
    assert by["record_id"].distinct == 1_000_001 and by["record_id"].semantic == "identifier"
    assert "near_constant" in profile(df, exact=False)[0].findings


def test_tasks(orders):
    by = {p.name: p for p in profile(orders)}
    assert problem.infer_task(orders, "o_orderstatus", by["o_orderstatus"]).kind == "multiclass"
    assert problem.infer_task(orders, "o_totalprice", by["o_totalprice"]).kind == "regression"
    b = orders.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    t = problem.infer_task(b, "y", {p.name: p for p in profile(b)}["y"])
    assert t.kind == "binary" and t.positive == "1" and 0.2 < t.positive_rate < 0.5


def test_splits(orders):
    s = problem.stratified_kfold(orders, "o_orderpriority", ["o_orderkey"])
    spread = s.groupBy("o_orderpriority", "fold").count().groupBy("o_orderpriority").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.agg(F.max("d")).first()[0] <= 1 and s.count() == orders.count()
    assert codegen.differing_rows(s, problem.stratified_kfold(orders.repartition(7), "o_orderpriority", ["o_orderkey"]), ["o_orderkey", "fold"]) == 0
    h = problem.holdout(orders, ["o_orderkey"], time="o_orderdate")
    assert h.where("is_holdout").agg(F.min("o_orderdate")).first()[0] >= h.where("NOT is_holdout").agg(F.max("o_orderdate")).first()[0]
    with pytest.raises(ValueError):
        problem.stratified_kfold(orders.limit(1), "o_orderpriority", ["o_orderkey"])
    with pytest.raises(ValueError):
        problem.group_kfold(orders.withColumn("g", F.lit(1)), "g")


def test_leaks(spark):
    rows = [(i, i % 2, "yes" if i % 2 else "no", 1 - i % 2, f"id-{i}", f"t{i * 37 % 300}", float(i % 2) + (i % 7) / 100, float(i % 13), None if i % 2 else 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, y int, copy string, inverse int, id string, code string, near double, clean double, gone double").withColumn("unique_target", F.concat(F.lit("t"), F.col("i").cast("string")))
    found = {f.column: f.kind for f in problem.deterministic_leaks(df, ["copy", "inverse", "clean", "near"], "y")}
    assert found == {"copy": "target_copy", "inverse": "inverted_target"}
    assert {f.column: f.kind for f in problem.deterministic_leaks(df, ["id", "clean"], "unique_target")} == {"id": "bijection"}
    embedded = df.withColumn("inside", F.concat(F.lit("x-"), F.col("copy"), F.lit("-z")))
    assert {f.column: f.kind for f in problem.deterministic_leaks(embedded, ["inside"], "copy")} == {"inside": "embedded_target"}
    b = {(f.column, f.kind) for f in problem.statistical_leaks(df, ["near", "clean", "gone"], "y")}
    assert b == {("near", "separation"), ("near", "information"), ("gone", "missingness")}  # few levels of near tell the class, too
    assert [f.kind for f in problem.availability({"a": None, "b": "2024-02-01", "c": "2023-01-01"}, "2024-01-01")] == ["availability_unknown", "available_too_late"]


def test_scores(spark):
    rows = [(i / 100, float(i % 100 < 60 and i > 30)) for i in range(100)]
    df = spark.createDataFrame(rows, "p double, y double")
    points = problem.calibrate(df, "p", "y")
    assert all(a[1] <= b[1] for a, b in zip(points, points[1:], strict=False))
    mid = spark.range(1).select(problem.apply_calibration(F.lit(0.5), points)).first()[0]
    assert 0 <= mid <= 1
    t, f1 = problem.best_threshold(df, "p", "y")
    want = max((2 * sum(y for p, y in rows if p >= c) / (sum(p >= c for p, _ in rows) + sum(y for _, y in rows)), c) for c, _ in rows)
    assert (f1, t) == (pytest.approx(want[0]), want[1])
    assert problem.best_threshold(df, "p", "y", "precision_floor", 2.0) is None
    assert problem.pareto_front([(1, 1), (2, 0), (0, 0)]) == [0, 1]


@pytest.fixture(scope="module")
def toy(spark):
    r = np.random.default_rng(5)
    a, b, noise = r.gamma(2, 5, 600), r.normal(0, 1, 600), r.normal(0, 0.2, 600)
    y = 3 * np.log1p(a) + b + noise
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), float(r.normal()), "uv"[i % 2], float(y[i])) for i in range(600)], "i int, a double, b double, junk double, c string, y double")


def test_gram_losses_equal_direct_ones(toy):
    fs = [Feature.of("identity", "a"), Feature.of("identity", "b")]
    made = FeaturePipeline(fs).transform(toy)
    g = Grams(made, fs, F.col("y"), ["i"])
    rows = made.withColumn("f", F.pmod(F.xxhash64(F.lit(0), F.col("i")), F.lit(3))).select("identity(a)", "identity(b)", "y", "f").toPandas()
    x = np.column_stack([np.ones(len(rows)), (rows.iloc[:, :2] - rows.iloc[:, :2].mean()) / rows.iloc[:, :2].std(ddof=0)])
    sse = 0.0
    for k in range(3):
        t = (rows.f != k).to_numpy()
        w = np.linalg.solve(x[t].T @ x[t] + 1e-6 * np.eye(3), x[t].T @ rows.y[t])
        sse += float(((rows.y[~t] - x[~t] @ w) ** 2).sum())
    assert g.loss([0, 1]) == pytest.approx(math.sqrt(sse / len(rows)), rel=1e-9)
    assert g.correlation(0, 1) == pytest.approx(rows.iloc[:, 0].corr(rows.iloc[:, 1]), rel=1e-6)
    assert len(progressive_cv(g, [0, 1])) == 4 and nested_cv(g, [0, 1])[0] > 0
    assert {i for i, _ in select_portfolio(g)} == {0, 1}


def test_learn_finds_the_signal(toy):
    found = learn(toy, "y", ["i"], size=3, candidates=("ridge", "tree_regression"))
    names = {f.name for f, _ in found.selection.chosen}
    assert names & {"log1p(a)", "sqrt(a)"} and "identity(b)" in names | {"signed_log1p(b)"} and not any("junk" in n for n in list(names)[:2])
    assert found.best in found.scores and found.scores["ridge"] < 1.0
    assert found.selection.loss < found.selection.base_loss


@pytest.fixture(scope="module")
def mixed(spark):
    r = np.random.default_rng(8)
    a, b = r.normal(size=600), r.normal(size=600)
    kind = np.where(a > 0.4, "high", np.where(a < -0.4, "low", "mid"))
    rows = [(i, float(a[i]), float(b[i]), f"t{i % 7}", bool(i % 3), str(kind[i]), bool(a[i] + 0.3 * b[i] > 0.2)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c string, flag boolean, kind string, yes boolean")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("i") % 300)
    return df.withColumns({"day": day, "at": day.cast("timestamp_ntz"), "at_zone": day.cast("timestamp")})


@pytest.mark.parametrize(("target", "kind", "loss"), [("kind", "multiclass", 0.2), ("yes", "binary", 0.2), ("at_number", "regression", None)])
def test_learn_on_columns_and_targets_of_all_types(mixed, target, kind, loss):
    df = mixed.withColumn("at_number", F.col("a") * 3 + F.month("day")).drop(*({"kind", "yes"} - {target}))
    df = df.select(*[c for c in df.columns if c == target or c not in ("at_number",)])
    found = learn(df, target, ["i"], size=2, candidates=("ridge", "logistic"))
    assert found.task.kind == kind and any("(a)" in f.name for f, _ in found.selection.chosen) and found.scores
    assert found.selection.loss < found.selection.base_loss
    if loss:
        assert 0 < found.selection.loss < loss


def test_learn_refuses_targets_without_a_probe(mixed):
    with pytest.raises(NotImplementedError, match="no probe"):
        learn(mixed.withColumn("y", F.concat(F.lit("c"), F.col("i").cast("string"))), "y", ["i"])


@pytest.mark.parametrize("classes", [1, 3])
def test_clipped_losses_equal_direct_ones(mixed, classes):
    fs = [Feature.of("identity", "a"), Feature.of("identity", "b")]
    names = ["high", "low", "mid"][:classes]
    made = FeaturePipeline(fs).transform(mixed)
    g = Grams(made, fs, [(F.col("kind") == n).cast("double") for n in names], ["i"], task="binary" if classes == 1 else "multiclass")
    rows = made.withColumn("f", F.pmod(F.xxhash64(F.lit(1), F.col("i")), F.lit(3))).select("identity(a)", "identity(b)", "kind", "f").toPandas()
    x = np.column_stack([np.ones(len(rows)), (rows.iloc[:, :2] - rows.iloc[:, :2].mean()) / rows.iloc[:, :2].std(ddof=0)])
    y = np.column_stack([(rows.kind == n).to_numpy(float) for n in names])
    total = 0.0
    for k in range(3):
        t = (rows.f != k).to_numpy()
        out = np.clip(x[~t] @ np.linalg.solve(x[t].T @ x[t] + 1e-6 * np.eye(3), x[t].T @ y[t]), 0, 1)
        if classes > 1:
            out = out / out.sum(axis=1, keepdims=True)
        total += float(((out - y[~t]) ** 2).mean(axis=1).sum())
    assert g.losses([([0, 1], 1, 4), ([], 1, 4)])[0] == pytest.approx(total / len(rows), rel=1e-9)
    g.close()


def test_leak_passes_take_dates(mixed):
    columns = ["day", "at", "at_zone", "flag", "c"]
    assert problem.deterministic_leaks(mixed, columns, "kind") == [] and problem.deterministic_leaks(mixed, ["c"], "day") == []
    assert problem.statistical_leaks(mixed, columns, "yes") == []
    assert [f.column for f in problem.deterministic_leaks(mixed.withColumn("again", F.col("at")), ["again"], "at")] == ["again"]


def test_metrics_policies_and_fold_safety():
    assert [m.name for m in problem.route_metrics("binary", imbalanced=True, action="f1")] == ["roc_auc", "average_precision", "log_loss", "brier", "f1"]
    assert [m.name for m in problem.route_metrics("forecasting")] == ["rmse", "mae", "r2", "mape"] and problem.route_metrics("auto") == []
    assert not problem.route_metrics("multiclass")[0].maximise and problem.route_metrics("regression", non_negative=True)[-1].name == "mape"
    a, b = problem.freeze_policy("f1", 0.4), problem.freeze_policy("f1", 0.4, "bins")
    assert a == problem.freeze_policy("f1", 0.4) and a.fingerprint != b.fingerprint
    aware, plain = Feature.of("target_mean_crossfit", "c", "y"), Feature.of("log1p", "x")
    assert problem.fold_safety([aware, plain]) == [] and len(problem.fold_safety([aware, plain], "development")) == 2
    assert problem.target_history(True)[0].level == "L3" and not problem.target_history(True, True) and problem.confirm_unavailable(["x"])[0].severity == "HARD_REJECT"


def test_holdout_rows_do_not_move_the_selection(toy):
    split = problem.holdout(toy, ["i"])
    changed = split.withColumn("y", F.when(F.col("is_holdout"), -F.col("y")).otherwise(F.col("y")))
    pick = lambda df: [f.name for f, _ in run_funnel(df.where(~F.col("is_holdout")).drop("is_holdout"), propose(profile(df.where(~F.col("is_holdout")).drop("is_holdout")), "y"), profile(df.where(~F.col("is_holdout")).drop("is_holdout", "y", "i")), F.col("y"), ["i"], 2).chosen]
    assert pick(split) == pick(changed)


def test_every_candidate_meets_the_chosen_ones(spark, monkeypatch):
    r = np.random.default_rng(5)
    y, n = r.normal(size=3000), r.normal(size=3000)
    n -= y * (n @ y) / (y @ y)  # alone it tells nothing of y
    frame = pd.DataFrame({"i": range(3000), "y": y, "a": y + n, "n": n, **{f"z{j}": r.normal(size=3000) for j in range(3)}})
    made, features = spark.createDataFrame(frame), [Feature.of("identity", c) for c in ("a", "z0", "z1", "z2", "n")]
    made = FeaturePipeline(features).fit(made).transform(made)
    whole, probes = selection.select_features(made, features, F.col("y"), ["i"], 2)
    assert [f.name for f, _ in whole] == ["identity(a)", "identity(n)"] and len(probes) == 5
    monkeypatch.setattr(selection, "BATCH", 2)
    parts, _ = selection.select_features(made, features, F.col("y"), ["i"], 2)
    assert [f.name for f, _ in parts] == ["identity(a)", "identity(n)"] and [g for _, g in parts] == pytest.approx([g for _, g in whole])
    table = spark.createDataFrame(frame)
    found = run_funnel(table, features, [p for p in profile(table) if p.name not in ("i", "y")], F.col("y"), ["i"], 2)
    assert [f.name for f, _ in found.chosen] == ["identity(a)", "identity(n)"]


def test_preconditions(toy):
    by = {p.name: p for p in profile(toy)}
    assert not f0_preconditions(Feature.of("log1p", "c"), by).passed and not f0_preconditions(Feature.of("log1p", "zz"), by).passed
    assert not f0_preconditions(Feature("sum", ("a",)), by).passed and f0_preconditions(Feature.of("sum", "a", "b"), by).passed


def test_models(toy):
    assert models.route("binary", 100, 5)[0] in ("logistic", "boosting") and not models.fits("svm", "regression")
    with pytest.raises(NotImplementedError):
        models.fits("knn", "binary")
    folded = toy.withColumn("fold", F.col("i") % 3)
    assert len(models.cross_validate(folded, ["a", "b"], "y", "regression", "ridge", "fold")) == 3
    peak = lambda p, budget: -((p["x"] - 3) ** 2)
    for search in (models.random_search, models.tpe_search, models.successive_halving, models.hyperband):
        assert search({"x": list(range(7))}, peak)[1] >= -4
    w = models.stack(toy.withColumn("p", F.col("y") + 0.0).withColumn("q", F.col("junk")), ["p", "q"], "y")
    assert w[1] == pytest.approx(1, abs=0.05) and abs(w[2]) < 0.05
    assert models.ensemble_weights([0.9, 0.1], True)[0] > 0.9 and models.ensemble_weights([0.1, 0.9], False)[0] > 0.8
    assert models.diversity(toy, ["a", "junk"]) > 0.8 and models.baselines(toy, "y", "regression")["mean_rmse"] > 0


def test_reports(orders, spark, sf):
    r = report.build_report(orders, "o_orderstatus", "o_orderdate")
    assert r["roles"]["o_orderstatus"] == "target" and sum(n for *_, n in r["charts"]["o_totalprice"]["histogram"]) == orders.count()
    d = r["charts"]["o_totalprice"]["kde"]
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(d, d[1:], strict=False)) == pytest.approx(1, abs=0.02)
    flat = spark.createDataFrame([(1.0,)] * 3, "x double")
    assert report.histogram(flat, "x").collect()[0].n == 3 and report.kde(flat, "x") == [] and report.histogram(flat.where("false"), "x").count() == 0
    wave = spark.range(70).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.sin(F.col("id") * 2 * math.pi / 7).alias("v"))
    s = report.seasonality(wave)
    assert max(s, key=s.get) in (7, 14, 21) and s[7] > 0.99 and report.autocorrelation(wave)[6] > 0.8


def test_reports_take_all_columns_and_exact_quantiles(spark):
    wide = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(25)])
    assert report.correlations(wide, wide.columns).count() == 300 and report.correlations(wide, wide.columns, 3).count() == 3
    r = np.random.default_rng(1).normal(size=501)
    df = spark.createDataFrame([(float(x),) for x in r] + [(None,)], "x double")
    assert report.quantiles(df, "x", [0.1, 0.25, 0.5, 0.9]) == pytest.approx(np.quantile(r, [0.1, 0.25, 0.5, 0.9]))
    assert report.outliers(df.where("x IS NULL"), "x") == {} and models.baselines(df.where("x IS NULL"), "x", "regression")["mean"] is None


def test_fingerprints_see_maps(spark):
    one = spark.sql("SELECT 1 AS i, map('a', 1, 'b', 2) AS m, array(map('x', 1)) AS n")
    again, other = spark.sql("SELECT 1 AS i, map('b', 2, 'a', 1) AS m, array(map('x', 1)) AS n"), spark.sql("SELECT 1 AS i, map('a', 1, 'b', 3) AS m, array(map('x', 1)) AS n")
    assert fingerprint(one) == fingerprint(again) != fingerprint(other)
    assert fingerprint(one) != fingerprint(spark.sql("SELECT 1 AS i, map('a', 1, 'b', 2) AS m, array(map('x', 2)) AS n"))


def test_all_workbooks_are_read(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.xlsx").write_bytes(f"a,b\n{i},x{i}\n".encode() if i else b"a\n0\n")
    got = readers._union_workbooks(spark, str(tmp_path), lambda raw: pd.read_csv(io.BytesIO(raw)))
    assert sorted(map(tuple, got.collect()), key=str) == [(0, None), (1, "x1"), (2, "x2")]
    (tmp_path / "none").mkdir()
    with pytest.raises(SourceError, match="no files"):
        readers._union_workbooks(spark, str(tmp_path / "none"), None)


def test_small_files_are_spread_over_the_cores(spark):
    n = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == n and spread(spark.range(10, numPartitions=n + 3)).rdd.getNumPartitions() == n + 3


def test_export_passes_eleven_gates(orders, tmp_path):
    p = FeaturePipeline(FEATURES, ["o_orderkey"]).fit(orders)
    gates = codegen.verify(p, orders, str(tmp_path / "export"))
    assert len(gates) == 11 and all(g.passed for g in gates), gates
    module = codegen.emit(p, "x").replace("'log1p'", "'sqrt'")
    broken = {g.name: g.passed for g in codegen.verify(p, orders, str(tmp_path / "export2"), module)}
    assert not broken["feature_parity"]
    with pytest.raises(ValueError, match="changed"):
        codegen.from_ir(codegen.to_ir(p).replace("log1p", "sqrt"))


def test_experience(spark, tmp_path):
    store = experience.ExperienceStore(spark, str(tmp_path / "cases"))
    near = {"log_rows": 6.0, "numeric": 0.5}
    store.write([experience.Case("binary", near, "numeric", "log1p", 0.1, True, identity=f"a{i}", tags=["too_strict:f3"]) for i in range(6)] + [experience.Case("binary", near, "text", "tfidf", -0.1, False, identity=f"b{i}") for i in range(6)])
    store.write([experience.Case("binary", near, "numeric", "log1p", 0.2, True, identity="a0"), experience.Case("binary", {"log_rows": 20.0}, "text", "x", 1, True, identity="far")])
    assert store.cases().count() == 13
    priors = {r.family: r for r in experience.retrieve(store.cases(), "binary", near).collect()}
    assert priors["numeric"].posterior == pytest.approx(7 / 8) and priors["text"].posterior == pytest.approx(1 / 8)
    assert experience.propose_from_experience(experience.retrieve(store.cases(), "binary", near)) == ["numeric"]
    assert experience.tune(store.cases(), {"f3": 1.0, "f4": 1.0}) == {"f3": 0.9, "f4": 1.0}


# ---- sources -----------------------------------------------------------------------------------------------------------


def test_csv_dialects(spark, tmp_path):
    def read(name, raw):
        at = tmp_path / name
        at.write_bytes(raw)
        return read_csv(spark, str(at))

    df = read("a.csv", b"a,a,b\n1,2,x\n3,4,\"q, \"\"w\"\"\"\n")
    assert df.columns == ["a", "a_1", "b"] and df.collect()[1].b == 'q, "w"'
    assert [tuple(r) for r in read("b.csv", "n;v\nä;1\nö;2\n".encode("latin-1")).collect()] == [("ä", "1"), ("ö", "2")]
    assert read("c.tsv", b"x\ty\n1\t2\n").columns == ["x", "y"] and read("d.txt", b"1|2\n3|4\n").columns == ["c0", "c1"]
    assert read("e.csv", b"\xef\xbb\xbfid,v\n1,2\n").columns == ["id", "v"]
    body = "id,v\n" + "".join(f"{i},{i}\n" for i in range(100))
    assert read("f.csv", (body + "bad\n").encode()).count() == 100
    with pytest.raises(SourceError, match="malformed"):
        read("g.csv", b"id,v\n1,2\n3,4\n5\n6\n")
    with pytest.raises(SourceError):
        read("h.csv", b"")
    assert sniff(b"a,b\n1,2\n").header


def test_files_and_frames(spark, tmp_path):
    frame = pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", None]})
    pa.feather.write_feather(frame, str(tmp_path / "t.feather"), compression="uncompressed")
    assert sorted(r.a for r in open_source(spark, str(tmp_path / "t.feather")).collect()) == [1, 2, 3]
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1}, {"a": 2, "b": "x"}]))
    assert open_source(spark, str(tmp_path / "t.json")).count() == 2
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nnot json\n{"a": ' + "[" * 100 + "]" * 100 + "}\n")
    assert open_source(spark, str(tmp_path / "t.jsonl")).where("a IS NOT NULL").count() >= 1
    spark.createDataFrame(frame).write.parquet(str(tmp_path / "t.parquet"))
    assert open_source(spark, str(tmp_path / "t.parquet")).count() == 3 and open_source(spark, frame).count() == 3
    assert open_source(spark, "SELECT 1 AS one").first().one == 1
    with sqlite3.connect(tmp_path / "e.db") as db:
        db.execute("CREATE TABLE emp (id INTEGER, name TEXT)")
        db.execute("INSERT INTO emp VALUES (1, 'a')")
    assert open_source(spark, str(tmp_path / "e.db")).first().name == "a"
    with sqlite3.connect(tmp_path / "e.db") as db:
        db.execute("CREATE TABLE more (x INTEGER)")
    with pytest.raises(SourceError, match="emp"):
        read_sqlite(spark, str(tmp_path / "e.db"))


def test_api_pages_and_guard(spark):
    pages = {"0": [{"id": 1, "v": "a"}, {"id": 2}], "2": [{"id": 3}], "4": []}

    def fetch(url, body):
        from urllib.parse import parse_qs, urlsplit

        return json.dumps({"data": {"items": pages[parse_qs(urlsplit(url).query)["offset"][0]]}}).encode()

    got = read_api(spark, "https://example.org/x", "data.items", page_param="offset", page_size=2, fetch=fetch)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    with pytest.raises(SourceError, match="HTML"):
        read_api(spark, "https://example.org", fetch=lambda u, b: b"<html>")
    for url in ("http://127.0.0.1/", "http://localhost/x", "file:///etc/passwd", "http://169.254.169.254/latest"):
        with pytest.raises(SourceError):
            assert_public(url)


def test_each_order_gets_a_leaf_from_other_folds(spark, tmp_path):
    rows = [(k, float(k * 37 % 101), "FOP"[k % 3], None, "1-URGENT") for k in range(1, 201)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_totalprice double, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.k: r.leaf for r in plan_queries.crossfit_tree_leaf(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(1, 201)) and None not in got.values()


def test_api_schema_of_all_records_and_page_limit(spark):
    from urllib.parse import parse_qs, urlsplit

    rows = [{"id": i, "v": i} for i in range(300)] + [{"id": 300, "v": 0.5, "late": "x"}, {"id": 301, "v": 2}]
    got = read_api(spark, "https://example.org/x", fetch=lambda u, b: json.dumps(rows).encode())
    assert {r.id: (r.v, r.late) for r in got.where("id >= 299").collect()} == {299: (299.0, None), 300: (0.5, "x"), 301: (2.0, None)}
    offset = lambda u, b: json.dumps(rows[int(parse_qs(urlsplit(u).query)["offset"][0]) :][:100]).encode()
    assert read_api(spark, "https://example.org/x", page_param="offset", max_pages=4, fetch=offset).count() == 302
    with pytest.raises(SourceError, match="more than 3 pages"):
        read_api(spark, "https://example.org/x", page_param="offset", max_pages=3, fetch=offset)


# ---- streams -----------------------------------------------------------------------------------------------------------


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a" if i % 3 else "b", f"2024-01-01 {i // 6:02}:{10 * (i % 6):02}:00", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, s string, v double").select("k", F.to_timestamp("s").alias("t"), "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed(stream, "t", ["k"], "v").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert codegen.differing_rows(spark.table("windows"), windowed(df, "t", ["k"], "v"), ["start", "k", "n", "total"]) == 0
    query = ewma_stream(stream, "k", "t", "v").writeStream.format("memory").queryName("averages").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    want = get("ewma").apply(df, F.col("v"), ["k"], ["t"], "ewma")
    assert codegen.differing_rows(spark.table("averages"), want, ["k", "t", "ewma"], 6) == 0
