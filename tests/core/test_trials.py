"""Trials, ensembles, the trial cache, and the learned parts of experience."""

import math

import pytest

from tabloom.plans import experience
from tabloom.plans.trials import Trial, TrialCache, at_fidelity, build_ensemble, eligible, fidelity_ladder, score_diversity, utility


def test_rungs_hold_those_below(spark):
    assert fidelity_ladder(0) == fidelity_ladder(10_000) == (1.0,)
    assert fidelity_ladder(10_001)[0] == 0.16 and fidelity_ladder(100_001)[0] == 0.05
    df = spark.range(20_000)
    rungs = [{r.id for r in at_fidelity(df, ["id"], s).collect()} for s in fidelity_ladder(200_000)]
    assert all(a < b for a, b in zip(rungs, rungs[1:], strict=False)) and len(rungs[-1]) == 20_000
    assert abs(len(rungs[1]) / 20_000 - 0.16) < 0.02


def test_utility_takes_penalties_off():
    assert utility(0.8) == 0.8
    assert utility(0.8, spread=0.1, gap=0.05, seconds=1, megabytes=2) == pytest.approx(0.8 - 0.05 - 0.05 - 0.1 - 0.1)


def test_ensembles():
    a, b, c = Trial("a", "rmse", (1.0, 1.2), seconds=2), Trial("b", "rmse", (2.0, 2.2), seconds=3), Trial("c", "roc_auc", (0.9,))
    failed, bare = Trial("f", "rmse", (1.0,), completed=False), Trial("n", "rmse", ())
    assert eligible([failed, bare, a, c, b]) == [a, b]
    assert eligible([]) == [] and build_ensemble([]) is None and build_ensemble([a]) is None
    made = build_ensemble([b, a, c])
    assert made.members == ("a", "b") and made.weights[0] > made.weights[1] >= 0.05 and math.isclose(sum(made.weights), 1) and made.seconds == 5
    assert build_ensemble([a, Trial("a2", "rmse", (1.1, 1.1))]) is None  # alike
    assert build_ensemble([a, b, Trial("o", "rmse", (1.5,), train_score=1.0)]) is None  # overfitted
    assert score_diversity([a]) == 0.0 and score_diversity([Trial("z", "r2", (0.0,)), Trial("y", "r2", (0.0,))]) == 0.0
    many = build_ensemble([Trial(str(i), "rmse", (1.0 + i,)) for i in range(30)], most=25)
    assert len(many.members) == 25 and many.members[0] == "0" and math.isclose(sum(many.weights), 1)


def test_cache_forgets_the_least_recently_used():
    cache, t = TrialCache(2), Trial("a", "rmse", (1.0,))
    cache.put("ridge", {"x": 1}, ["b", "a"], t)
    assert cache.get("ridge", {"x": 1}, ["a", "b"]) is t and cache.get("ridge", {"x": 2}, ["a"]) is None
    cache.put("tree", {}, [], t)
    cache.get("ridge", {"x": 1}, ["a", "b"])
    cache.put("svm", {}, [], t)
    cache.put("knn", {}, [], Trial("f", "rmse", (1.0,), completed=False))
    assert len(cache) == 2 and cache.get("tree", {}, []) is None and cache.get("ridge", {"x": 1}, ["a", "b"]) is t
    assert cache.hit_rate == pytest.approx(3 / 5)


def test_cases_of_other_widths_are_far(spark, tmp_path):
    store = experience.ExperienceStore(spark, str(tmp_path / "cases"))
    at = lambda columns: {"log_rows": 5.0, "log_columns": math.log(columns)}
    store.write([experience.Case("binary", at(10), "numeric", "log1p", 0.1, True), experience.Case("binary", at(60), "text", "x", 0.1, True), experience.Case("binary", {"log_rows": 5.0}, "group", "y", 0.1, True)])
    assert {r.family for r in experience.retrieve(store.cases(), "binary", at(10)).collect()} == {"numeric", "group"}
    ranker = experience.Ranker()
    for i in range(40):  # of two meta-features one tells
        ranker.update({"numeric": 1.0, "skew": 1.0}, {"numeric": (i % 5) / 5, "skew": (i % 3) / 3}, 2 * (i % 5) / 5 + 0.5)
    assert ranker.active and not experience.Ranker().active
    bias, *slopes = ranker.weights()
    told = dict(zip(experience.WEIGHTS, slopes, strict=True))
    assert bias == pytest.approx(0.5, abs=0.01) and told["numeric"] == pytest.approx(2, abs=0.01) and told["skew"] == pytest.approx(0, abs=0.01)
    assert all(r[0] == pytest.approx(0.5, abs=0.01) for r in store.cases().select(ranker.score({"numeric": 1.0})).collect())


def test_costs_and_gains():
    cost = experience.CostModel()
    assert cost.predict(1000, 10) == pytest.approx(0.1 + 0.1 + 0.5 + 0.1)
    for rows, features in ((1000, 5), (5000, 10), (9000, 3), (20_000, 8), (50_000, 2), (100_000, 20)):
        cost.observe(rows, features, "n" if features > 4 else "n log n", 2e-5 * rows + 0.3 * features + 1)
    assert cost.predict(70_000, 10) == pytest.approx(2e-5 * 70_000 + 3 + 1, rel=1e-6)
    assert experience.expected_gain("numeric", 1.0, 10, 1) == 0
    assert experience.expected_gain("numeric", 0.1, 10, 1) > experience.expected_gain("numeric", 0.1, 2000, 1) > experience.expected_gain("cluster", 0.1, 2000, 1)
    assert 0 < experience.expected_gain("unheard of", 0.0, 0.0, 100) < 0.1
