"""Model families of pyspark.ml, comparison on a holdout or by folds, searches, ensembles and baselines."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import correlation
from .report import quantiles
from .selection import as_number

#: family -> (tasks, maker); what Spark has no estimator for is named in UNSUPPORTED
FAMILIES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "logistic": (("binary", "multiclass"), lambda **p: C.LogisticRegression(**{"maxIter": 50, "regParam": 1e-3} | p)),
    "ridge": (("regression", "forecasting"), lambda **p: R.LinearRegression(**{"regParam": 1e-3, "elasticNetParam": 0.0} | p)),
    "lasso": (("regression", "forecasting"), lambda **p: R.LinearRegression(**{"regParam": 1e-2, "elasticNetParam": 1.0} | p)),
    "elastic_net": (("regression", "forecasting"), lambda **p: R.LinearRegression(**{"regParam": 1e-2, "elasticNetParam": 0.5} | p)),
    "tree": (("binary", "multiclass"), lambda **p: C.DecisionTreeClassifier(**{"maxDepth": 5, "seed": 42} | p)),
    "tree_regression": (("regression", "forecasting"), lambda **p: R.DecisionTreeRegressor(**{"maxDepth": 5, "seed": 42} | p)),
    "forest": (("binary", "multiclass"), lambda **p: C.RandomForestClassifier(**{"numTrees": 30, "seed": 42} | p)),
    "forest_regression": (("regression", "forecasting"), lambda **p: R.RandomForestRegressor(**{"numTrees": 30, "seed": 42} | p)),
    "boosting": (("binary",), lambda **p: C.GBTClassifier(**{"maxIter": 20, "seed": 42} | p)),
    "boosting_regression": (("regression", "forecasting"), lambda **p: R.GBTRegressor(**{"maxIter": 20, "seed": 42} | p)),
    "svm": (("binary",), lambda **p: C.LinearSVC(**{"maxIter": 50} | p)),
    "naive_bayes": (("binary", "multiclass"), lambda **p: C.NaiveBayes(**{"modelType": "gaussian"} | p)),
}
UNSUPPORTED = ("extra_trees", "adaboost", "bagging", "knn", "rbf_svm")
MAXIMISE = {"roc_auc": True, "accuracy": True, "macro_f1": True, "r2": True, "rmse": False, "mae": False, "log_loss": False, "brier": False, "mape": False, "mse": False}


def fits(family: str, task: str) -> bool:
    if family in UNSUPPORTED:
        raise NotImplementedError(f"{family} has no Spark estimator")
    return task in FAMILIES[family][0]


def route(task: str, rows: int, columns: int, categorical: bool = False) -> list[str]:
    """Families for a task, the most promising first."""
    score = {"boosting": 5, "boosting_regression": 5, "forest": 4, "forest_regression": 4, "logistic": 3, "ridge": 3, "elastic_net": 2, "lasso": 2, "tree": 2, "tree_regression": 2, "svm": 1, "naive_bayes": 1}
    boost = {f: 2 * (rows < 500 and f in ("logistic", "ridge")) + 2 * (columns > rows and f in ("lasso", "elastic_net", "ridge", "logistic")) + (categorical and f.startswith(("boosting", "forest", "tree"))) for f in score}
    return sorted((f for f in score if task in FAMILIES[f][0]), key=lambda f: (-(score[f] + boost[f]), f))


def is_better(a: float, b: float, metric: str) -> bool:
    return a > b if MAXIMISE[metric] else a < b


def primary_metric(task: str) -> str:
    return {"binary": "roc_auc", "multiclass": "accuracy"}.get(task, "rmse")


def assemble(df: DataFrame, names: list[str], label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    kinds = dict(df.dtypes)
    x = df.select(*[as_number(F.col(f"`{n}`"), kinds[n]).alias(f"_x{i}") for i, n in enumerate(names)], F.col(label).cast("double").alias("label"), *keep)
    return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(names))], outputCol="features").transform(x).select("features", "label", *keep)


def evaluate(scored: DataFrame, task: str, metric: str | None = None) -> float:
    metric = metric or primary_metric(task)
    if metric == "roc_auc":
        return BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)
    if task == "multiclass":
        return MulticlassClassificationEvaluator(metricName={"macro_f1": "f1", "log_loss": "logLoss"}.get(metric, metric)).evaluate(scored)
    return RegressionEvaluator(metricName=metric).evaluate(scored)


def compare(train: DataFrame, test: DataFrame, names: list[str], label: str, task: str, families: list[str], params: dict[str, dict] | None = None) -> dict[str, float]:
    """{family: score on test}; a family that cannot be fitted has no score."""
    a, b = assemble(train, names, label).cache(), assemble(test, names, label)
    try:
        return {f: evaluate(FAMILIES[f][1](**(params or {}).get(f, {})).fit(a).transform(b), task) for f in families}
    finally:
        a.unpersist()


def best_of(scores: dict[str, float], task: str) -> str | None:
    metric = primary_metric(task)
    return max(scores, key=lambda f: scores[f] if MAXIMISE[metric] else -scores[f], default=None)


def cross_validate(df: DataFrame, names: list[str], label: str, task: str, family: str, fold: str, **params) -> list[float]:
    """Score of each fold of a fold column."""
    x = assemble(df, names, label, (fold,)).cache()
    try:
        out = []
        for (k,) in sorted(x.select(fold).distinct().collect()):
            model = FAMILIES[family][1](**params).fit(x.where(F.col(fold) != k))
            out.append(evaluate(model.transform(x.where(F.col(fold) == k)), task))
        return out
    finally:
        x.unpersist()


# ---- searches: ``score(params, budget)`` is larger for better ---------------------------------------------------------


def random_search(space: dict[str, list], score: Callable[[dict, float], float], trials: int = 10, seed: int = 0) -> tuple[dict, float]:
    r = random.Random(seed)
    tried = [{k: r.choice(v) for k, v in space.items()} for _ in range(trials)]
    return max(((p, score(p, 1.0)) for p in tried), key=lambda t: t[1])


def tpe_search(space: dict[str, list], score: Callable[[dict, float], float], trials: int = 20, seed: int = 0, good: float = 0.25) -> tuple[dict, float]:
    """Tree-structured Parzen estimator over discrete choices: draw from what good trials share more than bad ones."""
    r = random.Random(seed)
    done: list[tuple[dict, float]] = []
    for i in range(trials):
        if i < max(4, trials // 4):
            p = {k: r.choice(v) for k, v in space.items()}
        else:
            ranked = sorted(done, key=lambda t: -t[1])
            cut = max(1, int(good * len(ranked)))
            p = {}
            for k, values in space.items():
                weight = lambda v, part, k=k, n=len(values): (sum(q[k] == v for q, _ in part) + 1) / (len(part) + n)
                p[k] = max(values, key=lambda v: weight(v, ranked[:cut]) / weight(v, ranked[cut:]) * r.uniform(0.8, 1.2))
        done.append((p, score(p, 1.0)))
    return max(done, key=lambda t: t[1])


def successive_halving(space: dict[str, list], score: Callable[[dict, float], float], trials: int = 9, rounds: int = 3, eta: int = 3, seed: int = 0) -> tuple[dict, float]:
    """The budget is the share of rows to train on; a round keeps the best 1 / eta."""
    r = random.Random(seed)
    left = [({k: r.choice(v) for k, v in space.items()}, 0.0) for _ in range(trials)]
    for i in range(rounds):
        budget = eta ** (i - rounds + 1)
        left = sorted(((p, score(p, budget)) for p, _ in left), key=lambda t: -t[1])[: max(1, len(left) // eta if i < rounds - 1 else 1)]
    return left[0]


def hyperband(space: dict[str, list], score: Callable[[dict, float], float], brackets: int = 3, eta: int = 3, seed: int = 0) -> tuple[dict, float]:
    """Halving with more and more starting budget, for fewer and fewer trials."""
    found = [successive_halving(space, score, eta**s * max(1, brackets // (s + 1)), s + 1, eta, seed + s) for s in range(brackets)]
    return max(found, key=lambda t: t[1])


# ---- ensembles: columns of out-of-fold predictions ---------------------------------------------------------------------


def ensemble_weights(scores: list[float], maximise: bool) -> list[float]:
    """Weights by score, in the metric's direction."""
    a = np.asarray(scores, float)
    raw = a - a.min() + 1e-9 if maximise else 1 / np.maximum(a, 1e-12)
    return (raw / raw.sum()).tolist()


def diversity(df: DataFrame, predictions: list[str]) -> float:
    """1 minus the mean absolute correlation of the prediction columns."""
    pairs = [(a, b) for i, a in enumerate(predictions) for b in predictions[i + 1 :]]
    if not pairs:
        return 0.0
    row = df.agg(*[F.abs(correlation(F.col(a), F.col(b))) for a, b in pairs]).first()
    return 1 - sum(v or 0.0 for v in row) / len(pairs)


def stack(df: DataFrame, predictions: list[str], label: str, ridge: float = 1.0) -> list[float]:
    """[bias, weights...] of a ridge meta-model on out-of-fold predictions: one aggregation, solved on the driver."""
    cols = [F.lit(1.0), *[F.col(p).cast("double") for p in predictions], F.col(label).cast("double")]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).first()
    g = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row, strict=True):
        g[i, j] = g[j, i] = v or 0.0
    penalty = ridge * np.eye(len(cols) - 1)
    penalty[0, 0] = 0
    return np.linalg.solve(g[:-1, :-1] + penalty, g[:-1, -1]).tolist()


def baselines(df: DataFrame, label: str, task: str) -> dict[str, float]:
    """Scores of constant predictions: the majority class, or the mean and the median."""
    y = F.col(label).cast("double")
    if task in ("binary", "multiclass"):
        n, most = df.where(y.isNotNull()).groupBy(y).count().agg(F.sum("count"), F.max("count")).first()
        shares = [r[0] / n for r in df.where(y.isNotNull()).groupBy(y).count().select("count").collect()]
        return {"majority_accuracy": most / n, "random_accuracy": sum(s * s for s in shares), "prior_log_loss": -sum(s * math.log(s) for s in shares)}
    mean, std = df.agg(F.avg(y), F.stddev_pop(y)).first()
    (median,) = quantiles(df, label, [0.5])
    if median is None:
        return {"mean_rmse": None, "median_mae": None, "mean": None}
    return {"mean_rmse": std, "median_mae": df.agg(F.avg(F.abs(y - F.lit(median)))).first()[0], "mean": mean}
