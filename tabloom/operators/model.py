"""Dimensionality, cluster and model-informed operators. States are matrices of columns x components or trees."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import num, txt
from ..functions.order import correlation
from .registry import Operator, register
from .text import tokens


def gram(df: DataFrame, xs: list[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, X'X) in one aggregation of p (p + 3) / 2 sums; only these numbers reach the driver."""
    p = len(xs)
    cols = [F.coalesce(x, F.lit(0.0)).alias(f"_{i}") for i, x in enumerate(xs)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.select(*cols).agg(F.count("*"), *[F.sum(f"_{i}") for i in range(p)], *[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i, j in pairs]).first()
    n, sums = row[0], np.array([v or 0.0 for v in row[1 : p + 1]])
    g = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[p + 1 :], strict=True):
        g[i, j] = g[j, i] = v or 0.0
    return n, sums, g


def _vectors(g: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors, the largest entry of each positive."""
    _, v = np.linalg.eigh(g)
    v = v[:, ::-1][:, :k]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def _project(xs: list[Column], mean: np.ndarray, v: np.ndarray) -> Column:
    parts = []
    for k in range(v.shape[1]):
        total = F.lit(0.0)
        for x, m, w in zip(xs, mean, v[:, k], strict=True):
            total = total + (F.coalesce(x, F.lit(0.0)) - float(m)) * float(w)
        parts.append(total)
    return F.array(*parts).cast("array<double>")


def _fit_pca(df: DataFrame, columns: list[str], params: dict) -> tuple[np.ndarray, np.ndarray]:
    n, sums, g = gram(df, [num(c) for c in columns])
    k = max(1, min(params.get("n_components", 2), len(columns), max(1, n - 1)))
    mean = sums / max(1, n)
    return mean, _vectors(g - n * np.outer(mean, mean), k)


def _fit_svd(df: DataFrame, columns: list[str], params: dict) -> tuple[np.ndarray, np.ndarray]:
    _, _, g = gram(df, [num(c) for c in columns])
    return np.zeros(len(columns)), _vectors(g, min(params.get("n_components", 2), len(columns)))


def _apply_projection(df: DataFrame, columns: list[str], params: dict, state, out: str) -> DataFrame:
    return df.withColumn(out, _project([num(c) for c in columns], *state))


def _fit_text_svd(df: DataFrame, columns: list[str], params: dict) -> tuple[list[str], np.ndarray]:
    """Vocabulary by document frequency; the matrix of co-occurring tokens is the Gram matrix of token presence."""
    docs = df.select(F.array_distinct(tokens(txt(columns[0]))).alias("w")).where("w IS NOT NULL")
    top = docs.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(params.get("max_features", 50))
    vocabulary = [r[0] for r in top.collect()]
    if not vocabulary:
        return [], np.zeros((0, 0))
    present = [F.array_contains("w", v).cast("double") for v in vocabulary]
    _, _, g = gram(docs, present)
    return vocabulary, _vectors(g, min(params.get("n_components", 2), len(vocabulary)))


def _apply_text_svd(df: DataFrame, columns: list[str], params: dict, state, out: str) -> DataFrame:
    vocabulary, v = state
    base = df.withColumn("_w", F.coalesce(tokens(txt(columns[0])), F.array().cast("array<string>")))
    counts = [(F.size("_w") - F.size(F.array_remove("_w", w))).cast("double") for w in vocabulary]
    return base.withColumn(out, _project(counts, np.zeros(len(vocabulary)), v) if vocabulary else F.array().cast("array<double>")).drop("_w")


def _assembled(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    filled = df.select(*(keep if keep is not None else df.columns), *[F.coalesce(num(c), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(columns)])
    return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(columns))], outputCol="_features").transform(filled)


def _fit_kmeans(df: DataFrame, columns: list[str], params: dict) -> np.ndarray:
    """Centres in lexicographic order, so that labels do not depend on the start."""
    rows = _assembled(df, columns, [])
    k = max(2, min(params.get("n_clusters", 3), rows.count(), max(2, len(columns))))
    model = KMeans(k=k, seed=42, featuresCol="_features").fit(rows)
    centres = np.array(model.clusterCenters())
    return centres[np.lexsort(centres.T[::-1])]


def _distances(columns: list[str], centres: np.ndarray) -> list[Column]:
    xs = [F.coalesce(num(c), F.lit(0.0)) for c in columns]
    out = []
    for centre in centres:
        total = F.lit(0.0)
        for x, c in zip(xs, centre, strict=True):
            total = total + (x - float(c)) * (x - float(c))
        out.append(F.sqrt(total))
    return out


def _apply_kmeans_label(df: DataFrame, columns: list[str], params: dict, state: np.ndarray, out: str) -> DataFrame:
    d = F.array(*_distances(columns, state))
    return df.withColumn(out, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def _apply_kmeans_distances(df: DataFrame, columns: list[str], params: dict, state: np.ndarray, out: str) -> DataFrame:
    return df.withColumn(out, F.array(*_distances(columns, state)))


def _fit_tree(df: DataFrame, columns: list[str], params: dict):
    """columns: features, then the target. A target of two values is classified, any other one is regressed."""
    y = num(columns[-1])
    rows = _assembled(df.where(y.isNotNull()).withColumn("_y", y), columns[:-1], ["_y"])
    few = rows.select("_y").distinct().limit(3).count() <= 2
    kind = DecisionTreeClassifier if few else DecisionTreeRegressor
    if few:
        values = sorted(r[0] for r in rows.select("_y").distinct().collect())
        rows = rows.withColumn("_y", (F.col("_y") == values[-1]).cast("double"))
    return kind(maxDepth=params.get("max_depth", 4), leafCol="_leaf", featuresCol="_features", labelCol="_y", predictionCol="_p", seed=42).fit(rows)


def _apply_tree(df: DataFrame, columns: list[str], params: dict, state, out: str) -> DataFrame:
    scored = state.transform(_assembled(df, columns[:-1]))
    return scored.select(*df.columns, F.col("_leaf").cast("int").alias(out))


def tree_leaf_by_fold(df: DataFrame, columns: list[str], fold: str, out: str, params: dict | None = None) -> DataFrame:
    """Leaf ids of trees that did not see the row's fold."""
    parts = None
    for (f,) in sorted(df.select(fold).distinct().collect()):
        model = _fit_tree(df.where(F.col(fold) != f), columns, params or {})
        part = _apply_tree(df.where(F.col(fold) == f), columns, params or {}, model, out)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def residual_interactions(df: DataFrame, columns: list[str], residual: str, top_k: int = 5, least: float = 0.01) -> DataFrame:
    """(column, score): |corr(x, |r|)| + |corr(x, r)| / 2 of all columns, in one aggregation."""
    r = num(residual)
    sums = df.agg(*[F.abs(correlation(num(c), F.abs(r))).alias(f"a{i}") for i, c in enumerate(columns)], *[F.abs(correlation(num(c), r)).alias(f"b{i}") for i, c in enumerate(columns)])
    score = lambda i: F.coalesce(f"a{i}", F.lit(0.0)) + 0.5 * F.coalesce(f"b{i}", F.lit(0.0))
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), score(i).alias("score")) for i, c in enumerate(columns)])))
    return rows.where(F.col("score") > least).orderBy(F.desc("score"), "column").limit(top_k)


_NUMBERS = ("continuous_numeric",)


def _register(name: str, family: str, fit, apply, inputs=_NUMBERS, output: str = "vector", leakage: str = "L1", **defaults) -> None:
    register(Operator(name, family, inputs, output, shape="fitted", fit=fit, apply=apply, defaults=defaults, leakage=leakage))


_register("pca", "dimensionality", _fit_pca, _apply_projection, n_components=2)
_register("truncated_svd", "dimensionality", _fit_svd, _apply_projection, n_components=2)
_register("text_svd", "dimensionality", _fit_text_svd, _apply_text_svd, ("free_text",), n_components=2, max_features=50)
_register("kmeans_label", "cluster", _fit_kmeans, _apply_kmeans_label, output="low_cardinality_categorical", n_clusters=3)
_register("kmeans_distances", "cluster", _fit_kmeans, _apply_kmeans_distances, n_clusters=3)
_register("tree_leaf_oof", "model_informed", _fit_tree, _apply_tree, ("continuous_numeric", "target"), "low_cardinality_categorical", "L2", max_depth=4)
register(Operator("residual_interaction_proposal", "model_informed", ("continuous_numeric", "target"), "proposal", shape="proposal", apply=residual_interactions, defaults={"top_k": 5}, leakage="L2"))
