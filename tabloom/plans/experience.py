"""Experience: cases of what was tried on which data, kept as Parquet, and retrieval of what helped on similar data."""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "identity string, task string, meta map<string,double>, family string, op string, gain double, accepted boolean, cost double, tags array<string>, at timestamp, id string"
#: fixed values: weights of the meta-features in the distance
WEIGHTS = {"log_rows": 1.0, "log_columns": 1.0, "missing": 1.0, "numeric": 1.0, "categorical": 1.0, "cardinality": 0.5, "skew": 0.5}
#: fixed values: a case is near if its data has at most so many times the rows and columns, or so many times fewer
BUCKETS = {"log_rows": 10.0, "log_columns": 5.0}


@dataclass
class Case:
    task: str
    meta: dict[str, float]
    family: str
    op: str
    gain: float
    accepted: bool
    cost: float = 0.0
    identity: str = ""
    tags: list[str] = field(default_factory=list)


class ExperienceStore:
    """Appends cases; of cases of one identity the latest counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, cases: list[Case]) -> None:
        now = datetime.now(timezone.utc)
        rows = [asdict(c) | {"gain": float(c.gain), "cost": float(c.cost), "meta": {k: float(v) for k, v in c.meta.items()}, "at": now, "id": uuid.uuid4().hex, "identity": c.identity or f"{c.task}:{c.op}:{sorted(c.meta.items())}"} for c in cases]
        names = [f.name for f in self.spark.createDataFrame([], SCHEMA).schema]
        self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA).write.mode("append").parquet(self.path)

    def cases(self) -> DataFrame:
        w = Window.partitionBy("identity").orderBy(F.desc("at"), "id")
        return self.spark.read.schema(SCHEMA).parquet(self.path).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distance(meta: dict[str, float]):
    """Weighted root mean square distance of a case's meta-features to ``meta``; features a case lacks are left out."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, w in WEIGHTS.items():
        if k in meta:
            v = F.try_element_at("meta", F.lit(k))
            total = total + F.coalesce(w * (v - meta[k]) * (v - meta[k]), F.lit(0.0))
            weight = weight + F.when(v.isNotNull(), w).otherwise(0.0)
    return F.sqrt(total / F.nullif(weight, F.lit(0.0)))


def retrieve(cases: DataFrame, task: str, meta: dict[str, float], k: int = 50) -> DataFrame:
    """(family, n, accepted, posterior, confidence, gain) from the k nearest cases of the task whose data is within ten
    times the rows and five times the columns; the posterior of acceptance has a uniform prior."""
    near = cases.where(F.col("task") == task)
    for name, times in BUCKETS.items():
        if name in meta:  # a case that does not tell stays
            away = F.abs(F.try_element_at("meta", F.lit(name)) - meta[name])
            near = near.where(F.coalesce(away <= math.log(times), F.lit(True)))
    near = near.withColumn("distance", distance(meta)).orderBy("distance", "id").limit(k)
    per = near.groupBy("family").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.avg("gain").alias("gain"))
    return per.select("family", "n", "accepted", ((F.col("accepted") + 1) / (F.col("n") + 2)).alias("posterior"), (F.col("n") / (F.col("n") + 10.0)).alias("confidence"), "gain")


def propose_from_experience(priors: DataFrame, least: float = 0.5, confidence: float = 0.1) -> list[str]:
    """Families worth proposing, the most promising first."""
    good = priors.where((F.col("posterior") >= least) & (F.col("confidence") >= confidence)).orderBy(F.desc("posterior"), "family")
    return [r[0] for r in good.select("family").collect()]  # one row a family


def tune(cases: DataFrame, thresholds: dict[str, float], share: float = 0.3, step: float = 0.1, bounds: tuple[float, float] = (0.5, 2.0)) -> dict[str, float]:
    """Thresholds whose failure tag (``too_strict:name`` or ``too_loose:name``) a share of the cases has move by one bounded step."""
    n = cases.count()
    tags = dict(cases.select(F.explode("tags").alias("t")).groupBy("t").count().collect()) if n else {}
    out = {}
    for name, value in thresholds.items():
        factor = 1.0
        if n and tags.get(f"too_strict:{name}", 0) / n >= share:
            factor -= step
        if n and tags.get(f"too_loose:{name}", 0) / n >= share:
            factor += step
        out[name] = value * min(max(factor, bounds[0]), bounds[1])
    return out


class Ranker:
    """Usefulness of a case as a linear function of the products of its meta-features with those asked for. Only sums of
    products are kept, so learning is exact and its order does not matter; it ranks once LEAST triples were seen."""

    LEAST, RIDGE = 20, 1e-3

    def __init__(self) -> None:
        k = len(WEIGHTS) + 1
        self.seen, self._xx, self._xy = 0, np.zeros((k, k)), np.zeros(k)

    @property
    def active(self) -> bool:
        return self.seen >= self.LEAST

    def update(self, asked: dict[str, float], case: dict[str, float], useful: float) -> None:
        x = np.array([1.0, *(asked.get(k, 0.0) * case.get(k, 0.0) for k in WEIGHTS)])
        self._xx += np.outer(x, x)
        self._xy += x * useful
        self.seen += 1

    def weights(self) -> list[float]:
        return np.linalg.solve(self._xx + self.RIDGE * np.eye(len(self._xy)), self._xy).tolist()

    def score(self, asked: dict[str, float]) -> Column:
        """The score of each case of a frame of cases."""
        bias, *slopes = self.weights()
        out = F.lit(bias)
        for k, w in zip(WEIGHTS, slopes, strict=True):
            if k in asked:
                out = out + F.coalesce(w * asked[k] * F.try_element_at("meta", F.lit(k)), F.lit(0.0))
        return out


#: fixed values: seconds for a row, a feature, a unit of an operator's complexity, and of any step
COST = (0.0001, 0.01, 0.5, 0.1)
#: fixed values: units of complexity by how an operator's work grows
COMPLEXITY = {"n": 1.0, "n*k": 2.0, "nnz*k": 3.0, "n log n": 4.0, "nkp": 5.0, "n*window": 8.0}


class CostModel:
    """Seconds of a step from rows, features and complexity: COST at first, from five observations on the least squares
    that stay nearest to it."""

    def __init__(self) -> None:
        self.observed: list[tuple[float, ...]] = []

    def observe(self, rows: int, features: int, growth: str, seconds: float) -> None:
        self.observed.append((rows, features, COMPLEXITY[growth], 1.0, seconds))

    def predict(self, rows: int, features: int, growth: str = "n") -> float:
        w = np.array(COST)
        if len(self.observed) >= 5:
            seen = np.array(self.observed)
            x, y = seen[:, :4], seen[:, 4]
            scale = np.maximum(np.abs(x).max(axis=0), 1e-12)  # rows are millions, features tens
            moved = np.linalg.lstsq(x / scale, y - x @ w, rcond=None)[0]
            w = w + moved / scale
        return max(0.0, float(np.array([rows, features, COMPLEXITY[growth], 1.0]) @ w))


#: fixed values: what features of a family are expected to gain before any was tried; others 0.1
FAMILY_GAIN = {
    "numeric": 0.3, "numeric interaction": 0.25, "categorical": 0.2, "datetime": 0.15, "temporal": 0.2, "group aggregate": 0.15, "text": 0.1,
    "text representation": 0.1, "dimensionality": 0.05, "cluster": 0.05, "model-informed": 0.1,
}


def expected_gain(family: str, null_fraction: float, variance: float, inputs: int) -> float:
    """A prior between 0 and 1: less for nulls, for variances far below 10 or far above, and for many inputs."""
    spread = min(1.0, variance / 10) * (1 - min(1.0, variance / 1000))
    few = 1 / (1 + math.log1p(inputs) / 10)
    return FAMILY_GAIN.get(family, 0.1) * (1 - null_fraction) * (0.5 + 0.5 * spread) * (0.7 + 0.3 * few)
