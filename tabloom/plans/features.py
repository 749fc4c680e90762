"""Feature pipelines: proposals are compiled into one projection, one window stage for each entity, and joins with fitted
state tables. States can be saved and loaded."""

from __future__ import annotations

import hashlib
import json
import pickle
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import cat, dt, num, txt
from ..operators import Operator, get
from ..operators.numeric import DOMAIN_CHECKS
from ..operators.temporal import seconds


@dataclass(frozen=True)
class Feature:
    """One operator over columns: ``inputs`` are column names, in the operator's order (commutative ones are sorted)."""

    op: str
    inputs: tuple[str, ...]
    params: tuple[tuple[str, Any], ...] = ()
    entity: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    source: str = "user"
    reason: str = ""

    @staticmethod
    def of(op: str, *inputs: str, entity: tuple[str, ...] = (), order: tuple[str, ...] = (), source: str = "user", reason: str = "", **params: Any) -> Feature:
        ordered = tuple(sorted(inputs)) if get(op).commutative else inputs
        return Feature(op, ordered, tuple(sorted(params.items())), entity, order, source, reason)

    @property
    def options(self) -> dict[str, Any]:
        return {**get(self.op).defaults, **dict(self.params)}

    @property
    def name(self) -> str:
        """op(in_in)[k=v,...]"""
        shown = f"[{','.join(f'{k}={v}' for k, v in self.params)}]" if self.params else ""
        return f"{self.op}({'_'.join(self.inputs)}){shown}"

    @property
    def identity(self) -> str:
        text = json.dumps([self.op, self.inputs, self.params, self.entity, self.order], sort_keys=True, default=str)
        return f"f_{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def fold_identity(feature: Feature, literals: dict[str, float]) -> Feature:
    """x + 0 and x * 1 are x; with two such literals, or anything else, the feature stays."""
    neutral = {"sum": 0.0, "product": 1.0}.get(feature.op)
    if neutral is None or len(feature.inputs) != 2:
        return feature
    kept = [i for i in feature.inputs if literals.get(i) != neutral]
    return Feature("identity", tuple(kept), (), (), (), feature.source, feature.reason) if len(kept) == 1 else feature


def clean(op: Operator, position: int, name: str, kind: str) -> Column:
    """The input column as the operator's declared type wants it."""
    wanted = op.inputs[min(position, len(op.inputs) - 1)]
    if wanted == "any":
        return num(name) if kind in ("double", "float") else F.col(name)
    if wanted == "datetime":
        return dt(name, kind)
    if wanted in ("categorical", "entity_key"):
        return cat(name)
    return txt(name) if wanted == "free_text" else num(name)


class FeaturePipeline:
    """fit learns the states of fitted features, transform adds one column for each feature."""

    def __init__(self, features: list[Feature], keep: list[str] | None = None) -> None:
        self.features = list({f.identity: f for f in features}.values())
        self.keep = keep
        self.states: dict[str, Any] = {}

    def fit(self, train: DataFrame) -> FeaturePipeline:
        for f in self.features:
            op = get(f.op)
            if op.shape == "fitted":
                self.states[f.identity] = op.fit(train, list(f.inputs), f.options)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        keep = self.keep if self.keep is not None else df.columns
        columns: list[Column] = []
        for f in self.features:
            op = get(f.op)
            if op.shape in ("scalar", "window"):
                inputs = [clean(op, i, c, kinds[c]) for i, c in enumerate(f.inputs)]
                if op.shape == "window":
                    w = Window.partitionBy(*f.entity).orderBy(*f.order)
                    x = seconds(inputs[0]) if op.inputs == ("datetime",) else inputs[0]
                    columns.append(op.build(x, w, **f.options).alias(f.name))
                else:
                    columns.append(op.build(*inputs, **f.options).alias(f.name))
        out = df.select("*", *columns)  # one projection: the optimizer shares what features have in common
        for f in self.features:
            op = get(f.op)
            if op.shape == "fitted":
                out = op.apply(out, list(f.inputs), f.options, self.states[f.identity], f.name)
            elif op.shape == "stream":
                out = op.apply(out, num(f.inputs[0]), list(f.entity), list(f.order), f.name, **f.options)
        return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{f.name}`") for f in self.features])

    def save(self, path: str, spark: SparkSession) -> None:
        """Tables as Parquet, small states as one pickled row; ``path`` may be in any store Spark writes to."""
        small = {k: v for k, v in self.states.items() if not isinstance(v, DataFrame) and not _holds_table(v) and not isinstance(v, Model)}
        for k, v in self.states.items():
            if isinstance(v, DataFrame):
                v.write.mode("overwrite").parquet(f"{path}/table={k}")
            elif isinstance(v, Model):
                v.write().overwrite().save(f"{path}/model={k}")
            elif _holds_table(v):
                v[2].write.mode("overwrite").parquet(f"{path}/binned={k}")
        rest = {k: v[:2] for k, v in self.states.items() if _holds_table(v)}
        blob = pickle.dumps({"features": self.features, "keep": self.keep, "small": small, "rest": rest, "tables": [k for k, v in self.states.items() if isinstance(v, DataFrame)], "models": {k: f"{type(v).__module__}:{type(v).__name__}" for k, v in self.states.items() if isinstance(v, Model)}})
        spark.createDataFrame([(blob,)], "state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/pipeline")

    @staticmethod
    def load(path: str, spark: SparkSession) -> FeaturePipeline:
        """Only load what you saved yourself: the state row is a pickle."""
        import importlib

        d = pickle.loads(bytes(spark.read.parquet(f"{path}/pipeline").first()[0]))
        out = FeaturePipeline(d["features"], d["keep"])
        out.states = dict(d["small"])
        for k in d["tables"]:
            out.states[k] = spark.read.parquet(f"{path}/table={k}")
        for k, v in d["rest"].items():
            out.states[k] = (*v, spark.read.parquet(f"{path}/binned={k}"))
        for k, name in d["models"].items():
            module, cls = name.split(":")
            out.states[k] = getattr(importlib.import_module(module), cls).load(f"{path}/model={k}")
        return out


def _holds_table(state: Any) -> bool:
    return isinstance(state, tuple) and len(state) == 3 and isinstance(state[2], DataFrame)


class FeatureEstimator(Estimator):
    """The pipeline as a pyspark.ml stage."""

    def __init__(self, features: list[Feature]) -> None:
        super().__init__()
        self.features = features

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        return FeatureModel(FeaturePipeline(self.features).fit(dataset))


class FeatureModel(Model):
    def __init__(self, pipeline: FeaturePipeline) -> None:
        super().__init__()
        self.pipeline = pipeline

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.pipeline.transform(dataset)

    def getOutputCols(self) -> list[str]:
        return [f.name for f in self.pipeline.features]


def check_domains(df: DataFrame, features: list[Feature]) -> dict[str, float]:
    """{feature name: bad share} of the features that a static domain check rejects; one aggregation for all of them."""
    checked = [f for f in features if f.op in DOMAIN_CHECKS]
    if not checked:
        return {}
    aggregates = [F.avg(F.coalesce(DOMAIN_CHECKS[f.op][0](*[num(c) for c in f.inputs]), F.lit(False)).cast("double")) for f in checked]
    shares = df.agg(*aggregates).first()
    return {f.name: s for f, s in zip(checked, shares, strict=True) if s is not None and s > DOMAIN_CHECKS[f.op][1]}


@dataclass
class FeatureGraph:
    """A directed acyclic graph of features over raw columns and other features; equal nodes are one."""

    nodes: dict[str, tuple[Feature, tuple[str, ...]]] = field(default_factory=dict)

    def add(self, feature: Feature, parents: tuple[str, ...] = ()) -> str:
        for p in parents:
            if p not in self.nodes:
                raise KeyError(f"no node {p}")
        node = feature.identity if not parents else f"f_{hashlib.sha256((feature.identity + ','.join(parents)).encode()).hexdigest()[:16]}"
        self.nodes.setdefault(node, (feature, parents))
        return node

    def order(self) -> list[str]:
        """Parents before children, ties by name; a cycle is an error."""
        done: list[str] = []
        left = dict(self.nodes)
        while left:
            ready = sorted(n for n, (_, ps) in left.items() if all(p not in left for p in ps))
            if not ready:
                raise ValueError("the feature graph has a cycle")
            for n in ready:
                del left[n]
            done += ready
        return done
