"""Export: pipelines as JSON, as a module of their own that uses this package, and the gates an export must pass."""

from __future__ import annotations

import ast
import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import all_operators, get
from .features import Feature, FeaturePipeline

VERSION = 1


def to_ir(pipeline: FeaturePipeline) -> str:
    """The features as JSON; the hash covers everything else."""
    body = {"version": VERSION, "keep": pipeline.keep, "nodes": [{"id": f.identity, "op": f.op, "inputs": f.inputs, "params": f.params, "entity": f.entity, "order": f.order, "fitted": get(f.op).shape == "fitted"} for f in pipeline.features]}
    body["hash"] = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    return json.dumps(body, indent=1)


def from_ir(text: str) -> FeaturePipeline:
    body = json.loads(text)
    given = body.pop("hash")
    if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() != given:
        raise ValueError("the pipeline was changed after it was hashed")
    features = [Feature(n["op"], tuple(n["inputs"]), tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in n["params"]), tuple(n["entity"]), tuple(n["order"])) for n in body["nodes"]]
    return FeaturePipeline(features, body["keep"])


def emit(pipeline: FeaturePipeline, state_path: str | None = None) -> str:
    """A module with ``transform(spark, df)``. It needs this package on the cluster, names every feature, and reads
    fitted states from ``state_path``."""
    lines = ['"""Generated feature pipeline."""', "", "from tabloom.plans.features import Feature, FeaturePipeline", "", "FEATURES = ["]
    for f in pipeline.features:
        lines.append(f"    Feature({f.op!r}, {f.inputs!r}, {f.params!r}, {f.entity!r}, {f.order!r}),")
    lines += ["]", f"KEEP = {pipeline.keep!r}", "", "", "def transform(spark, df):"]
    if any(get(f.op).shape == "fitted" for f in pipeline.features):
        lines += [f"    pipeline = FeaturePipeline.load({state_path!r}, spark)", "    assert [f.identity for f in pipeline.features] == [f.identity for f in FEATURES]"]
    else:
        lines += ["    pipeline = FeaturePipeline(FEATURES, KEEP)"]
    return "\n".join([*lines, "    return pipeline.transform(df)", ""])


@dataclass
class Gate:
    name: str
    passed: bool
    detail: str = ""


def differing_rows(a: DataFrame, b: DataFrame, names: list[str], digits: int = 9) -> int:
    """Rows that are in one and not in the other, doubles rounded."""
    def flat(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        one = lambda n: F.round(F.col(f"`{n}`"), digits) if kinds[n] in ("double", "float") else F.col(f"`{n}`").cast("string")
        return df.select(*[one(n).alias(f"_{i}") for i, n in enumerate(names)])

    x, y = flat(a), flat(b)
    return x.exceptAll(y).unionByName(y.exceptAll(x)).count()


def verify(pipeline: FeaturePipeline, df: DataFrame, state_path: str | None = None, module: str | None = None, budget_s: float = 600.0) -> list[Gate]:
    """Eleven gates. The module is parsed, and what it declares is run and compared; it is never executed as text."""
    spark, gates = df.sparkSession, []

    def gate(name: str, test) -> None:
        try:
            result = test()
            gates.append(Gate(name, bool(result), "" if result else "failed"))
        except Exception as e:  # noqa: BLE001  a gate reports whatever went wrong
            gates.append(Gate(name, False, f"{type(e).__name__}: {e}"[:300]))

    text, code = to_ir(pipeline), module if module is not None else emit(pipeline, state_path)
    features = pipeline.features
    again: list[FeaturePipeline] = []
    fitted = [f for f in features if get(f.op).shape == "fitted"]

    def restored() -> FeaturePipeline:
        if not again:
            if fitted and state_path:
                pipeline.save(state_path, spark)
                again.append(FeaturePipeline.load(state_path, spark))
            else:
                again.append(from_ir(text))
                again[0].states = dict(pipeline.states)
        return again[0]

    def declared() -> list[Feature]:
        tree = ast.parse(code)
        listed = next(n.value for n in tree.body if isinstance(n, ast.Assign) and n.targets[0].id == "FEATURES")
        return [Feature(*[ast.literal_eval(a) for a in call.args]) for call in listed.elts]

    def well_formed() -> bool:
        again = from_ir(text).features
        arity = all(len(f.inputs) == len(get(f.op).inputs) or get(f.op).family in ("dimensionality", "cluster", "model_informed") for f in again)
        return arity and [f.identity for f in again] == [f.identity for f in features] and all(get(f.op).shape != "window" or f.order for f in again)

    def parity() -> bool:
        """The features that the module declares, with the fitted states, give the pipeline's values."""
        listed = declared()
        if [f.identity for f in listed] != [f.identity for f in features]:
            return False
        rebuilt = FeaturePipeline(listed, pipeline.keep)
        rebuilt.states = dict(pipeline.states)
        return differing_rows(pipeline.transform(df), rebuilt.transform(df), [f.name for f in features]) == 0

    gate("validate_ir", well_formed)
    gate("topological_sort", lambda: all(c in df.columns for f in features for c in f.inputs))
    gate("deduplicate", lambda: len({f.identity for f in features}) == len(features))
    gate("partition_fit_transform", lambda: all(f.identity in pipeline.states for f in fitted))
    gate("select_backend", lambda: all(get(f.op).shape in ("scalar", "window", "fitted", "stream") for f in features))
    gate("emit_contracts", lambda: set(pipeline.transform(df).columns) >= {f.name for f in features})
    gate("syntax_check", lambda: compile(code, "features.py", "exec") is not None)
    gate("operator_coverage", lambda: {f.op for f in declared()} <= {o.name for o in all_operators()})
    gate("feature_parity", parity)
    names = [f.name for f in features]
    gate("prediction_parity", lambda: differing_rows(pipeline.transform(df), restored().transform(df), names) == 0)

    def quick() -> bool:
        began = time.time()
        pipeline.transform(df).select(*[F.col(f"`{n}`") for n in names]).write.format("noop").mode("overwrite").save()
        return time.time() - began <= budget_s

    gate("latency_resource", quick)
    return gates
