"""``learn``: profile, task, splits, leakage, proposals, funnel and a scored model, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import num
from ..functions.parallel import spread
from . import models, problem
from .profile import ColumnProfile, profile
from .selection import Selection, propose, run_funnel


@dataclass
class Report:
    task: problem.Task
    profiles: list[ColumnProfile]
    leaks: list[problem.LeakFinding]
    selection: Selection
    scores: dict[str, float]
    best: str | None


def learn(df: DataFrame, target: str, keys: list[str], task: str | None = None, time: str | None = None, group: str | None = None, size: int = 8, candidates: tuple[str, ...] = ("ridge", "logistic", "tree")) -> Report:
    """Select features for ``target`` on rows that are not held out, and score models on the held-out ones.

    Binary targets are probed by the clipped Brier score, up to MULTICLASS_CAP classes one against the rest, numbers by the
    root mean squared error. ``keys`` identify a row; they, the target and columns a detector rejects are never features."""
    df = spread(df)
    profiles = profile(df)
    by_name = {p.name: p for p in profiles}
    inferred = problem.infer_task(df, target, by_name[target], task, time)
    label = F.col(f"`{target}`").cast("string")
    if inferred.kind == "binary":
        y = probes = (label == inferred.positive).cast("double")
    elif inferred.kind == "multiclass" and inferred.classes <= problem.MULTICLASS_CAP:
        probes = [(label == c).cast("double") for c in inferred.labels]
        y = (F.array_position(F.array(*[F.lit(c) for c in inferred.labels]), label) - 1).cast("double")
    elif inferred.kind in ("regression", "forecasting") and by_name[target].numeric:
        y = probes = num(target)
    else:
        raise NotImplementedError(f"learn has no probe for a {inferred.kind} target of type {by_name[target].physical} with {by_name[target].distinct} values")
    split = problem.holdout(df.where(F.col(target).isNotNull()), keys, time=time, group=group)
    train, test = split.where(~F.col("is_holdout")).drop("is_holdout"), split.where(F.col("is_holdout")).drop("is_holdout")
    columns = [c for c in df.columns if c not in (target, *keys)]
    leaks = problem.deterministic_leaks(train, columns, target)
    if inferred.kind == "binary":
        leaks += problem.statistical_leaks(train, [c for c in columns if c not in {x.column for x in leaks}], target)
    rejected = {x.column for x in leaks if x.severity == "HARD_REJECT"}
    usable = [p for p in profiles if p.name in columns and p.name not in rejected and p.semantic != "identifier"]
    selection = run_funnel(train, propose(usable, target), usable, probes, keys, size, inferred.kind)
    scores, best = {}, None
    if selection.chosen:
        made = [selection.pipeline.transform(part.withColumn("_y", y)) for part in (train, test)]
        names = [f.name for f, _ in selection.chosen]
        wanted = [m for m in candidates if models.fits(m, inferred.kind)]
        scores = models.compare(made[0], made[1], names, "_y", inferred.kind, wanted)
        best = models.best_of(scores, inferred.kind)
    return Report(inferred, profiles, leaks, selection, scores, best)
