"""Task inference, fold columns, leakage detectors, cross-fitting, calibration, thresholds and shift."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import num
from ..functions.order import cumulative, rank_auc
from ..operators import get
from .profile import MISSING_TOKENS, ColumnProfile

MULTICLASS_CAP = 10
#: spellings of the positive class
TRUTHY = ("1", "true", "yes", "y", "t", "positive", "pos")
#: classes that are counted on the driver
MAX_CLASSES = 1000


@dataclass
class Task:
    kind: str  # binary, multiclass, regression, forecasting, auto
    confidence: float
    positive: str | None = None
    classes: int | None = None
    labels: tuple[str, ...] = ()
    positive_rate: float | None = None
    imbalanced: bool = False
    reasons: list[str] = field(default_factory=list)


def infer_task(df: DataFrame, target: str, p: ColumnProfile, explicit: str | None = None, time_key: str | None = None) -> Task:
    """The task of a target, with its classes counted in one aggregation."""
    if explicit:
        out = Task(explicit, 1.0, reasons=["explicit"])
    elif time_key and p.numeric:
        out = Task("forecasting", 0.6, reasons=["time key and numeric target"])
    elif p.semantic == "boolean" or p.distinct == 2:
        out = Task("binary", 1.0 if p.semantic == "boolean" else 0.6, reasons=[f"{p.distinct} classes"])
    elif p.semantic.endswith("categorical") or p.physical == "integer" and p.distinct <= MULTICLASS_CAP:
        out = Task("multiclass", 0.6, reasons=[f"{p.distinct} classes"]) if p.distinct <= MULTICLASS_CAP else Task("auto", 0.3, reasons=["too many classes"])
    elif p.numeric:
        out = Task("regression", 0.6, reasons=["numeric target"])
    else:
        out = Task("auto", 0.3, reasons=[f"{p.semantic} target"])
    if out.kind in ("binary", "multiclass"):
        label = F.col(f"`{target}`").cast("string")
        counts = df.where(label.isNotNull()).groupBy(label.alias("c")).count().orderBy("c").limit(MAX_CLASSES + 1).collect()
        if len(counts) > MAX_CLASSES:
            raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
        total = sum(r[1] for r in counts) or 1
        names = [r[0] for r in counts]
        out.classes, out.labels = len(names), tuple(names)
        out.positive = next((c for c in names if c.strip().lower() in TRUTHY or c.strip() == "1.0"), names[-1] if names else None)
        out.positive_rate = dict(map(tuple, counts)).get(out.positive, 0) / total
        out.imbalanced = min((r[1] for r in counts), default=0) / total < 0.2
    return out


#: fixed values: metrics of each task, the first is primary
METRICS = {
    "binary": ("roc_auc", "log_loss", "brier"),
    "multiclass": ("log_loss", "macro_f1", "accuracy"),
    "regression": ("rmse", "mae", "r2"),
    "forecasting": ("rmse", "mae", "mape"),
    "auto": ("rmse",),
}


@dataclass(frozen=True)
class Metric:
    name: str
    maximise: bool


def route_metrics(task: str, imbalanced: bool = False, probabilities: bool = True, action: str | None = None, costs: bool = False, non_negative: bool = False) -> list[Metric]:
    """The metrics a task is judged by, the first is primary; options add those that need more than a task tells."""
    up, down = (lambda *names: [Metric(n, True) for n in names]), (lambda *names: [Metric(n, False) for n in names])
    if task == "binary":
        extra = up("average_precision") if imbalanced else []
        extra += down("log_loss", "brier") if probabilities else []
        return up("roc_auc") + extra + (up("f1") if action == "f1" else []) + (up("business_utility") if costs else [])
    if task == "multiclass":
        return down("log_loss") + up("macro_f1", "micro_f1", "balanced_accuracy")
    if task in ("regression", "forecasting"):
        guarded = (["rmsle"] if non_negative else []) + (["mape"] if non_negative or task == "forecasting" else [])
        return down("rmse", "mae") + up("r2") + down(*guarded)
    return []


# ---- folds: always columns, never lists of rows ----------------------------------------------------------------------


def _hash(keys: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def kfold(df: DataFrame, keys: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """fold by a hash of the row's key: no shuffle, the same fold whenever it is computed, balanced in expectation."""
    return df.withColumn("fold", F.pmod(_hash(keys, seed), F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, target: str, keys: list[str], k: int = 5, seed: int = 0, salts: int = 64) -> DataFrame:
    """Folds whose class counts differ by one at most in each class and salt. Rows are dealt out within (class, salt), so a
    class of any size is shared by many tasks; the deal of a salt starts where the one before it ended."""
    y = F.col(target).cast("string")
    least = df.where(y.isNotNull()).groupBy(y.alias("y")).count().agg(F.min("count")).first()[0]
    if least is None or least < 2:
        raise ValueError("the smallest class has fewer than 2 rows")
    salted = df.withColumn("_s", F.pmod(_hash(keys, seed + 1), F.lit(salts)))
    cells = salted.groupBy(y.alias("_y"), "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_y").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select("_y", F.col("_s").alias("_t"), before.alias("_before"))
    w = Window.partitionBy(y, "_s").orderBy(_hash(keys, seed), *keys)
    ranked = salted.withColumn("_r", F.row_number().over(w) - 1)
    j = ranked.join(starts, y.eqNullSafe(F.col("_y")) & (F.col("_s") == F.col("_t")))
    return j.select(*df.columns, F.pmod(F.col("_before") + F.col("_r"), F.lit(k)).cast("int").alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 0) -> DataFrame:
    """A group is in one fold, by a hash of the group: no join, no shuffle."""
    if df.select(group).distinct().limit(2).count() < 2:
        raise ValueError("fewer than 2 groups")
    return df.withColumn("fold", F.pmod(_hash([group], seed), F.lit(k)).cast("int"))


def time_folds(df: DataFrame, time: str, k: int = 5) -> DataFrame:
    """fold by quantiles of time: a fold is validated on all folds before it. Rows of one instant share a fold."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = sorted({c for c in df.select(t.alias("t")).approxQuantile("t", [i / k for i in range(1, k)], 0.001)})
    fold = F.lit(0)
    for c in cuts:
        fold = fold + (t > F.lit(int(c))).cast("int")
    return df.withColumn("fold", fold)


def holdout(df: DataFrame, keys: list[str], fraction: float = 0.2, seed: int = 7, time: str | None = None, group: str | None = None) -> DataFrame:
    """is_holdout: the last rows in time, whole groups, or hashed rows."""
    if time:
        t = F.unix_micros(F.col(time).cast("timestamp"))
        (cut,) = df.select(t.alias("t")).approxQuantile("t", [1 - fraction], 0.001)
        return df.withColumn("is_holdout", t > F.lit(int(cut)))
    h = F.pmod(_hash([group] if group else keys, seed), F.lit(1_000_000))
    return df.withColumn("is_holdout", h < int(fraction * 1_000_000))


def make_splits(df: DataFrame, keys: list[str], target: str | None = None, time: str | None = None, group: str | None = None, seed: int = 0) -> DataFrame:
    """fold and is_holdout by the strategy the keys ask for; 7 folds under 500 rows, else 5."""
    k = 7 if df.limit(500).count() < 500 else 5
    out = holdout(df, keys, seed=seed + 7, time=time, group=group)
    if time:
        return time_folds(out, time, k)
    if group:
        return group_kfold(out, group, k, seed)
    return stratified_kfold(out, target, keys, k, seed) if target else kfold(out, keys, k, seed)


# ---- leakage ---------------------------------------------------------------------------------------------------------


@dataclass
class LeakFinding:
    column: str
    kind: str
    severity: str  # HARD_REJECT or REVIEW
    level: str  # L3 to L5
    score: float


def _binary(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    x = s.try_cast("double")
    return F.when(s.isin("yes", "true", "y", "t"), 1.0).when(s.isin("no", "false", "n", "f"), 0.0).when(~F.isnan(x), x)


def _present(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when((s != "") & ~s.isin(*MISSING_TOKENS), s)


def _number(df: DataFrame, c: str) -> Column:
    """The column as a double; dates, timestamps and nested values are no numbers, and Spark refuses their cast."""
    kind = dict(df.dtypes)[c]
    return F.lit(None).cast("double") if kind.startswith(("date", "timestamp", "interval", "binary", "array", "map", "struct")) else num(F.col(f"`{c}`"))


def deterministic_leaks(df: DataFrame, columns: list[str], target: str) -> list[LeakFinding]:
    """Stage A: copies, inverted copies, bijections of near-unique strings, and the target inside a string. All columns in
    one aggregation."""
    t, ty = _present(F.col(target)), _binary(F.col(target))
    aggregates = []
    for c in columns:
        f, fy = _present(F.col(c)), _binary(F.col(c))
        both = f.isNotNull() & t.isNotNull()
        residue = F.when(both & f.contains(t), F.replace(f, t, F.lit("")))
        same = F.coalesce(fy == ty, f == t)
        aggregates += [
            F.count_if(both).alias(f"{c}\0n"),
            F.avg(F.when(both, same.cast("double"))).alias(f"{c}\0copy"),
            F.avg(F.when(both & ty.isin(0.0, 1.0) & fy.isin(0.0, 1.0), (fy == 1 - ty).cast("double"))).alias(f"{c}\0inverse"),
            F.approx_count_distinct(F.when(both, f), 0.02).alias(f"{c}\0df"),
            F.approx_count_distinct(F.when(both, t), 0.02).alias(f"{c}\0dt"),
            F.avg(F.when(both & (F.length(t) >= 1), f.contains(t).cast("double"))).alias(f"{c}\0inside"),
            F.count_if(both & (_number(df, c).isNull() | _number(df, target).isNull())).alias(f"{c}\0texts"),
            F.min(residue).alias(f"{c}\0residue"),
            F.max(residue).alias(f"{c}\0other"),
            F.min(F.when(both, F.length(t))).alias(f"{c}\0least"),
        ]
    g = df.agg(*aggregates).first().asDict()
    out = []
    for c in columns:
        v = {k: g[f"{c}\0{k}"] for k in ("n", "copy", "inverse", "df", "dt", "inside", "texts", "residue", "other", "least")}
        if v["n"] < 4:
            continue
        if (v["copy"] or 0) >= 0.99:
            out.append(LeakFinding(c, "target_copy", "HARD_REJECT", "L5", v["copy"]))
        elif (v["inverse"] or 0) >= 0.99:
            out.append(LeakFinding(c, "inverted_target", "HARD_REJECT", "L5", v["inverse"]))
        elif v["texts"] == v["n"] and v["df"] / v["n"] >= 0.8 and v["dt"] / v["n"] >= 0.8 and (share := _bijection(df, _present(F.col(c)), t)) >= 0.9:
            out.append(LeakFinding(c, "bijection", "HARD_REJECT", "L5", share))
        elif (v["inside"] or 0) >= 0.95 and v["dt"] > 1 and (v["residue"] == v["other"] or (v["least"] or 0) >= 3):
            out.append(LeakFinding(c, "embedded_target", "HARD_REJECT", "L5", v["inside"]))
    return out


def _bijection(df: DataFrame, f: Column, t: Column) -> float:
    """The share of distinct values if values and targets determine each other, else 0; exact, for the few columns whose
    sketched counts allow it."""
    rows = df.select(f.alias("f"), t.alias("t")).where("f IS NOT NULL AND t IS NOT NULL")
    pairs = rows.groupBy("f", "t").agg(F.count("*").alias("n"))
    n, both = pairs.agg(F.sum("n"), F.count("*")).first()
    one = pairs.select("f").distinct().count()
    return one / n if n and one == both == pairs.select("t").distinct().count() else 0.0


def statistical_leaks(df: DataFrame, columns: list[str], target: str) -> list[LeakFinding]:
    """Stage B, binary targets: separation by rank, mutual information of few levels, and missingness by class."""
    y = _binary(F.col(target))
    out = []
    gaps = df.agg(
        *[a for c in columns for a in (
            F.avg(F.when(y == 1, _present(F.col(c)).isNull().cast("double"))) - F.avg(F.when(y == 0, _present(F.col(c)).isNull().cast("double"))),
            F.approx_count_distinct(_present(F.col(c)), 0.02), F.count(_number(df, c)), F.count(_present(F.col(c))), F.count_if(_present(F.col(c)).isNull()),
        )]
    ).first()
    for i, c in enumerate(columns):
        gap, levels, numbers, present, missing = gaps[5 * i : 5 * i + 5]
        if numbers and numbers == present and numbers >= 20:
            auc = rank_auc(df, _number(df, c), y)
            if auc is not None and auc >= 0.98:
                out.append(LeakFinding(c, "separation", "REVIEW", "L4", auc))
        if present and levels <= 200 and levels < 0.5 * present:
            mi = normalised_information(df, _present(F.col(c)), y)
            if mi >= 0.9:
                out.append(LeakFinding(c, "information", "REVIEW", "L4", mi))
        if gap is not None and abs(gap) >= 0.9 and missing >= 5 and present >= 5:
            out.append(LeakFinding(c, "missingness", "REVIEW", "L4", abs(gap)))
    return out


def normalised_information(df: DataFrame, f: Column, y: Column) -> float:
    """Mutual information over the target's entropy, base 2; only counts by (level, class) reach the driver."""
    rows = df.select(f.alias("f"), y.alias("y")).where("f IS NOT NULL AND y IS NOT NULL").groupBy("f", "y").count().collect()
    n = sum(r[2] for r in rows)
    if not n:
        return 0.0
    by_f: dict = {}
    by_y: dict = {}
    for a, b, c in rows:
        by_f[a] = by_f.get(a, 0) + c
        by_y[b] = by_y.get(b, 0) + c
    entropy = -sum(c / n * math.log2(c / n) for c in by_y.values())
    mi = sum(c / n * math.log2(c * n / (by_f[a] * by_y[b])) for a, b, c in rows)
    return mi / entropy if entropy > 0 else 0.0


def availability(columns: dict[str, str | None], prediction_time: str) -> list[LeakFinding]:
    """Stage C: ISO times at which columns become known against the time of prediction; unknown ones are for review."""
    out = []
    for c, at in columns.items():
        if at is None:
            out.append(LeakFinding(c, "availability_unknown", "REVIEW", "L3", 0.0))
        elif at > prediction_time:
            out.append(LeakFinding(c, "available_too_late", "REVIEW", "L4", 1.0))
    return out


def confirm_unavailable(columns: list[str]) -> list[LeakFinding]:
    """Columns that are known not to exist when a prediction is made."""
    return [LeakFinding(c, "unavailable_at_prediction", "HARD_REJECT", "L5", 1.0) for c in columns]


def target_history(used: bool, delay_known: bool = False) -> list[LeakFinding]:
    """Lags of the target need a known delay after which labels arrive."""
    return [LeakFinding("target_history", "label_delay_unknown", "REVIEW", "L3", 0.0)] if used and not delay_known else []


def fold_safety(features: list, scope: str = "training_fold") -> list[str]:
    """Stage D: what is wrong with fitting these features in ``scope`` (``training_fold`` or ``development``) when folds are
    judged. States fitted on all rows are for the final model only; features that see the target are cross-fitted."""
    out = []
    for f in features:
        op = get(f.op)
        if op.shape != "fitted":
            continue
        if scope != "training_fold":
            out.append(f"{f.name}: fitted on {scope} rows, which hold the rows it is judged on")
        if op.leakage == "L2" and scope != "training_fold":
            out.append(f"{f.name}: sees the target and needs cross-fitting")
    return out


# ---- scores ----------------------------------------------------------------------------------------------------------


def brier(df: DataFrame, p: str, y: str) -> float | None:
    return df.agg(F.avg((num(p) - num(y)) * (num(p) - num(y)))).first()[0]


def log_loss(df: DataFrame, p: str, y: str, eps: float = 1e-15) -> float | None:
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), num(p)))
    return df.agg(-F.avg(num(y) * F.log(q) + (1 - num(y)) * F.log(1 - q))).first()[0]


def calibrate(df: DataFrame, p: str, y: str, bins: int = 10) -> list[tuple[float, float]]:
    """[(score, probability)] by pool-adjacent-violators over equal-count bins; bin sums are all that reaches the driver."""
    rows = df.select(num(p).alias("p"), num(y).alias("y")).dropna()
    cuts = sorted({c for c in rows.approxQuantile("p", [i / bins for i in range(1, bins)], 0.001)})
    b = F.lit(0)
    for c in cuts:
        b = b + (F.col("p") > F.lit(c)).cast("int")
    sums = rows.groupBy(b.alias("b")).agg(F.avg("p"), F.sum("y"), F.count("*")).orderBy("b").collect()
    blocks: list[list[float]] = []
    for _, mean, s, n in sums:
        blocks.append([mean, s, n, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            m2, s2, n2, k2 = blocks.pop()
            m1, s1, n1, k1 = blocks.pop()
            blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), s1 + s2, n1 + n2, k1 + k2])
    return [(m, s / n) for m, s, n, _ in blocks]


def apply_calibration(p: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points, flat outside."""
    if not points:
        return p
    out = F.lit(points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = F.when(p > x0, F.lit(y0) + F.least(F.lit(1.0), (p - x0) / max(x1 - x0, 1e-300)) * (y1 - y0)).otherwise(out)
    return out


def threshold_table(df: DataFrame, p: str, y: str) -> DataFrame:
    """(threshold, tp, fp, pos, neg): what each distinct score as a threshold would take, by one cumulative sum."""
    per = df.select((-num(p)).alias("x"), num(y).alias("y")).dropna().groupBy("x").agg(F.count("*").alias("c"), F.sum("y").alias("s"))
    tp = cumulative(per, "x", "s").withColumnRenamed("below", "tp0")
    both = cumulative(tp, "x", "c")
    total, pos = per.agg(F.sum("c"), F.sum("s")).first()
    taken, hit = F.col("below") + F.col("c"), F.col("tp0") + F.col("s")
    return both.select((-F.col("x")).alias("threshold"), hit.alias("tp"), (taken - hit).alias("fp"), F.lit(pos).alias("pos"), (F.lit(total) - F.lit(pos)).alias("neg"))


def best_threshold(df: DataFrame, p: str, y: str, objective: str = "f1", floor: float = 0.0, gain: float = 1.0, loss: float = 1.0) -> tuple[float, float] | None:
    """(threshold, value) for f1, precision_floor (most recall at a precision), recall_floor, or utility."""
    t = threshold_table(df, p, y)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif(F.col("pos"), F.lit(0.0))
    value = {
        "f1": 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos")),
        "precision_floor": F.when(precision >= floor, recall),
        "recall_floor": F.when(recall >= floor, precision),
        "utility": F.col("tp") * gain - F.col("fp") * loss,
    }[objective]
    row = t.select(value.alias("v"), "threshold").where("v IS NOT NULL").agg(F.max(F.struct("v", "threshold")).alias("b")).first()[0]
    return (row["threshold"], row["v"]) if row else None


@dataclass(frozen=True)
class DecisionPolicy:
    """A threshold, and what calibrates the scores it is for, fixed before the holdout is looked at."""

    objective: str
    threshold: float
    calibrator: str | None
    fingerprint: str


def freeze_policy(objective: str, threshold: float, calibrator: str | None = None) -> DecisionPolicy:
    import hashlib
    import json

    body = json.dumps([objective, threshold, calibrator])
    return DecisionPolicy(objective, threshold, calibrator, hashlib.sha256(body.encode()).hexdigest())


def shift_auc(train: DataFrame, test: DataFrame, column: str) -> float | None:
    """How well a column tells train from test rows; 0.95 or more is shift."""
    both = train.select(num(column).alias("x"), F.lit(0.0).alias("y")).unionByName(test.select(num(column).alias("x"), F.lit(1.0).alias("y")))
    auc = rank_auc(both, F.col("x"), F.col("y"))
    return None if auc is None else max(auc, 1 - auc)


def pareto_front(points: list[tuple[float, ...]]) -> list[int]:
    """Indices of the points no other point dominates (all larger is better)."""
    a = np.asarray(points, float)
    return [i for i in range(len(a)) if not ((a >= a[i]).all(axis=1) & (a > a[i]).any(axis=1)).any()]
