"""Proposals, the gates F0 to F6, and greedy selection on Gram matrices.

Probing a ridge model on any set of candidates needs only the sums of products of their columns. One aggregation by
(seed fold keys, row bucket) collects these sums for all candidates at once; folds, prefixes, seeds, correlations and the
greedy search are then algebra on small matrices on the driver, without further jobs.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import get
from .features import Feature, FeaturePipeline, check_domains
from .profile import ColumnProfile

RIDGE, PROBE_FOLDS, SEEDS, BUCKETS = 1e-6, 3, 3, 4
MAX_CORRELATION, MAX_MEMBER_CORRELATION = 0.98, 0.95
#: candidates of one aggregation: its width grows with the square
BATCH = 48

#: fixed values: the first matching name pattern proposes its operators
NAME_HINTS = (
    (r"(^|_)(date|dt|timestamp|ts|time)(_|$)", ("year", "month", "day_of_week")),
    (r"(^|_)(price|amount|cost|revenue|salary|income|fee)(_|$)", ("log1p", "safe_ratio")),
    (r"(^|_)(count|qty|quantity|num|number|n_|cnt)(_|$)", ("log1p",)),
    (r"(^|_)(rate|ratio|pct|percent|share|frac)(_|$)", ("sqrt",)),
    (r"^(is|has|was|ever)_", ("identity",)),
)
DATE_PARTS = ("year", "month", "quarter", "day_of_week", "is_weekend", "hour")


def propose_for_column(p: ColumnProfile) -> list[Feature]:
    """Candidates that a column's profile triggers."""
    of = lambda op, why: Feature.of(op, p.name, source=f"profile:{why}")
    out = [of("identity", "raw")] if p.null_fraction < 0.5 else []
    if p.null_fraction > 0:
        out.append(of("missing_indicator", "missingness"))
    if p.numeric and p.numeric["count"]:
        lo, hi, std = p.numeric["min"], p.numeric["max"], p.numeric["std"]
        if not std or std < 1e-12:
            return out
        if p.numeric["zeros"]:
            out.append(of("zero_indicator", "zeros"))
        if lo >= 0:
            out += [of("log1p", "skew")] * ((p.numeric["mean"] or 0) > 0 or hi > 1) + [of("sqrt", "skew")]
        elif hi < 0:
            out += [of("square", "skew"), of("abs", "skew")]
        else:
            out += [of("signed_log1p", "signed_skew"), of("cbrt", "signed_skew")]
    if p.semantic == "datetime":
        out += [of(part, "datetime") for part in DATE_PARTS]
    return out


def propose_interactions(profiles: list[ColumnProfile], max_pairs: int = 20) -> list[Feature]:
    """Ratios and differences of the most informative numeric columns."""
    numeric = [p for p in profiles if p.numeric and p.numeric["std"] and p.semantic not in ("identifier", "boolean")]
    best = sorted(numeric, key=lambda p: -(1 - p.null_fraction) * (1 + min(p.numeric["std"], 10.0)))[: int(math.sqrt(max_pairs)) + 2]
    pairs = [(a, b) for i, a in enumerate(best) for b in best[i + 1 :]]
    return [Feature.of(op, a.name, b.name, source="interaction") for a, b in pairs for op in ("safe_ratio", "difference")][:max_pairs]


def propose_hints(p: ColumnProfile) -> list[Feature]:
    """Candidates by name; the first matching pattern decides. Ratios need a partner, which interactions give."""
    if p.semantic in ("identifier", "url_email_like_sensitive", "mixed_unknown"):
        return []
    for pattern, ops in NAME_HINTS:
        if re.search(pattern, p.name, re.I):
            fits = [op for op in ops if len(get(op).inputs) == 1 and (get(op).family != "datetime" or p.semantic == "datetime")]
            return [Feature.of(op, p.name, source="hints:name") for op in fits if p.numeric or get(op).family != "numeric" or op == "identity"]
    return []


def propose_from_residuals(df: DataFrame, profiles: list[ColumnProfile], residual: str) -> list[Feature]:
    """Transforms of columns that the size of the errors correlates with; one aggregation."""
    from ..functions.clean import num
    from ..functions.order import correlation

    numeric = [p for p in profiles if p.numeric and p.name != residual and p.numeric["count"] >= 20]
    if not numeric:
        return []
    row = df.agg(*[correlation(num(p.name), F.abs(num(residual))) for p in numeric]).first()
    out = []
    for p, r in zip(numeric, row, strict=True):
        r = abs(r or 0.0)
        if r > 0.2 and p.numeric["max"] > 0:
            out.append(Feature.of("log1p", p.name, source="residual"))
        if r > 0.15 and p.numeric["max"] >= 0:
            out.append(Feature.of("sqrt", p.name, source="residual"))
        if r >= 0.1 and 5 < p.numeric["zeros"] < 0.5 * p.rows:
            out.append(Feature.of("zero_indicator", p.name, source="residual"))
    return out


PLUGINS: dict[str, object] = {}


def register_plugin(name: str, propose) -> None:
    """``propose(profiles)`` returns features of a domain."""
    PLUGINS[name] = propose


register_plugin("financial", lambda profiles: [Feature.of("signed_log1p", p.name, source="plugin:financial") for p in profiles if p.semantic == "currency_like"])
register_plugin("temporal", lambda profiles: [Feature.of(op, p.name, source="plugin:temporal") for p in profiles if p.semantic == "datetime" for op in ("cyclical_month", "cyclical_dow")])


def propose(profiles: list[ColumnProfile], target: str, max_pairs: int = 20) -> list[Feature]:
    usable = [p for p in profiles if p.name != target]
    found = [f for p in usable for f in propose_for_column(p) + propose_hints(p)] + propose_interactions(usable, max_pairs)
    for plugin in PLUGINS.values():
        found += plugin(usable)
    for p in usable:
        if p.semantic.endswith("categorical"):
            found += [Feature.of("frequency_encode", p.name, source="profile:categorical"), Feature.of("hash_encode", p.name, source="profile:categorical")]
    return list({f.identity: f for f in found}.values())


# ---- gates -----------------------------------------------------------------------------------------------------------


@dataclass
class Verdict:
    feature: Feature
    gate: str
    passed: bool
    reason: str
    values: dict[str, float] = field(default_factory=dict)


def f0_preconditions(f: Feature, by_name: dict[str, ColumnProfile]) -> Verdict:
    op = get(f.op)
    if len(f.inputs) != len(op.inputs) and op.family not in ("dimensionality", "cluster", "model_informed"):
        return Verdict(f, "F0", False, "arity")
    for i, (c, wanted) in enumerate(zip(f.inputs, op.inputs, strict=False)):
        p = by_name.get(c)
        if p is None:
            return Verdict(f, "F0", False, f"no column {c}")
        if p.null_fraction >= 0.95:
            return Verdict(f, "F0", False, f"{c} is missing")
        fits = {"continuous_numeric": p.numeric is not None or p.physical == "boolean", "datetime": p.semantic == "datetime", "free_text": p.physical == "string"}
        if not fits.get(wanted, True):
            return Verdict(f, "F0", False, f"input {i} is {p.semantic}, not {wanted}")
    return Verdict(f, "F0", True, "")


#: fixed values: bytes a row of each output kind takes, for estimates before anything runs
_BYTES = {"vector": 800, "boolean": 1, "continuous_numeric": 8}


def f1_resources(f: Feature, rows: int, max_bytes: float = 1e15) -> Verdict:
    need = rows * _BYTES.get(get(f.op).output, 16)
    return Verdict(f, "F1", need <= max_bytes, "" if need <= max_bytes else "output too large", {"bytes": float(need)})


def as_number(c: Column, kind: str) -> Column:
    """A feature column as the probe sees it: null is 0, flags are 0 or 1, vectors are summed, text is hashed to [0, 1)."""
    if kind == "boolean":
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if kind.startswith("array"):
        return F.coalesce(F.aggregate(F.transform(c, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), F.lit(0.0))
    if kind == "string":
        return F.coalesce(F.pmod(F.xxhash64(c), F.lit(1000)) / 1000.0, F.lit(0.0))
    if kind.startswith(("timestamp", "date")):
        c = F.unix_micros(c.cast("timestamp")) / 1e6
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def f2_materialise(made: DataFrame, features: list[Feature]) -> list[Verdict]:
    """Invalid rates, variances and duplicates of all candidates in one aggregation."""
    kinds = dict(made.dtypes)
    aggregates = []
    for i, f in enumerate(features):
        c = F.col(f"`{f.name}`")
        x = as_number(c, kinds[f.name])
        aggregates += [F.avg(c.isNull().cast("double")).alias(f"n{i}"), F.var_pop(x).alias(f"v{i}"), F.sum(F.xxhash64(F.round(x, 9), F.col("_rid")).cast("decimal(38,0)")).alias(f"h{i}")]
    row = made.withColumn("_rid", F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, k in made.dtypes if not k.startswith(("array", "map", "struct"))])).agg(*aggregates).first()
    out, seen = [], {}
    for i, f in enumerate(features):
        nulls, var, h = row[f"n{i}"], row[f"v{i}"], row[f"h{i}"]
        if nulls is None or nulls > 0.5:
            out.append(Verdict(f, "F2", False, "invalid rate"))
        elif var is None or var < 1e-12:
            out.append(Verdict(f, "F2", False, "no variance"))
        elif h in seen:
            out.append(Verdict(f, "F2", False, f"equals {seen[h]}"))
        else:
            seen[h] = f.name
            out.append(Verdict(f, "F2", True, "", {"variance": var}))
    return out


# ---- Gram matrices ---------------------------------------------------------------------------------------------------


def _cell_grams(rows: DataFrame, columns: list[str], keys: list[str]) -> list[tuple[int, tuple[int, ...], np.ndarray]]:
    """[(first key, other keys, X'X)] with X = [1, columns]. Each task multiplies its Arrow batches and keeps one matrix for
    each cell; the tasks' matrices are summed by cell before they reach the driver. So wide sets of candidates cost matrix
    products and not thousands of aggregate expressions."""
    import pyarrow as pa

    width = len(columns) + 1

    def multiply(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(len(columns))]])
            cell = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))])
            names, at = np.unique(cell, axis=0, return_inverse=True)
            for k, name in enumerate(names):
                part = x[at.ravel() == k]
                sums[tuple(name)] = sums.get(tuple(name), 0.0) + part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array([list(map(int, k)) for k in sums], pa.list_(pa.int64())), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["cell", "m"])

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for cell, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[tuple(cell)] = sums.get(tuple(cell), 0.0) + np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in sums], pa.list_(pa.int64())), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["cell", "m"])

    schema = "cell array<bigint>, m binary"
    each = rows.select(*[F.col(k).cast("bigint") for k in keys], *columns).mapInArrow(multiply, schema)
    found = each.repartition("cell").mapInArrow(add, schema).collect()  # one matrix a cell
    return [(c[0], tuple(c[1:]), np.frombuffer(bytes(m)).reshape(width, width)) for c, m in found]


class Grams:
    """Sums of products of [1, candidates..., targets...] by row bucket and by the fold of each seed.

    Regression has one target and the root mean squared error, which is algebra on the sums. Classes have an indicator
    target each (binary: one for the positive class), a ridge model for each, and the mean squared error of their outputs
    clipped to [0, 1], of several classes divided by their sum. Clipping is by row, so each call of ``losses`` is one pass over
    the rows, for all sets of candidates it is given; the rows are kept meanwhile, until ``close``."""

    def __init__(self, made: DataFrame, features: list[Feature], target: Column | list[Column], keys: list[str], folds: int = PROBE_FOLDS, seeds: int = SEEDS, task: str = "regression") -> None:
        self.names, self.folds, self.seeds, self.clipped = [f.name for f in features], folds, seeds, task in ("binary", "multiclass")
        targets = target if isinstance(target, list) else [target]
        kinds = dict(made.dtypes)
        p, self.classes = len(features), len(targets)
        xs = [as_number(F.col(f"`{f.name}`"), kinds[f.name]) for f in features]
        ys = [f"_{p + i}" for i in range(len(targets))]
        base = made.select(*[x.alias(f"_{i}") for i, x in enumerate(xs)], *[t.cast("double").alias(y) for t, y in zip(targets, ys, strict=True)], *[F.col(k) for k in keys]).dropna(subset=ys)
        centre = base.agg(*[F.avg(f"_{i}") for i in range(p)], *[F.stddev_pop(f"_{i}") for i in range(p)]).first()
        self.mean = np.array([v or 0.0 for v in centre[:p]])
        self.scale = np.array([v if v and v > 1e-12 else 1.0 for v in centre[p:]])
        fold = lambda seed: F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(folds))
        bucket = F.pmod(F.xxhash64(F.lit(-1), *[F.col(k) for k in keys]), F.lit(BUCKETS))
        # centred and scaled, so that sums of squares keep their precision
        ready = base.select(*[((F.col(f"_{i}") - float(self.mean[i])) / float(self.scale[i])).alias(f"_{i}") for i in range(p)], *ys, bucket.alias("_b"), *[fold(s).alias(f"_f{s}") for s in range(seeds)])
        self.ready = ready.persist() if self.clipped else ready
        self.cells = _cell_grams(self.ready, [f"_{i}" for i in range(p + self.classes)], ["_b", *[f"_f{s}" for s in range(seeds)]])
        self.p = p

    def close(self) -> None:
        if self.clipped:
            self.ready.unpersist()

    def total(self, keep=lambda bucket, folds: True) -> np.ndarray:
        return sum((g for b, f, g in self.cells if keep(b, f)), np.zeros((self.p + 1 + self.classes,) * 2))

    def _fold_weights(self, chosen: list[int], seed: int, buckets: int, ridge: float) -> list[np.ndarray | None]:
        """(1 + chosen, targets) for each fold, learned on the others; None for a fold without rows."""
        at = np.array([0, *[c + 1 for c in chosen]])
        whole = self.total(lambda b, f: b < buckets)
        out: list[np.ndarray | None] = []
        for k in range(self.folds):
            left = self.total(lambda b, f, k=k: b < buckets and f[seed] == k)
            train = whole - left
            out.append(np.linalg.solve(train[np.ix_(at, at)] + ridge * np.eye(len(at)), train[at, self.p + 1 :]) if left[0, 0] else None)
        return out

    def loss(self, chosen: list[int], seed: int = 0, buckets: int = BUCKETS, ridge: float = RIDGE) -> float:
        return self.losses([(chosen, seed, buckets)], ridge)[0]

    def losses(self, jobs: list[tuple[list[int], int, int]], ridge: float = RIDGE) -> list[float]:
        """Cross-validated loss of ridge models for each (chosen candidates, seed, first buckets)."""
        if self.clipped:
            return self._clipped(jobs, ridge)
        out = []
        for chosen, seed, buckets in jobs:
            at, y = np.array([0, *[c + 1 for c in chosen]]), self.p + 1
            sse = n = 0.0
            for k, w in enumerate(self._fold_weights(chosen, seed, buckets, ridge)):
                if w is not None:
                    left, w = self.total(lambda b, f, k=k: b < buckets and f[seed] == k), w[:, 0]  # noqa: B023
                    sse += left[y, y] - 2 * w @ left[at, y] + w @ left[np.ix_(at, at)] @ w
                    n += left[0, 0]
            out.append(math.sqrt(max(0.0, sse) / n) if n else float("inf"))
        return out

    def _clipped(self, jobs: list[tuple[list[int], int, int]], ridge: float) -> list[float]:
        import pyarrow as pa

        p, classes, folds = self.p, self.classes, self.folds
        plans: dict[tuple[int, int], tuple[list[int], np.ndarray]] = {}
        for seed, buckets in {(s, b) for _, s, b in jobs}:
            at = [i for i, (_, s, b) in enumerate(jobs) if (s, b) == (seed, buckets)]
            dense = np.zeros((folds, p + 1, len(at), classes))
            for n, i in enumerate(at):
                for k, w in enumerate(self._fold_weights(jobs[i][0], seed, buckets, ridge)):
                    if w is not None:
                        dense[k, [0, *[c + 1 for c in jobs[i][0]]], n] = w
            plans[seed, buckets] = (at, dense.reshape(folds, p + 1, -1))

        def score(batches):
            sse, rows = np.zeros(len(jobs)), np.zeros(len(jobs))
            for b in batches:
                column = lambda i, b=b: b.column(i).to_numpy(zero_copy_only=False)
                x = np.column_stack([np.ones(b.num_rows), *[column(i) for i in range(p)]])
                y = np.column_stack([column(p + i) for i in range(classes)])
                bucket = column(p + classes)
                for (seed, buckets), (at, w) in plans.items():
                    fold = column(p + classes + 1 + seed)
                    for k in range(folds):
                        mine = (fold == k) & (bucket < buckets)
                        if mine.any():
                            out = np.clip(x[mine] @ w[k], 0.0, 1.0).reshape(-1, len(at), classes)
                            if classes > 1:
                                total = out.sum(axis=2, keepdims=True)
                                out = np.where(total > 0, out / np.where(total > 0, total, 1.0), 1.0 / classes)
                            sse[at] += ((out - y[mine][:, None, :]) ** 2).mean(axis=2).sum(axis=0)
                            rows[at] += mine.sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(jobs)), pa.int32()), pa.array(sse), pa.array(rows)], names=["job", "sse", "n"])

        sums = self.ready.mapInArrow(score, "job int, sse double, n double").groupBy("job").agg(F.sum("sse"), F.sum("n")).collect()  # one row a job
        found = {job: s / n if n else float("inf") for job, s, n in sums}
        return [found.get(i, float("inf")) for i in range(len(jobs))]

    def correlation(self, i: int, j: int) -> float:
        g = self.total()
        n, a, b = g[0, 0], i + 1, j + 1
        cov = g[a, b] - g[0, a] * g[0, b] / n
        va, vb = g[a, a] - g[0, a] ** 2 / n, g[b, b] - g[0, b] ** 2 / n
        return cov / math.sqrt(va * vb) if va > 0 and vb > 0 else 0.0

    def weights(self, chosen: list[int], ridge: float = RIDGE) -> np.ndarray:
        """Of the first target."""
        at = np.array([0, *[c + 1 for c in chosen]])
        g = self.total()
        return np.linalg.solve(g[np.ix_(at, at)] + ridge * np.eye(len(at)), g[at, self.p + 1])


def f3_gains(g: Grams, base: list[int], seed: int = 0) -> dict[int, float]:
    """Gain of each candidate over the base."""
    others = [i for i in range(g.p) if i not in base]
    start, *each = g.losses([(base, seed, BUCKETS), *[([*base, i], seed, BUCKETS) for i in others]])
    return {i: start - v for i, v in zip(others, each, strict=True)}


def select_portfolio(g: Grams, size: int = 8) -> list[tuple[int, float]]:
    """Forward selection: the best gain that correlates with no member too much, while gains are positive."""
    chosen: list[tuple[int, float]] = []
    while len(chosen) < size:
        members = [i for i, _ in chosen]
        gains = {i: v for i, v in f3_gains(g, members).items() if all(abs(g.correlation(i, m)) <= MAX_CORRELATION for m in members)}
        best = max(gains, key=lambda i: (gains[i], -i), default=None)
        if best is None or gains[best] <= 1e-9:
            break
        chosen.append((best, gains[best]))
    return chosen


def select_features(made: DataFrame, features: list[Feature], target: Column | list[Column], keys: list[str], size: int = 8, task: str = "regression") -> tuple[list[tuple[Feature, float]], list[tuple[Feature, float]]]:
    """(chosen features with their gains, each feature with its best gain in any step): ``select_portfolio`` over any number
    of features. Every feature is probed beside the chosen ones in each step. Up to BATCH of them need one Gram pass; more
    need one for each batch and step, of the batch and the chosen ones together."""
    best_gain = [-math.inf] * len(features)
    batches = [list(range(i, min(i + BATCH, len(features)))) for i in range(0, len(features), BATCH)]
    one = Grams(made, features, target, keys, task=task) if len(batches) == 1 else None
    chosen: list[tuple[int, float]] = []
    while len(chosen) < size:
        members = [i for i, _ in chosen]
        gains: dict[int, float] = {}
        for part in batches:
            at = part if one else [*members, *[i for i in part if i not in members]]
            if not set(at) - set(members):
                continue
            g = one or Grams(made, [features[i] for i in at], target, keys, task=task)
            base = [at.index(i) for i in members]
            for k, v in f3_gains(g, base).items():
                best_gain[at[k]] = max(best_gain[at[k]], v)
                if all(abs(g.correlation(k, m)) <= MAX_CORRELATION for m in base):
                    gains[at[k]] = v
            if not one:
                g.close()
        best = max(gains, key=lambda i: (gains[i], -i), default=None)
        if best is None or gains[best] <= 1e-9:
            break
        chosen.append((best, gains[best]))
    if one:
        one.close()
    return [(features[i], v) for i, v in chosen], list(zip(features, best_gain, strict=True))


def f4_progressive(g: Grams, base: list[int], i: int) -> tuple[bool, list[float]]:
    """Gain on 1, 2 and all row buckets: positive, and half of it retained."""
    losses = g.losses([(x, 0, b) for b in (1, 2, BUCKETS) for x in (base, [*base, i])])
    gains = [a - b for a, b in zip(losses[::2], losses[1::2], strict=True)]
    return all(v > 0 for v in gains) and gains[-1] >= 0.5 * max(gains), gains


def f5_complementary(g: Grams, members: list[int], i: int) -> bool:
    return all(abs(g.correlation(i, m)) <= MAX_MEMBER_CORRELATION for m in members)


def f6_stability(g: Grams, base: list[int], i: int) -> tuple[bool, float]:
    """Positive gain under each seed, and a coefficient of variation of 0.5 at most; stability is 1 / (1 + cv)."""
    losses = g.losses([(x, s, BUCKETS) for s in range(g.seeds) for x in (base, [*base, i])])
    gains = np.array(losses[::2]) - np.array(losses[1::2])
    cv = float(gains.std() / gains.mean()) if gains.mean() > 0 else float("inf")
    return bool((gains > 0).all() and cv <= 0.5), 0.0 if math.isinf(cv) else 1 / (1 + cv)


@dataclass
class Selection:
    pipeline: FeaturePipeline
    chosen: list[tuple[Feature, float]]
    verdicts: list[Verdict]
    loss: float
    base_loss: float


def run_funnel(df: DataFrame, features: list[Feature], profiles: list[ColumnProfile], target: Column | list[Column], keys: list[str], size: int = 8, task: str = "regression") -> Selection:
    """F0 to F6 over ``df`` (training rows): profiles decide first, then one pass each for domains, F2 and the Gram sums."""
    by_name = {p.name: p for p in profiles}
    rows = profiles[0].rows if profiles else 0
    log: list[Verdict] = []
    alive = []
    for f in features:
        for v in (f0_preconditions(f, by_name), f1_resources(f, rows)):
            log.append(v)
            if not v.passed:
                break
        else:
            alive.append(f)
    bad = check_domains(df, alive)
    log += [Verdict(f, "F0", False, "domain", {"share": bad[f.name]}) for f in alive if f.name in bad]
    alive = [f for f in alive if f.name not in bad]
    pipeline = FeaturePipeline(alive).fit(df)
    made = pipeline.transform(df)
    passed = f2_materialise(made, alive)
    log += passed
    alive = [v.feature for v in passed if v.passed]
    picked, probes = select_features(made, alive, target, keys, size, task)
    log += [Verdict(f, "F3", v > 0, "", {"gain": v}) for f, v in probes]
    if not picked:
        return Selection(FeaturePipeline([]), [], log, float("nan"), float("nan"))
    finalists = [f for f, _ in picked]
    g = Grams(made, finalists, target, keys, task=task)
    members: list[int] = []
    chosen = []
    for i, (_, gain) in enumerate(picked):
        progress, _ = f4_progressive(g, members, i)
        stable, stability = f6_stability(g, members, i)
        ok = progress and stable and f5_complementary(g, members, i)
        log.append(Verdict(finalists[i], "F6", ok, "" if ok else "unstable", {"gain": gain, "stability": stability}))
        if ok:
            members.append(i)
            chosen.append((finalists[i], gain))
    final = FeaturePipeline([f for f, _ in chosen])
    final.states = {k: v for k, v in pipeline.states.items() if k in {f.identity for f in final.features}}
    with_members, without = g.losses([(members, 0, BUCKETS), ([], 0, BUCKETS)])
    g.close()
    return Selection(final, chosen, log, with_members, without)


def progressive_cv(g: Grams, chosen: list[int], ridge: float = 1.0) -> list[float]:
    """Cross-validated loss on growing shares of the rows."""
    return [g.loss(chosen, buckets=b, ridge=ridge) for b in range(1, BUCKETS + 1)]


def nested_cv(g: Grams, chosen: list[int], grid: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0, 10.0)) -> tuple[float, float]:
    """Of the first target, unclipped: (outer loss, mean ridge): the ridge of each outer fold is chosen on folds of another seed within its training rows."""
    at, y = np.array([0, *[c + 1 for c in chosen]]), g.p + 1
    sse = n = 0.0
    picked = []
    for k in range(g.folds):
        def inner(ridge: float, k: int = k) -> float:
            whole = g.total(lambda b, f: f[0] != k)
            loss = 0.0
            for j in range(g.folds):
                out = g.total(lambda b, f, j=j: f[0] != k and f[1] == j)
                w = np.linalg.solve((whole - out)[np.ix_(at, at)] + ridge * np.eye(len(at)), (whole - out)[at, y])
                loss += out[y, y] - 2 * w @ out[at, y] + w @ out[np.ix_(at, at)] @ w
            return loss

        ridge = min(grid, key=inner)
        picked.append(ridge)
        out = g.total(lambda b, f, k=k: f[0] == k)
        train = g.total() - out
        w = np.linalg.solve(train[np.ix_(at, at)] + ridge * np.eye(len(at)), train[at, y])
        sse += out[y, y] - 2 * w @ out[at, y] + w @ out[np.ix_(at, at)] @ w
        n += out[0, 0]
    return math.sqrt(max(0.0, sse) / n), float(np.mean(picked))
