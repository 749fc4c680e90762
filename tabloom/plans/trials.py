"""Trials of models: how many rows each sees, what a trial is worth, which go into an ensemble, and a cache of results."""

from __future__ import annotations

import json
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import MAXIMISE, ensemble_weights, is_better

#: fixed values: shares of the rows that a trial goes through, for tables of more than so many rows
LADDERS = ((100_000, (0.05, 0.16, 0.40, 1.0)), (10_000, (0.16, 0.32, 0.64, 1.0)), (-1, (1.0,)))
#: fixed values: what takes off a trial's utility, per unit
PENALTIES = {"spread": 0.5, "gap": 1.0, "seconds": 0.1, "megabytes": 0.05}


def fidelity_ladder(rows: int) -> tuple[float, ...]:
    return next(shares for more_than, shares in LADDERS if rows > more_than)


def at_fidelity(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows of one rung: by a hash of the key, so a rung holds all rows of the rungs below it."""
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(share * 1_000_000))


def utility(quality: float, **costs: float) -> float:
    """Quality less the penalties of ``spread``, ``gap``, ``seconds`` and ``megabytes``."""
    return quality - sum(PENALTIES[k] * v for k, v in costs.items())


@dataclass(frozen=True)
class Trial:
    name: str
    metric: str
    folds: tuple[float, ...]
    train_score: float | None = None
    seconds: float = 0.0
    completed: bool = True

    @property
    def score(self) -> float:
        return float(np.mean(self.folds))


def eligible(trials: list[Trial]) -> list[Trial]:
    """Completed trials with fold scores, of the metric that the first of them has: others cannot be compared."""
    done = [t for t in trials if t.completed and t.folds]
    return [t for t in done if t.metric == done[0].metric]


def score_diversity(trials: list[Trial]) -> float:
    """Coefficient of variation of the trials' mean scores, 1 at most; 0 for fewer than two."""
    means = np.array([t.score for t in trials])
    if len(means) < 2 or not means.mean():
        return 0.0
    return min(1.0, float(means.std() / abs(means.mean())))


@dataclass(frozen=True)
class Ensemble:
    members: tuple[str, ...]
    weights: tuple[float, ...]
    diversity: float
    seconds: float


def build_ensemble(trials: list[Trial], least: int = 2, most: int = 10, diversity: float = 0.1, overfit: float = 0.05, floor: float = 0.05) -> Ensemble | None:
    """The best ``most`` eligible trials with weights by score, none under ``floor``. None if there are too few, if they are
    too much alike, or if one is better on its training rows than in its folds by more than ``overfit``."""
    able = eligible(trials)
    if len(able) < least:
        return None
    up = MAXIMISE[able[0].metric]
    able = sorted(able, key=lambda t: (-t.score if up else t.score, t.name))[:most]
    varied = score_diversity(able)
    gaps = [abs(t.train_score - t.score) for t in able if t.train_score is not None and is_better(t.train_score, t.score, t.metric)]
    if varied < diversity or max(gaps, default=0.0) > overfit:
        return None
    weights = ensemble_weights([t.score for t in able], up)
    room = max(0.0, 1 - floor * len(able))
    raised = np.array([(floor if room else 0.0) + room * w for w in weights]) if room else np.ones(len(able))
    return Ensemble(tuple(t.name for t in able), tuple((raised / raised.sum()).tolist()), varied, sum(t.seconds for t in able))


class TrialCache:
    """Results of completed trials by family, parameters and set of features; the least recently used goes first."""

    def __init__(self, size: int = 1000) -> None:
        self.size, self.hits, self.misses = size, 0, 0
        self._held: OrderedDict[str, Trial] = OrderedDict()

    @staticmethod
    def _key(family: str, params: dict, features: list[str]) -> str:
        return json.dumps([family, params, sorted(features)], sort_keys=True, default=str)

    def get(self, family: str, params: dict, features: list[str]) -> Trial | None:
        key = self._key(family, params, features)
        found = self._held.get(key)
        if found is None:
            self.misses += 1
        else:
            self.hits += 1
            self._held.move_to_end(key)
        return found

    def put(self, family: str, params: dict, features: list[str], trial: Trial) -> None:
        if not trial.completed:
            return
        key = self._key(family, params, features)
        self._held[key] = trial
        self._held.move_to_end(key)
        if len(self._held) > self.size:
            self._held.popitem(last=False)

    def __len__(self) -> int:
        return len(self._held)

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0
