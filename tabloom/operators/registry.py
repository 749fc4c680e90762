"""The operator registry.

An operator is declared once and compiled to Spark in one of three shapes:

* ``scalar``: a Column from cleaned input Columns, fused with all others into one projection;
* ``window``: a Column over a window of its entity in time order;
* ``fitted``: ``fit(df, inputs, params)`` learns a state on training rows, and ``apply(df, inputs, params, state, out)``
  adds the column ``out`` by literals or by an equi-join with a state table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Operator:
    name: str
    family: str
    inputs: tuple[str, ...]
    output: str
    shape: str = "scalar"
    build: Callable | None = None
    fit: Callable | None = None
    apply: Callable | None = None
    defaults: dict[str, Any] = field(default_factory=dict)
    commutative: bool = False
    leakage: str = "L0"  # L0 row-wise, L1 fitted on features, L2 uses the target
    null_policy: str = "propagate"
    uses_future: bool = False


_REGISTRY: dict[str, Operator] = {}


def register(op: Operator) -> Operator:
    if op.name in _REGISTRY:
        raise ValueError(f"operator {op.name!r} is registered already")
    _REGISTRY[op.name] = op
    return op


def get(name: str) -> Operator:
    load()
    try:
        return _REGISTRY[name]
    except KeyError:
        raise KeyError(f"no operator {name!r}") from None


def all_operators() -> list[Operator]:
    load()
    return [_REGISTRY[n] for n in sorted(_REGISTRY)]


def families() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for op in all_operators():
        out.setdefault(op.family, []).append(op.name)
    return out


def load() -> None:
    """Import the catalogue; the modules register themselves."""
    from . import categorical, datetime, fitted, group, model, numeric, temporal, text  # noqa: F401
