"""What to compare: key pairs, column pairs and any-of groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

MISSING_KEY = "<MISSING>"
MISSING_ROW = "<ROW MISSING>"


@dataclass(frozen=True)
class Pair:
    """One column of A compared with one column of B.

    ``threshold`` below 100 accepts similar texts (0-100); ``weight`` counts in the weighted score.
    """

    a: str
    b: str
    threshold: int = 100
    weight: float = 1.0

    @property
    def targets(self) -> tuple[str, ...]:
        return (self.b,)


@dataclass(frozen=True)
class AnyOf:
    """One column of A that passes if it equals any of several columns of B."""

    a: str
    bs: tuple[str, ...]
    weight: float = 1.0

    def __post_init__(self):
        object.__setattr__(self, "bs", tuple(self.bs))

    @property
    def targets(self) -> tuple[str, ...]:
        return self.bs

    @property
    def threshold(self) -> int:
        return 100


Rule = Pair | AnyOf


def key_pairs(keys: str | tuple | Sequence) -> list[tuple[str, str]]:
    """Accept ``"id"``, ``("a", "b")``, ``(["a1", "a2"], ["b1", "b2"])`` or ``[("a1", "b1"), …]``."""
    if isinstance(keys, str):
        return [(keys, keys)]
    if isinstance(keys, tuple) and len(keys) == 2:
        left, right = keys
        if isinstance(left, str) and isinstance(right, str):
            return [(left, right)]
        if isinstance(left, list) and isinstance(right, list):
            if len(left) != len(right):
                raise ValueError(f"{len(left)} key columns in A but {len(right)} in B")
            return list(zip(left, right))
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in keys]


def rules_from(mapping: dict | Iterable) -> list[Rule]:
    """A column map (``{a: b}`` or ``{a: [b1, b2]}``) or a list of rules, as a list of rules."""
    if not isinstance(mapping, dict):
        return list(mapping)
    return [AnyOf(a, tuple(t)) if isinstance(t, (list, tuple)) else Pair(a, t) for a, t in mapping.items() if a and t]


def check_columns(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], rules: Sequence[Rule], once: bool = True) -> None:
    """Argument checks that need no data: unknown columns, compared keys, with ``once`` columns mapped twice."""
    need_a = [k for k, _ in keys] + [r.a for r in rules]
    need_b = [k for _, k in keys] + [t for r in rules for t in r.targets]
    for side, frame, need in (("A", a, need_a), ("B", b, need_b)):
        unknown = sorted({c for c in need if c not in frame.columns})
        if unknown:
            raise KeyError(f"source {side} has no columns {unknown}")
    if not keys:
        raise ValueError("at least one key column is needed on each side")
    if not once:
        return
    targets = [t for r in rules for t in r.targets]
    twice = sorted({t for t in targets if targets.count(t) > 1})
    if twice:
        raise ValueError(f"source B columns mapped more than once: {twice}")
    sources = [r.a for r in rules]
    twice = sorted({s for s in sources if sources.count(s) > 1})
    if twice:
        raise ValueError(f"source A columns mapped more than once: {twice}")


def without_keys(rules: Sequence[Rule], keys: list[tuple[str, str]]) -> list[Rule]:
    """Leave out rules on key columns: the join already compares them."""
    keys_a, keys_b = {k for k, _ in keys}, {k for _, k in keys}
    kept: list[Rule] = []
    for rule in rules:
        targets = tuple(t for t in rule.targets if t not in keys_b)
        if rule.a in keys_a or not targets:
            continue
        kept.append(rule if targets == rule.targets else AnyOf(rule.a, targets, rule.weight))
    return kept
