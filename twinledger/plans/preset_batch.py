"""Several saved mappings in one comparison: presets with equal keys share a survey and a join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import literal
from ..operators.keys import KeyPlan
from ..operators.records import ANY_OF_LABELS, NO_RULE, RULE, SHARED_LABELS, Comparison, compare
from ..operators.survey import Survey
from ..sources.presets import Preset
from ..spec import Rule, check_columns, without_keys


@dataclass(frozen=True)
class Member:
    """The part of a preset that is a comparison: its record pairs, or its any-of groups."""

    preset: str
    approach: str
    rules: tuple[Rule, ...]


@dataclass
class SharedComparison:
    """The findings of all members, each with its ``preset`` and ``approach``; what two members find stands there twice."""

    findings: DataFrame
    members: list[Member]
    plan: KeyPlan
    survey: Survey
    sources: tuple[DataFrame, DataFrame]

    def of(self, member: Member) -> Comparison:
        """The comparison of one member, as if it had been made alone."""
        mine = (F.col("preset") == member.preset) & (F.col("approach") == member.approach)
        return Comparison(self.findings.where(mine).drop("preset", "approach"), list(member.rules), self.plan, self.survey, self.sources)


def members_of(presets: Sequence[Preset]) -> list[Member]:
    """Record pairs and any-of groups of each preset, without key columns; a preset may have neither."""
    parts = [
        Member(p.name, approach, tuple(without_keys(rules, list(p.keys))))
        for p in presets for approach, rules in (("records", p.pairs), ("any_of", p.any_of))
    ]
    return [m for m in parts if m.rules]


def by_keys(presets: Sequence[Preset]) -> list[list[Preset]]:
    """The presets in groups of equal key pairs, in the order in which the groups begin."""
    groups: dict[tuple, list[Preset]] = {}
    for preset in presets:
        groups.setdefault(preset.keys, []).append(preset)
    return list(groups.values())


def compare_presets(a: DataFrame, b: DataFrame, presets: Sequence[Preset], **options) -> SharedComparison:
    """Compare two sources by all rules of presets with equal keys: one survey of the keys, one full outer join.

    A rule of several members is tested once, whatever its weights. Rows without partner are findings of every member.
    The options are those of ``operators.records.compare``.
    """
    if len(by_keys(presets)) != 1:
        raise ValueError("the presets of one comparison have the same keys")
    keys, members = list(presets[0].keys), members_of(presets)
    for member in members:
        check_columns(a, b, keys, member.rules)
    numbers = {rule: i for i, rule in enumerate(dict.fromkeys(_unweighted(r) for m in members for r in m.rules))}
    found = compare(a, b, keys, list(numbers), SHARED_LABELS, **options)
    findings = _tagged(found.findings, members, numbers)
    return SharedComparison(findings, members, found.plan, found.survey, found.sources)


def _unweighted(rule: Rule) -> Rule:
    return replace(rule, weight=1.0)


def _tagged(findings: DataFrame, members: Sequence[Member], numbers: dict[Rule, int]) -> DataFrame:
    """One row per finding and member that has its rule."""
    interested: list[list[Member]] = [list(members), *([] for _ in numbers)]
    for member in members:
        for rule in member.rules:
            interested[numbers[_unweighted(rule)] + 1].append(member)
    tag = lambda m: f"named_struct('preset', {literal(m.preset)}, 'approach', {literal(m.approach)})"
    lists = ", ".join(f"array({', '.join(tag(m) for m in of_rule)})" for of_rule in interested)
    tags = f"inline(element_at(array({lists}), {RULE} - ({NO_RULE}) + 1))" if members else "inline(array())"
    lone = f"approach = 'any_of' AND {RULE} = {NO_RULE}"
    kind = f"CASE WHEN {lone} THEN {literal(ANY_OF_LABELS.missing_in_b)} ELSE {SHARED_LABELS.column} END"
    tagged = findings.selectExpr("*", tags)
    return tagged.withColumn(SHARED_LABELS.column, F.expr(kind)).drop(RULE)
