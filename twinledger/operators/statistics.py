"""Descriptive comparison: count, mean, spread and quartiles of paired columns side by side."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import rules_from
from .coercion import column_pairs, with_values
from .lineage import cut
from .survey import modes_only

METRICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
QUARTILES = (0.25, 0.5, 0.75)

# The rank error of the sketch is at most 1/SKETCH_ACCURACY of the rows; brackets are taken twice as wide.
SKETCH_ACCURACY = 10_000

STATISTICS = "column string, metric string, a double, b double, abs_diff double, rel_diff double"


def compare_statistics(
    a: DataFrame, b: DataFrame, columns, modes: Mapping | None = None, accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """``(column, metric, a, b, abs_diff, rel_diff)``: differences A - B, and relative to B as a fraction.

    Pairs that do not compare as numbers have NULLs. Each pass reads both sides once for all pairs, and the driver
    gets single numbers only.
    """
    pairs = column_pairs(rules_from(columns))
    _check(a, b, pairs)
    open_pairs = [p for p in pairs if p not in (modes or {})]
    chosen = {**modes_only(a, b, None, open_pairs), **dict(modes or {})}
    numeric = [p for p in pairs if chosen[p] == "numeric"]
    described_a, described_b = _describe([(a, [p for p, _ in numeric]), (b, [q for _, q in numeric])], accuracy)
    rows = []
    for pair in pairs:
        values_a = described_a.get(pair[0]) if pair in numeric else None
        values_b = described_b.get(pair[1]) if pair in numeric else None
        for k, metric in enumerate(METRICS):
            x, y = (values_a[k], values_b[k]) if values_a and values_b else (None, None)
            gap = None if x is None or y is None else x - y
            rows.append((pair[0], metric, x, y, gap, None if gap is None or y == 0 else gap / y))
    return a.sparkSession.createDataFrame(rows, STATISTICS)


def describe_numbers(df: DataFrame, names: Sequence[str], accuracy: int = SKETCH_ACCURACY) -> dict[str, tuple]:
    """The metrics of every column as numbers: sample deviation, exact quartiles with linear interpolation."""
    return _describe([(df, names)], accuracy)[0]


@dataclass
class _Ranks:
    """One column of one side: its row count, the ranks wanted, and the stretches of values in which they are looked for.

    The stretches part the values into regions, numbered from 0: those with odd numbers are the stretches. A region
    has the slot ``first_slot`` plus its number.
    """

    side: int
    column: int
    n: int
    stretches: list[tuple[float, float]]
    first_slot: int = 0
    values: dict[int, float] = field(default_factory=dict)

    @property
    def ranks(self) -> list[int]:
        """The rows, numbered from 0 by value, between which the quartiles lie."""
        return sorted({whole((self.n - 1) * q) for q in QUARTILES for whole in (math.floor, math.ceil)})

    @property
    def slots(self) -> int:
        return 2 * len(self.stretches) + 1

    def cell(self) -> str:
        """A value's slot, and the value itself where it lies in a stretch; values in between are only counted."""
        v, steps = f"v{self.column}", []
        for k, (low, high) in enumerate(self.stretches):
            steps.append(f"WHEN {v} < {_double(low)} THEN {self.first_slot + 2 * k}")
            steps.append(f"WHEN {v} <= {_double(high)} THEN {self.first_slot + 2 * k + 1}")
        slot = f"CASE WHEN {v} IS NULL THEN NULL {' '.join(steps)} ELSE {self.first_slot + 2 * len(self.stretches)} END"
        inside = " OR ".join(f"{v} BETWEEN {_double(low)} AND {_double(high)}" for low, high in self.stretches)
        return f"named_struct('slot', {slot}, 'v', CASE WHEN {inside} THEN {v} END)"

    def quartile(self, q: float) -> float:
        place = (self.n - 1) * q
        lower, upper = self.values[math.floor(place)], self.values[math.ceil(place)]
        # equal ends (infinities too) need no interpolation
        return lower if lower == upper else lower + (upper - lower) * (place - math.floor(place))


def _describe(sides: Sequence[tuple[DataFrame, Sequence[str]]], accuracy: int) -> list[dict[str, tuple]]:
    """The metrics of the columns of all sides, by two passes over them.

    The first takes counts, moments and a quantile sketch, whose known rank error brackets every quartile. The second
    counts the rows in each region that the brackets make and, inside the brackets, the rows of every value. Those
    counts prove the brackets and hold the quartiles. A side whose brackets fail is counted once more by value.
    """
    names = [list(dict.fromkeys(columns)) for _, columns in sides]
    width = max(map(len, names))
    if not width:
        return [{} for _ in sides]
    values = []
    for (df, _), mine in zip(sides, names):
        slim = with_values(df, mine).select(*[f"v{i}" for i in range(len(mine))]) if mine else df.select()
        values.append(slim.withColumns({f"v{i}": F.lit(None).cast("double") for i in range(len(mine), width)}))
    facts = _facts(values, width, accuracy)
    looked_for = []
    for side, mine in enumerate(names):
        for i in range(len(mine)):
            n, near = facts[side][i][0], facts[side][i][5]
            if n:
                looked_for.append(_Ranks(side, i, n, _apart(list(zip(near[::2], near[1::2])))))
    missed = _find(values, looked_for)
    for ranks in missed:
        ranks.stretches = [facts[ranks.side][ranks.column][3:5]]
    _find(values, missed)
    found = {(r.side, r.column): r for r in looked_for}
    out = []
    for side, mine in enumerate(names):
        described = {}
        for i, name in enumerate(mine):
            n, mean, deviation, low, high, _ = facts[side][i]
            ranks = found.get((side, i))
            described[name] = (float(n), mean, deviation, low, *[ranks.quartile(q) if ranks else None for q in QUARTILES], high)
        out.append(described)
    return out


def _facts(values: list[DataFrame], width: int, accuracy: int) -> list[list[tuple]]:
    """Per side and column: count, mean, deviation, least, most, and the sketch's values around every quartile."""
    around = [p for q in QUARTILES for p in (max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy))]
    forms = ("count({v})", "avg({v})", "stddev_samp({v})", "min({v})", "max({v})",
             f"percentile_approx({{v}}, array({', '.join(map(str, around))}), {accuracy})")
    sided = reduce(DataFrame.unionByName, [v.withColumn("side", F.lit(side)) for side, v in enumerate(values)])
    totals = sided.groupBy("side").agg(*[F.expr(form.format(v=f"v{i}")) for i in range(width) for form in forms])
    rows = {r["side"]: tuple(r)[1:] for r in totals.collect()}
    nothing = (0, None, None, None, None, None) * width
    return [[rows.get(side, nothing)[i * len(forms):(i + 1) * len(forms)] for i in range(width)] for side in range(len(values))]


def _find(values: list[DataFrame], looked_for: list[_Ranks]) -> list[_Ranks]:
    """Set the values at the wanted ranks; those columns of which a rank lies outside its stretches are returned."""
    if not looked_for:
        return []
    slots = 0
    for ranks in looked_for:
        ranks.first_slot, slots = slots, slots + ranks.slots
    counts = _counts(values, looked_for)
    in_parts = sorted((r["slot"], r["part"], r["n"]) for r in counts.select("slot", "part", "n").mapInArrow(
        _part_totals, "slot int, part int, n bigint").collect())
    missed, places = [], {}
    for ranks in looked_for:
        wanted = {}
        before, mine = 0, [p for p in in_parts if ranks.first_slot <= p[0] < ranks.first_slot + ranks.slots]
        for slot, part, n in _summed(mine):
            for rank in ranks.ranks:
                if before <= rank < before + n:
                    wanted[rank] = (slot, part, rank - before)
            before += n
        if all((slot - ranks.first_slot) % 2 for slot, _, _ in wanted.values()):
            places.update({place: (ranks, rank) for rank, place in wanted.items()})
        else:
            missed.append(ranks)
    if places:
        parts = sorted({part for _, part, _ in places})
        taken = counts.where(F.col("part").isin(parts)).mapInArrow(_taker(list(places)), "slot int, part int, place bigint, v double")
        for row in taken.collect():
            ranks, rank = places[(row["slot"], row["part"], row["place"])]
            ranks.values[rank] = row["v"]
    return missed


def _counts(values: list[DataFrame], looked_for: list[_Ranks]) -> DataFrame:
    """``(slot, v, n, part)``: the rows of every value in a stretch, and of every other region (v is NULL), counted before they
    are shuffled and dealt by range of slot and value, so that a task holds some neighbouring values in their order."""
    cells = []
    for side, frame in enumerate(values):
        mine = [r.cell() for r in looked_for if r.side == side]
        if mine:
            cells.append(frame.selectExpr(f"inline(array({', '.join(mine)}))"))
    rows = reduce(DataFrame.unionByName, cells).where("slot IS NOT NULL")
    counts = rows.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.repartitionByRange("slot", "v").sortWithinPartitions("slot", "v")
    return cut(dealt.withColumn("part", F.spark_partition_id()))


def _part_totals(batches):
    """Row counts per slot and part; a part that comes in several batches has several rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["slot", "part"]).aggregate([("n", "sum")])
        yield from table.rename_columns(["slot", "part", "n"]).to_batches()


def _summed(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    totals: dict[tuple[int, int], int] = {}
    for slot, part, n in counts:
        totals[slot, part] = totals.get((slot, part), 0) + n
    return [(slot, part, n) for (slot, part), n in totals.items()]


def _taker(places: list[tuple[int, int, int]]):
    """The values at places ``(slot, part, rows before it)`` of parts that come in their order."""

    def take(batches):
        passed: dict[tuple[int, int], int] = {}
        for batch in batches:
            slots, parts, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("slot", "part", "n"))
            v = batch.column(batch.schema.get_field_index("v"))
            rows = []
            for slot, part in {(s, p) for s, p, _ in places}:
                here = np.flatnonzero((slots == slot) & (parts == part))
                if not len(here):
                    continue
                before = passed.get((slot, part), 0)
                upto = before + np.cumsum(n[here])
                for place in (q for s, p, q in places if (s, p) == (slot, part)):
                    if before <= place < upto[-1]:
                        at = here[np.searchsorted(upto, place, side="right")]
                        rows.append((slot, part, place, v[int(at)].as_py()))
                passed[slot, part] = int(upto[-1])
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["slot", "part", "place", "v"])

    return take


def _apart(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Brackets in rising order with those that touch made one; NaN is the greatest value, as in Spark."""
    key = lambda x: (math.isnan(x), x if not math.isnan(x) else 0.0)
    out = brackets[:1]
    for low, high in brackets[1:]:
        if key(low) <= key(out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], high, key=key))
        else:
            out.append((low, high))
    return out


def _double(x: float) -> str:
    return f"double('{x!r}')"


def _check(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> None:
    for side, frame, names in (("A", a, {p for p, _ in pairs}), ("B", b, {q for _, q in pairs})):
        unknown = sorted(names - set(frame.columns))
        if unknown:
            raise KeyError(f"source {side} has no columns {unknown}")
