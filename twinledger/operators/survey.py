"""One job over the keys before a comparison: pair modes, key counts, and keys that hold very many rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coercion import Modes, key_facts, known_modes, matched_totals, pair_rows, pair_types, with_decision
from .keys import OVERVIEW, KeyPlan, key_rows, overview_totals
from .lineage import cut

# A key is hot if it has more rows than this on a side, or makes more row pairs than this: what one task can take
# doesn't depend on how large the tables are.
HOT_ROWS = 1_000_000
HOT_PAIRS = 100_000_000


@dataclass
class Survey:
    """What a comparison needs to know first.

    ``types`` is the decision table if one was made; ``hot`` the keys to treat apart with their row counts, or None.
    """

    modes: Modes
    overview: dict = field(default_factory=dict)
    types: DataFrame | None = None
    hot: DataFrame | None = None


def take_survey(
    a: DataFrame,
    b: DataFrame,
    plan: KeyPlan,
    pairs: Sequence[tuple[str, str]],
    given: Mapping | None = None,
    hot_rows: int = HOT_ROWS,
    hot_pairs: int = HOT_PAIRS,
) -> Survey:
    """Decide modes and find hot keys, by the work that a key makes. The driver gets one row per pair of columns."""
    if hot_rows < 0 or hot_pairs < 0:
        raise ValueError("hot_rows and hot_pairs are not negative")
    modes: Modes = {**known_modes(a, b, pairs), **dict(given or {})}
    types = None
    if any(p not in modes for p in pairs):
        totals = key_facts(a, b, pairs, plan).agg(*overview_totals(), *matched_totals(pairs))
        decided = with_decision(totals.select(*OVERVIEW, pair_rows(pairs)))
        found = decided.collect()
        types = a.sparkSession.createDataFrame(found, decided.schema).drop(*OVERVIEW)
        modes = {(r.col_a, r.col_b): r["mode"] for r in found} | modes
        overview = {c: found[0][c] for c in OVERVIEW}
    else:
        overview = key_rows(a, b, plan).agg(*overview_totals()).first().asDict()
    hot = None
    most_a, most_b = overview["largest_a"], overview["largest_b"]
    if most_a > hot_rows or most_b > hot_rows or most_a * most_b > hot_pairs:
        work = F.col("n_a").cast("double") * F.col("n_b")
        hot = cut(key_rows(a, b, plan).where((F.col("n_a") > hot_rows) | (F.col("n_b") > hot_rows) | (work > hot_pairs)))
        hot = None if hot.isEmpty() else hot
    return Survey(modes, overview, types, hot)


def modes_only(a: DataFrame, b: DataFrame, plan: KeyPlan | None, pairs: Sequence[tuple[str, str]]) -> Modes:
    """The modes alone: from the schema where it settles them, else by one aggregate job."""
    modes = known_modes(a, b, pairs)
    open_pairs = [p for p in pairs if p not in modes]
    if open_pairs:
        modes.update({(r.col_a, r.col_b): r["mode"] for r in pair_types(a, b, open_pairs, plan).collect()})
    return modes
