"""Estimated key counts from theta sketches: one per side, or per day and side, stored and merged without seeing the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from .keys import KeyPlan
from .rows import side_by_side

# Nominal entries of a sketch as a power of two: up to so many keys counts are exact; a sketch has 32 KB at most.
LG_ENTRIES = 12
# Standard deviations on either side of an estimate.
DEVIATIONS = 3.0

COUNTS = ("total_keys", "in_both", "only_a", "only_b")


def key_sketches(df: DataFrame, plan: KeyPlan, side: str, by: Sequence[str] = (), lg_entries: int = LG_ENTRIES) -> DataFrame:
    """``(*by, n_rows, sketch)``: one row per value of ``by`` (a day, say), or one in all. Sketches are made in every task
    and merged, so keys are not shuffled. Null keys follow the plan, as in exact counts."""
    slim = plan.slim(df, side, [quoted(c).alias(f"by_{i}") for i, c in enumerate(by)])
    groups = [F.col(f"by_{i}").alias(c) for i, c in enumerate(by)]
    return slim.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), F.theta_sketch_agg(F.xxhash64(*plan.names), F.lit(lg_entries)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = (), lg_entries: int = LG_ENTRIES) -> DataFrame:
    """The stored sketches of many days (and runs) as one per value of ``by``, or one in all."""
    return sketches.groupBy(*[quoted(c).alias(c) for c in by]).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.theta_union_agg("sketch", F.lit(lg_entries)).alias("sketch"))


def estimated_overview(sketches_a: DataFrame, sketches_b: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """One row: for each of ``total_keys``, ``in_both``, ``only_a`` and ``only_b`` an estimate and, as ``…_bound``, how far off it may be.

    With k nominal entries, a sketch of a union of U keys holds a sample of each key with probability about k/U. A subset of e keys is
    then estimated with variance about e*U/k; the bound takes three deviations, and some more for small subsets. Up to k keys nothing is left to chance.
    """
    sides = side_by_side(
        merged(sketches_a, lg_entries=lg_entries).select(F.col("sketch").alias("a")),
        merged(sketches_b, lg_entries=lg_entries).select(F.col("sketch").alias("b")))
    lg = F.lit(lg_entries)
    made = sides.select(
        F.theta_sketch_estimate(F.theta_union("a", "b", lg)).alias("total_keys"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("in_both"),
        F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("only_a"),
        F.theta_sketch_estimate(F.theta_difference("b", "a")).alias("only_b"))
    return made.select(*COUNTS, *[_bound(c, 2**lg_entries).alias(f"{c}_bound") for c in COUNTS])


def _bound(count: str, entries: int) -> Column:
    share = F.col("total_keys") / F.lit(float(entries))
    return F.when(share <= 1, F.lit(0.0)).otherwise(
        F.lit(DEVIATIONS) * F.sqrt((F.col(count) + F.lit(DEVIATIONS**2) * share) * share))
