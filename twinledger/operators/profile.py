"""Column profiles, breakdown of mismatched keys by a category, review samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ident, literal, quoted, render, type_of
from ..spec import MISSING_ROW
from .coercion import is_mixed
from .keys import KeyPlan, mismatched_keys

# Limits for a category column, and for a column that is mostly missing.
MAX_CATEGORIES = 50
MAX_CATEGORY_SHARE = 0.5
HIGH_NULL_PCT = 50.0


def _filled(df: DataFrame, name: str) -> str:
    """The rendered value: NaN counts as missing."""
    return render(ident(name), type_of(df, name))


def profile_columns(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """One row per column: type, missing share, distinct values, mixed-type and high-null flags.

    One pass for all columns. Distinct values come from a sketch; ``exact_distinct`` counts them by a second
    pass that groups (column, value). An empty table has no profile.
    """
    totals = ["count(1) AS n"]
    rows = []
    for i, name in enumerate(df.columns):
        totals.append(f"count({_filled(df, name)}) AS filled{i}")
        totals.append(f"{is_mixed(ident(name), type_of(df, name))} AS mixed{i}")
        if not exact_distinct:
            totals.append(f"approx_count_distinct({_filled(df, name)}) AS distinct{i}")
        null_pct = f"try_divide(CAST(n - filled{i} AS DOUBLE), CAST(n AS DOUBLE)) * 100"
        rows.append(
            f"named_struct('column', {literal(name)}, 'type', {literal(type_of(df, name).simpleString())}, 'null_pct', {null_pct}, "
            + ("" if exact_distinct else f"'n_distinct', distinct{i}, ")
            + f"'is_mixed', mixed{i}, 'high_null', {null_pct} > {HIGH_NULL_PCT}D)"
        )
    profile = df.agg(*[F.expr(t) for t in totals]).where("n > 0").selectExpr(f"inline(array({', '.join(rows)}))")
    if exact_distinct:
        profile = profile.join(distinct_values(df, df.columns), "column", "left")
        profile = profile.withColumn("n_distinct", F.expr("coalesce(n_distinct, 0L)"))
    return profile.select("column", "type", "null_pct", "n_distinct", "is_mixed", "high_null")


def distinct_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, n_filled, n_distinct)`` exactly, for columns with at least one value."""
    cells = [f"named_struct('column', {literal(n)}, 'value', {_filled(df, n)})" for n in names]
    values = df.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("n_filled"), F.count(F.lit(1)).alias("n_distinct"))


def profile_issues(profile: DataFrame) -> DataFrame:
    """One row: how many columns are mixed and how many are mostly missing."""
    return profile.agg(F.count_if("is_mixed").alias("mixed_columns"), F.count_if("high_null").alias("high_null_columns"))


def mixed_type_columns(df: DataFrame) -> DataFrame:
    """Names of text columns that hold numbers and other texts."""
    return profile_columns(df).where("is_mixed").select("column")


def crosstab_candidates(df: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """Columns fit to group mismatches by: few distinct values, each repeated; with both counts.

    A sketch discards clearly wide columns in one pass (the driver gets one row); the rest are counted exactly.
    """
    nothing = df.sparkSession.createDataFrame([], "column string, n_filled bigint, n_distinct bigint")
    names = [c for c in df.columns if c not in key_columns]
    if not names:
        return nothing
    sketch = df.agg(*[F.expr(f"approx_count_distinct({_filled(df, c)})") for c in names]).first()
    likely = [c for c, about in zip(names, sketch) if about <= 4 * MAX_CATEGORIES]
    if not likely:
        return nothing
    counts = distinct_values(df, likely)
    few = (F.col("n_distinct") <= MAX_CATEGORIES) & (F.col("n_distinct") < F.col("n_filled") * F.lit(MAX_CATEGORY_SHARE))
    return counts.where(few)


def crosstab(df: DataFrame, side: str, plan: KeyPlan, findings: DataFrame, group_column: str) -> DataFrame:
    """Mismatched keys per value of one column, with the share of the total in percent."""
    keyed = plan.slim(df, side, [quoted(group_column).alias("group_value")]).where("group_value IS NOT NULL")
    pairs = keyed.distinct().join(mismatched_keys(side, plan, findings), plan.names, "left_semi")
    groups = pairs.groupBy("group_value").agg(F.count(F.lit(1)).alias("mismatches"))
    total = groups.agg(F.sum("mismatches").alias("total")).scalar()
    return groups.withColumn("total", total).select(
        "group_value", "mismatches",
        F.round(F.try_divide(F.col("mismatches").cast("double"), F.col("total").cast("double")) * 100, 1).alias("pct_of_total"),
    ).orderBy(F.desc("mismatches"), "group_value")


def review_sample(mismatches: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """A random but repeatable sample of n cell mismatches, the same on any partitioning.

    Rows are ranked by a digest of their content and the seed; each task keeps only its first n.
    """
    cells = mismatches.where(F.col("col_df1") != MISSING_ROW)
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in mismatches.columns], F.lit(str(seed))))
    return cells.withColumn("draw", digest).orderBy("draw", *mismatches.columns).limit(n).drop("draw")


def first_rows(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """The first n rows, in a stable order if one is given."""
    return (df.orderBy(*[quoted(c) for c in order]) if order else df).limit(n)
