"""Scores and breakdowns of findings (``Comparison.findings``), counted ones too. They count keys by their parts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import MISSING_KEY, MISSING_ROW, Rule
from .keys import FOUND_IN, KEY_PARTS
from .rows import side_by_side

# Score limits with their badge, and with their narrative.
BADGES = (
    (95.0, "Excellent Match"),
    (80.0, "Review Recommended"),
    (50.0, "Significant Mismatches"),
    (None, "Likely Column Mismatch — Check Mapping"),
)
NARRATIVES = (
    (100.0, "All clear! Every record and value matched perfectly between sources."),
    (95.0, "Mostly matched with limited issues. Data integrity is high with few discrepancies."),
    (80.0, "Review recommended. Significant portions match, but some systematic issues may be present."),
    (None, "Significant mismatch volume detected. Verify column mappings and source data consistency."),
)


def ladder(score: Column, steps) -> Column:
    """The text of the first step whose limit the score reaches."""
    out = None
    for limit, text in steps[:-1]:
        out = F.when(score >= limit, F.lit(text)) if out is None else out.when(score >= limit, F.lit(text))
    return out.otherwise(F.lit(steps[-1][1]))


def score_band(score: Column) -> Column:
    return ladder(score, BADGES)


def narrative(score: Column) -> Column:
    return ladder(score, NARRATIVES)


def _any_key(findings: DataFrame) -> Column:
    """What a finding's key is: its parts. A table without them, as written for readers, only has the shown text."""
    if KEY_PARTS in findings.columns:
        return F.col(KEY_PARTS)
    return F.when(F.col("key_df1") == MISSING_KEY, F.col("key_df2")).otherwise(F.col("key_df1"))


def _only_in(findings: DataFrame, side: str) -> Column:
    if FOUND_IN in findings.columns:
        return F.col(FOUND_IN) == side
    return ~_is_cell() & (F.col("key_df1" if side == "b" else "key_df2") == MISSING_KEY)


def _is_cell() -> Column:
    return F.col("col_df1") != MISSING_ROW


def bad_key_counts(mismatches: DataFrame) -> DataFrame:
    """One row: distinct keys with any finding, with a cell mismatch, missing in A, missing in B.

    Keys are reduced to one row each first, so the counts need no distinct aggregates.
    """
    per_key = mismatches.groupBy(_any_key(mismatches).alias("any_key")).agg(
        F.bool_or(_is_cell()).alias("cell"),
        F.bool_or(_only_in(mismatches, "b")).alias("not_in_a"),
        F.bool_or(_only_in(mismatches, "a")).alias("not_in_b"),
    )
    return per_key.agg(
        F.count(F.lit(1)).alias("bad_keys"),
        F.count_if("cell").alias("mismatch_count"),
        F.count_if("not_in_a").alias("missing_in_a"),
        F.count_if("not_in_b").alias("missing_in_b"),
    )


def _score(bad: Column, total: Column) -> Column:
    share = F.try_divide(bad.cast("double"), total.cast("double"))
    return (
        F.when(bad == 0, F.lit(100.0))
        .when(total <= 0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (F.lit(1.0) - share) * 100.0))
    )


def match_score(mismatches: DataFrame, overview: DataFrame) -> DataFrame:
    """Share of keys without any finding: ``score`` as it is and ``score_rounded`` to one decimal."""
    bad = bad_key_counts(mismatches).select("bad_keys")
    row = side_by_side(bad, overview.select("total_keys"))
    return row.select(
        "total_keys", "bad_keys", _score(F.col("bad_keys"), F.col("total_keys")).alias("score")
    ).withColumn("score_rounded", F.round("score", 1))


def _keys_per_column(mismatches: DataFrame) -> DataFrame:
    """Distinct bad keys of every column with a cell mismatch; two groupings, no distinct aggregate."""
    cells = mismatches.where(_is_cell()).select("col_df1", _any_key(mismatches).alias("any_key"))
    return cells.groupBy("col_df1", "any_key").agg(F.lit(1)).groupBy("col_df1").agg(F.count(F.lit(1)).alias("mismatches"))


def _weight(weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for column, weight in weights.items():
        out = F.when(F.col("col_df1") == column, F.lit(float(weight))).otherwise(out)
    return out


def rule_weights(rules: Iterable[Rule]) -> dict[str, float]:
    return {r.a: r.weight for r in rules if r.weight != 1}


def weighted_score(mismatches: DataFrame, overview: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """A score over cell mismatches in which some columns count more."""
    # One grouping serves both: rows without partner form the group of no column.
    column = F.when(_is_cell(), F.col("col_df1"))
    keys = mismatches.select(column.alias("col_df1"), _any_key(mismatches).alias("any_key")).groupBy("col_df1", "any_key").agg(F.lit(1))
    per_column = keys.groupBy("col_df1").agg(F.count(F.lit(1)).alias("mismatches")).withColumn("weight", _weight(weights))
    named = F.col("col_df1").isNotNull()
    sums = per_column.agg(
        F.coalesce(F.sum(F.when(named, F.col("mismatches") * F.col("weight"))), F.lit(0.0)).alias("weighted"),
        F.coalesce(F.sum(F.when(named, F.col("weight"))), F.lit(0.0)).alias("weights"),
        F.count_if(named).alias("bad_columns"),
        F.coalesce(F.sum("mismatches"), F.lit(0)).alias("findings"),
    )
    row = side_by_side(sums, overview.select("total_keys"))
    mean_weight = F.greatest(F.lit(1.0), F.try_divide(F.col("weights"), F.col("bad_columns")))
    effective = F.try_divide(F.col("weighted"), mean_weight)
    total = F.col("total_keys").cast("double")
    score = (
        F.when(F.col("findings") == 0, F.lit(100.0))
        .when(F.col("total_keys") <= 0, F.lit(0.0))
        .when(F.col("bad_columns") == 0, F.lit(100.0))
        .otherwise(F.greatest(F.lit(0.0), (F.lit(1.0) - F.try_divide(effective, total)) * 100.0))
    )
    return row.select("total_keys", score.alias("weighted_score")).withColumn(
        "weighted_score_rounded", F.round("weighted_score", 1)
    )


def column_scores(mismatches: DataFrame, joined_count: int | DataFrame) -> DataFrame:
    """Match rate of every column with a mismatch over the keys found on both sides, worst first."""
    joined = F.lit(joined_count) if isinstance(joined_count, int) else joined_count.select("joined_count").scalar()
    return (
        _keys_per_column(mismatches)
        .withColumn("joined_count", joined)
        .where(F.col("joined_count") > 0)
        .select(
            F.col("col_df1").alias("column"),
            "mismatches",
            ((F.lit(1.0) - F.try_divide(F.col("mismatches").cast("double"), F.col("joined_count").cast("double"))) * 100.0)
            .alias("score"),
        )
        .orderBy("score", "column")
    )


def clean_columns(mismatches: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Mapped columns without any cell mismatch, by name."""
    mapped = mismatches.sparkSession.createDataFrame([(r.a,) for r in rules], "column string")
    bad = mismatches.where(_is_cell()).select(F.col("col_df1").alias("column")).distinct()
    return mapped.join(bad, "column", "left_anti").distinct().orderBy("column")


def mismatch_frequency(mismatches: DataFrame) -> DataFrame:
    """Mismatch rows per column, most first."""
    rows = F.sum("n_rows") if "n_rows" in mismatches.columns else F.count(F.lit(1))
    cells = mismatches.where(_is_cell()).groupBy(F.col("col_df1").alias("column"))
    return cells.agg(rows.alias("mismatch_rows")).orderBy(F.desc("mismatch_rows"), "column")


def coverage_summary(mismatches: DataFrame, overview: DataFrame) -> DataFrame:
    """One row with keys in all, joined, matched in full, mismatched, missing on either side, score, band, narrative."""
    row = side_by_side(bad_key_counts(mismatches), overview.select("total_keys", "joined_count"))
    score = F.round(_score(F.col("bad_keys"), F.col("total_keys")), 1)
    return row.select(
        score.alias("score"), "total_keys", "joined_count", "missing_in_a", "missing_in_b", "mismatch_count",
        (F.col("joined_count") - F.col("mismatch_count")).alias("fully_matched"),
        score_band(score).alias("band"), narrative(score).alias("narrative"),
    )
