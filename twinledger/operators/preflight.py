"""Checks before a comparison: are the keys usable, and how large will the join be?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FLOATING, ident, is_numeric, literal, quoted, type_of
from ..spec import key_pairs
from .keys import KeyPlan
from .rows import side_by_side

# Limits of the checks.
MIN_UNIQUE = 0.10
SAFE_UNIQUE = 0.9
SEQUENCE_SHARE = 0.95
MAX_JOIN_ROWS = 10_000_000


def _grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """The different raw keys with their row count ``__n``.

    All checks of a side start from this same grouping, so that Spark runs its scan and shuffle once.
    """
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))


def key_uniqueness(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """One row ``(side, key_columns, n_rows, distinct_keys, ratio)``; a missing single key is not counted as a key."""
    counted = "count(1)" if len(keys) > 1 else f"count({ident(keys[0])})"
    totals = _grouped(df, keys).agg(F.expr("coalesce(sum(__n), 0L) AS n_rows"), F.expr(f"{counted} AS distinct_keys"))
    return totals.selectExpr(
        f"{literal(side)} AS side", f"{literal('|'.join(keys))} AS key_columns", "n_rows", "distinct_keys",
        "try_divide(CAST(distinct_keys AS DOUBLE), CAST(n_rows AS DOUBLE)) AS ratio",
    )


def sequence_share(df: DataFrame, key: str) -> DataFrame:
    """One row ``(steps_of_one, neighbours, share)``: how often sorted neighbours differ by exactly 1.

    Without sorting: values are grouped by their whole part, keeping only the least and the greatest of each
    group. A step of 1 is a group whose least value is the greatest of the group before, plus 1. Equal values
    are neighbours that differ by 0.
    """
    dtype = type_of(df, key)
    x, exact = f"CAST({ident(key)} AS BIGINT)", "true"
    if isinstance(dtype, FLOATING):
        x = f"nanvl(CAST({ident(key)} AS DOUBLE), NULL)"
        # beyond this the next double is 2 away, so no neighbours differ by 1
        exact = f"abs({x}) < {2.0**53!r}D"
    elif isinstance(dtype, T.DecimalType):
        x = ident(key)
        exact = f"abs({x}) < {2**62}"
    values = _grouped(df, [key]).selectExpr("__n", f"{x} AS v", f"CASE WHEN {exact} THEN CAST(floor({x}) AS BIGINT) END AS whole")
    groups = values.groupBy("whole").agg(
        F.min("v").alias("least"), F.max("v").alias("most"), F.expr("sum(CASE WHEN v IS NOT NULL THEN __n END) AS n")
    )
    # each group also tells the next one its greatest value
    here = "named_struct('whole', whole, 'least', least, 'before', NULL, 'n', n)"
    after = "named_struct('whole', CAST(try_add(whole, 1L) AS BIGINT), 'least', NULL, 'before', most, 'n', NULL)"
    met = groups.selectExpr(f"inline(array({here}, {after}))").groupBy("whole").agg(
        F.max("least").alias("least"), F.max("before").alias("before"), F.sum("n").alias("n")
    )
    totals = met.agg(
        F.expr("count_if(whole IS NOT NULL AND least - before = 1) AS steps_of_one"),
        F.expr("greatest(coalesce(sum(n), 0L) - 1, 0L) AS neighbours"),
    )
    return totals.selectExpr("*", "try_divide(CAST(steps_of_one AS DOUBLE), CAST(neighbours AS DOUBLE)) AS share")


def row_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(rows_a, rows_b, differ)``."""
    counts = side_by_side(a.agg(F.count(F.lit(1)).alias("rows_a")), b.agg(F.count(F.lit(1)).alias("rows_b")))
    return counts.selectExpr("*", "rows_a <> rows_b AS differ")


def join_size(a: DataFrame, b: DataFrame, keys, **key_options) -> DataFrame:
    """One row: uniqueness of both sides, rows_a * rows_b, the exact size of the join, and whether it is refused."""
    pairs = key_pairs(keys)
    plan = KeyPlan.of(a, b, pairs, **key_options)
    facts, sides = [], []
    for df, side, names in ((a, "a", [k for k, _ in pairs]), (b, "b", [k for _, k in pairs])):
        unique = key_uniqueness(df, names, side)
        facts.append(unique.selectExpr(f"n_rows AS rows_{side}", f"ratio AS ratio_{side}"))
        normal = plan.slim(_grouped(df, names), side, [F.col("__n")])
        sides.append(normal.groupBy(*plan.names).agg(F.sum("__n").alias(f"n_{side}")))
    joined = sides[0].join(sides[1], plan.names, "inner")
    exact = joined.agg(F.expr("coalesce(sum(CAST(n_a AS DOUBLE) * n_b), 0.0D) AS joined_rows"))
    return side_by_side(*facts, exact).selectExpr(
        "rows_a", "rows_b", "ratio_a", "ratio_b", "CAST(rows_a AS DOUBLE) * rows_b AS estimated_rows", "joined_rows",
    ).selectExpr(
        "*", f"coalesce((ratio_a < {SAFE_UNIQUE}D OR ratio_b < {SAFE_UNIQUE}D) AND estimated_rows > {MAX_JOIN_ROWS}, false) AS refused"
    )


def run_preflight(a: DataFrame, b: DataFrame, keys, **key_options) -> DataFrame:
    """``(check, severity, subject, observed, message)``: one row per finding. No ``error`` row means safe to run.

    One query: its parts share one grouping of the keys per side, which Spark computes once.
    """
    pairs = key_pairs(keys)
    keys_a, keys_b = [k for k, _ in pairs], [k for _, k in pairs]
    findings = [_uniqueness_findings(key_uniqueness(df, ks, side)) for df, ks, side in ((a, keys_a, "A"), (b, keys_b, "B"))]
    if len(pairs) == 1:
        for df, key in ((a, keys_a[0]), (b, keys_b[0])):
            if is_numeric(type_of(df, key)):
                share = sequence_share(df, key).where(F.col("share") > SEQUENCE_SHARE)
                findings.append(_finding(
                    share, "sequence_key", "warning", F.lit(key), F.col("share"),
                    F.lit(f"key column '{key}' counts up by one: an offset in one source would mispair every record"),
                ))
    size = join_size(a, b, pairs, **key_options)
    findings.append(_finding(
        size.where("rows_a <> rows_b"), "row_counts", "warning", F.lit("rows"), F.expr("CAST(rows_a - rows_b AS DOUBLE)"),
        F.format_string("source A has %d rows and source B has %d", F.col("rows_a"), F.col("rows_b")),
    ))
    findings.append(_finding(
        size.where("refused"), "join_size", "error", F.lit("|".join(keys_a)), F.col("joined_rows"),
        F.format_string("keys are not unique enough: up to %.0f joined rows, %.0f exactly",
                        F.col("estimated_rows"), F.col("joined_rows")),
    ))
    out = findings[0]
    for finding in findings[1:]:
        out = out.unionByName(finding)
    return out


def _uniqueness_findings(row: DataFrame) -> DataFrame:
    empty = F.col("n_rows") == 0
    bad = row.where(empty | (F.col("ratio") < MIN_UNIQUE))
    message = F.when(empty, F.lit("empty source")).otherwise(
        F.format_string("key is only %.1f%% unique: risk of wrong matches", F.col("ratio") * 100)
    )
    return _finding(bad, "key_uniqueness", "error", F.concat_ws(" ", "side", "key_columns"),
                    F.coalesce(F.col("ratio"), F.lit(0.0)), message)


def _finding(rows: DataFrame, check: str, severity: str, subject, observed, message) -> DataFrame:
    return rows.select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"), subject.alias("subject"),
        observed.alias("observed"), message.alias("message"),
    )
