import pytest
from pyspark.sql import functions as F

from twinledger import Pair
from twinledger.operators.keys import rows_of_keys
from twinledger.operators.records import compare_records
from twinledger.operators.scores import (
    clean_columns, column_scores, coverage_summary, match_score, mismatch_frequency, narrative, score_band, weighted_score,
)

ROW = ("<ROW MISSING>",) * 4
SCHEMA = "key_df1 string, key_df2 string, col_df1 string, col_df2 string, val_df1 string, val_df2 string, match_type string"


def cell(key, column):
    return (key, key, column, column, "1", "2", "Value Mismatch")


FOUND = [
    cell("1", "x"), cell("1", "y"), cell("1", "y"), cell("2", "y"),
    ("3", "<MISSING>", *ROW, "Missing in Source B"), ("3", "<MISSING>", *ROW, "Missing in Source B"),
    ("<MISSING>", "4", *ROW, "Missing in Source A"),
]


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(FOUND, SCHEMA)


def overview(spark, total=14, joined=10):
    return spark.createDataFrame([(total, joined)], "total_keys bigint, joined_count bigint")


def test_summary(spark, found):
    row = coverage_summary(found, overview(spark)).first()
    assert row.asDict() | {"narrative": None, "band": None} == {
        "score": 71.4, "total_keys": 14, "joined_count": 10, "missing_in_a": 1, "missing_in_b": 1, "mismatch_count": 2,
        "fully_matched": 8, "band": None, "narrative": None}


def test_match_score_edges(spark, found):
    nothing = found.limit(0)
    assert match_score(nothing, overview(spark)).first()["score"] == 100.0
    assert match_score(found, overview(spark, 0, 0)).first()["score"] == 0.0
    assert match_score(found, overview(spark, 2, 2)).first()["score"] == 0.0


def test_weighted_score(spark, found):
    # x: 1 key, weight 3; y: 2 keys, weight 1: (3 + 2) / max(1, 4 / 2) = 2.5 of 14
    got = weighted_score(found, overview(spark), {"x": 3.0}).first()
    assert got["weighted_score"] == pytest.approx((1 - 2.5 / 14) * 100)
    assert got["weighted_score_rounded"] == 82.1
    # a mean weight below 1 does not raise the penalty
    assert weighted_score(found, overview(spark), {"x": 0.1, "y": 0.1}).first()["weighted_score"] == pytest.approx((1 - 0.3 / 14) * 100)
    only_missing = found.where("col_df1 = '<ROW MISSING>'")
    assert weighted_score(only_missing, overview(spark), {}).first()["weighted_score"] == 100.0
    assert weighted_score(only_missing, overview(spark, 0), {}).first()["weighted_score"] == 0.0
    assert weighted_score(found.limit(0), overview(spark, 0), {}).first()["weighted_score"] == 100.0


def test_per_column(spark, found):
    got = [tuple(r) for r in column_scores(found, 10).collect()]
    assert got == [("y", 2, 80.0), ("x", 1, 90.0)]
    assert [tuple(r) for r in column_scores(found, overview(spark)).collect()] == got
    assert column_scores(found, 0).isEmpty()
    assert [tuple(r) for r in mismatch_frequency(found).collect()] == [("y", 3), ("x", 1)]
    assert [r[0] for r in clean_columns(found, [Pair("z", "z"), Pair("x", "x"), Pair("a", "a")]).collect()] == ["a", "z"]


def test_counted_tables_give_the_same(spark, found):
    counted = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n_rows"))
    assert coverage_summary(counted, overview(spark)).first() == coverage_summary(found, overview(spark)).first()
    assert [tuple(r) for r in mismatch_frequency(counted).collect()] == [("y", 3), ("x", 1)]


@pytest.mark.parametrize("score, band, words", [
    (100.0, "Excellent Match", "All clear!"), (95.0, "Excellent Match", "Mostly matched"), (94.9, "Review Recommended", "Review recommended."),
    (80.0, "Review Recommended", "Review recommended."), (79.9, "Significant Mismatches", "Significant mismatch"),
    (50.0, "Significant Mismatches", "Significant mismatch"), (49.9, "Likely Column Mismatch", "Significant mismatch"),
])
def test_bands(spark, score, band, words):
    row = spark.range(1).select(score_band(F.lit(score)), narrative(F.lit(score))).first()
    assert row[0].startswith(band) and row[1].startswith(words)


def test_keys_are_told_apart_by_their_parts(spark):
    """Composite keys that show as the same text, and texts that look like the markers."""
    rows = "x string, y string, v int"
    a = spark.createDataFrame([("x|y", "z", 1), ("x", "y|z", 1), ("<NULL>", "m", 1), (None, "m", 2), ("<MISSING>", "q", 5)], rows)
    b = spark.createDataFrame([("x|y", "z", 2), ("x", "y|z", 3), ("<null>", "m", 1), ("k", "k", 1)], rows)
    found = compare_records(a, b, (["x", "y"], ["x", "y"]), {"v": "v"})
    summary = coverage_summary(found.findings, found.overview).first()
    assert (summary.total_keys, summary.joined_count, summary.mismatch_count) == (6, 3, 2)
    assert (summary.missing_in_a, summary.missing_in_b, summary.score) == (1, 2, round(100 * (1 - 5 / 6), 1))
    assert column_scores(found.findings, found.overview).first().mismatches == 2
    rows = rows_of_keys(a, "a", found.plan, found.findings).collect()
    assert sorted((r.x or "", r.y) for r in rows) == [("", "m"), ("<MISSING>", "q"), ("x", "y|z"), ("x|y", "z")]
    assert "key_parts" not in found.mismatches.columns


def test_missing_keys_can_be_left_out(spark):
    a = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "k double, v int")
    assert compare_records(a, a.where("v <> 1"), "k", {"v": "v"}, null_keys="drop").mismatches.count() == 1
