import random

import pandas as pd
import pytest

from twinledger.operators.preflight import join_size, key_uniqueness, row_counts, run_preflight, sequence_share
from twinledger.operators.profile import (
    crosstab, crosstab_candidates, first_rows, mixed_type_columns, profile_columns, profile_issues, review_sample,
)
from twinledger.operators.records import compare_records
from twinledger.operators import statistics
from twinledger.operators.statistics import compare_statistics, describe_numbers


def findings(frame):
    return {(r.check, r.severity) for r in frame.collect()}


def test_uniqueness_limit(spark):
    # exactly 10% unique is no error
    ten = spark.createDataFrame([(i % 2, i) for i in range(20)], "k int, v int")
    less = spark.createDataFrame([(i % 2, i) for i in range(21)], "k int, v int")
    assert key_uniqueness(ten, ["k"], "A").first()["ratio"] == 0.1
    assert findings(run_preflight(ten, ten, "k")) == set()
    assert ("key_uniqueness", "error") in findings(run_preflight(less, ten, "k"))
    nulls = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    assert key_uniqueness(nulls, ["k"], "A").first()["distinct_keys"] == 1
    assert key_uniqueness(nulls, ["k", "v"], "A").first()["distinct_keys"] == 2


def test_empty_source(spark):
    some = spark.createDataFrame([(1,)], "k int")
    got = run_preflight(some, some.limit(0), "k").where("check = 'key_uniqueness'").first()
    assert got["message"] == "empty source"


@pytest.mark.parametrize("values", [
    [1, 2, 3, 4, 5], [5, 5, 6, 9], [1], [None, 1, 2], [1.0, 1.5, 2.0, 3.0], [0.1, 1.1, 2.1], [2**63 - 1, 2**63 - 2, 7],
    [-3, -2, -1, 0, 1], [1.0, 2.0, 2.5], [-0.5, 0.5, 1.5], [2.0**53, 2.0**53 + 2],
])
def test_sequence_share_against_sorting(spark, values):
    kind = "double" if any(isinstance(v, float) for v in values) else "bigint"
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    ordered = sorted(v for v in values if v is not None)
    gaps = [y - x for x, y in zip(ordered, ordered[1:])]
    row = sequence_share(df, "k").first()
    assert (row.steps_of_one, row.neighbours) == (sum(g == 1 for g in gaps), len(gaps))


def test_sequence_warning_is_strict(spark):
    exactly = spark.createDataFrame([(i,) for i in range(20)] + [(100,)], "k int")
    more = spark.createDataFrame([(i,) for i in range(21)] + [(100,)], "k int")
    assert ("sequence_key", "warning") not in findings(run_preflight(exactly, exactly, "k"))
    assert ("sequence_key", "warning") in findings(run_preflight(more, more, "k"))


def test_row_counts_and_join_size(spark):
    a = spark.createDataFrame([(i // 2,) for i in range(10)], "k int")
    b = spark.createDataFrame([(i,) for i in range(4)], "k int")
    assert tuple(row_counts(a, b).first()) == (10, 4, True)
    size = join_size(a, b, "k").first()
    assert (size.estimated_rows, size.joined_rows, size.refused) == (40.0, 8.0, False)
    big = spark.range(4000).selectExpr("id % 2000 AS k")
    assert join_size(big, big, "k").first()["refused"]
    assert ("join_size", "error") in findings(run_preflight(big, big, "k"))


def test_profile(spark):
    df = spark.createDataFrame(
        [("1", None, 1.0, "a"), ("x", None, float("nan"), "b"), (None, "z", 2.0, None)], "m string, n string, d double, t string")
    for exact in (False, True):
        got = {r.column: (r.type, round(r.null_pct, 1), r.n_distinct, r.is_mixed, r.high_null) for r in profile_columns(df, exact).collect()}
        assert got == {
            "m": ("string", 33.3, 2, True, False), "n": ("string", 66.7, 1, False, True),
            "d": ("double", 33.3, 2, False, False), "t": ("string", 33.3, 2, False, False)}
    assert tuple(profile_issues(profile_columns(df)).first()) == (1, 1)
    assert [r[0] for r in mixed_type_columns(df).collect()] == ["m"]
    assert profile_columns(df.limit(0)).isEmpty()


def test_crosstab(spark):
    a = spark.createDataFrame([(i, i % 3, i, "g1" if i < 6 else "g2" if i < 11 else None) for i in range(12)], "k int, v int, w int, g string")
    b = a.selectExpr("k", "CASE WHEN k IN (0, 1, 7, 11) THEN -1 ELSE v END AS v")
    found = compare_records(a, b, "k", {"v": "v"})
    got = [tuple(r) for r in crosstab(a, "a", found.plan, found.findings, "g").collect()]
    assert got == [("g1", 2, 66.7), ("g2", 1, 33.3)]
    assert {r.column for r in crosstab_candidates(a, ["k"]).collect()} == {"v", "g"}
    # a share of exactly one half is too much
    half = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "b")], "k int, g string")
    assert crosstab_candidates(half, ["k"]).isEmpty()


def test_review_sample_is_repeatable(spark):
    a = spark.range(300).selectExpr("id AS k", "id AS v")
    b = a.selectExpr("k", "v + 1 AS v")
    found = compare_records(a, b, "k", {"v": "v"}).mismatches
    draws = [{r.key_df1 for r in review_sample(f, 20).collect()} for f in (found, found.repartition(13), found.coalesce(1))]
    assert len(draws[0]) == 20 and draws[0] == draws[1] == draws[2]
    assert draws[0] != {r.key_df1 for r in review_sample(found, 20, seed=1).collect()}


def test_first_rows(spark):
    assert [r[0] for r in first_rows(spark.range(100).repartition(9), 3, ["id"]).collect()] == [0, 1, 2]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_statistics_against_pandas(spark, accuracy):
    rng = random.Random(4)
    values = {"u": [rng.gauss(0, 100) for _ in range(3001)], "dup": [float(rng.randint(0, 3)) for _ in range(3001)],
              "few": [1.5] + [None] * 3000, "none": [None] * 3001, "text": [str(i) if i % 50 else " " for i in range(3001)]}
    df = spark.createDataFrame(list(zip(*values.values())), "u double, dup double, few double, none double, text string").repartition(5)
    got = describe_numbers(df, list(values), accuracy)
    for name, column in values.items():
        want = pd.to_numeric(pd.Series(column, dtype=object), errors="coerce").astype(float).describe()
        for value, expected in zip(got[name], want):
            assert (value is None and expected != expected) or value == pytest.approx(expected), name


def test_compare_statistics(spark):
    a = spark.createDataFrame([(1.0, "x"), (3.0, "y")], "n double, t string")
    b = spark.createDataFrame([("2", "x"), ("2", "y")], "m string, u string")
    rows = {(r.column, r.metric): (r.a, r.b, r.abs_diff, r.rel_diff) for r in compare_statistics(a, b, {"n": "m", "t": "u"}).collect()}
    assert rows[("n", "mean")] == (2.0, 2.0, 0.0, 0.0)
    assert rows[("n", "25%")] == (1.5, 2.0, -0.5, -0.25)
    assert rows[("n", "std")][1] == 0.0 and rows[("n", "std")][3] is None
    assert rows[("t", "mean")] == (None, None, None, None) and len(rows) == 16
    with pytest.raises(KeyError):
        compare_statistics(a, b, {"n": "nope"})


def test_statistics_whose_brackets_fail(spark, monkeypatch):
    df = spark.range(1000).selectExpr("double(id) AS u", "double(id % 7) AS w").repartition(6)
    want = describe_numbers(df, ["u", "w"])
    assert want["u"][4:7] == (249.75, 499.5, 749.25)
    right = statistics._facts
    passes = []

    def wrong(values, width, accuracy):
        facts = right(values, width, accuracy)
        facts[0][0] = (*facts[0][0][:5], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
        return facts

    found = statistics._find
    monkeypatch.setattr(statistics, "_facts", wrong)
    monkeypatch.setattr(statistics, "_find", lambda values, ranks: passes.append(len(ranks)) or found(values, ranks))
    assert describe_numbers(df, ["u", "w"]) == want
    assert passes == [2, 1]


def test_statistics_with_infinities(spark):
    low, high = float("-inf"), float("inf")
    df = spark.createDataFrame([(v,) for v in [low] * 6 + [1.0] * 8 + [high] * 7], "u double")
    assert describe_numbers(df, ["u"])["u"][3:] == (low, low, 1.0, high, high)


def test_brackets_that_touch_are_one():
    nan = float("nan")
    assert statistics._apart([(1.0, 2.0), (2.0, 3.0), (4.0, 5.0)]) == [(1.0, 3.0), (4.0, 5.0)]
    assert [repr(x) for x in statistics._apart([(1.0, nan), (2.0, nan)])] == ["(1.0, nan)"]


def test_statistics_reads_each_side_twice(spark, tmp_path):
    for side in "ab":
        spark.range(50_000).selectExpr("sqrt(id) AS x", "double(id % 10) AS y").repartition(4).write.parquet(f"{tmp_path}/{side}")
    a, b = (spark.read.parquet(f"{tmp_path}/{side}") for side in "ab")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("statistics", "")
    try:
        got = compare_statistics(a, b, {"x": "x", "y": "y"}).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.abs_diff for r in got} == {0.0}
    # the last job is the collect of this test
    assert 3 < len(tracker.getJobIdsForGroup("statistics")) - 1 <= 8
