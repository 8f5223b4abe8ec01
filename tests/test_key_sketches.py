"""Estimated key counts: exact where sketches are not full, within their bounds beyond, the same whether merged or not."""

import pytest
from pyspark.sql import functions as F

from twinledger.operators import key_sketches as ks
from twinledger.operators.keys import KeyPlan


def sides(spark, n, shift, size):
    a = spark.range(n).selectExpr("id AS k", "id % 7 AS day")
    b = spark.range(shift, shift + size).selectExpr("concat(' ', id, ' ') AS key", "id % 5 AS day")
    return a, b, KeyPlan.of(a, b, [("k", "key")])


def test_few_keys_are_counted_exactly(spark):
    a, b, plan = sides(spark, 1000, 800, 600)
    row = ks.estimated_overview(ks.key_sketches(a, plan, "a", by=["day"]), ks.key_sketches(b, plan, "b")).first()
    assert [row[c] for c in ks.COUNTS] == [1400, 200, 800, 400] and not any(row[f"{c}_bound"] for c in ks.COUNTS)


@pytest.mark.parametrize("n,shift,size", [(60_000, 50_000, 30_000), (60_000, 0, 60_000), (60_000, 60_000, 500), (200_000, 199_990, 50_000)])
def test_many_keys_lie_within_their_bounds(spark, n, shift, size):
    a, b, plan = sides(spark, n, shift, size)
    row = ks.estimated_overview(ks.key_sketches(a, plan, "a"), ks.key_sketches(b, plan, "b", by=["day"]), ).first()
    both = max(0, min(n, shift + size) - shift)
    for c, exact in zip(ks.COUNTS, (n + size - both, both, n - both, size - both)):
        assert abs(row[c] - exact) <= row[f"{c}_bound"], (c, row)
    assert row["total_keys_bound"] < 0.1 * (n + size)


def test_stored_days_merge_to_the_whole(spark):
    a, _, plan = sides(spark, 30_000, 0, 10)
    days = ks.key_sketches(a, plan, "a", by=["day"])
    assert days.count() == 7
    again = ks.merged(days.unionByName(ks.key_sketches(a.where("day < 3"), plan, "a", by=["day"])))
    row = again.select("n_rows", F.theta_sketch_estimate("sketch").alias("n")).first()
    assert row.n_rows == 30_000 + a.where("day < 3").count() and abs(row.n - 30_000) < 0.05 * 30_000
    assert ks.merged(days, by=["day"]).count() == 7


def test_no_rows(spark):
    a, b, plan = sides(spark, 20, 0, 10)
    row = ks.estimated_overview(ks.key_sketches(a.limit(0), plan, "a"), ks.key_sketches(b, plan, "b")).first()
    assert [row[c] for c in ks.COUNTS] == [10, 0, 0, 10]
    row = ks.estimated_overview(ks.key_sketches(a, plan, "a", by=["day"]).limit(0), ks.key_sketches(b, plan, "b")).first()
    assert [row[c] for c in ks.COUNTS] == [10, 0, 0, 10]
