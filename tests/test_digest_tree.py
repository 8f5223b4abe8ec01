"""Digest trees: the findings of the full comparison, from the rows of differing buckets alone."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinledger import Pair
from twinledger.operators import digest_tree as dt
from twinledger.operators.keys import KeyPlan
from twinledger.operators.records import compare_records

COLUMNS = {"x": "x2", "t": "t2", "d": "d2"}


def sides(spark, n, rng, duplicates=False):
    rows_a, rows_b = [], []
    for k in range(n):
        for _ in range(rng.choice((1, 1, 2)) if duplicates else 1):
            x, t, d = rng.choice((None, float(k), k / 3)), rng.choice(("a ", "B", None, "", " é")), rng.choice(("7", "8.50", "n/a"))
            rows_a.append((None if k % 50 == 0 else f"k{k}", x, t, d))
            if rng.random() < 0.05:
                x, t = rng.choice((None, k + 1.0)), rng.choice(("a", "Z"))
            if rng.random() > 0.03:
                rows_b.append((None if k % 50 == 0 else f" K{k} ", None if x is None else x * 1.000001, t.lower() if t else t, f" {d}"))
    a = spark.createDataFrame(rows_a, "k string, x double, t string, d string")
    return a, spark.createDataFrame(rows_b, "key string, x2 double, t2 string, d2 string")


def found(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("duplicates", [False, True])
@pytest.mark.parametrize("buckets", [64, 1 << 16])
def test_findings_equal_the_full_comparison(spark, duplicates, buckets):
    a, b = sides(spark, 300, random.Random(buckets), duplicates)
    for options in ({}, {"null_keys": "drop"}):
        want = found(compare_records(a, b, [("k", "key")], COLUMNS, **options).mismatches)
        changed = dt.compare_changed(a, b, [("k", "key")], COLUMNS, buckets=buckets, **options)
        assert found(changed.mismatches) == want and want and changed.n_differing <= buckets


def test_equal_sides_with_duplicates_have_findings(spark):
    """A key with two values on both sides: all sums are equal, and yet each value meets the other."""
    a = spark.createDataFrame([("k", 1), ("k", 2), ("m", 5), ("m", 5)], "k string, v int")
    assert found(dt.compare_changed(a, a, "k", {"v": "v"}).mismatches) == found(compare_records(a, a, "k", {"v": "v"}).mismatches) != Counter()
    once = a.where("v <> 2")
    changed = dt.compare_changed(once, once, "k", [Pair("v", "v")])
    assert changed.n_differing == 0 and changed.mismatches.isEmpty()


def test_similar_texts_and_empty_sides(spark):
    a = spark.createDataFrame([(1, "blue house"), (2, "green tree")], "k int, t string")
    b = spark.createDataFrame([(1, "house blue"), (2, "red car")], "k int, t string")
    pairs = [Pair("t", "t", threshold=90)]
    assert found(dt.compare_changed(a, b, "k", pairs).mismatches) == found(compare_records(a, b, "k", pairs).mismatches)
    assert found(dt.compare_changed(a, b.limit(0), "k", pairs).mismatches) == found(compare_records(a, b.limit(0), "k", pairs).mismatches)
    with pytest.raises(ValueError):
        dt.compare_changed(a, b, "k", pairs, buckets=0)


def test_digests_of_parts_and_coarser_levels_add_up(spark):
    a, _ = sides(spark, 400, random.Random(1), True)
    plan, pairs, modes = KeyPlan.of(a, a, [("k", "k")]), [("t", "t"), ("x", "x")], {("t", "t"): "text", ("x", "x"): "numeric"}
    a = a.withColumn("part", F.pmod(F.xxhash64("t", "x"), F.lit(3)))
    whole = dt.bucket_digests(a, plan, "a", pairs, modes, 64)
    parts = [dt.bucket_digests(a.where(F.col("part") == i), plan, "a", pairs, modes, 64) for i in range(3)]
    assert dt.differing_buckets(dt.added_up(parts[0].unionByName(parts[1]).unionByName(parts[2])), whole).isEmpty()
    assert dt.differing_buckets(dt.added_up(whole, 8), dt.bucket_digests(a, plan, "a", pairs, modes, 8)).isEmpty()
    changed = a.withColumn("t", F.expr("if(k = 'k7', 'other', t)"))
    one = dt.differing_buckets(dt.bucket_digests(changed, plan, "a", pairs, modes, 64), whole).collect()
    assert len(one) == 1 and one[0].bucket % 8 == dt.differing_buckets(
        dt.bucket_digests(changed, plan, "a", pairs, modes, 8), dt.added_up(whole, 8)).first().bucket


def shuffled_bytes(spark, action):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    empty = lambda: gateway.jvm.java.util.ArrayList()

    def total():
        stages = store.stageList(empty(), False, False, gateway.new_array(gateway.jvm.double, 0), empty())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def test_little_is_shuffled_where_little_changed(spark):
    """One percent of the rows changed in wide rows: a fraction of the full join's bytes."""
    n = 60_000
    wide = [F.sha2((F.col("k") * 31 + i).cast("string"), 512).alias(f"w{i}") for i in range(6)]
    a = spark.range(n).withColumnRenamed("id", "k").select("k", *wide).cache()
    b = a.withColumn("w0", F.expr("if(k % 100 = 0, 'changed', w0)")).cache()
    a.count(), b.count()
    columns, modes = {f"w{i}": f"w{i}" for i in range(6)}, {(f"w{i}", f"w{i}"): "text" for i in range(6)}
    results = {}
    full = shuffled_bytes(spark, lambda: results.update(full=found(compare_records(a, b, "k", columns, modes=modes, skew="none").mismatches)))
    part = shuffled_bytes(spark, lambda: results.update(part=found(
        dt.compare_changed(a, b, "k", columns, modes=modes, unique=True, buckets=1 << 16, skew="none").mismatches)))
    assert results["full"] == results["part"] and len(results["part"]) == n // 100
    print(f"shuffled bytes: {part} of {full}")
    assert part * 5 < full
