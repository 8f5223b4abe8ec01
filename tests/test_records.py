import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinledger import AnyOf, Pair
from twinledger.functions.similarity import indel_percent, similarity, token_sorted
from twinledger.operators import records
from twinledger.operators.coercion import apply_overrides, convert_numeric_columns, numeric_pairs, pair_types
from twinledger.operators.keys import KeyPlan, joined_key_count, key_overview, key_rows, latest_per_key, union_key_count
from twinledger.operators.records import compare_any_of, compare_records, matched_rows, missing_rows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def cells(mismatches):
    return Counter(tuple(r) for r in mismatches.collect())


def modes_of(spark, left, right):
    a = frame(spark, [(i, v) for i, v in enumerate(left)], "k int, x string")
    b = frame(spark, [(i, v) for i, v in enumerate(right)], "k int, x string")
    row = pair_types(a, b, [("x", "x")], KeyPlan.of(a, b, [("k", "k")])).first()
    return row["mode"], row["note"]


@pytest.mark.parametrize("left, right, mode, note", [
    (["1", "2"], ["1", "2"], "numeric", "Numeric handling applied"),
    (["1", " "], ["1", "2"], "numeric", "Numeric handling applied (blanks standardized to missing)"),
    (["a", "2"], ["1", "2"], "text", "String fallback — mixed types"),
    (["a", ""], ["b", "c"], "text", "String fallback — mixed types (blanks standardized to missing)"),
    (["A1", "2"], ["1", "2"], "text", "ID pattern detected — string comparison"),
    (["01", ""], ["1", "2"], "text", "ID pattern detected — string comparison (blanks normalized to missing)"),
    ([None, None], ["1", "2"], "text", "String fallback — mixed types"),
    # exactly 5% identifiers, or exactly 90% numbers, do not pass
    (["A1"] + ["1"] * 19, ["1"] * 20, "numeric", "Numeric handling applied"),
    (["A1", "A2"] + ["1"] * 18, ["1"] * 20, "text", "ID pattern detected — string comparison"),
    (["x"] + ["1"] * 9, ["1"] * 10, "text", "String fallback — mixed types"),
    (["x"] + ["1"] * 10, ["1"] * 11, "numeric", "Numeric handling applied"),
])
def test_type_decision(spark, left, right, mode, note):
    assert modes_of(spark, left, right) == (mode, note)


def test_types_follow_the_matched_rows_with_their_multiplicity(spark):
    # key 1 is matched twice, so its identifier counts twice; key 9 is not matched
    a = frame(spark, [(1, "A1"), (2, "2"), (9, "A9")], "k int, x string")
    b = frame(spark, [(1, "1"), (1, "1"), (2, "2")], "k int, x string")
    row = pair_types(a, b, [("x", "x")], KeyPlan.of(a, b, [("k", "k")])).first()
    assert (row.n_a, row.n_b) == (3, 3)
    assert row.id_rate_a == pytest.approx(2 / 3)
    whole = pair_types(a, b, [("x", "x")]).first()
    assert (whole.n_a, whole.n_b, whole.id_rate_a) == (3, 3, pytest.approx(2 / 3))


A_ROWS = [("1", "100", "History", 1.0), ("2", None, "art", 2.0), (" 3 ", "7", " ", 3.0), ("4", "5", "x", float("nan")), ("a9", "1", "y", 5.0)]
B_ROWS = [("1", 100.0, " HISTORY ", 1.000001), ("2", 3.0, None, 2.1), ("3", 7.0, None, None), ("A9", 1.0, "z", 5.0), ("6", 1.0, "q", 1.0)]


def test_cell_rules_and_labels(spark):
    a = frame(spark, A_ROWS, "id string, n string, t string, d double")
    b = frame(spark, B_ROWS, "key string, n2 double, t2 string, d2 double")
    found = compare_records(a, b, ("id", "key"), {"n": "n2", "t": "t2", "d": "d2"}).mismatches
    assert cells(found) == Counter([
        ("2", "2", "n", "n2", None, "3", "Missing Value"),
        ("2", "2", "t", "t2", "art", None, "Missing Value"),
        ("2", "2", "d", "d2", "2", "2.1", "Value Mismatch"),
        ("3", "3", "d", "d2", "3", None, "Missing Value"),
        ("A9", "A9", "t", "t2", "y", "z", "Value Mismatch"),
        ("4", "<MISSING>") + ("<ROW MISSING>",) * 4 + ("Missing in Source B",),
        ("<MISSING>", "6") + ("<ROW MISSING>",) * 4 + ("Missing in Source A",),
    ])
    # the caller's frames are as they were
    assert a.columns == ["id", "n", "t", "d"] and a.first()["id"] == "1"


def test_a_blank_is_missing_but_labelled_by_its_raw_value(spark):
    a = frame(spark, [(1, "  ")], "k int, t string")
    b = frame(spark, [(1, "x")], "k int, t string")
    assert compare_records(a, b, "k", {"t": "t"}).mismatches.first()["match_type"] == "Value Mismatch"


def test_case_sensitive_and_missing_keys(spark):
    a = frame(spark, [("x", 1), (None, 2)], "k string, v int")
    b = frame(spark, [("X", 1), (None, 3)], "k string, v int")
    loose = compare_records(a, b, "k", {"v": "v"}).mismatches
    assert cells(loose) == Counter([("<NULL>", "<NULL>", "v", "v", "2", "3", "Value Mismatch")])
    strict = compare_records(a, b, "k", {"v": "v"}, case_sensitive=True).mismatches
    assert {r.match_type for r in strict.collect()} == {"Value Mismatch", "Missing in Source A", "Missing in Source B"}
    assert compare_records(a, b, "k", {"v": "v"}, null_keys="drop").mismatches.isEmpty()


def test_integral_keys_with_nulls(spark):
    a = frame(spark, [(0, 1), (None, 2)], "k int, v int")
    b = frame(spark, [(0, 1), (None, 2)], "k bigint, v int")
    assert compare_records(a, b, "k", {"v": "v"}).mismatches.isEmpty()
    assert compare_records(a, b.where("k = 0"), "k", {"v": "v"}).mismatches.first()["key_df1"] == "<NULL>"


def test_composite_keys_do_not_collide(spark):
    a = frame(spark, [("a|b", "c", 1)], "x string, y string, v int")
    b = frame(spark, [("a", "b|c", 1)], "x string, y string, v int")
    found = compare_records(a, b, (["x", "y"], ["x", "y"]), {"v": "v"}).mismatches
    assert {r.match_type for r in found.collect()} == {"Missing in Source A", "Missing in Source B"}


def test_column_names_with_dots_and_on_both_sides(spark):
    a = frame(spark, [(1, 2, "p")], "`k.1` int, `v v` int, same string")
    b = frame(spark, [(1, 3, "q")], "`k.1` int, `v'v` int, same string")
    found = compare_records(a, b, "k.1", {"v v": "v'v", "same": "same"}).mismatches
    assert cells(found) == Counter([
        ("1", "1", "v v", "v'v", "2", "3", "Value Mismatch"), ("1", "1", "same", "same", "p", "q", "Value Mismatch")])


def test_any_of(spark):
    a = frame(spark, [(1, "MATH"), (2, "ART"), (3, None), (4, "BIO"), (5, "5")], "k int, m string")
    b = frame(spark, [(1, "x", "math"), (2, "art ", "y"), (3, "z", ""), (4, "c", "d"), (6, "e", "f")], "k int, m1 string, m2 string")
    found = compare_any_of(a, b, "k", {"m": ["m1", "m2"]}).mismatches
    assert cells(found) == Counter([
        ("4", "4", "m", "m1", "BIO", "c", "m vs m1"), ("4", "4", "m", "m2", "BIO", "d", "m vs m2"),
        ("5", "<MISSING>") + ("<ROW MISSING>",) * 4 + ("missing_key",),
        ("<MISSING>", "6") + ("<ROW MISSING>",) * 4 + ("missing_key",),
    ])


def test_any_of_with_numeric_and_text_targets(spark):
    a = frame(spark, [(1, "1.0"), (2, "2"), (3, "x")] + [(i, "1") for i in range(10, 40)], "k int, m string")
    b = frame(spark, [(1, 1.0, "q"), (2, 5.0, "2"), (3, 1.0, "X")] + [(i, 1.0, "t") for i in range(10, 40)], "k int, n double, t string")
    found = compare_any_of(a, b, "k", [AnyOf("m", ("n", "t"))])
    assert found.survey.modes == {("m", "n"): "numeric", ("m", "t"): "text"}
    assert found.mismatches.isEmpty()


def test_few_cells_need_a_score(spark):
    """Cells that the edit distance settles never reach Python."""
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefgh ", k=12)).strip() + "q" for _ in range(400)]
    near = [n if i % 3 else n[:5] + "x" + n[6:] for i, n in enumerate(names)]
    far = [n if i % 5 else "".join(rng.sample(n, len(n))) for i, n in enumerate(near)]
    rows = spark.createDataFrame(list(zip(names, far)), "a string, b string").selectExpr(
        f"named_struct('text_a', {token_sorted('a')}, 'text_b', {token_sorted('b')}, 'threshold', 85) AS cell").cache()
    judged = records._Engine.open_cells(rows)
    words = lambda x: " ".join(sorted(x.split()))
    failing = sum(indel_percent(words(a), words(b)) < 85 for a, b in zip(names, far))
    assert judged.where("reached IS NULL").count() < 0.2 * sum(a != b for a, b in zip(names, far))
    kept = judged.withColumn("score", similarity(F.col("cell.text_a"), F.col("cell.text_b"))).where("score < cell.threshold").count()
    assert kept == failing > 20


def test_fuzzy_equality(spark):
    rows = [(1, "Smith, John", "john smith"), (2, "Acme Corporation", "Acme Corporatoin"), (3, "Alpha", "Omega"),
            (4, None, "x"), (5, None, " "), (6, "a", "a much longer text than that")]
    a = frame(spark, [(k, x) for k, x, _ in rows], "k int, t string")
    b = frame(spark, [(k, y) for k, _, y in rows], "k int, u string")
    fuzzy = compare_records(a, b, "k", [Pair("t", "u", threshold=90)]).mismatches
    assert {r.key_df1 for r in fuzzy.collect()} == {"3", "4", "6"}
    exact = compare_records(a, b, "k", [Pair("t", "u")]).mismatches
    assert {r.key_df1 for r in exact.collect()} == {"1", "2", "3", "4", "6"}
    hot = compare_records(a, b, "k", [Pair("t", "u", threshold=90)], hot_rows=0).mismatches
    assert cells(hot) == cells(fuzzy)


def random_sides(spark, seed, n=120):
    rng = random.Random(seed)
    texts = ["x", "X ", "y", None, "", "12", "A1"]
    def side():
        return [(rng.choice([None, *range(25)]), rng.choice("pqP"), rng.choice(texts), rng.choice([1.0, 1.000001, 2.0, None, float("nan")]))
                for _ in range(n)]
    schema = "k int, g string, t string, d double"
    return frame(spark, side(), schema), frame(spark, side(), schema)


KEYS, MAP = (["k", "g"], ["k", "g"]), {"t": "t", "d": "d"}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_plans_agree(spark, seed):
    """Full join, hot keys apart (some or all), and counted rows give the same findings on many-to-many keys."""
    a, b = random_sides(spark, seed)
    expected = cells(compare_records(a, b, KEYS, MAP, skew="none").mismatches)
    for floor in (0, 3):
        assert cells(compare_records(a, b, KEYS, MAP, hot_rows=floor).mismatches) == expected
    for options in ({}, {"hot_rows": 2}):
        counted = compare_records(a, b, KEYS, MAP, counted=True, **options).mismatches
        assert Counter({tuple(r)[:7]: int(r.n_rows) for r in counted.collect()}) == expected
    groups = {"t": ["t", "g"], "d": ["d"]}
    any_of = cells(compare_any_of(a, b, "k", groups, skew="none").mismatches)
    assert cells(compare_any_of(a, b, "k", groups, hot_rows=2).mismatches) == any_of


def test_against_brute_force(spark):
    a, b = random_sides(spark, 5, 60)
    rows_a, rows_b = a.collect(), b.collect()
    key = lambda r: ("<NULL>" if r.k is None else str(r.k), r.g.strip().upper())
    want = Counter()
    num = lambda v: None if v is None or v != v else v
    txt = lambda v: (v or "").strip().upper()
    for x in rows_a:
        for y in rows_b:
            if key(x) == key(y):
                p, q = num(x.d), num(y.d)
                if (p is None) != (q is None) or (p is not None and abs(p - q) > 1e-8 + 1e-5 * abs(q)):
                    want[("|".join(key(x)), "d")] += 1
                if txt(x.t) != txt(y.t):
                    want[("|".join(key(x)), "t")] += 1
    lone_a = sum(1 for x in rows_a if key(x) not in {key(y) for y in rows_b})
    lone_b = sum(1 for y in rows_b if key(y) not in {key(x) for x in rows_a})
    found = compare_records(a, b, KEYS, MAP).mismatches.collect()
    assert Counter((r.key_df1, r.col_df1) for r in found if r.col_df1 != "<ROW MISSING>") == want
    assert sum(r.match_type == "Missing in Source B" for r in found) == lone_a
    assert sum(r.match_type == "Missing in Source A" for r in found) == lone_b


def test_same_table_and_swapped_sides(spark):
    a, b = random_sides(spark, 9)
    unique = a.dropDuplicates(["k", "g"]).where("g <> 'P'")
    assert compare_records(unique, unique, KEYS, MAP).mismatches.isEmpty()
    for side, other in (("a", "b"), ("b", "a")):
        got = missing_rows(a, b, KEYS, side).collect()
        assert Counter(r[0] for r in got) == Counter(r[0] for r in missing_rows(b, a, KEYS, other).collect())


def test_result_does_not_depend_on_partitions(spark):
    a, b = random_sides(spark, 11)
    one = cells(compare_records(a.coalesce(1), b.coalesce(1), KEYS, MAP).mismatches)
    assert cells(compare_records(a.repartition(7), b.repartition(5), KEYS, MAP).mismatches) == one


def test_very_many_pairs(spark):
    n = 260
    schema = "k int, " + ", ".join(f"c{i} int" for i in range(n))
    a = frame(spark, [(1, *range(n)), (2, *range(n))], schema)
    b = frame(spark, [(1, *range(n)), (2, *[i + (i % 130 == 0) for i in range(n)])], schema)
    found = compare_records(a, b, "k", {f"c{i}": f"c{i}" for i in range(n)}).mismatches
    assert sorted(r.col_df1 for r in found.collect()) == ["c0", "c130"]


def test_key_counts(spark):
    a, b = random_sides(spark, 3)
    plan = KeyPlan.of(a, b, [("k", "k"), ("g", "g")])
    view = key_overview(key_rows(a, b, plan)).first()
    keys = [{(r.k, r.g.upper()) for r in f.select("k", "g").collect()} for f in (a, b)]
    assert view.total_keys == len(keys[0] | keys[1]) == union_key_count(a, b, plan).first()[0]
    assert view.joined_count == len(keys[0] & keys[1]) == joined_key_count(a, b, plan).first()[0]
    assert view.joined_count + view.missing_in_a + view.missing_in_b == view.total_keys
    assert view.joined_rows == matched_rows(a, b, KEYS, ["t"], ["d"]).count()
    assert abs(union_key_count(a, b, plan, approximate=True).first()[0] - view.total_keys) <= 5


def test_argument_checks(spark):
    a = frame(spark, [(1, 2)], "k int, v int")
    for keys, columns in (("nope", {"v": "v"}), ("k", {"v": "nope"})):
        with pytest.raises(KeyError):
            compare_records(a, a, keys, columns)
    for bad in ({"columns": [Pair("v", "v"), Pair("k", "v")]}, {"columns": {"v": "v"}, "hot_rows": -1},
                {"columns": {"v": "v"}, "skew": "x"}, {"columns": {"v": "v"}, "null_keys": "x"}):
        with pytest.raises(ValueError):
            compare_records(a, a, "k", **bad)


def test_convert_numeric_columns(spark):
    rows = [("1", "1", str(i)) for i in range(8)] + [("x", "x", "01"), (None, "2", "02")]
    out = convert_numeric_columns(frame(spark, rows, "eight string, nine string, all string"), ["eight", "nine", "all", "none"])
    # exactly 80% of all rows does not pass
    assert dict(out.dtypes) == {"eight": "string", "nine": "double", "all": "double"}


def test_type_overrides(spark):
    df = frame(spark, [("1", "2.5", "2024-01-02", 3.0), ("x", "3", "01/31/2024", 4.0)], "a string, b string, c string, d double")
    out = apply_overrides(df, {"a": "Numeric", "b": "Integer", "c": "Datetime", "d": "String", "zz": "Numeric"})
    # b holds a fraction and stays as it is
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "timestamp_ntz", "d": "string"}
    rows = out.orderBy("d").collect()
    assert [r.a for r in rows] == [1.0, None] and [r.d for r in rows] == ["3", "4"]
    assert [str(r.c) for r in rows] == ["2024-01-02 00:00:00", "2024-01-31 00:00:00"]
    assert apply_overrides(df, {"d": "Integer", "a": "Auto"}).dtypes[3] == ("d", "bigint")


def test_numeric_pair_filter(spark):
    a = frame(spark, [("1", "x")], "n string, t string")
    got = {r.col_a: r.kept for r in numeric_pairs(a, a, [("n", "n"), ("t", "t")]).collect()}
    assert got == {"n": True, "t": False}


def test_latest_per_key(spark):
    df = frame(spark, [("a", 1, 1), ("a", 3, 2), ("a", 3, 9), ("b", 0, 5)], "k string, term int, tie int")
    got = latest_per_key(df, ["k"], ["term", "tie"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 3, 9), ("b", 0, 5)]


def test_a_third_of_all_rows_on_one_key(spark):
    """100 million matched rows of one key are counted without being built."""
    rows = spark.range(30_000, numPartitions=4)
    a = rows.selectExpr("IF(id % 3 = 0, 0, id) AS k", "id % 7 AS v")
    b = rows.selectExpr("IF(id % 3 = 0, 0, id) AS k", "IF(id % 10 = 0, 8, id % 7) AS v")
    result = compare_records(a, b, "k", {"v": "v"}, counted=True, hot_rows=1_000)
    assert [r["__key0"] for r in result.survey.hot.collect()] == [0]
    hot_a, hot_b = (Counter(r.v for r in f.where("k = 0").collect()) for f in (a, b))
    want = sum(n * m for x, n in hot_a.items() for y, m in hot_b.items() if x != y)
    got = {r.key_df1: 0 for r in result.mismatches.collect()}
    for r in result.mismatches.collect():
        got[r.key_df1] += int(r.n_rows)
    assert got["0"] == want
    assert set(got) == {"0"} | {str(r.k) for r in b.where("k <> 0 AND v = 8").collect()}
    lone = compare_records(a, b.where("k <> 0"), "k", {"v": "v"}, hot_rows=1_000).mismatches
    assert lone.where("match_type = 'Missing in Source B'").count() == 10_000
