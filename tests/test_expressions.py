import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions import similarity as similarity_module
from twinledger.functions.numbers import as_number, is_identifier, locale_text, numbers_differ, parse_number, with_parsed
from twinledger.functions.similarity import common_subsequence, common_subsequences, cosine, indel_percent, indel_percents, reaches, token_sorted
from twinledger.functions.text import drop_null_tokens, is_blank, is_missing, normal_text, present_text, render, strip

TEXT, DOUBLE = T.StringType(), T.DoubleType()


def evaluate(spark, values, kind, *forms):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", *[F.expr(f).alias(f"r{k}") for k, f in enumerate(forms)]).orderBy("i").collect()
    out = [[r[f"r{k}"] for r in rows] for k in range(len(forms))]
    return out[0] if len(forms) == 1 else out


def test_strip_matches_python(spark):
    values = [" a ", "\t　b\xa0", "c d", "", "  ", "\x1fe", "é ", " é", None, " ", "'q' "]
    assert evaluate(spark, values, "string", strip("x")) == [None if v is None else v.strip() for v in values]


def test_normal_and_present_text(spark):
    values = [" history ", "", "  ", None, "ß"]
    normal, present, blank = evaluate(
        spark, values, "string", normal_text("x", TEXT), present_text("x", TEXT), is_blank("x", TEXT))
    assert normal == ["HISTORY", "", "", "", "SS"]
    assert present == ["history", None, None, None, "ß"]
    assert blank == [False, True, True, False, False]


ACCEPTED = {"12": 12.0, " 12 ": 12.0, "+3": 3.0, ".5": 0.5, "5.": 5.0, "1e5": 1e5, "-0.25": -0.25,
            "inf": math.inf, "Infinity": math.inf, "-inf": -math.inf}
REJECTED = ["1_000", "1,000", "$5", "0x10", "True", "", "1 2", "1L", "1d", "1f", "NaN", "nan", "1e400", "-", "+", ".", "e5", "abc"]


def test_parse_number(spark):
    values = list(ACCEPTED) + REJECTED + [None]
    assert evaluate(spark, values, "string", parse_number("x")) == list(ACCEPTED.values()) + [None] * (len(REJECTED) + 1)


def test_numbers_and_rendering_of_doubles(spark):
    values = [100.0, 0.5, float("nan"), None, 12345678.25, -3.0, 1e20, math.inf]
    number, shown, missing = evaluate(spark, values, "double", as_number("x", DOUBLE), render("x", DOUBLE), is_missing("x", DOUBLE))
    assert number == [100.0, 0.5, None, None, 12345678.25, -3.0, 1e20, math.inf]
    assert shown[:6] == ["100", "0.5", None, None, "12345678.25", "-3"]
    assert missing == [False, False, True, True, False, False, False, False]


def test_render_other_types(spark):
    df = spark.createDataFrame([([1, 2], True, 7)], "a array<int>, b boolean, c int")
    row = df.select(*[F.expr(render(f.name, f.dataType)).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(row) == ("[1,2]", "true", "7")


def test_identifier(spark):
    values = ["A12345", "z9", "00123", "0", "12", "AB1", "A1B", "A", "0x1", "A٣"]
    assert evaluate(spark, values, "string", is_identifier("x")) == [
        True, True, True, False, False, False, False, False, False, True]


@pytest.mark.parametrize("a, b, differ", [
    (1.0, 1.0, False), (1.0, 1.000009, False), (1.0, 1.00002, True), (0.0, 1e-9, False), (0.0, 1e-7, True),
    (None, None, False), (None, 0.0, True), (0.0, None, True),
    (math.inf, math.inf, False), (math.inf, -math.inf, True), (1.0, math.inf, True), (math.inf, 1.0, True),
    # the tolerance scales with B
    (100001.0, 100000.0, False), (100000.0, 100001.0, False), (100001.00001, 100000.0, True), (100000.0, 100001.00001, False),
])
def test_tolerance(spark, a, b, differ):
    row = spark.createDataFrame([(a, b)], "a double, b double").select(F.expr(numbers_differ("a", "b"))).first()
    assert row[0] is differ


def test_locale_numbers(spark):
    df = spark.createDataFrame([("1.234,5", "1,234.5"), ("7", " 7 "), ("x", "1.2.3"), (None, None)], "eu string, us string")
    got = with_parsed(df, {"e": locale_text("eu", "EU"), "u": locale_text("us", "US")}).select("e", "u").collect()
    assert [tuple(r) for r in got] == [(1234.5, 1234.5), (7.0, 7.0), (None, None), (None, None)]


def test_null_tokens(spark):
    df = spark.createDataFrame([("NULL", 1), ("N/A", 2), ("-", 3), ("", 4), ("na", 5), (None, 6)], "x string, n int")
    assert [r.x for r in drop_null_tokens(df).orderBy("n").collect()] == [None, None, "-", None, "na", None]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence_against_table():
    import random

    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, 90))) for _ in range(2))
        assert common_subsequence(a, b) == slow_lcs(a, b)
    assert indel_percent("", "") == 100
    assert indel_percent("abc", "") == 0
    assert indel_percent("new york", "york new"[::-1]) < 100


def test_token_sorted(spark):
    assert evaluate(spark, ["Zeta, alpha-BETA", "  one  ", "---", "Éa b"], "string", token_sorted("x")) == [
        "alpha beta zeta", "one", "", "b éa"]


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(F.expr(cosine("a", "b"))).collect()] == [0.96, 0.0]


def _pairs(n, longest, letters="abcd é😀"):
    rng = random.Random(longest)
    make = lambda: "".join(rng.choices(letters, k=rng.randint(0, longest)))
    pairs = [(make(), make()) for _ in range(n)]
    return pairs + [(a, "".join(c for c in a if rng.random() > 0.1)) for a, _ in pairs]


@pytest.mark.parametrize("longest", [8, 64, 65, 200])
def test_common_subsequences_of_many_pairs(longest, monkeypatch):
    monkeypatch.setattr(similarity_module, "TABLE", 5_000)
    pairs = _pairs(150, longest) + [("", ""), ("", "x"), ("x" * 64, "x" * 64), ("x" * 128, "x" * 300), ("ab" * 64, "ba" * 64)]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert common_subsequences(left, right).tolist() == [common_subsequence(a, b) for a, b in pairs]
    assert indel_percents(left, right).tolist() == [indel_percent(a, b) for a, b in pairs]


def test_edit_distance_settles_only_what_is_so(spark):
    """Against the score itself, at every threshold; and most pairs are settled without it."""
    pairs = _pairs(120, 14)
    df = spark.createDataFrame([(a, b, t) for a, b in pairs for t in (1, 50, 67, 80, 85, 86, 93, 99)], "a string, b string, t int")
    got = df.selectExpr("a", "b", "t", f"{reaches('a', 'b', 't')} AS reached").collect()
    assert all(r.reached is None or r.reached == (indel_percent(r.a, r.b) >= r.t) for r in got)
    assert sum(r.reached is None for r in got) < 0.35 * len(got)
    assert {r.reached for r in got} == {True, False, None}
