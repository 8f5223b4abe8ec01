import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from twinledger.functions.similarity import indel_percent
from twinledger.operators import name_matching as nm
from twinledger.operators import vector_matching as vm
from twinledger.operators.vector_matching import best_cosine_match


def names(spark, values):
    return spark.createDataFrame(list(zip(values, range(len(values)))), "name string, place int")


def words(name):
    import re

    return " ".join(sorted(re.sub(r"\W+", " ", name.lower()).split()))


def brute_best(left, right, threshold):
    out = {}
    for a in dict.fromkeys(left):
        if a in right:
            out[a] = (a, 100)
        elif a.lower() in [b.lower() for b in right]:
            out[a] = (next(b for b in right if b.lower() == a.lower()), 99)
        else:
            best = None
            for b in right:
                score = indel_percent(words(a), words(b)) if words(a) and words(b) else -1
                if best is None or score > best[1]:
                    best = (b, score)
            if best and best[1] >= threshold:
                out[a] = best
    return out


def brute_pairs(left, right, threshold):
    kept = {}
    for a, (b, score) in brute_best(left, right, min(85, threshold)).items():
        if b not in kept or score > kept[b][1]:
            kept[b] = (a, score)
    return {(a, b, s) for b, (a, s) in kept.items()}


LEFT = ["PID", "pid", "Term Code", "Units Completed", "zip", "ZIP", "---", "Major", "Birth date", "a"]
RIGHT = ["term_code", "Completed Units", "PID", "Zip", "Majr", "date of birth", "Unrelated", "ab", "***"]


def test_name_ladder(spark):
    got = {tuple(r) for r in nm.best_fuzzy_match(names(spark, LEFT), names(spark, RIGHT), 60).collect()}
    assert got == brute_pairs(LEFT, RIGHT, 60)
    assert ("PID", "PID", 100) in got and ("zip", "Zip", 99) in got and ("Units Completed", "Completed Units", 100) in got


@pytest.mark.parametrize("threshold", [40, 60, 85])
def test_table_form_finds_the_same_as_brute_force(spark, monkeypatch, threshold):
    """The form for long lists loses no match: its filters are exact."""
    rng = random.Random(threshold)
    base = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 14))).strip() or "q" for _ in range(60)]
    noise = lambda s: "".join(c for c in s if rng.random() > 0.15) + rng.choice(["", "a", " b", "é"])
    left, right = list(dict.fromkeys(base)), list(dict.fromkeys(noise(s) or "z" for s in base))
    monkeypatch.setattr(nm, "SMALL_LIST", 0)
    got = {r.left_name: (r.right_name, r.score) for r in nm.best_right_per_left(names(spark, left), names(spark, right), threshold).collect()}
    assert got == brute_best(left, right, threshold)


@pytest.mark.parametrize("pairs_in_task", [3, 1_000_000])
def test_pairs_meet_once_at_their_first_common_signature(spark, pairs_in_task):
    """No pair that reaches the level is missed, none comes twice, and few others come; heavy signatures may be cut anyhow."""
    rng = random.Random(12)
    syllables = ["ka", "lo", "mi", "ter", "son", "vel", "ra", "qu", "bo", "est", "in", "dor", "wy", "zh"]
    base = ["".join(rng.choices(syllables, k=rng.randint(3, 7))) + " " + "".join(rng.choices(syllables, k=3)) for _ in range(150)]
    change = lambda s: "".join(c for c in s if rng.random() > 0.06)
    left, right = list(dict.fromkeys(map(words, base))), list(dict.fromkeys(words(change(s)) for s in base))
    a = spark.createDataFrame([(w,) for w in left], "words string")
    b = spark.createDataFrame([(w,) for w in right], "words string")
    letters = nm._letter_ranks(a.unionByName(b))
    ranked_a, ranked_b = nm._ranked_letters(a, letters), nm._ranked_letters(b, letters)
    for level, share in ((94, 0.05), (85, 0.05), (72, 0.6)):
        frame = nm._candidates(ranked_a, ranked_b, level, pairs_in_task)
        got = [tuple(r) for r in frame.collect()]
        reaching = {(x, y) for x in left for y in right if indel_percent(x, y) >= level}
        assert len(got) == len(set(got)) and reaching <= set(got)
        assert len(got) < share * len(left) * len(right)


def test_signatures_are_never_sent_to_every_task(spark):
    """Spark takes the signatures of a small list for small, so it sent them all through the driver."""
    listed = spark.sql("SELECT * FROM VALUES ('0001 supplier'), ('0002 supplier'), ('0003 ltd supplier') AS t(words)")
    ranked = nm._ranked_letters(listed, nm._letter_ranks(listed))
    frame = nm._candidates(ranked, ranked, 60)
    assert {("0001 supplier", "0002 supplier"), ("0002 supplier", "0003 ltd supplier")} <= {tuple(r) for r in frame.collect()}
    joins = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "other_ranked" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_no_level_is_searched_when_nothing_is_open(spark, monkeypatch):
    levels, candidates = [], nm._candidates
    monkeypatch.setattr(nm, "_candidates", lambda a, b, level: levels.append(level) or candidates(a, b, level))
    left, right = ["Supplier#0001", "Supplier#0002"], ["0001 SUPPLIER", "0002 SUPPLIER", "Supplier#0001 Ltd"]
    got = {tuple(r) for r in nm.best_right_per_left(names(spark, left), names(spark, right), 60, small_list=0).collect()}
    assert got == {("Supplier#0001", "0001 SUPPLIER", 100), ("Supplier#0002", "0002 SUPPLIER", 100)} and not levels


def test_hybrid(spark):
    left, right = ["alpha", "beta", "gamma", "delta"], ["Alpha", "x1", "x2"]
    cosines = spark.createDataFrame(
        [("alpha", "x1", 0.99), ("beta", "x1", 0.8), ("gamma", "x1", 0.9), ("delta", "Alpha", 0.95)],
        "left_name string, right_name string, cosine double")
    got = {tuple(r) for r in nm.hybrid_match(names(spark, left), names(spark, right), cosines).collect()}
    assert got == {("alpha", "Alpha", 99.0), ("gamma", "x1", 0.9)}


def vectors(spark, rows, dim):
    return spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id bigint, vec array<double>")


@pytest.mark.parametrize("threshold", [0.75, 0.2])
def test_cosine_forms_against_brute_force(spark, threshold):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    make = lambda n: [centres[i % 5] + rng.normal(scale=0.4, size=8) for i in range(n)]
    left = [*enumerate(make(90)), (1000, np.zeros(8))]
    # many vectors of one direction: a crowded centre is cut into blocks
    right = [*enumerate(make(150)), (2000, np.zeros(8)), *[(3000 + i, centres[0] * (i + 1)) for i in range(60)]]
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    want = {}
    for i, x in left:
        scores = [(float(unit(x) @ unit(y)), j) for j, y in right]
        top = max(s for s, _ in scores)
        if top > 0 and top >= threshold:
            want[i] = top
    a, b = vectors(spark, left, 8).repartition(4), vectors(spark, right, 8).repartition(3)
    for options in ({}, {"small_elements": 0, "block_rows": 25}):
        got = {r.left_id: r.cosine for r in best_cosine_match(a, b, "id", "id", "vec", threshold, **options).collect()}
        assert got == pytest.approx(want)


def test_own_bounds_leave_few_blocks_to_visit(spark):
    """At threshold 0 a left used to visit half of the sphere; with the bound of its first block it visits what is near."""
    rng = np.random.default_rng(7)
    directions = rng.normal(size=(40, 16))
    make = lambda n: [directions[i % 40] + rng.normal(scale=0.15, size=16) for i in range(n)]
    left, right = [*enumerate(make(300))], [*enumerate(make(2000))]
    a, b = (vectors(spark, rows, 16).withColumnRenamed("vec", "vector") for rows in (left, right))
    lefts, rights = a.withColumnRenamed("id", "left_id").withColumn("bound", F.lit(0.0)), b.withColumnRenamed("id", "right_id")
    around = vm.RightBlocks(rights, 2000, 20)
    blocks = around.placed.groupBy("centre", "ring", "part").count()
    assert around.rings["parts"].max() <= 3 and blocks.agg(F.sum("count")).first()[0] == 2000
    first = around.first_visits(lefts).cache()
    assert first.count() == 300
    unbounded = around.further_visits(first).count()
    near = {r.left_id: r.cosine for r in around.met(first, "left_id bigint, right_id bigint, cosine double").collect()}
    bounds = spark.createDataFrame(list(near.items()), "left_id bigint, best double")
    bounded = first.join(bounds, "left_id").withColumn("bound", F.col("best")).drop("best")
    bounded = bounded.select(first.columns)
    assert len(near) == 300 and around.further_visits(bounded).count() * 3 <= unbounded
    got = {r.left_id: r.cosine for r in best_cosine_match(a, b, "id", "id", "vector", 0.0, small_elements=0, block_rows=20).collect()}
    unit = lambda rows: np.array([v / np.linalg.norm(v) for _, v in rows])
    want = (unit(left) @ unit(right).T).max(axis=1)
    assert got == pytest.approx({i: want[i] for i in range(300) if want[i] > 0})


def test_vectors_are_sent_for_groups_of_lefts(spark, monkeypatch):
    """Evenly spread vectors open most blocks to every left; a vector used to be sent once for each of them."""
    rng = np.random.default_rng(11)
    a, b = (vectors(spark, [*enumerate(rng.normal(size=(n, 16)))], 16).withColumnRenamed("vec", "vector").cache() for n in (900, 1200))
    monkeypatch.setattr(vm, "LEFTS_SENT", 200)
    monkeypatch.setattr(vm, "RIGHTS_SENT", 500)
    monkeypatch.setattr(vm.RightBlocks, "further_visits", lambda *_: pytest.fail("one row for each left and block"))
    assert sorted(vm._near_order(np.eye(7))) == list(range(7))
    got = {r.left_id: (r.right_id, r.cosine) for r in best_cosine_match(a, b, "id", "id", "vector", 0.0, small_elements=0, block_rows=10).collect()}
    unit = lambda df: np.array([np.array(r.vector) / np.linalg.norm(r.vector) for r in df.orderBy("id").collect()])
    cosines = unit(a) @ unit(b).T
    assert {i: j for i, (j, _) in got.items()} == dict(enumerate(cosines.argmax(axis=1)))
    assert [got[i][1] for i in range(900)] == pytest.approx(list(cosines.max(axis=1)))


def test_groups_of_lefts_find_what_single_visits_find(spark, monkeypatch):
    """Small blocks whose lefts meet in groups, crowded ones among them: what the visits of single lefts find."""
    rng = np.random.default_rng(5)
    right = [*enumerate(rng.normal(size=(300, 6))), *[(1000 + i, np.ones(6) * (i + 1)) for i in range(80)], (2000, np.zeros(6))]
    left = [*enumerate(rng.normal(size=(150, 6))), (500, np.ones(6)), (501, np.zeros(6))]
    lefts = vectors(spark, left, 6).toDF("left_id", "vector").withColumn("bound", F.lit(0.3))
    around = vm.RightBlocks(vectors(spark, right, 6).toDF("right_id", "vector"), len(right), 7)
    first = around.first_visits(lefts).cache()
    schema = "left_id bigint, right_id bigint, cosine double"
    best = lambda met: {r.left_id: round(r.cosine, 9) for r in met.groupBy("left_id").agg(F.max("cosine").alias("cosine")).collect()}
    near = around.met(first, schema)
    want = best(near.unionByName(around.met(around.further_visits(first), schema)))
    for lefts_sent, rights_sent in ((4096, 16384), (20, 30)):
        monkeypatch.setattr(vm, "LEFTS_SENT", lefts_sent)
        monkeypatch.setattr(vm, "RIGHTS_SENT", rights_sent)
        assert best(around.further_met(first, schema)) == want and 500 in want and 501 not in want


def test_cosine_ties_and_repeated_ids_in_blocks(spark):
    """Equal directions go to the lowest right id, whichever block holds it; rows that share a left id count as one."""
    right = [(9, np.array([1.0, 0.0])), (4, np.array([2.0, 0.0])), *[(10 + i, np.array([3.0, 0.0])) for i in range(50)], (1, np.array([0.0, 1.0]))]
    left = [(1, np.array([5.0, 0.0])), (2, np.array([0.0, 2.0])), (2, np.array([1.0, 1.0])), (3, np.array([-1.0, 0.0])), (4, np.array([0.0, 0.0]))]
    a, b = vectors(spark, left, 2), vectors(spark, right, 2)
    got = best_cosine_match(a, b, "id", "id", "vec", 0.5, small_elements=0, block_rows=4).collect()
    assert sorted((r.left_id, r.right_id, round(r.cosine, 9)) for r in got) == [(1, 4, 1.0), (2, 1, 1.0)]


def test_cosine_without_rights(spark):
    a = vectors(spark, [(1, np.ones(2))], 2)
    assert best_cosine_match(a, a.limit(0), "id", "id", "vec").isEmpty()
