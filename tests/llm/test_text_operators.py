"""Quality rules, near duplicates, repeated strings and windows: against SQL or plain versions, with awkward cases."""

import os
import random
import sys

import numpy as np
import pytest

from small import AWKWARD, byte_removal, documents, near_groups, window_removal
from twinledger.llm import neardup, quality, substring, suffix_dedup
from twinledger.llm.suffix_groups import suffix_order

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import difference  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def texts(rows):
    return [(d, t) for d, t, *_ in rows]


@pytest.fixture(scope="module")
def given(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source").limit(120).collect()]
    return AWKWARD + [(d + 1000, *r) for d, *r in rows]


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(4)
    for _ in range(3000):
        symbols = [rng.randint(1, rng.choice((1, 2, 3, 6))) for _ in range(rng.randint(0, 30))] + [0]
        assert suffix_order(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_order_holds_little_for_each_symbol():
    import tracemalloc

    rng = random.Random(5)
    symbols = [rng.randint(2, 60) for _ in range(60_000)] + [0]
    tracemalloc.start()
    suffix_order(symbols)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160 * len(symbols)


def test_near_duplicates(spark, given):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, given)).collect()}
    assert found == near_groups(texts(given))


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(200)] = f"v{rng.randrange(1000)}"
        rows.append((d, " ".join(w), "en", "s"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows), neardup.Forest(region=16)).collect()}
    assert found == near_groups(texts(rows))


def test_near_duplicates_of_many_groups_in_a_large_region(spark):
    """Pairs of near copies that share most of their text with all others, so that regions are far over their limit at any depth."""
    common, rows = " ".join(f"common{i}" for i in range(500)), []
    for k in range(40):
        own = " ".join(f"own{k}x{i}" for i in range(15))
        for j in range(2):
            rows.append((len(rows) * 7 + 1, f"{common} {own} {' '.join(f'end{k}x{j}x{i}' for i in range(36))}", "en", "hot"))
    want = near_groups(texts(rows))
    assert len({c for _, c in want.values()}) == 40
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows), neardup.Forest(region=4)).collect()}
    assert found == want


def test_near_duplicates_write_no_pairs_of_a_group_that_is_almost_linked(spark, monkeypatch):
    """300 documents, nearly all pairs of which are a little under the wanted similarity: 44,850 pairs, all to be tried."""
    rng, rows, written = random.Random(3), [], []
    for d in range(300):
        w = [f"w{i}" for i in range(300)]
        for i in rng.sample(range(300), 6):
            w[i] = f"v{d}x{i}"
        rows.append((d, rows[-1][1] + " end" if d % 50 == 49 else " ".join(w), "en", "s"))
    kept = neardup.kept_table

    def counted(frame, kind):
        out = kept(frame, kind)
        written.append((out.count(), kind))
        return out

    monkeypatch.setattr(neardup, "kept_table", counted)
    want = near_groups(texts(rows))
    assert 100 < len({c for _, c in want.values()}) < 300
    found = neardup.near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert max(n for n, kind in written if kind in ("pairs", "links", "undecided")) < 40 * len(rows), written


def test_intersections_and_joining_links():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(9000), rng.choice((1, 40, 6000)))), np.uint64) for _ in range(20)]
    both = neardup._intersections(sets)
    assert both.tolist() == [[len(np.intersect1d(a, b)) if i != j else both[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    linked = np.ones((6, 6), bool)
    linked[4:, :4] = linked[:4, 4:] = False
    assert neardup._joining(np.array([7, 7, 8, 9, 10, 10]), linked) == [(0, 2), (0, 3)]


def test_repeated_windows(spark, given):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeated_windows(documents(spark, given)).collect()}
    assert found == window_removal(texts(given))


def test_repeated_strings(spark, given):
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeated_strings(documents(spark, given)).collect()}
    assert found == byte_removal(texts(given))


def test_repeated_strings_that_overlap(spark):
    rows = [(1, "abc" * 100, "en", "s"), (2, "ab" * 60 + "abc" * 60, "en", "s"), (3, "x" * 99, "en", "s"), (4, "x" * 101, "en", "s"), (5, "y" + "x" * 100, "en", "s")]
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeated_strings(documents(spark, rows)).collect()}
    assert found == byte_removal(texts(rows))


def test_repeated_strings_around_a_very_frequent_passage(spark):
    """The passage holds its anchor twice within a string and stands in many different surroundings, some of which repeat in part."""
    rng = random.Random(6)
    passage, parts = "the same few words stand here, " * 3, [f"{i:05d}" + "".join(rng.choices("abcdefgh ", k=rng.choice((20, 45, 80)))) for i in range(60)]
    rows = []
    for d in range(1500):
        one = "".join(rng.choices("stuvwxyz ", k=90)) if d % 3 else rng.choice(parts)
        two = "".join(rng.choices("stuvwxyz ", k=90)) if d % 4 else rng.choice(parts)
        rows.append((d, f"{one}{passage[d % 7:]}{two}", "en", "s"))
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeated_strings(documents(spark, rows)).collect()}
    assert found == byte_removal(texts(rows))


def test_the_surroundings_of_a_frequent_anchor_are_told_apart():
    """Equal strings come into one part; surroundings that share no string don't."""
    rule = suffix_dedup.Repeats(length=12, gram=4)
    entries = [(b"aaaaaaaa" + b"ANCH" + b"bbbbbbbb", 8), (b"aaaaaaaa" + b"ANCH" + b"cccccccc", 8), (b"dddddddd" + b"ANCH" + b"eeeeeeee", 8)]
    lefts = [left for _, left in entries]
    parts = suffix_dedup._narrowed([(e, 0, 9) for e in range(3)], lambda e: entries[e][0], lefts, rule)
    assert parts == [[(0, 0, 5), (1, 0, 5)]]


def test_kept_texts_come_back(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(40)), "en", "s"), (2, "go " + " ".join(f"w{i}" for i in range(40)) + " on", "en", "s")]
    assert {r.doc_id: r.kept for r in substring.remove_repeated_windows(documents(spark, rows), texts=True).collect()} == {1: "", 2: "go on"}


def test_quality_against_sql(spark, given):
    import duckdb

    con, frame = duckdb.connect(), documents(spark, given)
    documents_table = frame.toPandas()
    con.register("documents_table", documents_table)
    con.execute("CREATE VIEW documents AS SELECT * FROM documents_table")
    rules = quality.QualityRules(least_docs=20)
    assert difference(quality.quality_rules(frame, rules), con, quality.duckdb_sql(rules)) is None


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two three " * 30, "en", "s"), (7, "same text here " * 20, "en", "s"), (7, "same text here " * 20, "en", "s"), (None, None, None, None)]
    frame = documents(spark, rows)
    near = neardup.near_duplicates(frame).collect()
    assert len(near) == 4 and all(r.kept for r in near) and {r.component_id for r in near} == {None, 7}
    assert neardup.representatives(frame).count() == 4
    assert substring.remove_repeated_windows(frame).count() == suffix_dedup.remove_repeated_strings(frame).count() == 4
    assert quality.quality_rules(frame).count() == 4
    assert quality.kept_documents(frame).columns == frame.columns


def test_empty_tables(spark):
    frame = documents(spark, [])
    for found in (neardup.near_duplicates(frame), substring.remove_repeated_windows(frame), suffix_dedup.remove_repeated_strings(frame), quality.quality_rules(frame)):
        assert found.count() == 0
