import json
from datetime import datetime, timezone

import pytest

from twinledger import AnyOf, Pair
from twinledger.operators.records import RECORD_LABELS, compare_any_of, compare_records
from twinledger.plans.preset_batch import compare_presets
from twinledger.plans.reconcile import Outputs, PreflightError, reconcile, reconcile_statistics, run_presets
from twinledger.sources.history import delete_old_runs, read_runs, recent_runs, run_by_id, save_run
from twinledger.sources.presets import load_presets, preset_of, preset_table
from twinledger.sources.sinks import write_mismatches


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(f"A{i}", i, "x", f"m{i}") for i in range(40)], "id string, n int, t string, m string")
    b = a.selectExpr("lower(id) AS key", "CAST(IF(n = 3, 99, n) AS STRING) AS n2", "IF(n = 5, NULL, ' X') AS t2",
                     "IF(n % 2 = 0, m, 'other') AS m1", "IF(n % 2 = 1 AND n <> 7, m, '-') AS m2").where("n2 <> '39'")
    return a, b


def test_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    ids = [save_run(spark, path, "records", score=90.0 + i, total_keys=10, joined_count=9, ts=datetime(2024, 1, 1 + i, tzinfo=timezone.utc),
                    column_pairs=[("a", "b")], composite_pairs=[("a", ["b", "c"])]) for i in range(4)]
    runs = read_runs(spark, path)
    assert [r.run_id for r in recent_runs(runs, 2).collect()] == [ids[3], ids[2]]
    row = run_by_id(runs, ids[1]).first()
    assert (row.score, row.missing_in_a, row.key_cols_a, row.column_pairs[0].b, row.composite_pairs[0].bs) == (91.0, None, [], "b", ["b", "c"])
    delete_old_runs(spark, path, keep=3)
    assert {r.run_id for r in read_runs(spark, path).collect()} == set(ids[1:])
    save_run(spark, path, "statistics")
    assert read_runs(spark, path).count() == 4
    assert len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError):
        save_run(spark, path, "records", nope=1)


def test_record_run(spark, sides, tmp_path):
    a, b = sides
    outputs = Outputs(str(tmp_path / "found"), str(tmp_path / "report"), str(tmp_path / "runs"), "export", "base")
    result = reconcile(a, b, ("id", "key"), [Pair("n", "n2"), Pair("t", "t2", weight=2.0), Pair("id", "key")], outputs=outputs)
    assert (result.summary["total_keys"], result.summary["joined_count"], result.summary["mismatch_count"]) == (40, 39, 2)
    assert result.summary["missing_in_b"] == 1 and result.summary["score"] == 92.5
    assert result.summary["weighted_score"] == 95.0
    saved = spark.read.option("header", True).csv(str(tmp_path / "found"))
    assert saved.count() == 3 and saved.columns[-1] == "match_type"
    report = spark.read.json(str(tmp_path / "report/summary")).first()
    assert report["score"] == 92.5
    assert spark.read.json(str(tmp_path / "report/column_scores")).count() == 2
    assert {r.mode for r in spark.read.json(str(tmp_path / "report/coercion")).collect()} == {"numeric", "text"}
    run = read_runs(spark, str(tmp_path / "runs")).first()
    assert (run.run_id, run.source_a_name, run.score, run.results_path) == (result.run_id, "export", 92.5, str(tmp_path / "found"))
    assert [(p.a, p.b) for p in run.column_pairs] == [("n", "n2"), ("t", "t2")]


def test_any_of_run_with_overrides(spark, sides):
    a, b = sides
    result = reconcile(a, b, ("id", "key"), {"m": ["m1", "m2"]}, approach="any_of", overrides_a={"n": "String"}, overrides_b={"n2": "Integer"})
    assert result.summary["mismatch_count"] == 1
    assert {r.col_df2 for r in result.comparison.mismatches.where("key_df1 = 'A7'").collect()} == {"m1", "m2"}
    same = reconcile(a, b, ("id", "key"), {"m": ["m1", "m2"]}, approach="any_of", skew="none")
    assert same.summary == result.summary


def test_preflight_stops_a_run(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)], "k int, v int")
    with pytest.raises(PreflightError, match="key_uniqueness"):
        reconcile(df, df, "k", {"v": "v"})
    assert reconcile(df, df, "k", {"v": "v"}, preflight=False, counted=True).summary["mismatch_count"] == 1


def test_nothing_to_write(spark, sides, tmp_path):
    a, _ = sides
    found = reconcile(a, a, "id", {"n": "n"}).comparison.mismatches
    assert write_mismatches(found, str(tmp_path / "none")) is False and not (tmp_path / "none").exists()


def test_statistics_run(spark, sides, tmp_path):
    a, b = sides
    result = reconcile_statistics(a, b, {"n": "n2", "t": "t2"}, Outputs(history=str(tmp_path / "runs")))
    assert result.skipped == [("t", "t2")] and {r.column for r in result.statistics.collect()} == {"n"}
    assert read_runs(spark, str(tmp_path / "runs")).first()["score"] is None
    with pytest.raises(ValueError):
        reconcile_statistics(a, b, {"t": "t2"})


def test_presets(spark, sides, tmp_path):
    folder = tmp_path / "presets"
    folder.mkdir()
    (folder / "plain.json").write_text(json.dumps({
        "version": "1", "key_col_pairs": [{"a": "id", "b": "key"}],
        "col_pairs": [{"a": "n", "b": "n2"}, {"a": "t", "b": ""}, {"a": "t"}], "composite_map": [{"a": "m", "bs": ["m1", "m2"]}, {"a": "n", "bs": []}]}))
    saved = preset_of("weighted", [("id", "key"), ("x", "")], [Pair("t", "t2", threshold=80, weight=3.0), Pair("n", ""), AnyOf("m", ("m1",))])
    (folder / "weighted.json").write_text(saved.to_json())
    assert preset_table(spark, str(folder)).count() == 2
    plain, weighted = load_presets(spark, str(folder))
    assert plain.pairs == (Pair("n", "n2"),) and plain.any_of == (AnyOf("m", ("m1", "m2")),)
    assert weighted == saved and weighted.pairs[0].threshold == 80
    results, history = str(tmp_path / "results"), str(tmp_path / "runs")
    done = run_presets(spark, str(folder), *sides, results, history)
    assert done == {"plain": ["records", "any_of", "statistics"], "weighted": ["records", "any_of"]}
    found = spark.read.parquet(f"{results}/mismatches")
    counts = {(r.preset, r.approach): r["count"] for r in found.groupBy("preset", "approach").count().collect()}
    assert counts[("plain", "records")] == 2 and counts[("plain", "any_of")] == 3 and counts[("weighted", "any_of")] > 3
    assert spark.read.parquet(f"{results}/statistics").where("preset = 'plain'").count() == 8
    assert read_runs(spark, history).count() == 5
    runs = read_runs(spark, history).collect()
    for r in runs:
        if r.approach == "records":
            assert (r.total_keys, r.joined_count, r.missing_in_a, r.missing_in_b, r.mismatch_count, r.score) == (40, 39, 0, 1, 1, 95.0)
        if r.approach == "statistics":
            assert (r.total_keys, r.mismatch_count, r.score) == (None, None, None)
    summary = spark.read.parquet(f"{results}/summary")
    assert summary.count() == 4 and {"ts", "weighted_score"} <= set(summary.columns)
    assert summary.where("preset = 'weighted' AND approach = 'records'").first().weighted_score is not None


def _table(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


@pytest.mark.parametrize("options", [{}, {"hot_rows": 2}, {"counted": True}, {"skew": "none"}])
def test_presets_that_share_a_join_find_what_each_finds(spark, sides, options):
    a, b = sides
    a = a.unionByName(a.where("n < 6")).unionByName(a.where("n < 4"))
    b = b.unionByName(b.where("n2 < '20'"))
    one = preset_of("one", [("id", "key")], [Pair("n", "n2"), Pair("t", "t2", threshold=70), AnyOf("m", ("m1", "m2"))])
    two = preset_of("two", [("id", "key")], [Pair("n", "n2", weight=4.0), Pair("m", "m1"), Pair("t", "t2")])
    shared = compare_presets(a, b, [one, two], **options)
    assert [(m.preset, m.approach) for m in shared.members] == [("one", "records"), ("one", "any_of"), ("two", "records")]
    for member in shared.members:
        compare = compare_records if member.approach == "records" else compare_any_of
        alone = compare(a, b, ("id", "key"), list(member.rules), **options)
        label = RECORD_LABELS.column if member.approach == "records" else "comparison_type"
        wanted = alone.mismatches.withColumnRenamed(label, "kind")
        got = shared.of(member).mismatches.select(wanted.columns)
        assert _table(got) == _table(wanted) and not wanted.isEmpty()
    if options.get("skew") == "none":
        plan = shared.findings._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1


def test_preset_batch_says_what_it_left_out(spark, sides, tmp_path):
    a, b = sides
    folder = tmp_path / "presets"
    folder.mkdir()
    for preset in (preset_of("bad", [("t", "t2")], [Pair("n", "n2")]), preset_of("keys", [("id", "key")], [Pair("id", "key")]),
                   preset_of("loose", [], [Pair("n", "n2")]), preset_of("text", [("id", "key")], [Pair("t", "t2")])):
        (folder / f"{preset.name}.json").write_text(preset.to_json())
    done = run_presets(spark, str(folder), a, b, str(tmp_path / "results"))
    assert done == {"bad": [], "keys": [], "loose": [], "text": ["records"]}
    notes = {(r.preset, r.part): r.note for r in spark.read.parquet(str(tmp_path / "results/notes")).collect()}
    assert set(notes) == {("bad", "preflight"), ("keys", "comparison"), ("loose", "comparison"), ("text", "statistics")}
    assert "key_uniqueness" in notes["bad", "preflight"]
