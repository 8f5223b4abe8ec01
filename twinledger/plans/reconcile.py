"""Whole runs: checks, comparison, scores, outputs, history; and batches of saved mappings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coercion import apply_overrides, convert_numeric_columns, numeric_pairs
from ..operators.preflight import run_preflight
from ..operators.keys import FOUND_IN, KEY_PARTS
from ..operators.records import Comparison, compare_any_of, compare_records
from ..operators.scores import column_scores, coverage_summary, rule_weights, weighted_score
from ..operators.statistics import STATISTICS, compare_statistics
from ..operators.rows import side_by_side
from ..sources.history import RUN_FIELDS, save_run
from ..sources.presets import Preset, load_presets
from ..sources.sinks import write_mismatches, write_report
from ..spec import AnyOf, Pair, key_pairs, rules_from, without_keys
from .preset_batch import Member, SharedComparison, by_keys, compare_presets, members_of

APPROACHES = ("statistics", "records", "any_of")


class PreflightError(ValueError):
    """The checks found an error; ``findings`` are its rows."""

    def __init__(self, findings):
        self.findings = findings
        super().__init__("; ".join(f"{r['check']} ({r['subject']}): {r['message']}" for r in findings))


class NoNumericPairs(ValueError):
    """A statistics run has nothing to compare."""


@dataclass
class Outputs:
    """Where a run writes; what is None is not written."""

    mismatches: str | None = None
    report: str | None = None
    history: str | None = None
    source_a_name: str | None = None
    source_b_name: str | None = None


@dataclass
class RunResult:
    run_id: str | None
    summary: dict
    comparison: Comparison | None = None
    statistics: DataFrame | None = None
    skipped: list[tuple[str, str]] = field(default_factory=list)


def reconcile(
    a: DataFrame, b: DataFrame, keys, columns, approach: str = "records", outputs: Outputs | None = None,
    overrides_a: dict | None = None, overrides_b: dict | None = None, preflight: bool = True, **options,
) -> RunResult:
    """One run of records or any-of: checks first, then the comparison, its scores and outputs.

    The mismatch table is kept in memory and on disk while the run reads it several times.
    """
    if approach not in APPROACHES[1:]:
        raise ValueError(f"approach is one of {APPROACHES[1:]}")
    outputs = outputs or Outputs()
    a, b = apply_overrides(a, overrides_a or {}), apply_overrides(b, overrides_b or {})
    pairs = key_pairs(keys)
    rules = without_keys(rules_from(columns), pairs)
    key_options = {k: v for k, v in options.items() if k in ("case_sensitive", "null_keys")}
    if preflight:
        errors = run_preflight(a, b, pairs, **key_options).where(F.col("severity") == "error").collect()
        if errors:
            raise PreflightError(errors)
    compare = compare_records if approach == "records" else compare_any_of
    result = compare(a, b, pairs, rules, **options)
    result.findings = result.findings.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        spark = a.sparkSession
        summary = run_summary(result, approach)
        values = summary.first().asDict()
        path = None
        if outputs.mismatches and write_mismatches(result.mismatches, outputs.mismatches):
            path = outputs.mismatches
        if outputs.report:
            scores = column_scores(result.findings, values["joined_count"])
            write_report(outputs.report, summary.withColumn("ts", F.current_timestamp()), scores, result.coercion)
        run_id = None
        if outputs.history:
            run_id = save_run(
                spark, outputs.history, approach, results_path=path, source_a_name=outputs.source_a_name,
                source_b_name=outputs.source_b_name, **_run_values(values, pairs, rules))
    finally:
        result.findings.unpersist()
    return RunResult(run_id, values, result)


def run_summary(result: Comparison, approach: str) -> DataFrame:
    """One row: the coverage summary of a comparison with its approach, and the weighted score where columns have weights."""
    overview = result.overview
    summary = coverage_summary(result.findings, overview)
    weights = rule_weights(result.rules)
    if weights:
        summary = side_by_side(summary, weighted_score(result.findings, overview, weights).select(F.col("weighted_score_rounded").alias("weighted_score")))
    else:
        summary = summary.withColumn("weighted_score", F.lit(None).cast("double"))
    return summary.select(F.lit(approach).alias("approach"), *summary.columns)


def run_row(result: Comparison, approach: str, **names: str | None) -> DataFrame:
    """The history row of a comparison, all fields but its id and time."""
    values = run_summary(result, approach).first().asDict()
    row = {n: None for n in RUN_FIELDS} | {"approach": approach} | names | _run_values(values, list(result.plan.keys), result.rules)
    fields = [n for n in RUN_FIELDS if n not in ("run_id", "ts")]
    return result.findings.sparkSession.createDataFrame(
        [tuple(row[n] for n in fields)], ", ".join(f"{n} {RUN_FIELDS[n]}" for n in fields))


def _run_values(values: dict, pairs, rules) -> dict:
    return {
        "key_cols_a": [k for k, _ in pairs], "key_cols_b": [k for _, k in pairs],
        "column_pairs": [(r.a, r.b) for r in rules if isinstance(r, Pair)],
        "composite_pairs": [(r.a, list(r.bs)) for r in rules if isinstance(r, AnyOf)],
        **{n: values[n] for n in ("score", "total_keys", "joined_count", "missing_in_a", "missing_in_b", "mismatch_count")},
    }


def reconcile_statistics(
    a: DataFrame, b: DataFrame, columns, outputs: Outputs | None = None
) -> RunResult:
    """A descriptive run: text columns that are mostly numbers are converted, pairs that are not numeric skipped.

    Its history row has no score: agreement of statistics is not a share of matching records.
    """
    rules = rules_from(columns)
    pairs = [(r.a, t) for r in rules for t in r.targets]
    a = convert_numeric_columns(a, [p for p, _ in pairs])
    b = convert_numeric_columns(b, [q for _, q in pairs])
    kept, skipped = [], []
    for row in numeric_pairs(a, b, pairs).collect():
        (kept if row["kept"] else skipped).append((row["col_a"], row["col_b"]))
    if not kept:
        raise NoNumericPairs("no numeric column pairs to compare")
    modes = {p: "numeric" for p in kept}
    statistics = compare_statistics(a, b, [Pair(p, q) for p, q in kept], modes)
    run_id = None
    if outputs and outputs.history:
        run_id = save_run(
            a.sparkSession, outputs.history, "statistics", source_a_name=outputs.source_a_name,
            source_b_name=outputs.source_b_name, column_pairs=kept,
        )
    return RunResult(run_id, {"kept": len(kept), "skipped": len(skipped)}, statistics=statistics, skipped=skipped)


NOTES = "preset string, part string, note string"


def run_presets(
    spark: SparkSession, presets: str, a: DataFrame, b: DataFrame, results: str, history: str | None = None,
    preflight: bool = True, **options,
) -> dict[str, list[str]]:
    """Run every saved mapping of a folder on two sources and append findings, summaries, statistics and notes, by preset.

    Returns the parts run per preset. Presets with equal keys are checked and joined once. What is left out has a row in
    ``notes``: presets that preflight refuses or that have no rules, and pairs that the statistics skip.
    """
    loaded = load_presets(spark, presets)
    done: dict[str, list[str]] = {p.name: [] for p in loaded}
    notes: list[tuple[str, str, str]] = []
    key_options = {k: v for k, v in options.items() if k in ("case_sensitive", "null_keys")}
    accepted = []
    for group in by_keys(loaded):
        if not group[0].keys:
            notes += [(p.name, "comparison", "no key columns") for p in group]
            continue
        errors = []
        if preflight and members_of(group):
            errors = run_preflight(a, b, list(group[0].keys), **key_options).where(F.col("severity") == "error").collect()
        if errors:
            notes += [(p.name, "preflight", str(PreflightError(errors))) for p in group]
            continue
        accepted += group
        if members_of(group):
            for member in _run_shared(compare_presets(a, b, group, **options), results, history):
                done[member.preset].append(member.approach)
    notes += [(p.name, "comparison", "no column pairs beside the keys") for p in accepted if not done[p.name]]
    for preset, statistics, skipped in _preset_statistics(a, b, accepted):
        notes += [(preset.name, "statistics", f"{x} = {y} is not numeric") for x, y in skipped]
        if statistics is None:
            continue
        statistics.withColumn("preset", F.lit(preset.name)).write.mode("append").partitionBy("preset").parquet(f"{results}/statistics")
        if history:
            kept = [(p.a, p.b) for p in without_keys(preset.pairs, list(preset.keys)) if (p.a, p.b) not in skipped]
            save_run(spark, history, "statistics", column_pairs=kept)
        done[preset.name].append("statistics")
    if notes:
        spark.createDataFrame(notes, NOTES).write.mode("append").partitionBy("preset").parquet(f"{results}/notes")
    return done


def _run_shared(shared: SharedComparison, results: str, history: str | None) -> list[Member]:
    """Write findings, summaries and history rows of all members; the findings are computed once."""
    spark = shared.findings.sparkSession
    shared.findings = shared.findings.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        shared.findings.drop(KEY_PARTS, FOUND_IN).write.mode("append").partitionBy("preset", "approach").parquet(f"{results}/mismatches")
        for member in shared.members:
            summary = run_summary(shared.of(member), member.approach)
            values = summary.first().asDict()
            row = spark.createDataFrame([tuple(values.values())], summary.schema)
            row.withColumns({"preset": F.lit(member.preset), "ts": F.current_timestamp()}).write.mode("append").partitionBy(
                "preset", "approach").parquet(f"{results}/summary")
            if history:
                save_run(spark, history, member.approach, results_path=f"{results}/mismatches",
                         **_run_values(values, list(shared.plan.keys), member.rules))
    finally:
        shared.findings.unpersist()
    return shared.members


def _preset_statistics(a: DataFrame, b: DataFrame, presets: list[Preset]):
    """``(preset, statistics or None, skipped pairs)`` of each preset with column pairs.

    Statistics of a pair don't depend on the preset, so each is computed once; pairs of one column of A with several of B take turns.
    """
    mine = {p.name: [(r.a, r.b) for r in without_keys(p.pairs, list(p.keys))] for p in presets}
    turns: list[dict[str, str]] = []
    for x, y in dict.fromkeys(pair for pairs in mine.values() for pair in pairs):
        turn = next((t for t in turns if x not in t), None)
        if turn is None:
            turns.append(turn := {})
        turn[x] = y
    rows: dict[tuple[str, str], list] = {}
    for turn in turns:
        try:
            found = reconcile_statistics(a, b, turn).statistics
        except NoNumericPairs:
            continue
        for row in found.collect():
            rows.setdefault((row["column"], turn[row["column"]]), []).append(tuple(row))
    for preset in presets:
        pairs = mine[preset.name]
        kept = [row for pair in pairs for row in rows.get(pair, [])]
        if pairs:
            yield preset, a.sparkSession.createDataFrame(kept, STATISTICS) if kept else None, [p for p in pairs if p not in rows]
