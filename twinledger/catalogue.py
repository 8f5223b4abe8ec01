"""The registered queries: every operator on the test tables, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions.numbers import locale_text, with_parsed
from .functions.similarity import cosine
from .functions.text import drop_null_tokens, is_blank, normal_text, present_text, type_of
from .operators import coercion, digest_tree, key_sketches, keys, name_matching, preflight, profile, records, scores, statistics, vector_matching
from .operators.keys import KeyPlan
from .operators.lineage import checkpoint_folder
from .operators.rows import side_by_side
from .plans import preset_batch, reconcile
from .sources import delimited, file_dialects, history, hygiene, json_arrays, quoted_records, sinks, structured
from .sources.presets import Preset
from .sources.fixed_width import APPLICANT_LAYOUT, fixed_width_fields, layout_from_text
from .spec import AnyOf, Pair

Query = Callable[[SparkSession, str], DataFrame]

CUSTOMER_LAYOUT = layout_from_text("cust, segment, nation", "0:8, 8:20, 20:24")
WEIGHTS = {"o_totalprice": 3.0, "o_orderstatus": 2.0}
REVIEW_SIZE = 20
COSINE_THRESHOLD = 0.35


def _compare(spark: SparkSession, sf_dir: str, name: str, **options) -> records.Comparison:
    a, b = fx.side_pair(spark, sf_dir, name)
    compare = records.compare_any_of if name == "part" else records.compare_records
    return compare(a, b, fx.KEYS[name], fx.COLUMNS[name], **options)


def _plan(a: DataFrame, b: DataFrame, name: str) -> KeyPlan:
    return KeyPlan.of(a, b, fx.KEYS[name])


def _pairs(name: str) -> list[tuple[str, str]]:
    return list(fx.COLUMNS[name].items())


def orders_record_mismatches(spark, sf_dir):
    return _compare(spark, sf_dir, "orders").mismatches


def lineitem_composite_key_mismatches(spark, sf_dir):
    return _compare(spark, sf_dir, "lineitem").mismatches


def lineitem_mismatches_counted(spark, sf_dir):
    found = _compare(spark, sf_dir, "lineitem", counted=True).mismatches
    return found.withColumn("n_rows", F.col("n_rows").cast("bigint"))


def lineitem_mismatches_hot_keys(spark, sf_dir):
    """The same with keys of more than three rows on a side taken apart."""
    found = _compare(spark, sf_dir, "lineitem", counted=True, hot_rows=3).mismatches
    return found.withColumn("n_rows", F.col("n_rows").cast("bigint"))


def customer_case_sensitive_keys(spark, sf_dir):
    return _compare(spark, sf_dir, "customer", case_sensitive=True).mismatches


def customer_record_mismatches(spark, sf_dir):
    return _compare(spark, sf_dir, "customer").mismatches


def any_of_mismatches(spark, sf_dir):
    return _compare(spark, sf_dir, "part").mismatches


def missing_in_b(spark, sf_dir):
    return records.missing_rows(*fx.side_pair(spark, sf_dir, "orders"), fx.KEYS["orders"], "b")


def missing_in_a(spark, sf_dir):
    return records.missing_rows(*fx.side_pair(spark, sf_dir, "orders"), fx.KEYS["orders"], "a")


def documents_without_labels(spark, sf_dir):
    return records.missing_rows(fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels"), "doc_id", "b")


def matched_rows(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "orders")
    return records.matched_rows(a, b, fx.KEYS["orders"], ["o_custkey", "o_orderstatus"], ["customer", "status"])


def outer_rows(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "lineitem")
    return records.outer_rows(a, b, fx.KEYS["lineitem"], ["l_quantity"], ["qty"])


def rows_of_mismatched_keys(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "orders")
    found = _compare(spark, sf_dir, "orders")
    return keys.rows_of_keys(a.select("o_orderkey", "o_orderstatus"), "a", found.plan, found.findings)


def pair_type_decision(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "customer")
    return coercion.pair_types(a, b, _pairs("customer"), _plan(a, b, "customer")).drop("position")


def orders_pair_types(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "orders")
    return coercion.pair_types(a, b, _pairs("orders"), _plan(a, b, "orders")).drop("position")


def numeric_pair_filter(spark, sf_dir):
    return coercion.numeric_pairs(*fx.side_pair(spark, sf_dir, "customer"), _pairs("customer"))


def convert_numeric_columns(spark, sf_dir):
    b = fx.derived(spark, sf_dir, "customer_b").select("cust_id", "zip", "balance", "nation")
    return coercion.convert_numeric_columns(b, ["zip", "balance", "nation"])


def type_overrides(spark, sf_dir):
    a = fx.derived(spark, sf_dir, "orders_a").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    text = a.withColumns({"o_custkey": F.col("o_custkey").cast("string"), "o_orderdate": F.col("o_orderdate").cast("string")})
    priced = text.withColumn("price", F.expr(
        "CASE WHEN o_orderkey % 59 = 0 THEN 'N/A' ELSE concat(' ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) END"))
    return coercion.apply_overrides(
        priced, {"o_orderkey": "String", "o_custkey": "Integer", "o_totalprice": "Integer", "o_orderdate": "Datetime", "price": "Numeric"})


def normalise_text(spark, sf_dir):
    b = fx.derived(spark, sf_dir, "customer_b")
    text = type_of(b, "segment")
    return b.selectExpr("cust_id", f"{normal_text('segment', text)} AS segment_text", f"{present_text('segment', text)} AS segment_shown")


def blank_values(spark, sf_dir):
    b = fx.derived(spark, sf_dir, "orders_b")
    return b.agg(*[F.expr(f"count_if({is_blank(c, type_of(b, c))}) AS {c}_blanks") for c in b.columns])


def null_tokens(spark, sf_dir):
    return drop_null_tokens(fx.derived(spark, sf_dir, "customer_b").select("cust_id", "segment", "balance"))


def locale_numbers(spark, sf_dir):
    prices = fx.derived(spark, sf_dir, "european_prices")
    return with_parsed(prices, {"price": locale_text("price_text", "EU")}).select("l_orderkey", "l_linenumber", "price")


def fixed_width_field_table(spark, sf_dir):
    lines = fx.derived(spark, sf_dir, "customer_lines")
    return drop_null_tokens(lines.select(*fixed_width_fields("value", CUSTOMER_LAYOUT)))


def drop_empty_columns(spark, sf_dir):
    return hygiene.finish(fx.derived(spark, sf_dir, "customer_b"))


def descriptive_stats_orders(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "orders")
    found = statistics.compare_statistics(a, b, fx.COLUMNS["orders"])
    return found.withColumns({c: F.round(c, 4) for c in ("a", "b", "abs_diff", "rel_diff")})


def union_key_count(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "orders")
    return keys.union_key_count(a, b, _plan(a, b, "orders"))


def joined_key_count(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "lineitem")
    return keys.joined_key_count(a, b, _plan(a, b, "lineitem"))


def key_counts(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "lineitem")
    return keys.key_overview(keys.key_rows(a, b, _plan(a, b, "lineitem")))


def coverage_summary(spark, sf_dir):
    found = _compare(spark, sf_dir, "orders")
    return scores.coverage_summary(found.findings, found.overview)


def match_score(spark, sf_dir):
    found = _compare(spark, sf_dir, "lineitem", counted=True)
    return scores.match_score(found.findings, found.overview)


def weighted_score(spark, sf_dir):
    found = _compare(spark, sf_dir, "orders")
    return scores.weighted_score(found.findings, found.overview, WEIGHTS)


def column_scores(spark, sf_dir):
    found = _compare(spark, sf_dir, "orders")
    return scores.column_scores(found.findings, found.overview)


def score_bands(spark, sf_dir):
    """The match rate of the orders of every customer, with its band and narrative."""
    found = _compare(spark, sf_dir, "orders")
    bad = found.mismatches.where(F.col("key_df1") != "<MISSING>").select(F.col("key_df1").cast("bigint").alias("o_orderkey"))
    orders = fx.derived(spark, sf_dir, "orders_a")
    flagged = orders.join(bad.distinct().withColumn("bad", F.lit(1)), "o_orderkey", "left")
    rates = flagged.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_bad"))
    score = F.round((F.lit(1.0) - F.col("n_bad") / F.col("n")) * 100, 1)
    rated = rates.select("o_custkey", score.alias("score"))
    return rated.select("*", scores.score_band(F.col("score")).alias("band"), scores.narrative(F.col("score")).alias("narrative"))


def clean_columns(spark, sf_dir):
    found = _compare(spark, sf_dir, "orders")
    return scores.clean_columns(found.findings, found.rules)


def mismatch_frequency(spark, sf_dir):
    return scores.mismatch_frequency(_compare(spark, sf_dir, "orders").findings)


def crosstab_candidates(spark, sf_dir):
    return profile.crosstab_candidates(fx.derived(spark, sf_dir, "orders_a"), ["o_orderkey"])


def crosstab_by_priority(spark, sf_dir):
    found = _compare(spark, sf_dir, "orders")
    return profile.crosstab(fx.derived(spark, sf_dir, "orders_a"), "a", found.plan, found.findings, "o_orderpriority")


def column_profile(spark, sf_dir):
    return profile.profile_columns(fx.derived(spark, sf_dir, "customer_b"), exact_distinct=True)


def mixed_type_columns(spark, sf_dir):
    return profile.mixed_type_columns(fx.derived(spark, sf_dir, "customer_b"))


def preflight_uniqueness(spark, sf_dir):
    line_a, line_b = fx.side_pair(spark, sf_dir, "lineitem")
    orders_a = fx.derived(spark, sf_dir, "orders_a")
    checks = (
        preflight.key_uniqueness(line_a, ["l_orderkey", "l_linenumber"], "A"),
        preflight.key_uniqueness(line_b, ["order_id", "line_no"], "B"),
        preflight.key_uniqueness(orders_a, ["o_orderkey"], "A"),
        preflight.key_uniqueness(orders_a, ["o_orderpriority"], "A"),
    )
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out.withColumn("fires", F.col("ratio") < preflight.MIN_UNIQUE)


def preflight_sequence(spark, sf_dir):
    orders = preflight.sequence_share(fx.derived(spark, sf_dir, "orders_a"), "o_orderkey")
    line = preflight.sequence_share(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return orders.withColumn("key", F.lit("o_orderkey")).unionByName(line.withColumn("key", F.lit("l_extendedprice")))


def preflight_row_counts(spark, sf_dir):
    return preflight.row_counts(*fx.side_pair(spark, sf_dir, "orders"))


def preflight_join_size(spark, sf_dir):
    return preflight.join_size(*fx.side_pair(spark, sf_dir, "lineitem"), fx.KEYS["lineitem"])


def latest_per_key(spark, sf_dir):
    return keys.latest_per_key(fx.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


def first_n_rows(spark, sf_dir):
    return profile.first_rows(fx.table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), 1000, ["ts", "event_id"])


def review_sample(spark, sf_dir):
    return profile.review_sample(_compare(spark, sf_dir, "orders").mismatches, REVIEW_SIZE)


def cosine_best_match(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "embeddings")
    best = vector_matching.best_cosine_match(a, b, "vec_id", "vec_id", "embedding", COSINE_THRESHOLD)
    return best.withColumn("cosine", F.round("cosine", 4))


def cosine_of_neighbours(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "embeddings")
    pairs = a.withColumnRenamed("vec_id", "left_id").join(
        b.selectExpr("vec_id AS right_id", "vec_id - 1 AS left_id", "embedding AS other"), "left_id")
    return pairs.selectExpr("left_id", "right_id", f"round({cosine('embedding', 'other')}, 4) AS cosine")


def fuzzy_record_mismatches(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "supplier")
    return records.compare_records(a, b, fx.KEYS["supplier"], [Pair("s_name", "name", threshold=80)]).mismatches


def fuzzy_best_match(spark, sf_dir):
    a, b = fx.side_pair(spark, sf_dir, "supplier")
    left, right = name_matching.names_of(a, "s_name", "s_suppkey"), name_matching.names_of(b, "name", "supp_id")
    return name_matching.best_fuzzy_match(left, right, 60)


def csv_lines(spark, sf_dir):
    """CSV lines with quotes, commas, short and ragged records, back to columns."""
    return delimited.table_of_lines(fx.derived(spark, sf_dir, "order_csv_lines"), ["o_orderkey", "note", "total"], ",", "keep")


def tsv_lines(spark, sf_dir):
    return delimited.table_of_lines(fx.derived(spark, sf_dir, "customer_tsv_lines"), ["c_custkey", "name", "segment"], "\t", "keep")


def header_line(spark, sf_dir):
    """The header row found among the first lines, titles above it."""
    return delimited.header_search(fx.derived(spark, sf_dir, "titled_lines"))


def fuzzy_best_match_table(spark, sf_dir):
    """The same by signature joins, as for a long list of right names."""
    a, b = fx.side_pair(spark, sf_dir, "supplier")
    left, right = name_matching.names_of(a, "s_name", "s_suppkey"), name_matching.names_of(b, "name", "supp_id")
    return name_matching.best_fuzzy_match(left, right, 60, small_list=0)


def cosine_best_match_blocks(spark, sf_dir):
    """The same in blocks, as for a large right side."""
    a, b = fx.side_pair(spark, sf_dir, "embeddings")
    best = vector_matching.best_cosine_match(a, b, "vec_id", "vec_id", "embedding", COSINE_THRESHOLD, small_elements=0, block_rows=128)
    return best.withColumn("cosine", F.round("cosine", 4))


def run_history_row(spark, sf_dir):
    """What the history records of a comparison, all fields but id and time; lists as text."""
    found = _compare(spark, sf_dir, "orders")
    row = reconcile.run_row(found, "records", source_a_name="orders", source_b_name="copy", results_path=None)
    return row.selectExpr(
        "approach", "source_a_name", "source_b_name", "concat_ws(',', key_cols_a) AS key_cols_a", "concat_ws(',', key_cols_b) AS key_cols_b",
        "score", "total_keys", "joined_count", "missing_in_a", "missing_in_b", "mismatch_count",
        "concat_ws(',', transform(column_pairs, p -> concat(p.a, '=', p.b))) AS column_pairs", "size(composite_pairs) AS n_composite_pairs")


def coverage_of_like_keys(spark, sf_dir):
    """Composite text keys that hold the separator and the markers: keys that show alike are counted apart."""
    a, b = fx.derived(spark, sf_dir, "like_keys_a"), fx.derived(spark, sf_dir, "like_keys_b")
    found = records.compare_records(a, b, (["k1", "k2"], ["k1", "k2"]), {"size": "size"})
    return scores.coverage_summary(found.findings, found.overview)


def recent_runs(spark, sf_dir):
    return history.recent_runs(fx.derived(spark, sf_dir, "run_rows"))


def runs_retention(spark, sf_dir):
    return history.kept_runs(fx.derived(spark, sf_dir, "run_rows"))


def run_by_id(spark, sf_dir):
    return history.run_by_id(fx.derived(spark, sf_dir, "run_rows"), "1997-01-15")


def multi_line_records(spark, sf_dir):
    """CSV lines of records whose values hold line breaks, some across blocks, back to columns."""
    lines = fx.derived(spark, sf_dir, "order_record_lines")
    lines = lines.repartitionByRange("block").sortWithinPartitions("block", "at").select("file", "block", "value")
    return delimited.table_of_lines(quoted_records.records(lines, ","), ["o_orderkey", "note", "total"], ",", "keep")


def json_array_records(spark, sf_dir):
    """The objects of a JSON array that many tasks hold in pieces, some across blocks, back to columns."""
    pieces = fx.derived(spark, sf_dir, "order_json_pieces").repartitionByRange("block").sortWithinPartitions("block", "at")
    found = json_arrays.json_records(pieces.select("file", "block", "value"))
    record = F.from_json("value", "key bigint, note string, of struct<status: string, tags: array<bigint>>", {"mode": "FAILFAST"})
    return found.select(record.alias("r")).select("r.key", "r.note", "r.of.status", F.element_at("r.of.tags", 1).alias("tag"))


def sketched_key_counts(spark, sf_dir):
    """Exact key counts, and whether the counts from merged sketches (A by day) are off by no more than their bounds."""
    a, b = fx.side_pair(spark, sf_dir, "orders")
    plan = _plan(a, b, "orders")
    exact = keys.key_overview(keys.key_rows(a, b, plan)).selectExpr(
        "total_keys", "joined_count AS in_both", "missing_in_b AS only_a", "missing_in_a AS only_b")
    guessed = key_sketches.estimated_overview(
        key_sketches.key_sketches(a, plan, "a", by=["o_orderdate"]), key_sketches.key_sketches(b, plan, "b"))
    guessed = guessed.withColumnsRenamed({c: f"{c}_guess" for c in key_sketches.COUNTS})
    both = side_by_side(exact, guessed)
    return both.select(*key_sketches.COUNTS, *[
        F.expr(f"abs({c} - {c}_guess) <= {c}_bound").alias(f"{c}_within") for c in key_sketches.COUNTS])


def orders_mismatches_by_digest(spark, sf_dir):
    """The findings of ``orders_record_mismatches``, with only the buckets joined whose digests differ."""
    a, b = fx.side_pair(spark, sf_dir, "orders")
    return digest_tree.compare_changed(a, b, fx.KEYS["orders"], fx.COLUMNS["orders"]).mismatches


def lineitem_mismatches_by_digest(spark, sf_dir):
    """The same for a key with duplicates."""
    a, b = fx.side_pair(spark, sf_dir, "lineitem")
    return digest_tree.compare_changed(a, b, fx.KEYS["lineitem"], fx.COLUMNS["lineitem"]).mismatches


def applicant_layout_fields(spark, sf_dir):
    """Lines of 203 characters in the built-in layout, to its 58 columns."""
    return fx.derived(spark, sf_dir, "applicant_lines").select("c_custkey", *fixed_width_fields("line", APPLICANT_LAYOUT))


def preflight_findings(spark, sf_dir):
    """All checks at once, on keys that are far from unique."""
    a, b = fx.side_pair(spark, sf_dir, "lineitem")
    found = preflight.run_preflight(a, b, (["l_linenumber", "l_returnflag"], ["line_no", "flag"]))
    return found.select("check", "severity", "subject", F.round("observed", 9).alias("observed"))


def titled_files(spark, sf_dir):
    """Lines of two files, each with its own titles, delimiter and columns, as one table by name."""
    lines = fx.derived(spark, sf_dir, "customer_files").repartitionByRange("file", "block").sortWithinPartitions("file", "at")
    found = file_dialects.table_of_files(lines, "search", skip_footer=1)
    return found.withColumnRenamed("segment, nation", "segment")


def hybrid_match(spark, sf_dir):
    """Supplier names matched by text first, what is left over by the vectors of their numbers; cosines of copies tie at four digits."""
    a, b = fx.side_pair(spark, sf_dir, "supplier")
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    lefts = a.join(vectors, a["s_suppkey"] == vectors["vec_id"])
    rights = b.join(vectors, b["supp_id"] + 1 == vectors["vec_id"])
    best = vector_matching.best_cosine_match(lefts, rights, "s_name", "supp_id", "embedding", HYBRID_THRESHOLD)
    named = best.join(b, best["right_id"] == b["supp_id"]).select(F.col("left_id").alias("left_name"), F.col("name").alias("right_name"), F.round("cosine", 4).alias("cosine"))
    return name_matching.hybrid_match(name_matching.names_of(a, "s_name", "s_suppkey"), name_matching.names_of(b, "name", "supp_id"), named)


def _written(spark: SparkSession, kind: str) -> str:
    """A new folder on the storage that driver and executors share."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written_mismatches(spark, sf_dir):
    """The mismatch table as the CSV that a run writes, read back."""
    path = _written(spark, "mismatches")
    sinks.write_mismatches(_compare(spark, sf_dir, "orders").mismatches, path)
    return spark.read.options(header=True, escape='"').csv(path)


def written_report(spark, sf_dir):
    """The report of a run, read back: every pair with its mode and score, and the score of the run."""
    found, path = _compare(spark, sf_dir, "orders"), _written(spark, "report")
    summary = reconcile.run_summary(found, "records")
    sinks.write_report(path, summary, scores.column_scores(found.findings, found.overview), found.coercion)
    summary, per_column, coerced = (spark.read.json(f"{path}/{part}") for part in ("summary", "column_scores", "coercion"))
    pairs = coerced.join(per_column, coerced["col_a"] == per_column["column"], "left")
    run_score = summary.select("score").scalar()
    return pairs.select("col_a", "col_b", "mode", "mismatches", F.round(per_column["score"], 6).alias("score"), run_score.alias("run_score"))


def sql_with_clause(spark, sf_dir):
    """A query with common table expressions and a subquery over given frames."""
    return structured.read_sql(
        spark, LATE_ORDERS, orders_in=fx.table(spark, sf_dir, "orders"), lines_in=fx.table(spark, sf_dir, "lineitem"))


HYBRID_THRESHOLD = 0.2
LATE_ORDERS = """WITH sizes AS (SELECT l_orderkey, count(*) AS n_lines FROM {lines_in} GROUP BY l_orderkey),
large AS (SELECT o_orderkey, o_orderpriority, n_lines FROM {orders_in} JOIN sizes ON o_orderkey = l_orderkey WHERE o_totalprice > 100000)
SELECT o_orderpriority, count(*) AS n_orders, sum(n_lines) AS n_lines FROM large
WHERE o_orderkey IN (SELECT l_orderkey FROM {lines_in} WHERE l_quantity >= 40) GROUP BY o_orderpriority"""
ORDER_PRESETS = (
    Preset("amounts", (("o_orderkey", "order_id"),), (Pair("o_custkey", "customer"), Pair("o_totalprice", "total", weight=2.0)),
           (AnyOf("o_orderstatus", ("status", "priority")),)),
    Preset("states", (("o_orderkey", "order_id"),), (Pair("o_orderstatus", "status"), Pair("o_totalprice", "total")), ()),
)


def preset_batch_mismatches(spark, sf_dir):
    """Two saved mappings with equal keys in one comparison, findings by mapping."""
    found = preset_batch.compare_presets(*fx.side_pair(spark, sf_dir, "orders"), ORDER_PRESETS)
    return found.findings.drop(keys.KEY_PARTS, keys.FOUND_IN)


def preset_batch_summaries(spark, sf_dir):
    """Their coverage, one row per mapping and kind of comparison."""
    shared = preset_batch.compare_presets(*fx.side_pair(spark, sf_dir, "orders"), ORDER_PRESETS)
    rows = [reconcile.run_summary(shared.of(m), m.approach).withColumn("preset", F.lit(m.preset)) for m in shared.members]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.select("preset", "approach", "score", "weighted_score", "total_keys", "joined_count", "missing_in_a", "missing_in_b", "mismatch_count")


QUERIES: dict[str, Query] = {
    q.__name__: q for q in (
        orders_record_mismatches, lineitem_composite_key_mismatches, lineitem_mismatches_counted, lineitem_mismatches_hot_keys,
        customer_record_mismatches, customer_case_sensitive_keys, any_of_mismatches, missing_in_b, missing_in_a,
        documents_without_labels, matched_rows, outer_rows, rows_of_mismatched_keys, pair_type_decision, orders_pair_types,
        numeric_pair_filter, convert_numeric_columns, type_overrides, normalise_text, blank_values, null_tokens,
        locale_numbers, fixed_width_field_table, drop_empty_columns, descriptive_stats_orders, union_key_count,
        joined_key_count, key_counts, coverage_summary, match_score, weighted_score, column_scores, score_bands,
        clean_columns, mismatch_frequency, crosstab_candidates, crosstab_by_priority, column_profile, mixed_type_columns,
        preflight_uniqueness, preflight_sequence, preflight_row_counts, preflight_join_size, latest_per_key, first_n_rows,
        review_sample, cosine_best_match, cosine_of_neighbours, fuzzy_record_mismatches, fuzzy_best_match, fuzzy_best_match_table, cosine_best_match_blocks, run_history_row, coverage_of_like_keys, csv_lines, tsv_lines, header_line, recent_runs,
        runs_retention, run_by_id, multi_line_records, sketched_key_counts, preflight_findings, orders_mismatches_by_digest,
        lineitem_mismatches_by_digest, applicant_layout_fields, json_array_records,
        preset_batch_mismatches, preset_batch_summaries, titled_files, hybrid_match, written_mismatches,
        written_report, sql_with_clause,
    )
}
