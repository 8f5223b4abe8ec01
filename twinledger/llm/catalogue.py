"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe_codec, decontam, langid, neardup, packing, periodic_runs, phrases, quality, secret_scan, sitetree, substring, suffix_dedup, tokenstore,
)
from .shared import scratch, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), folder)
    return tokenstore.document_digests(tokenstore.read_store(spark, folder))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.with_lengths(sitetree.extract_main_text(table(spark, sf_dir, "pages")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(table(spark, sf_dir, "documents")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated_windows(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.fit(secret_scan.example_findings(spark))
    return secret_scan.findings(secret_scan.scan_documents(table(spark, sf_dir, "documents"), model))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(bpe_codec.decode_documents(bpe_codec.encode_documents(table(spark, sf_dir, "documents"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.find_runs(table(spark, sf_dir, "documents"), periodic_runs.planted_periods))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_token_store, op3_benchmark_decontamination, op4_quality_rules, op5_near_duplicates, op6_site_tree, op7_packing,
    op8_suffix_dedup, op9_substring_dedup, op10_secret_scan, op11_bpe_round_trip, op12_periodic_runs, op13_collocations,
)}
ORACLE: dict[str, str] = {"op4_quality_rules": quality.duckdb_sql(), "op13_collocations": phrases.duckdb_sql()}
