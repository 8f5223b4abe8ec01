"""Run history: an append-only Parquet table of one row per run."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOWN_RUNS, KEPT_RUNS = 20, 100

RUN_FIELDS = {
    "run_id": "string", "ts": "timestamp", "approach": "string", "source_a_name": "string", "source_b_name": "string",
    "key_cols_a": "array<string>", "key_cols_b": "array<string>", "score": "double", "total_keys": "bigint",
    "joined_count": "bigint", "missing_in_a": "bigint", "missing_in_b": "bigint", "mismatch_count": "bigint",
    "column_pairs": "array<struct<a:string,b:string>>", "composite_pairs": "array<struct<a:string,bs:array<string>>>",
    "results_path": "string",
}
RUNS = ", ".join(f"{name} {kind}" for name, kind in RUN_FIELDS.items())


def save_run(spark: SparkSession, path: str, approach: str, **values) -> str:
    """Append a run and return its id. Lists default to empty ones; what isn't known is NULL."""
    unknown = set(values) - set(RUN_FIELDS)
    if unknown:
        raise ValueError(f"unknown run fields {sorted(unknown)}")
    defaults = {"key_cols_a": [], "key_cols_b": [], "column_pairs": [], "composite_pairs": []}
    row = {n: None for n in RUN_FIELDS} | defaults | {
        "run_id": uuid.uuid4().hex, "ts": datetime.now(timezone.utc), "approach": approach,
    } | values
    run = spark.createDataFrame([tuple(row[n] for n in RUN_FIELDS)], RUNS)
    run.withColumn("run_date", F.to_date("ts")).write.mode("append").partitionBy("run_date").parquet(path)
    return row["run_id"]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def recent_runs(runs: DataFrame, limit: int = SHOWN_RUNS) -> DataFrame:
    """The newest runs, newest first."""
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(limit)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def kept_runs(runs: DataFrame, keep: int = KEPT_RUNS) -> DataFrame:
    """The runs that retention keeps: the newest ones."""
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(keep)


def delete_old_runs(spark: SparkSession, path: str, keep: int = KEPT_RUNS) -> list[str]:
    """Delete the days that hold none of the newest runs, and return them.

    Whole ``run_date`` folders go, one delete each; nothing is rewritten or moved, so runs appended meanwhile stay and an
    interrupted call leaves a valid table. The oldest day kept may hold more than ``keep`` asks for; ``kept_runs`` cuts exactly.
    """
    oldest = kept_runs(read_runs(spark, path), keep).agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0]
    if oldest is None:
        return []
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(path_of(path)):
        name = status.getPath().getName()
        if name.startswith("run_date=") and name.removeprefix("run_date=") < oldest:
            files.delete(status.getPath(), True)
            gone.append(name.removeprefix("run_date="))
    return sorted(gone)
