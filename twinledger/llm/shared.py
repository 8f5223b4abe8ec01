"""What the operators of this subpackage share: reading tables, the scratch folder, checked broadcasts, stable columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows up to which a small side may be broadcast; the caller counts first.
BROADCAST_ROWS = 100_000
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir. Where none is set, a folder of this machine serves a
    local session, as in tests; a cluster has to name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="twinledger-llm-"))
        folder = context.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder that spark.checkpoint.dir names."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept_table(frame: DataFrame, kind: str) -> DataFrame:
    """Writes the frame as Parquet to the shared folder and reads it back: lineage ends, later jobs read only the columns they need."""
    path = scratch(frame.sparkSession, kind)
    schema = frame.schema
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(schema).parquet(path)


def small_side(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it is proven to hold at most `limit` rows, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as empty, and further columns; whatever else the frame holds is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, columns unchanged, whose doc_id is among ids (one column, doc_id); null matches null."""
    wanted = ids.select(F.col("doc_id").cast("long").alias("_wanted_id")).distinct()
    return docs.join(wanted, same(docs["doc_id"].cast("long"), wanted["_wanted_id"]), "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select(F.col("doc_id").cast("long").alias("_wanted_id")).distinct()
    return docs.join(wanted, same(docs["doc_id"].cast("long"), wanted["_wanted_id"]), "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
