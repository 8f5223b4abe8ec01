"""The corpus pipeline: documents in, packed training windows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinledger.llm.decontam import clean_documents
from twinledger.llm.neardup import Forest, representatives
from twinledger.llm.packing import pack_documents, piece_digests
from twinledger.llm.quality import kept_documents
from twinledger.llm.secret_scan import example_findings, fit, masked_documents
from twinledger.llm.shared import scratch, table

#: Near-duplicate stages take shingles of five words and a similarity of 0.8.
NEAR = Forest(shingle=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules; cut-offs come from the documents given."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of least doc_id."""
    return representatives(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of benchmark."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked."""
    return masked_documents(docs, fit(example_findings(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, cut and packed into windows."""
    return piece_digests(pack_documents(docs))


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret scan", secret_scan), ("packing", packing),
]
#: Tokenizing and packing can't be said in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
