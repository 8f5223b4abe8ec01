"""Cutting long lineage between the steps of an iterative job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder under ``spark.checkpoint.dir``; an error where none is named or set on the context."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the session's checkpoint folder and go on from there.

    The folder is the one that ``spark.checkpoint.dir`` names, or was set on the context: it has to be shared by the
    driver and all executors, so none is made up here. ``spark.cleaner.referenceTracking.cleanCheckpoints``
    lets Spark remove the files with the frames.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
