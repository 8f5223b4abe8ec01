"""Writing results: mismatches and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_mismatches(mismatches: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> bool:
    """Write the mismatch table as CSV (with header) or Parquet. Nothing is written, and False returned, if it is empty.

    Looking for a first row stops at the first one found; keep the table with ``persist`` if it was costly.
    """
    if mismatches.isEmpty():
        return False
    writer = mismatches.write.mode(mode)
    if format == "csv":
        # White space around a value may be what differs.
        writer.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(format).save(path)
    return True


def write_report(path: str, summary: DataFrame, column_scores: DataFrame, coercion: DataFrame, mode: str = "errorifexists") -> None:
    """The report of a run as three JSON tables: summary, scores per column, type handling notes."""
    for name, table in (("summary", summary), ("column_scores", column_scores), ("coercion", coercion)):
        table.coalesce(1).write.mode(mode).json(f"{path}/{name}")
