"""Readers for JSON, Parquet, database queries and views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from .hygiene import finish
from .json_arrays import read_arrays

# Fixed value: seconds to wait for a database connection.
LOGIN_TIMEOUT = 10


def read_json(spark: SparkSession, path: str, lines: bool = False, keep_empty: bool = False) -> DataFrame:
    """Records of JSON files: one array (or object) per file, or one object per line with ``lines``.

    Files of either form are cut in parallel, arrays by ``json_arrays``.
    """
    return finish(spark.read.json(path) if lines else read_arrays(spark, path), keep_empty)


def read_parquet(spark: SparkSession, path: str, keep_empty: bool = True) -> DataFrame:
    """Parquet files. Looking for empty columns reads the data once more, so it is off unless wanted."""
    return finish(spark.read.parquet(path), keep_empty)


# What hides brackets and words in SQL: texts, quoted names and comments. Else brackets, and the word that starts the query proper.
_SQL_TOKENS = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\]|--[^\n]*|/\*.*?\*/|(?P<mark>[()]|\bSELECT\b)""", re.I | re.S)


def split_with_clause(query: str) -> tuple[str | None, str]:
    """A leading WITH clause (None without one) and the query after it: the first SELECT outside of brackets."""
    if not re.match(r"(?is)(\s|--[^\n]*\n|/\*.*?\*/)*WITH\b", query):
        return None, query
    depth = 0
    for found in _SQL_TOKENS.finditer(query):
        mark = found["mark"]
        if mark in ("(", ")"):
            depth += 1 if mark == "(" else -1
        elif mark and depth == 0:
            return query[:found.start()].strip(), query[found.start():].strip()
    raise ValueError("a WITH clause without a SELECT after it")


def database_reader(
    spark: SparkSession, url: str, query: str | None = None, with_clause: str | None = None, table: str | None = None,
    split_column: str | None = None, lower: str | None = None, upper: str | None = None, splits: int | None = None,
    fetch_size: int = 10_000, **login: str,
) -> DataFrameReader:
    """A JDBC reader for a query or a table, with login options passed through.

    A leading WITH clause is told apart from its query, which stands in a subquery of its own; it may also be given as ``with_clause``. A table is read
    by many tasks if a numeric or date ``split_column`` with its bounds is named; one query is one task.
    """
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    options = {"url": url, "loginTimeout": str(LOGIN_TIMEOUT), "fetchsize": str(fetch_size), **login}
    if query is not None:
        if with_clause is None:
            with_clause, query = split_with_clause(query)
        options["query"] = query
        if with_clause:
            options["prepareQuery"] = with_clause
    else:
        options["dbtable"] = table
        if split_column:
            if lower is None or upper is None or not splits:
                raise ValueError("split_column needs lower, upper and splits")
            options |= {
                "partitionColumn": split_column, "lowerBound": str(lower), "upperBound": str(upper),
                "numPartitions": str(splits),
            }
    return spark.read.format("jdbc").options(**options)


def read_database(spark: SparkSession, url: str, **options) -> DataFrame:
    return finish(database_reader(spark, url, **options).load(), keep_empty=True)


def read_sql(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """Any Spark SQL query (CTEs and subqueries included) over the session's tables and the given frames."""
    return finish(spark.sql(query, **views), keep_empty=True)
