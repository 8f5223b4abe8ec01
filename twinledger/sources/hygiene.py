"""Table hygiene after reading: names, missing tokens, empty columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, ident, quoted, render, type_of


def clean_names(names: Sequence) -> list[str]:
    """Column names as trimmed text; an error if two are the same."""
    trimmed = [str(n).strip(WHITESPACE) for n in names]
    twice = sorted(n for n, k in Counter(trimmed).items() if k > 1)
    if twice:
        raise ValueError(f"duplicate column names: {twice}")
    return trimmed


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value, found in one pass over all columns (an empty table has none)."""
    filled = [F.expr(f"count({render(ident(c), type_of(df, c))})") for c in df.columns]
    rows, *counts = df.agg(F.count(F.lit(1)), *filled).first()
    return [c for c, n in zip(df.columns, counts) if n == 0] if rows else []


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table without its empty columns, and their names."""
    empty = empty_columns(df)
    return df.select(*[quoted(c) for c in df.columns if c not in empty]), empty


def finish(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """What every reader ends with: trimmed unique names, empty columns left out."""
    named = trim_names(df)
    return named if keep_empty else drop_empty_columns(named)[0]
