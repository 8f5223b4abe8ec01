"""Keys: normalised parts, key counts, latest record per key, rows of given keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import INTEGRAL, ident, quoted, stripped, type_of

# What a table of findings holds beside the shown columns: the key itself, and the sides that have it (both, a, b).
KEY_PARTS, FOUND_IN = "key_parts", "found_in"

NULL_KEY = "<NULL>"
OVERVIEW = (
    "total_keys", "joined_count", "missing_in_a", "missing_in_b", "rows_a", "rows_b", "joined_rows", "largest_a", "largest_b",
)


@dataclass(frozen=True)
class KeyPlan:
    """How the key columns of both sides become plain equi-join columns.

    Every part is joined on its own with a flag for a missing value, so no two keys collide and no text equals a
    missing key. Two integral columns keep their type; all other parts are compared as trimmed, by default upper-cased,
    text. Missing parts match each other, or are left out with ``null_keys="drop"``. The display is for readers only:
    what counts or joins keys uses the columns ``names``.
    """

    keys: tuple[tuple[str, str], ...]
    integral: tuple[bool, ...]
    case_sensitive: bool = False
    null_keys: str = "match"

    @classmethod
    def of(cls, a: DataFrame, b: DataFrame, keys, case_sensitive: bool = False, null_keys: str = "match") -> KeyPlan:
        if null_keys not in ("match", "drop"):
            raise ValueError("null_keys is 'match' or 'drop'")
        integral = tuple(isinstance(type_of(a, ka), INTEGRAL) and isinstance(type_of(b, kb), INTEGRAL) for ka, kb in keys)
        return cls(tuple(keys), integral, case_sensitive, null_keys)

    @property
    def names(self) -> list[str]:
        """The equi-join columns."""
        return [n for i in range(len(self.integral)) for n in (f"__key{i}", f"__key{i}_null")]

    @property
    def parts(self) -> Column:
        """All of ``names`` as one column: what a key is."""
        return F.struct(*self.names)

    @property
    def display(self) -> Column:
        """The key as one text, parts joined with ``|``, from the equi-join columns."""
        shown = [
            f"if(__key{i}_null, '{NULL_KEY}', CAST(__key{i} AS STRING))" for i in range(len(self.integral))
        ]
        return F.expr(shown[0] if len(shown) == 1 else f"concat_ws('|', {', '.join(shown)})")

    def columns(self, df: DataFrame, side: str) -> list[Column]:
        """The equi-join columns computed from one side's rows."""
        out = []
        for i, (pair, whole) in enumerate(zip(self.keys, self.integral)):
            name = pair[0] if side == "a" else pair[1]
            x = ident(name)
            if whole:
                out.append(F.expr(f"coalesce(CAST({x} AS BIGINT), 0L) AS __key{i}"))
                out.append(F.expr(f"isnull({x}) AS __key{i}_null"))
            else:
                text = stripped(x, type_of(df, name))
                text = text if self.case_sensitive else f"upper({text})"
                out.append(F.expr(f"coalesce({text}, '') AS __key{i}"))
                out.append(F.expr(f"isnull({text}) AS __key{i}_null"))
        return out

    def slim(self, df: DataFrame, side: str, extra: Sequence[Column] = ()) -> DataFrame:
        """Key columns and the wanted expressions of one side; the caller's frame stays as it is."""
        slim = df.select(*self.columns(df, side), *extra)
        if self.null_keys == "drop":
            slim = slim.where(" AND ".join(f"NOT __key{i}_null" for i in range(len(self.integral))))
        return slim


def key_rows(a: DataFrame, b: DataFrame, plan: KeyPlan) -> DataFrame:
    """One row per key of either side with its row counts ``n_a`` and ``n_b``.

    Keys are counted before they are brought together, so a key holding much of a table reaches the join
    as one row.
    """
    names = plan.names
    count_a = plan.slim(a, "a").groupBy(*names).agg(F.count(F.lit(1)).alias("n_a"))
    count_b = plan.slim(b, "b").groupBy(*names).agg(F.count(F.lit(1)).alias("n_b"))
    joined = count_a.join(count_b, names, "full_outer")
    return joined.withColumns({n: F.expr(f"coalesce({n}, 0L)") for n in ("n_a", "n_b")})


def overview_totals() -> list[Column]:
    """Aggregates over per-key row counts: keys in all, in both, on one side only, and rows."""
    forms = (
        "count(1)", "count_if(n_a > 0 AND n_b > 0)", "count_if(n_a = 0)", "count_if(n_b = 0)",
        "coalesce(sum(n_a), 0L)", "coalesce(sum(n_b), 0L)", "coalesce(sum(CAST(n_a AS DOUBLE) * n_b), 0.0D)",
        "coalesce(max(n_a), 0L)", "coalesce(max(n_b), 0L)",
    )
    return [F.expr(f"{form} AS {name}") for form, name in zip(forms, OVERVIEW)]


def key_overview(rows: DataFrame) -> DataFrame:
    """One row of ``overview_totals`` from a ``key_rows`` table."""
    return rows.agg(*overview_totals())


def union_key_count(a: DataFrame, b: DataFrame, plan: KeyPlan, approximate: bool = False) -> DataFrame:
    """Distinct keys over both sides; ``approximate`` counts with a sketch and no shuffle of keys."""
    both = plan.slim(a, "a").unionByName(plan.slim(b, "b"))
    if approximate:
        return both.agg(F.approx_count_distinct(F.struct(*plan.names)).alias("total_keys"))
    return both.groupBy(*plan.names).agg(F.lit(1)).agg(F.count(F.lit(1)).alias("total_keys"))


def joined_key_count(a: DataFrame, b: DataFrame, plan: KeyPlan) -> DataFrame:
    """Distinct keys found on both sides, in one grouping of the tagged union (no join)."""
    tagged = plan.slim(a, "a", [F.lit(1).alias("side")]).unionByName(plan.slim(b, "b", [F.lit(2).alias("side")]))
    sides = tagged.groupBy(*plan.names).agg(F.bit_or("side").alias("sides"))
    return sides.agg(F.count_if(F.col("sides") == 3).alias("joined_count"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key by ``order`` (later columns break ties).

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a key with very many
    rows is never gathered or sorted in one place.
    """
    newest = F.max_by(F.struct(*[quoted(c) for c in df.columns]), F.struct(*[quoted(c) for c in order]))
    return df.groupBy(*[quoted(k) for k in keys]).agg(newest.alias("newest")).select("newest.*")


def mismatched_keys(side: str, plan: KeyPlan, findings: DataFrame) -> DataFrame:
    """The equi-join columns of the keys of one side that occur in ``Comparison.findings``."""
    return findings.where(F.col(FOUND_IN).isin("both", side)).select(f"{KEY_PARTS}.*").select(*plan.names).distinct()


def rows_of_keys(df: DataFrame, side: str, plan: KeyPlan, findings: DataFrame) -> DataFrame:
    """The source rows whose key occurs in ``Comparison.findings``, with the key as ``row_key``."""
    keyed = plan.slim(df, side, [quoted(c) for c in df.columns])
    rows = keyed.join(mismatched_keys(side, plan, findings), plan.names, "left_semi")
    return rows.select(plan.display.alias("row_key"), *[quoted(c) for c in df.columns])
