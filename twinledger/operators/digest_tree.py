"""Comparing two large tables that are mostly equal: digests per bucket of keys first, then only the buckets that differ.

Both sides are summed up where they lie: a few numbers per bucket and task are all that is shuffled, whatever the rows hold. Digests can be
stored and put together from parts of a table, and bucket numbers cut short give the digests of coarser levels.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_number
from ..functions.text import ident, normal_text, type_of
from ..spec import check_columns, key_pairs, rules_from
from .coercion import column_pairs
from .keys import KeyPlan
from .lineage import cut
from .records import Comparison, compare_records
from .survey import modes_only

# Buckets per side; the numbers of those that differ go to every task, so this is bounded (8 MB).
BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 20

_SUMS = tuple(f"sum_{i}" for i in range(4))


@dataclass
class Changed:
    """The comparison of the rows in differing buckets: its findings are those of the whole tables, its key counts are not."""

    comparison: Comparison
    n_buckets: int
    n_differing: int

    @property
    def mismatches(self) -> DataFrame:
        return self.comparison.mismatches


def _bucket(plan: KeyPlan, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*plan.names), F.lit(buckets)).alias("bucket")


def _digested(df: DataFrame, plan: KeyPlan, side: str, pairs: list[tuple[str, str]], modes: Mapping, buckets: int) -> DataFrame:
    """``(bucket, key_1, key_2, row_1, row_2)`` of every row. Rows of two sides with equal digests have equal keys and no finding."""
    cells = []
    for i, pair in enumerate(pairs):
        name = pair[0] if side == "a" else pair[1]
        x, kind = ident(name), type_of(df, name)
        form = f"coalesce(CAST({as_number(x, kind)} AS STRING), '')" if modes[pair] == "numeric" else normal_text(x, kind)
        cells.append(F.expr(form).alias(f"cell_{i}"))
    slim = plan.slim(df, side, cells)
    names = [f"cell_{i}" for i in range(len(pairs))]
    hashes = [F.xxhash64(F.lit(seed), *columns).alias(f"{kind}_{seed}") for kind, columns in (("key", plan.names), ("row", [*plan.names, *names])) for seed in (1, 2)]
    return slim.select(_bucket(plan, buckets), *hashes)


def bucket_digests(df: DataFrame, plan: KeyPlan, side: str, pairs: list[tuple[str, str]], modes: Mapping, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n_rows, sum_0..sum_3)``: two 64-bit digests of every row, summed in halves so that no sum overflows."""
    halves = [F.expr(e) for seed in (1, 2) for e in (f"row_{seed} & 4294967295L", f"shiftrightunsigned(row_{seed}, 32)")]
    return _digested(df, plan, side, pairs, modes, buckets).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(h).alias(n) for h, n in zip(halves, _SUMS)])


def added_up(digests: DataFrame, buckets: int | None = None) -> DataFrame:
    """Digests of parts of a table as those of the whole; with ``buckets`` (a divisor of their number) those of a coarser level."""
    bucket = F.col("bucket") if buckets is None else F.pmod(F.col("bucket"), F.lit(buckets)).alias("bucket")
    return digests.groupBy(bucket).agg(*[F.sum(c).alias(c) for c in ("n_rows", *_SUMS)])


def differing_buckets(digests_a: DataFrame, digests_b: DataFrame) -> DataFrame:
    """``bucket`` of those whose digests differ, or that one side lacks."""
    facts = ["n_rows", *_SUMS]
    other = digests_b.select("bucket", *[F.col(c).alias(f"other_{c}") for c in facts])
    same = " AND ".join(f"{c} <=> other_{c}" for c in facts)
    return digests_a.join(other, "bucket", "full_outer").where(f"NOT ({same})").select("bucket")


def _buckets_of_mixed_keys(digested: DataFrame) -> DataFrame:
    """Buckets with a key that has rows of different values: many-to-many matching finds those even where both sides are equal."""
    rows = F.struct("row_1", "row_2")
    mixed = digested.groupBy("bucket", "key_1", "key_2").agg(F.min(rows).alias("low"), F.max(rows).alias("high"))
    return mixed.where("low <> high").select("bucket").distinct()


def compare_changed(
    a: DataFrame, b: DataFrame, keys, columns, *, modes: Mapping | None = None, unique: bool = False, buckets: int = BUCKETS,
    case_sensitive: bool = False, null_keys: str = "match", **options,
) -> Changed:
    """The findings of ``compare_records``, with only the rows of differing buckets joined.

    The type decision needs the matched rows, so ``modes`` for all pairs that are not of two number columns saves a join of the whole
    tables. ``unique`` says that keys are unique on at least one side (as ``preflight`` finds out); without it the keys of A are grouped
    by 16 bytes each, as rows that share a key have findings of their own. Other options are those of ``compare``.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets lie between 1 and {MOST_BUCKETS}")
    rules, named = rules_from(columns), key_pairs(keys)
    check_columns(a, b, named, rules)
    plan, pairs = KeyPlan.of(a, b, named, case_sensitive, null_keys), column_pairs(rules)
    open_pairs = [p for p in pairs if p not in (modes or {})]
    modes = {**(modes_only(a, b, plan, open_pairs) if open_pairs else {}), **dict(modes or {})}
    differing = differing_buckets(*(bucket_digests(df, plan, side, pairs, modes, buckets) for df, side in ((a, "a"), (b, "b"))))
    if not unique:
        differing = differing.unionByName(_buckets_of_mixed_keys(_digested(a, plan, "a", pairs, modes, buckets))).distinct()
    differing = cut(differing)

    def rows(df: DataFrame, side: str) -> DataFrame:
        placed = df.withColumns({f"__side_{i}": c for i, c in enumerate(plan.columns(df, side))})
        bucket = F.pmod(F.xxhash64(*[f"__side_{i}" for i in range(len(plan.names))]), F.lit(buckets))
        kept = placed.withColumn("__bucket", bucket).join(F.broadcast(differing.withColumnRenamed("bucket", "__bucket")), "__bucket", "left_semi")
        return kept.select(*df.columns)

    found = compare_records(
        rows(a, "a"), rows(b, "b"), named, columns, modes=modes, case_sensitive=case_sensitive, null_keys=null_keys, **options)
    return Changed(found, buckets, differing.count())
