"""Column types: which pairs compare as numbers, whole-column conversion, type overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import as_number, is_identifier, parse_number, parse_stripped
from ..functions.text import INTEGRAL, ident, is_numeric, literal, present_text, quoted, render, stripped, type_of
from ..spec import Rule
from .keys import KeyPlan
from .rows import side_by_side

# The shares that decide a pair's type, and the notes that say how it was handled.
ID_SHARE = 0.05
NUMERIC_SHARE = 0.9
CONVERT_SHARE = 0.8
NOTE_ID = "ID pattern detected — string comparison"
NOTE_NUMERIC = "Numeric handling applied"
NOTE_TEXT = "String fallback — mixed types"
BLANKS_ID = " (blanks normalized to missing)"
BLANKS_OTHER = " (blanks standardized to missing)"

Modes = dict[tuple[str, str], str]

_FACTS = ("filled", "ids", "numbers", "blanks")


def column_pairs(rules: Sequence[Rule]) -> list[tuple[str, str]]:
    return [(r.a, t) for r in rules for t in r.targets]


def with_values(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns as their trimmed text ``t0, t1, …`` and their number ``v0, v1, …``.

    Two projections, so that every value is trimmed and parsed once, however many facts are taken from it.
    """
    first, second = [], {}
    for i, name in enumerate(names):
        x, dtype = ident(name), type_of(df, name)
        if is_numeric(dtype):
            first.append(f"{as_number(x, dtype)} AS v{i}")
            continue
        first.append(f"{stripped(x, dtype)} AS t{i}")
        second[f"v{i}"] = F.expr(parse_stripped(f"t{i}") if isinstance(dtype, T.StringType) else "CAST(NULL AS DOUBLE)")
    values = df.selectExpr(*keep, *first)
    return values.withColumns(second) if second else values


def _facts(df: DataFrame, names: Sequence[str], side: str) -> list[Column]:
    """Counts over a group of rows of ``with_values``: filled values, identifiers, numbers, blanks."""
    out = []
    for i, name in enumerate(names):
        if is_numeric(type_of(df, name)):
            forms = (f"count(v{i})", "count_if(false)", f"count(v{i})", "count_if(false)")
        else:
            forms = (f"count_if(t{i} <> '')", f"count_if({is_identifier(f't{i}')})", f"count(v{i})", f"count_if(t{i} = '')")
        out += [F.expr(f"{form} AS {side}{i}_{label}") for label, form in zip(_FACTS, forms)]
    return out


def key_facts(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]], plan: KeyPlan) -> DataFrame:
    """One row per key of either side: its row counts, and the value facts of the paired columns.

    Each side is counted per key before the two meet, so the join sees every key once per side, whatever
    share of the rows it holds, and no matched row is ever built.
    """
    sides = []
    for frame, side, names in ((a, "a", _sources(pairs)), (b, "b", _targets(pairs))):
        keyed = plan.slim(frame, side, [quoted(n) for n in names])
        values = with_values(keyed, names, plan.names)
        sides.append(values.groupBy(*plan.names).agg(F.count(F.lit(1)).alias(f"n_{side}"), *_facts(frame, names, side)))
    joined = sides[0].join(sides[1], plan.names, "full_outer")
    return joined.withColumns({n: F.expr(f"coalesce({n}, 0L)") for n in ("n_a", "n_b")})


def _sources(pairs: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({p for p, _ in pairs})


def _targets(pairs: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({q for _, q in pairs})


def matched_totals(pairs: Sequence[tuple[str, str]]) -> list[Column]:
    """Aggregates over ``key_facts``: every fact weighted by the other side's rows, as in the joined rows."""
    weights = (("a", _sources(pairs), "n_b"), ("b", _targets(pairs), "n_a"))
    return [
        F.expr(f"coalesce(sum(CAST({side}{i}_{label} AS DOUBLE) * {other}), 0.0D) AS {side}{i}_{label}")
        for side, names, other in weights
        for i in range(len(names))
        for label in _FACTS
    ]


def pair_types(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]], plan: KeyPlan | None = None) -> DataFrame:
    """One row per column pair: value shares on both sides, the chosen mode and its note.

    With a key plan the shares are those of the matched rows, without one those of the whole columns.
    """
    if plan is not None:
        totals = key_facts(a, b, pairs, plan).agg(*matched_totals(pairs))
    else:
        whole = []
        for df, side, names in ((a, "a", _sources(pairs)), (b, "b", _targets(pairs))):
            counts = with_values(df, names).agg(*_facts(df, names, side))
            whole.append(counts.selectExpr(*[f"CAST({c} AS DOUBLE) AS {c}" for c in counts.columns]))
        totals = side_by_side(*whole)
    return with_decision(totals.select(pair_rows(pairs)))


def pair_rows(pairs: Sequence[tuple[str, str]]) -> Column:
    """Generator: the one row of totals as one row per pair."""
    names_a, names_b = _sources(pairs), _targets(pairs)
    rows = [_pair_row(p, names_a.index(p[0]), names_b.index(p[1]), i) for i, p in enumerate(pairs)]
    return F.expr(f"inline(array({', '.join(rows)}))")


def _pair_row(pair: tuple[str, str], ia: int, ib: int, position: int) -> str:
    def share(side: str, fact: str) -> str:
        return f"coalesce(try_divide({side}_{fact}, {side}_filled), 0.0D)"

    a, b = f"a{ia}", f"b{ib}"
    lost = f"{a}_filled - {a}_numbers + {b}_filled - {b}_numbers"
    fields = {
        "position": str(position), "col_a": literal(pair[0]), "col_b": literal(pair[1]),
        "n_a": f"try_cast({a}_filled AS BIGINT)", "n_b": f"try_cast({b}_filled AS BIGINT)",
        "id_rate_a": share(a, "ids"), "id_rate_b": share(b, "ids"),
        "num_rate_a": share(a, "numbers"), "num_rate_b": share(b, "numbers"),
        "blanks_found": f"{a}_blanks > 0 OR {b}_blanks > 0", "n_unparseable": f"try_cast({lost} AS BIGINT)",
    }
    return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in fields.items()) + ")"


def with_decision(shares: DataFrame) -> DataFrame:
    """Add ``mode`` and ``note`` to the shares of each pair."""
    is_id = f"(id_rate_a > {ID_SHARE}D OR id_rate_b > {ID_SHARE}D)"
    is_number = f"(num_rate_a > {NUMERIC_SHARE}D AND num_rate_b > {NUMERIC_SHARE}D)"
    note = f"CASE WHEN {is_id} THEN {literal(NOTE_ID)} WHEN {is_number} THEN {literal(NOTE_NUMERIC)} ELSE {literal(NOTE_TEXT)} END"
    suffix = f"CASE WHEN NOT blanks_found THEN '' WHEN {is_id} THEN {literal(BLANKS_ID)} ELSE {literal(BLANKS_OTHER)} END"
    return shares.selectExpr(
        "*", f"if(NOT {is_id} AND {is_number}, 'numeric', 'text') AS mode", f"concat({note}, {suffix}) AS note"
    )


def known_modes(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Modes:
    """Pairs whose mode follows from the schema: two number columns never look like identifiers and always parse."""
    return {(p, q): "numeric" for p, q in pairs if is_numeric(type_of(a, p)) and is_numeric(type_of(b, q))}


def numeric_pairs(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The pairs that compare as numbers over whole columns (``kept``) and those to skip."""
    types = pair_types(a, b, pairs)
    return types.select("col_a", "col_b", (F.col("mode") == "numeric").alias("kept"), "note")


def convert_numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Make DOUBLE of the text columns of which more than 80% of all rows parse as numbers."""
    names = [c for c in columns if c in df.columns and not is_numeric(type_of(df, c))]
    if not names:
        return df
    numbers = {n: as_number(ident(n), type_of(df, n)) for n in names}
    shares = df.agg(*[F.expr(f"coalesce(try_divide(count({x}), count(1)), 0.0D)") for x in numbers.values()]).first()
    return df.withColumns({n: F.expr(x) for share, (n, x) in zip(shares, numbers.items()) if share > CONVERT_SHARE})


# Date and time patterns tried in turn by the Datetime override.
DATETIME_PATTERNS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
    "yyyyMMdd", "dd-MMM-yyyy",
)


def apply_overrides(df: DataFrame, overrides: Mapping[str, str]) -> DataFrame:
    """Force column types: Auto, Numeric, String, Integer, Datetime. What does not convert becomes NULL.

    Integer keeps a column as it is if it holds fractions, as a failing conversion leaves the column alone.
    """
    changed: dict[str, str] = {}
    for name, target in overrides.items():
        if name not in df.columns or target == "Auto":
            continue
        x, dtype = ident(name), type_of(df, name)
        if target == "Numeric":
            changed[name] = x if is_numeric(dtype) else as_number(x, dtype)
        elif target == "String":
            changed[name] = render(x, dtype)
        elif target == "Integer":
            number = as_number(x, dtype)
            if isinstance(dtype, INTEGRAL):
                changed[name] = f"CAST({x} AS BIGINT)"
            elif df.where(f"{number} <> floor({number})").isEmpty():
                changed[name] = f"try_cast({number} AS BIGINT)"
        elif target == "Datetime":
            if isinstance(dtype, T.DateType):
                changed[name] = f"CAST({x} AS TIMESTAMP_NTZ)"
            elif not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
                text = present_text(x, dtype)
                tries = [f"CAST(try_to_timestamp({text}, {literal(p)}) AS TIMESTAMP_NTZ)" for p in DATETIME_PATTERNS]
                changed[name] = f"coalesce({', '.join(tries)})"
        else:
            raise ValueError(f"unknown type override {target!r}")
    return df.withColumns({n: F.expr(x) for n, x in changed.items()}) if changed else df


def is_mixed(x: str, dtype: T.DataType) -> str:
    """Aggregate: a text column where some values parse as numbers and some do not."""
    if not isinstance(dtype, T.StringType):
        return "false"
    return f"count({parse_number(x)}) > 0 AND count({parse_number(x)}) < count({x})"
