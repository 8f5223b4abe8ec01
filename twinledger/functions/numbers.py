"""Number rules: guarded parsing, tolerance, identifiers, locale marks. Written as Spark SQL text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import FLOATING, ident, is_numeric, strip

RTOL = 1e-5
ATOL = 1e-8

# The accepted spellings of numbers and infinities, and the shape of identifiers.
DECIMAL_SPELLING = r"r'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
INFINITE_SPELLINGS = "'inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity'"
IDENTIFIER = r"r'^([A-Za-z]|0)\p{Nd}+$'"

INFINITY = "double('Infinity')"


def parse_number(x: str) -> str:
    """Text to DOUBLE, anything but a plainly written number to NULL (so is ``NaN``, and ``1e400``)."""
    return parse_stripped(strip(x))


def parse_stripped(t: str) -> str:
    """``parse_number`` of a text without white space at its ends.

    The first character (``+`` to ``9``) rules out most other texts before a pattern is tried. A remainder by infinity
    leaves finite numbers as they are and makes NaN of an overflow.
    """
    return (
        f"CASE WHEN ascii({t}) BETWEEN 43 AND 57 AND rlike({t}, {DECIMAL_SPELLING}) "
        f"THEN nanvl(try_cast({t} AS DOUBLE) % {INFINITY}, NULL) "
        f"WHEN lower({t}) IN ({INFINITE_SPELLINGS}) THEN try_cast({t} AS DOUBLE) END"
    )


def with_parsed(df: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """Add (or replace) number columns parsed from trimmed texts, given as SQL.

    Two projections: Spark makes each text once and does not merge them, as the text is used several times.
    """
    if not texts:
        return df
    made = df.withColumns({f"__text_{n}": F.expr(x) for n, x in texts.items()})
    parsed = made.withColumns({n: F.expr(parse_stripped(ident(f"__text_{n}"))) for n in texts})
    return parsed.drop(*[f"__text_{n}" for n in texts])


def as_number(x: str, dtype: T.DataType) -> str:
    """Any column as DOUBLE for comparing; NULL where it is missing or no number."""
    if isinstance(dtype, FLOATING):
        return f"nanvl(CAST({x} AS DOUBLE), NULL)"
    if is_numeric(dtype):
        return f"CAST({x} AS DOUBLE)"
    return parse_number(x) if isinstance(dtype, T.StringType) else "CAST(NULL AS DOUBLE)"


def is_identifier(t: str) -> str:
    """Letter and digits (``A12345``) or a leading zero (``00123``): must be compared as text. Takes trimmed text.

    A second character that is plainly no digit settles it before the pattern is tried.
    """
    return f"(ascii(substring({t}, 2, 1)) NOT BETWEEN 58 AND 127 AND rlike({t}, {IDENTIFIER}))"


def numbers_differ(a: str, b: str, rtol: float = RTOL, atol: float = ATOL) -> str:
    """True unless equal within ``atol + rtol*|b|`` or both missing; the tolerance scales with B.

    Infinities equal only themselves, so the tolerance counts for finite numbers.
    """
    near = f"abs({a}) < {INFINITY} AND abs({b}) < {INFINITY} AND abs({a} - {b}) <= double('{atol!r}') + double('{rtol!r}') * abs({b})"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN isnull({a}) <> isnull({b}) ELSE NOT ({a} = {b} OR ({near})) END"


def texts_differ(a: str, b: str) -> str:
    """For texts in normal form, in which no value is NULL."""
    return f"{a} <> {b}"


def locale_text(x: str, locale: str = "US") -> str:
    """``1,234.5`` (US) or ``1.234,5`` (EU) as a trimmed text that parses as a number."""
    decimal, thousands = {"US": (".", ","), "EU": (",", ".")}[locale]
    return f"translate(translate({strip(x)}, '{thousands}', ''), '{decimal}', '.')"
