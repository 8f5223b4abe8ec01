"""Text rules: rendering to text, trimming, blanks, missing tokens.

Rules are written as Spark SQL text and composed as text; ``F.expr`` turns the whole into one expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WHITESPACE_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"

# Texts that mean "missing" in files.
NULL_TOKENS = ("", "NULL", "null", "NA", "N/A", "n/a", "None", "nan", "NaN", "#N/A")

FLOATING = (T.DoubleType, T.FloatType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans are not numbers here."""
    return isinstance(dtype, T.NumericType)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def ident(name: str) -> str:
    """A column name as SQL, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """A column by its exact name."""
    return F.col(ident(name))


def literal(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(x: str) -> str:
    """Trim Unicode white space; plain ``trim`` removes only U+0020.

    Texts that start and end with a printable ASCII character, nearly all, skip the search for each white space.
    """
    printable = "BETWEEN 33 AND 126"
    return f"CASE WHEN ascii({x}) {printable} AND ascii(right({x}, 1)) {printable} THEN {x} ELSE btrim({x}, {_WHITESPACE_SQL}) END"


def render(x: str, dtype: T.DataType) -> str:
    """A value as text: whole numbers without ``.0``, nested values as JSON, NaN as missing."""
    if isinstance(dtype, T.StringType):
        return x
    text = f"CAST({x} AS STRING)"
    if isinstance(dtype, FLOATING):
        return (
            f"CASE WHEN isnan({x}) THEN NULL WHEN abs({x}) < 1e15 AND {x} = floor({x}) THEN CAST(try_cast({x} AS BIGINT) AS STRING) "
            f"WHEN abs({x}) >= 1e7 AND abs({x}) < 1e15 THEN rtrim('0', CAST(try_cast({text} AS DECIMAL(38,18)) AS STRING)) "
            f"ELSE {text} END"
        )
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return f"to_json({x})"
    return text


def stripped(x: str, dtype: T.DataType) -> str:
    """A value as trimmed text; what is rendered from other types has no white space to trim."""
    return strip(x) if isinstance(dtype, T.StringType) else render(x, dtype)


def present_text(x: str, dtype: T.DataType) -> str:
    """Trimmed text, blanks as NULL; case is kept."""
    return f"nullif({stripped(x, dtype)}, '')"


def normal_text(x: str, dtype: T.DataType) -> str:
    """The form texts are compared in: trimmed and upper case, with an empty text for blank and missing alike."""
    return f"coalesce(upper({stripped(x, dtype)}), '')"


def is_missing(x: str, dtype: T.DataType) -> str:
    """True for NULL and NaN."""
    return f"({x} IS NULL OR isnan({x}))" if isinstance(dtype, FLOATING) else f"{x} IS NULL"


def is_blank(x: str, dtype: T.DataType) -> str:
    """True where a text is there but holds white space only."""
    return f"coalesce({strip(x)} = '', false)" if isinstance(dtype, T.StringType) else "false"


def drop_null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn missing-value tokens in every text column into NULL."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    listed = ", ".join(literal(t) for t in tokens)
    if not listed:
        return df
    return df.withColumns({n: F.expr(f"CASE WHEN {ident(n)} NOT IN ({listed}) THEN {ident(n)} END") for n in texts})
