"""Readers for delimited text: CSV, TSV and text files with titles, footers and locale numbers."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import locale_text, with_parsed
from ..functions.text import NULL_TOKENS, drop_null_tokens, ident, literal, quoted, strip
from .hygiene import clean_names, finish
from .quoted_records import ends_inside, records

# The delimiters tried in turn, the lines looked at for a header, the most rows left out.
DELIMITERS = ("\t", ",", "|")
HEADER_SEARCH_LINES = 10
MAX_SKIP = 20

# Text beyond the header's columns: an error, or kept as the whole line in a column of its own.
SURPLUS, SURPLUS_LINE = ("fail", "keep"), "surplus_line"

# Blocks that lose lines, at most this many, are sent to every task (some 20 MB).
BROADCAST_BLOCKS = 100_000

UTF8, LATIN1 = "UTF-8", "ISO-8859-1"


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid, else latin-1. The search ends at the first bad line.

    Valid files are read once in full for this; readers given an ``encoding`` skip it.
    """
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return UTF8 if bad.isEmpty() else LATIN1


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", null_tokens: Sequence[str] = NULL_TOKENS,
    encoding: str | None = None, multi_line: bool = False, keep_empty: bool = False, surplus: str = "fail",
) -> DataFrame:
    """A CSV file or folder with a header line, all columns as text so that leading zeros survive.

    ``multi_line`` allows line breaks within quotes; they become ``\\n``. Such files are cut in parallel as others are, see
    ``quoted_records``. Without it a quote left open in a line is an error, since its record would fall apart. A quote opens a value only
    at the start of a field. All files of a folder need the same header, in one line. Rows with fewer fields end in missing
    values; for rows with more see ``with_surplus``.
    """
    encoding = encoding or encoding_of(spark, path)
    header = _first_line(spark, path, encoding)
    names = clean_names(_split(header, sep))
    if _check_lines(spark, path, encoding, header, sep, multi_line):
        found = records(decoded_lines(spark, path, encoding, *_PLACE), sep)
        # The first record of a file is its header, which was compared above.
        body = found.where(f"NOT (block = 0 AND n = 1 AND {_without_marks('value')} <=> {literal(header)})")
        rows = table_of_lines(body, names, sep, surplus)
    else:
        raw = (
            spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("enforceSchema", True)
            .option("escape", '"').option("columnNameOfCorruptRecord", RAGGED).option("columnPruning", False)
            .schema(_all_text([*names, RAGGED])).csv(path)
        )
        rows = with_surplus(raw, len(names), sep, surplus)
    return finish(drop_null_tokens(rows, null_tokens), keep_empty)


# The column for lines that have more or fewer fields than the header, while a table is read.
RAGGED = "__ragged_line"


# Where a line comes from: its file, and its block's first byte.
_PLACE = ("_metadata.file_path AS file", "_metadata.file_block_start AS block")


def _without_marks(value: str) -> str:
    return rf"regexp_replace(regexp_replace({value}, '^\ufeff', ''), '\r$', '')"


def _check_lines(spark: SparkSession, path: str, encoding: str, header: str, sep: str, multi_line: bool) -> bool:
    """Whether any line leaves a quote open. One aggregate over the lines; files that start with another header are an error."""
    lines = decoded_lines(spark, path, encoding, *_PLACE).where(f"{strip('value')} <> ''").withColumn("at", F.monotonically_increasing_id())
    facts = lines.groupBy("file", "block").agg(
        F.count_if(F.expr(ends_inside("value", sep))).alias("open_quotes"), F.min_by("value", "at").alias("first"))
    other = F.expr(f"{_without_marks('first')} <> {literal(header)}")
    found = facts.agg(
        F.coalesce(F.sum("open_quotes"), F.lit(0)).alias("open_quotes"),
        F.coalesce(F.count_if((F.col("block") == 0) & other), F.lit(0)).alias("headers")).first()
    if found["headers"]:
        raise ValueError(f"{found['headers']} files of {path} start with another header than {header!r}")
    if found["open_quotes"] and not multi_line:
        raise ValueError(f"{found['open_quotes']} lines of {path} leave a quote open: read it with multi_line=True")
    return bool(found["open_quotes"])


def with_surplus(rows: DataFrame, n: int, sep: str, surplus: str = "fail") -> DataFrame:
    """The rows without RAGGED. A line with more than n fields is an error that counts them, or with ``surplus="keep"`` stands
    in the column ``surplus_line``, so that nothing is lost unseen."""
    if surplus not in SURPLUS:
        raise ValueError(f"surplus is one of {SURPLUS}")
    mark = "\\Q" + sep + "\\E"
    fields = F.size(F.split(F.col(RAGGED), mark + '(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    extra = F.col(RAGGED).isNotNull() & (fields > n)
    if surplus == "keep":
        return rows.withColumn(SURPLUS_LINE, F.when(extra, F.col(RAGGED))).drop(RAGGED)
    count = rows.agg(F.count_if(extra), F.count(quoted(rows.columns[0]))).first()[0]
    if count:
        raise ValueError(f"{count} lines have more fields than the {n} of the header: surplus='keep' shows them")
    return rows.drop(RAGGED)


def table_of_lines(lines: DataFrame, names: Sequence[str], sep: str = ",", surplus: str = "fail") -> DataFrame:
    """The records in a column ``value`` of lines, as text columns; the half of a reader that needs no file."""
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAGGED}
    parsed = lines.select(F.from_csv(F.col("value"), _ddl([*names, RAGGED]), options).alias("r")).select("r.*")
    return with_surplus(parsed, len(names), sep, surplus)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def _all_text(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def decoded_lines(spark: SparkSession, path: str, encoding: str, *more: str) -> DataFrame:
    """The lines of the files as text. Spark reads lines as bytes, so other encodings are decoded here."""
    value = "value" if encoding == UTF8 else f"decode(CAST(value AS BINARY), '{encoding}') AS value"
    return spark.read.text(path).selectExpr(*more, value)


def _first_line(spark: SparkSession, path: str, encoding: str) -> str:
    lines = decoded_lines(spark, path, encoding).where(f"{strip('value')} <> ''").head(1)
    if not lines:
        raise ValueError(f"no header line in {path}")
    return _clean_header(lines[0]["value"])


def _clean_header(line: str) -> str:
    return line.removeprefix("\ufeff").rstrip("\r")


def _split(line: str, sep: str) -> list[str]:
    """The column names in a header line."""
    fields = next(csv.reader([line], delimiter=sep), [])
    return [f if f.strip() else f"Unnamed: {i}" for i, f in enumerate(fields)]


def _placed_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``(file, block, at, value)`` of all lines that are not blank; ``at`` counts up within a block without gaps."""
    lines = decoded_lines(spark, path, encoding, "_metadata.file_path AS file", "_metadata.file_block_start AS block")
    return lines.where(f"{strip('value')} <> ''").withColumn("at", F.monotonically_increasing_id())


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: where its lines start, how many it has, how many its file has before it and in all.

    A file is read in blocks by many tasks. Only block counts are gathered, never lines.
    """
    counts = lines.groupBy("file", "block").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    of_file = Window.partitionBy("file")
    before = F.sum("n").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("lines_in_file", F.sum("n").over(of_file))


def numbered_lines(spark: SparkSession, path: str, encoding: str = UTF8) -> DataFrame:
    """``(file, line_no, lines_in_file, value)`` of all lines that are not blank, numbered from 0 in each file."""
    lines = _placed_lines(spark, path, encoding)
    return lines.join(_blocks(lines), ["file", "block"]).selectExpr("file", "before + at - first_at AS line_no", "lines_in_file", "value")


def body_lines(spark: SparkSession, path: str, skip_top: int, skip_bottom: int, encoding: str = UTF8) -> DataFrame:
    """The lines of every file without its first and last ones (blank lines do not count).

    Only the few blocks that lose lines are joined, as a small table, so the lines themselves are not shuffled.
    """
    lines = _placed_lines(spark, path, encoding)
    cuts = _blocks(lines).selectExpr(
        "file", "block", "first_at", "n",
        f"greatest(0L, least(n, {skip_top} - before)) AS top",
        f"greatest(0L, least(n, before + n - lines_in_file + {skip_bottom})) AS bottom",
    ).where("top > 0 OR bottom > 0")
    if cuts.count() <= BROADCAST_BLOCKS:
        cuts = F.broadcast(cuts)
    kept = lines.join(cuts, ["file", "block"], "left").where("top IS NULL OR at - first_at >= top AND at - first_at < n - bottom")
    return kept.select("value")


def _first_lines(spark: SparkSession, path: str, encoding: str, n: int) -> DataFrame:
    """``(line_no, value)`` of the first lines of one of the files."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").head(1)
    if not files:
        raise ValueError(f"no files in {path}")
    lines = decoded_lines(spark, files[0]["path"], encoding).where(f"{strip('value')} <> ''").limit(n).collect()
    return spark.createDataFrame([(i, r["value"]) for i, r in enumerate(lines)], "line_no bigint, value string")


def header_search(lines: DataFrame) -> DataFrame:
    """One row ``(header_row, fields)``: of the first 10 lines the one with most filled fields, the first on a tie.

    ``lines`` is ``(line_no, value)`` of one file; the delimiter of a line is the one that gives most fields.
    """
    counts = [f"size(filter(split(value, {literal(chr(92) + 'Q' + d + chr(92) + 'E')}), x -> {strip('x')} <> ''))" for d in DELIMITERS]
    filled = lines.where(f"line_no < {HEADER_SEARCH_LINES}").selectExpr("line_no", f"greatest({', '.join(counts)}) AS fields")
    return filled.agg(
        F.max_by("line_no", F.struct(F.col("fields"), -F.col("line_no"))).alias("header_row"), F.max("fields").alias("fields")
    )


def read_text(
    spark: SparkSession, path: str, header_row: int | str = 0, skip_footer: int = 0, locale: str = "US",
    type_hint: str = "auto", null_tokens: Sequence[str] = NULL_TOKENS, encoding: str | None = None, keep_empty: bool = False,
    surplus: str = "fail", max_skip: int = MAX_SKIP,
) -> DataFrame:
    """Delimited text with title lines above the header and total lines below, in every file of the path.

    ``header_row`` counts lines that are not blank from 0, or is ``"search"``. The delimiter is the first of
    tab, comma, pipe that gives the header more than one column. ``type_hint`` is ``auto`` (columns whose every
    value is a number of the locale become numbers), ``text`` or ``numeric``.
    """
    if type_hint not in ("auto", "text", "numeric"):
        raise ValueError("type_hint is 'auto', 'text' or 'numeric'")
    if not 0 <= skip_footer <= max_skip or (header_row != "search" and not 0 <= int(header_row) <= max_skip):
        raise ValueError(f"header_row and skip_footer lie between 0 and {max_skip}")
    encoding = encoding or encoding_of(spark, path)
    top = _first_lines(spark, path, encoding, max_skip + 1)
    if header_row == "search":
        header_row = header_search(top).first()["header_row"]
    found = top.where(F.col("line_no") == int(header_row)).select("value").head(1)
    if not found:
        raise ValueError(f"{path} has no line {header_row}")
    header = _clean_header(found[0]["value"])
    splits = [(d, _split(header, d)) for d in DELIMITERS]
    sep, fields = next(((d, f) for d, f in splits if len(f) > 1), splits[1])
    names = clean_names(fields)
    body = body_lines(spark, path, int(header_row) + 1, skip_footer, encoding)
    _check_text(spark, path, encoding, int(header_row), header, body, sep)
    rows = drop_null_tokens(table_of_lines(body, names, sep, surplus), null_tokens)
    return finish(_typed(rows, locale, type_hint), keep_empty)


def _check_text(spark: SparkSession, path: str, encoding: str, header_row: int, header: str, body: DataFrame, sep: str) -> None:
    """Every file of the path has the same header in the same line, and no record goes over the end of a line."""
    lines = _placed_lines(spark, path, encoding)
    # The one block of each file that holds the header line.
    blocks = _blocks(lines).where(F.expr(f"before <= {header_row} AND before + n > {header_row}")).select("file", "block", "first_at", "before")
    if blocks.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    headers = lines.join(blocks, ["file", "block"]).where(f"before + at - first_at = {header_row}")
    others = headers.where(f"{_without_marks('value')} <> {literal(header)}").count()
    if others:
        raise ValueError(f"{others} files of {path} have another header in line {header_row} than {header!r}")
    n_open = body.where(ends_inside("value", sep)).count()
    if n_open:
        raise ValueError(f"{n_open} lines of {path} leave a quote open")


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"{ident(n)} STRING" for n in names)


def _typed(rows: DataFrame, locale: str, type_hint: str) -> DataFrame:
    if type_hint == "text":
        return rows
    texts = {c: locale_text(ident(c), locale) for c in rows.columns}
    if type_hint == "numeric":
        return with_parsed(rows, texts)
    # Leading zeros mark identifiers: such a column stays text.
    parsed = with_parsed(rows, {f"{c} parsed": x for c, x in texts.items()})
    counts = parsed.agg(*[
        F.expr(f"count({ident(c)}) > 0 AND count({ident(c)}) = count({ident(c + ' parsed')}) "
               f"AND NOT bool_or(coalesce(rlike({strip(ident(c))}, r'^0[0-9]'), false))")
        for c in rows.columns
    ]).first()
    return with_parsed(rows, {c: texts[c] for c, numeric in zip(rows.columns, counts) if numeric})
