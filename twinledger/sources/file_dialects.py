"""Folders of delimited text in which every file has its own title lines, delimiter and column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NULL_TOKENS, drop_null_tokens, ident, literal, strip
from ..operators.lineage import cut
from .delimited import (
    BROADCAST_BLOCKS, DELIMITERS, HEADER_SEARCH_LINES, MAX_SKIP, RAGGED, SURPLUS, SURPLUS_LINE, _blocks, _placed_lines, _typed, _without_marks,
    encoding_of,
)
from .hygiene import finish
from .quoted_records import ends_inside

FIELDS = "__fields"


def read_text_folder(
    spark: SparkSession, path: str, header_row: int | str = "search", skip_footer: int = 0, locale: str = "US",
    type_hint: str = "auto", null_tokens: Sequence[str] = NULL_TOKENS, encoding: str | None = None, keep_empty: bool = False,
    surplus: str = "fail", max_skip: int = MAX_SKIP,
) -> DataFrame:
    """As ``delimited.read_text``, but each file is read by its own header line, delimiter and column order.

    The table has all columns of all files by name; a file without a column has NULL there.
    """
    if type_hint not in ("auto", "text", "numeric"):
        raise ValueError("type_hint is 'auto', 'text' or 'numeric'")
    if not 0 <= skip_footer <= max_skip or (header_row != "search" and not 0 <= int(header_row) <= max_skip):
        raise ValueError(f"header_row and skip_footer lie between 0 and {max_skip}")
    lines = _placed_lines(spark, path, encoding or encoding_of(spark, path))
    rows = drop_null_tokens(table_of_files(lines, header_row, skip_footer, surplus), null_tokens)
    return finish(_typed(rows, locale, type_hint), keep_empty)


def split_outside_quotes(x: str, sep: str) -> str:
    """SQL for the fields of a line, quotes and all."""
    mark = chr(92) + "Q" + sep + chr(92) + "E" + '(?=(?:[^"]*"[^"]*")*[^"]*$)'
    return f"split({x}, {literal(mark)})"


def file_dialects(lines: DataFrame, header_row: int | str = "search") -> DataFrame:
    """``(file, header_row, sep, names)`` of every file, by one aggregate over its first lines ``(file, line_no, value)``.

    With ``"search"`` the header is, of the first 10 lines, the one with most filled fields under its best delimiter, the
    first on a tie. The delimiter is the first of tab, comma, pipe that gives the header more than one field, else comma.
    Fields without a name are called by their place.
    """
    if header_row == "search":
        sizes = [f"size(filter({split_outside_quotes('value', d)}, x -> {strip('x')} <> ''))" for d in DELIMITERS]
        top = lines.where(f"line_no < {HEADER_SEARCH_LINES}").withColumn("filled", F.expr(f"greatest({', '.join(sizes)})"))
        best = F.max_by(F.struct("line_no", "value"), F.struct("filled", -F.col("line_no")))
    else:
        top = lines.where(f"line_no = {int(header_row)}")
        best = F.min_by(F.struct("line_no", "value"), "line_no")
    header = top.groupBy("file").agg(best.alias("h")).selectExpr(
        "file", "h.line_no AS header_row", f"{_without_marks('h.value')} AS header")
    several = " ".join(f"WHEN size({split_outside_quotes('header', d)}) > 1 THEN {literal(d)}" for d in DELIMITERS)
    split = " ".join(f"WHEN sep = {literal(d)} THEN {split_outside_quotes('header', d)}" for d in DELIMITERS)
    bare = "regexp_replace(regexp_replace(x, '^\"(.*)\"$', '$1'), '\"\"', '\"')"
    named = f"transform(CASE {split} END, (x, i) -> if({strip(bare)} = '', concat('Unnamed: ', i), {strip(bare)}))"
    return header.withColumn("sep", F.expr(f"CASE {several} ELSE ',' END")).selectExpr("file", "header_row", "sep", f"{named} AS names")


def table_of_files(lines: DataFrame, header_row: int | str = "search", skip_footer: int = 0, surplus: str = "fail") -> DataFrame:
    """The records of lines ``(file, block, at, value)`` that are not blank, as text columns by name.

    ``at`` counts up without gaps within a block, and blocks follow one another in a file. What a file needs to be parsed goes
    to its blocks, as a small table of one row per block; lines are not shuffled.
    """
    if surplus not in SURPLUS:
        raise ValueError(f"surplus is one of {SURPLUS}")
    blocks = _blocks(lines)
    heads = lines.join(_small(blocks.where(f"before <= {MAX_SKIP}")), ["file", "block"])
    dialects = file_dialects(heads.selectExpr("file", "before + at - first_at AS line_no", "value"), header_row)
    placed = cut(blocks.join(dialects, "file", "left"))
    columns, widths = _layouts(placed, header_row)
    numbered = lines.join(_small(placed), ["file", "block"]).withColumn("line_no", F.expr("before + at - first_at"))
    body = numbered.where(f"line_no > header_row AND line_no < lines_in_file - {int(skip_footer)}")
    parsed = body.select("value", "sep", "names", F.expr(f"CASE {' '.join(_parsed(d, w) for d, w in widths.items())} END").alias(FIELDS))
    counts = " ".join(f"WHEN sep = {literal(d)} THEN size({split_outside_quotes('value', d)})" for d in widths)
    # Fields are counted only where there may be more than names.
    extra = f"{FIELDS}.ragged OR size(names) < size({FIELDS}.found)"
    parsed = parsed.withColumn("extra", F.expr(f"({extra}) AND CASE {counts} END > size(names)"))
    _check_lines(parsed, list(widths), surplus)
    taken = [f"get({FIELDS}.found, CAST(array_position(names, {literal(c)}) - 1 AS INT)) AS {ident(c)}" for c in columns]
    if surplus == "keep":
        taken.append(f"if(extra, value, NULL) AS {SURPLUS_LINE}")
    return parsed.selectExpr(*taken)


def _layouts(placed: DataFrame, header_row: int | str) -> tuple[list[str], dict[str, int]]:
    """All column names, in the order of the files and within them, and the most fields under each delimiter."""
    files = placed.where("block = 0 OR before = 0").groupBy("file").agg(
        F.first("sep").alias("sep"), F.first("names").alias("names"), F.first("header_row").alias("header_row"))
    faults = files.agg(
        F.count_if(F.col("header_row").isNull()).alias("headless"),
        F.count_if(F.size(F.array_distinct("names")) < F.size("names")).alias("twice"),
        F.count(F.lit(1)).alias("files")).first()
    if not faults["files"]:
        raise ValueError("no lines to read")
    if faults["headless"]:
        raise ValueError(f"{faults['headless']} files have no line {header_row}")
    if faults["twice"]:
        raise ValueError(f"{faults['twice']} files have duplicate column names")
    names = files.select("file", F.posexplode("names").alias("place", "name")).groupBy("name").agg(
        F.min(F.struct("file", "place")).alias("first")).orderBy("first")
    widths = files.groupBy("sep").agg(F.max(F.size("names")).alias("width")).collect()
    return [r["name"] for r in names.collect()], {r["sep"]: r["width"] for r in widths}


def _parsed(sep: str, width: int) -> str:
    """SQL for a line's values under one delimiter, and whether it has another number of fields than the widest header."""
    fields = [f"f{i}" for i in range(width)]
    schema = ", ".join(f"{f} STRING" for f in [*fields, RAGGED])
    options = f"map('sep', {literal(sep)}, 'escape', '\"', 'mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '{RAGGED}')"
    read = f"from_csv(value, '{schema}', {options})"
    values = ", ".join(f"r.{f}" for f in fields)
    struct = f"named_struct('found', array({values}), 'ragged', r.{RAGGED} IS NOT NULL)"
    return f"WHEN sep = {literal(sep)} THEN transform(array({read}), r -> {struct})[0]"


def _check_lines(parsed: DataFrame, seps: list[str], surplus: str) -> None:
    """No line leaves a quote open, and with ``surplus="fail"`` none has more fields than its file's header."""
    inside = " ".join(f"WHEN sep = {literal(d)} THEN {ends_inside('value', d)}" for d in seps)
    found = parsed.agg(F.count_if(F.expr(f"CASE {inside} END")).alias("open_quotes"), F.count_if("extra").alias("extra")).first()
    if found["open_quotes"]:
        raise ValueError(f"{found['open_quotes']} lines leave a quote open")
    if found["extra"] and surplus == "fail":
        raise ValueError(f"{found['extra']} lines have more fields than their header: surplus='keep' shows them")


def _small(blocks: DataFrame) -> DataFrame:
    """Sent to every task if there are few blocks; joined as Spark sees fit if there are many."""
    return F.broadcast(blocks) if blocks.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else blocks
