"""Records of JSON files that hold one array, or one value after another, cut in parallel wherever line breaks stand.

A file is read in pieces that end at its closing braces, so that an array in one line is read by many tasks too. Whether a brace closes a
record depends on all text before it: on whether it stands in a string, and on the depth of brackets. A piece is a function of the first
that also adds to the second, and so is a block of pieces. Only the functions of blocks are gathered and put one behind
the other; then every task cuts its own pieces, and only records that cross blocks are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import literal
from ..operators.lineage import checkpoint_folder, cut
from .quoted_records import BROADCAST_BLOCKS, starting_states

END = "}"
_STRING = r'"(?:[^"\\]|\\.)*+"'
_REST_OF_STRING = r'(?s)^(?:[^"\\]|\\.)*+"'


def _bare(text: str) -> str:
    """SQL: the text without whole strings, and without what follows a quote that stays open but that quote."""
    whole = f"regexp_replace({text}, {literal('(?s)' + _STRING)}, '')"
    return f"regexp_replace({whole}, {literal('(?s)\".*$')}, '\"')"


def _end_and_depth(bare: str) -> str:
    """SQL: whether a piece ends inside a string, and how much deeper it ends, its closing brace included."""
    inside = f"endswith({bare}, '\"')"
    deeper = f"length(regexp_replace({bare}, {literal(r'[^\[{]')}, '')) - length(regexp_replace({bare}, {literal(r'[^\]}]')}, ''))"
    return f"named_struct('inside', {inside}, 'deeper', {deeper} - if({inside}, 0, 1))"


def _judged(pieces: DataFrame) -> DataFrame:
    """Each piece with what it makes of either state it may begin in."""
    rest = f"regexp_replace(value, {literal(_REST_OF_STRING)}, '')"
    stays = f"NOT rlike(value, {literal(_REST_OF_STRING)})"
    bare = pieces.selectExpr("file", "block", "value", f"{_bare('value')} AS bare", f"if({stays}, NULL, {_bare(rest)}) AS bare_rest")
    found = bare.selectExpr(
        "file", "block", "value", f"{_end_and_depth('bare')} AS o",
        f"if(bare_rest IS NULL, named_struct('inside', true, 'deeper', 0), {_end_and_depth('bare_rest')}) AS i")
    return found.selectExpr("file", "block", "value", "o.inside AS from_outside", "o.deeper AS outside_deeper", "i.inside AS from_inside", "i.deeper AS inside_deeper")


FUNCTIONS = "file string, block bigint, from_outside boolean, outside_deeper bigint, from_inside boolean, inside_deeper bigint, is_array boolean"
_FUNCTIONS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_outside", pa.bool_()), ("outside_deeper", pa.int64()),
                        ("from_inside", pa.bool_()), ("inside_deeper", pa.int64()), ("is_array", pa.bool_())])
CUT = "file string, block bigint, n bigint, open boolean, piece string"
_CUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("open", pa.bool_()), ("piece", pa.string())])
_BEFORE = "\ufeff \t\r\n"


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _block_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block what it makes of either state; ``is_array`` says whether its text begins with a square bracket."""
    key, out = None, []
    for batch in batches:
        for file, block, value, o_inside, o_deeper, i_inside, i_deeper in _rows_of(batch):
            if (file, block) != key:
                if key is not None:
                    out.append((*key, s, d, t, e, is_array))
                key, s, d, t, e = (file, block), False, 0, True, 0
                is_array = value.lstrip(_BEFORE).startswith("[")
            s, d = (i_inside, d + i_deeper) if s else (o_inside, d + o_deeper)
            t, e = (i_inside, e + i_deeper) if t else (o_inside, e + o_deeper)
        if out:
            yield _record_batch(out, _FUNCTIONS)
            out = []
    if key is not None:
        yield _record_batch([(*key, s, d, t, e, is_array)], _FUNCTIONS)


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block. ``n`` counts from 0, where 0 is what continues a record of the block before;
    ``open`` marks the last one if it goes on in the next block."""
    key, held, out = None, [], []
    for batch in batches:
        for file, block, value, o_inside, o_deeper, i_inside, i_deeper, starts_inside, starts_depth, base, _ in _rows_of(batch):
            if (file, block) != key:
                if held:
                    out.append((*key, n, True, "".join(held)))
                key, held, inside, depth = (file, block), [], starts_inside, starts_depth
                # A block that begins between records, or before all of them, continues none.
                n = 0 if inside or depth > base else 1
            held.append(value + END)
            inside, depth = (i_inside, depth + i_deeper) if inside else (o_inside, depth + o_deeper)
            if not inside and depth <= base:
                out.append((*key, n, False, "".join(held)))
                n, held = n + 1, []
        if len(out) >= 4096:
            yield _record_batch(out, _CUT)
            out = []
    if held:
        out.append((*key, n, True, "".join(held)))
    if out:
        yield _record_batch(out, _CUT)


def json_records(pieces: DataFrame) -> DataFrame:
    """``(file, block, n, value)``: the objects in the ``(file, block, value)`` pieces of texts that end at each ``}``, which come block by
    block in their order and lack that brace.

    A text is one array of objects, or objects one after another. Line breaks between tokens become blanks. A text whose brackets or
    strings do not close, and elements that are no objects, are errors; only the very last brace of objects one after another is
    not missed. An empty text or array has no records.
    """
    judged = _judged(pieces)
    functions = cut(judged.mapInArrow(_block_functions, FUNCTIONS))
    of_file = Window.partitionBy("file")
    order = of_file.orderBy("block")
    starts = starting_states(functions).withColumn("deeper", F.expr("if(starts_inside, inside_deeper, outside_deeper)"))
    starts = starts.withColumn("depth", F.coalesce(F.sum("deeper").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = cut(starts.withColumn("base", F.first(F.expr("CAST(is_array AS INT)")).over(order)))
    # The last piece of a text has no brace of its own: after the end of an array, or of all objects, one too many is counted.
    ends = starts.where("is_last").selectExpr("if(starts_inside, from_inside, from_outside) OR NOT (depth + deeper = -1 OR base = 0 AND depth + deeper = 0) AS broken")
    n_broken = ends.agg(F.count_if("broken")).first()[0]
    if n_broken:
        raise ValueError(f"{n_broken} JSON texts end within a string or within brackets")
    known = starts.select("file", "block", "starts_inside", "depth", "base")
    # Spark drops a sort below a join unless something like this number, which is read to the end, stands between them.
    placed = judged.withColumn("at", F.monotonically_increasing_id())
    if known.count() <= BROADCAST_BLOCKS:
        told = placed.join(F.broadcast(known), ["file", "block"])
    else:
        told = placed.join(known, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    told = told.select("file", "block", "value", "from_outside", "outside_deeper", "from_inside", "inside_deeper", "starts_inside", "depth", "base", "at")
    found = told.mapInArrow(_cut_pieces, CUT)
    whole = found.where("n > 0 AND NOT open").selectExpr("file", "block", "n", "piece AS value")
    parts = found.where("n = 0 OR open")
    begun = F.sum(F.expr("CAST(n > 0 AS INT)")).over(of_file.orderBy("block", "n"))
    crossing = parts.withColumn("record", begun).groupBy("file", "record").agg(
        F.min(F.struct("block", "n")).alias("first"), F.array_sort(F.collect_list(F.struct("block", "n", "piece"))).alias("parts"))
    crossing = crossing.selectExpr("file", "first.block AS block", "first.n AS n", "array_join(transform(parts, p -> p.piece), '') AS value")
    # What stands between records goes: the array's own brackets and commas. What is left without an object is the end of a text.
    bare = whole.unionByName(crossing).selectExpr(
        "file", "block", "n", r"regexp_replace(regexp_replace(value, '^[\uFEFF\\s]*\\[?[\\s,]*', ''), '[\r\n]+', ' ') AS value")
    told = "concat('an element of a JSON array is no object: ', left(value, 80))"
    objects = f"CASE WHEN startswith(value, '{{') THEN value ELSE CAST(raise_error({told}) AS STRING) END AS value"
    return bare.where(r"NOT rlike(value, '^\\]?\\s*}$')").selectExpr("file", "block", "n", objects)


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of JSON files up to each closing brace, by file and block."""
    return spark.read.option("lineSep", END).text(path).selectExpr("_metadata.file_path AS file", "_metadata.file_block_start AS block", "value")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON files as columns. They are written once as lines to the folder of ``spark.checkpoint.dir``, from where types
    are found and values are read."""
    folder = f"{checkpoint_folder(spark)}/json-{uuid.uuid4().hex}"
    json_records(json_pieces(spark, path)).select("value").write.text(folder)
    return spark.read.json(folder)
