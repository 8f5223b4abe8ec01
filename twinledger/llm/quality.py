"""Quality rules with adaptive thresholds, in DataFrame and SQL functions only.

Each document gets counts (words, symbols, repeated lines, repeated words) and whole-number measures from them. A quantile
sketch per language, source and measure is a histogram with steps of at most 1/32 of the value: a count per bucket, so sketches merge by
adding counts, in any order, with the same result. The cut-off of a group is its upper quartile plus `reach` times the distance
of its quartiles (at least the measure's least spread): a group keeps its usual documents whatever is usual
for it. Groups under `least_docs` documents take the cut-offs of their language, then of all documents. The cut-offs are
joined to the documents, and a document over any of them goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import keep_ids, kept_table, small_side

WORD_GAP = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Measure:
    """A whole-number measure of a document, and the least distance of the quartiles that counts as spread."""

    name: str
    expression: str
    least_spread: int


#: In thousandths, but for the word length, in hundredths of a code point.
MEASURES = (
    Measure("symbols", "1000 * n_symbols div greatest(word_chars, 1)", 10),
    Measure("dup_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", 150),
    Measure("repeat_words", "1000 * n_repeat_words div greatest(n_words, 1)", 150),
    Measure("word_length", "100 * word_chars div greatest(n_words, 1)", 150),
)


@dataclass(frozen=True)
class QualityRules:
    least_words: int = 50
    most_repeat_percent: int = 50
    least_docs: int = 100
    reach: int = 3
    measures: tuple[Measure, ...] = MEASURES


def document_counts(docs: DataFrame, *more: str) -> DataFrame:
    """Counts of every whole text (null: empty) beside doc_id, lang and source."""
    gap, lines = f"'{WORD_GAP}'", "filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    cells = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                    F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
        .selectExpr("*", f"array_remove(split(text, {gap}), '') AS words", f"{lines} AS lines")
        .selectExpr("*", "CASE WHEN size(words) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(words) - 3), "
                         "i -> xxhash64(words[i], words[i + 1], words[i + 2])) END AS windows")
    )
    # array(x) with transform(...)[0] names a value once, so that it isn't worked out again for every element.
    repeated = """
      CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
        transform(array(array_sort(transform(windows, (h, i) -> struct(h, i)))), s ->
          aggregate(
            array_sort(transform(
              filter(s, (x, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h)),
              x -> x.i)),
            struct(-3 AS last, 0L AS covered),
            (a, p) -> struct(p AS last, a.covered + least(3, p - a.last) AS covered),
            a -> a.covered))[0]
      END"""
    return cells.selectExpr(
        "doc_id", "lang", "source", *more,
        "cast(size(words) AS bigint) AS n_words",
        "cast(char_length(array_join(words, '')) AS bigint) AS word_chars",
        f"cast(regexp_count(text, '{SYMBOLS}') AS bigint) AS n_symbols",
        "cast(size(lines) AS bigint) AS n_lines",
        "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines",
        f"cast({repeated} AS bigint) AS n_repeat_words",
    )


def bucket(value: str) -> str:
    """Lower edge of the value's bucket: exact below 64, then steps of 1/32 of the power of two below."""
    cases = " ".join(f"WHEN {value} < {2 ** b} THEN {value} - {value} % {2 ** (b - 6)}" for b in range(7, 62))
    return f"CASE WHEN {value} < 64 THEN {value} {cases} ELSE {value} - {value} % {2 ** 56} END"


def sketches(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketch of each group; partial counts meet, not rows."""
    pairs = ", ".join(f"'{m.name}', {m.name}" for m in rules.measures)
    long = measured.filter("NOT base_failed").selectExpr("lang", "source", f"stack({len(rules.measures)}, {pairs}) AS (measure, value)")
    return long.selectExpr("lang", "source", "measure", f"{bucket('value')} AS bucket").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """docs, q1 and q3 of each group and measure: the least bucket that holds the quartile."""
    group = Window.partitionBy(*keys, "measure")
    ranked = (
        sketch.withColumn("docs", F.sum("n").over(group))
        .withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    )
    return ranked.groupBy(*keys, "measure").agg(
        F.max("docs").alias("docs"),
        F.min(F.expr("CASE WHEN 4 * upto >= docs THEN bucket END")).alias("q1"),
        F.min(F.expr("CASE WHEN 4 * upto >= 3 * docs THEN bucket END")).alias("q3"),
    )


def cutoffs(sketch: DataFrame, keys: list[str], rules: QualityRules) -> DataFrame:
    """One row per group that is large enough: a column <measure>_most for each measure."""
    spread = "CASE measure " + " ".join(f"WHEN '{m.name}' THEN {m.least_spread}" for m in rules.measures) + " END"
    limits = quartiles(sketch, keys).filter(F.col("docs") >= (rules.least_docs if keys else 1)).withColumn(
        "most", F.expr(f"q3 + {rules.reach} * greatest(q3 - q1, {spread})"))
    named = [F.max(F.when(F.col("measure") == m.name, F.col("most"))).alias(m.name) for m in rules.measures]
    return limits.groupBy(*keys).agg(*named) if keys else limits.agg(*named)


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    the measures with the cut-offs that held for it.

    base_failed: under least_words words, or more than most_repeat_percent of the words in repeated windows of three words.
    Such documents don't enter the sketches. Null text counts as empty, a null lang or source as the empty name; a null
    doc_id stays; repeated rows count as often as they occur; further columns are left out; an empty table gives no rows.
    """
    counted = document_counts(docs).withColumn(
        "base_failed", F.expr(f"n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeat_percent} * n_words"))
    # The counts are worked out once; sketches and filtering read this narrow table.
    measured = kept_table(counted.selectExpr("*", *[f"{m.expression} AS {m.name}" for m in rules.measures]), "measures")
    sketch = kept_table(sketches(measured, rules), "sketches")
    joined = measured
    for level, keys in (("source", ["lang", "source"]), ("lang", ["lang"])):
        limits = cutoffs(merged(sketch, keys), keys, rules)
        renamed = small_side(limits.select(*keys, *[F.col(m.name).alias(f"{m.name}_{level}") for m in rules.measures]))
        joined = joined.join(renamed, keys, "left")
    over_all = cutoffs(merged(sketch, []), [], rules).first()

    def most(m: Measure) -> Column:
        fallback = over_all[m.name] if over_all else None
        return F.coalesce(F.col(f"{m.name}_source"), F.col(f"{m.name}_lang"), F.lit(fallback).cast("long"))

    within = F.lit(True)
    for m in rules.measures:
        within = within & F.coalesce(F.col(m.name) <= most(m), F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & within).alias("kept"), *[m.name for m in rules.measures], *[most(m).alias(f"{m.name}_most") for m in rules.measures])


def kept_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs, columns unchanged, whose document passes. If a doc_id repeats, its rows stay when any of them passes."""
    return keep_ids(docs, quality_rules(docs, rules).filter("kept").select("doc_id"))


def duckdb_sql(rules: QualityRules = QualityRules()) -> str:
    """The same rules over the view `documents` in DuckDB SQL, counting by unnested words instead of arrays."""
    names = [m.name for m in rules.measures]
    spread = "CASE measure " + " ".join(f"WHEN '{m.name}' THEN {m.least_spread}" for m in rules.measures) + " END"
    measures = ", ".join(f"CAST({m.expression.replace(' div ', ' // ')} AS BIGINT) AS {m.name}" for m in rules.measures)

    def level(keys: list[str], name: str) -> str:
        by = "".join(f"{k}, " for k in keys)
        least = f"HAVING max(docs) >= {rules.least_docs}" if keys else ""
        return f"""
  {name}_q AS (SELECT {by}measure, bucket, sum(n) OVER (PARTITION BY {by}measure) AS docs,
      sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto
    FROM (SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)),
  {name}_m AS (SELECT {by}measure, q3 + {rules.reach} * greatest(q3 - q1, {spread}) AS most
    FROM (SELECT {by}measure, min(bucket) FILTER (4 * upto >= docs) AS q1, min(bucket) FILTER (4 * upto >= 3 * docs) AS q3
      FROM {name}_q GROUP BY {by}measure {least})),
  {name}_l AS (SELECT {by}{', '.join(f"max(most) FILTER (measure = '{m}') AS {m}" for m in names)} FROM {name}_m {'GROUP BY ' + by.rstrip(', ') if keys else ''})"""

    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS value FROM measured WHERE NOT base_failed" for m in names)
    most = {m: f"CAST(coalesce(s.{m}, l.{m}, a.{m}) AS BIGINT)" for m in names}
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
  grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
  twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
  covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
  ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
  c AS (SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN w USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN covered USING (doc_id)),
  measured AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeat_percent} * n_words AS base_failed, {measures} FROM c),
  sketch AS (SELECT lang, source, measure, {bucket('value')} AS bucket, count(*) AS n FROM ({union}) GROUP BY ALL),{level(['lang', 'source'], 's')},{level(['lang'], 'l')},{level([], 'a')}
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(f'coalesce(m.{n} <= {most[n]}, true)' for n in names)} AS kept,
  {', '.join(f'm.{n}' for n in names)}, {', '.join(f'{most[n]} AS {n}_most' for n in names)}
FROM measured m LEFT JOIN s_l s ON m.lang = s.lang AND m.source = s.source LEFT JOIN l_l l ON m.lang = l.lang CROSS JOIN a_l a
"""
