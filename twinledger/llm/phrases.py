"""Collocations: phrases of two or three words that occur together more often than their parts let expect.

Texts become blocks of word numbers with a dictionary per block; words that are frequent enough get ids; each task counts the
n-grams of its blocks in counting quotient filters and hands them on by shard; the filters of a shard are merged.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.taskcontext import TaskContext

from .quotient_filter import Layout, added_up, built, entries
from .shared import kept_table
from .textscan import give_back

UNKNOWN = "und"
#: Words whose n-grams a task makes at once.
SLICE_WORDS = 1 << 17
#: Upper-case letters to lower ones; whatever parts pieces to a full stop; tabs to blanks.
_TURNED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


@dataclasses.dataclass(frozen=True)
class Phrases:
    #: Occurrences of a candidate, per language.
    least: int = 10
    #: A shorter candidate goes if a longer one around it has this share (in hundredths) of its occurrences.
    absorbed: int = 50
    #: Phrases given per language.
    top: int = 2000
    #: Words in a block, entries in a shard and entries that a task holds before it hands filters on; they bound memory, not results.
    block_words: int = 1 << 20
    shard_entries: int = 1 << 20
    held_entries: int = 1 << 20


class _Numbers(dict):
    """Numbers new words by the order in which they come; 0 is the border of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


BLOCKS = "block string, lang string, words array<string>, counts array<long>, numbers binary"


def _blocks_of(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("block", pa.string()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
                        ("numbers", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        open_blocks: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            for lang, (numbers, parts) in open_blocks.items():
                row = np.concatenate(parts)
                words = [w.decode() for w in numbers if w != b"."]
                counts = np.bincount(row, minlength=len(numbers))[1:]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{part}-{made}"]), pa.array([lang]), pa.array([words], pa.list_(pa.string())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([row.tobytes()], pa.binary())], schema=schema)
            made, held = made + 1, 0
            open_blocks.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                if lang not in open_blocks:
                    open_blocks[lang] = _Numbers(), []
                numbers, parts = open_blocks[lang]
                words = text.as_py().encode().translate(_TURNED).replace(b".", b" . ").split()
                words.append(b".")
                parts.append(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words)))
                held += len(words)
                if held >= limit:
                    yield from out()
        if open_blocks:
            yield from out()
        give_back()

    return make


def text_blocks(docs: DataFrame, settings: Phrases) -> DataFrame:
    """Per block and language the distinct words, their counts, and the words of all texts by number (0: border)."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_blocks_of(settings.block_words), BLOCKS)


def frequent_words(blocks: DataFrame, least: int) -> DataFrame:
    """lang, word, f and a dense id from 1 of every word that occurs `least` times in its language."""
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    counted = words.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).where(F.col("f") >= least)
    within = F.monotonically_increasing_id()
    # The place within the partition is in the lower 33 bits; written, so that places stay as they are.
    kept = kept_table(counted.select("lang", "word", "f", F.shiftright(within, 33).alias("part"), within.bitwiseAND((1 << 33) - 1).alias("place")),
                      "phrase-words")
    sizes = kept.groupBy("part").count()
    # One row per partition of the step before.
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return kept.join(F.broadcast(before), "part").select("lang", "word", "f", (F.col("before") + F.col("place") + 1).alias("id"))


def _grams(row: np.ndarray, first: int) -> np.ndarray:
    """The stretches of two and three ids without a 0 that begin at the first places, as rows of three ids; the third is 0 in
    stretches of two."""
    two = ((row[:-1] > 0) & (row[1:] > 0))[:first]
    three = two[:max(0, len(row) - 2)] & (row[2:first + 2] > 0)
    at2, at3 = np.flatnonzero(two), np.flatnonzero(three)
    out = np.zeros((len(at2) + len(at3), 3), np.int64)
    out[:len(at2), 0], out[:len(at2), 1] = row[at2], row[at2 + 1]
    for i in range(3):
        out[len(at2):, i] = row[at3 + i]
    return out


def _counter(layout: Layout, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("shard", pa.int64()), ("filter", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return added_up(*(np.concatenate(x) for x in zip(*held)), layout.half)

        def out() -> Iterator[pa.RecordBatch]:
            high, low, counts = merged()
            held.clear()
            shard = (high >> np.uint64(layout.rest)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            for lo, hi in zip(first, [*first[1:], len(shard)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard[lo]]), pa.array([built(layout, high[lo:hi], low[lo:hi], counts[lo:hi])], pa.binary())], schema=schema)

        for batch in batches:
            for numbers, places, ids in zip(batch.column(0), batch.column(1), batch.column(2)):
                row = np.frombuffer(numbers.as_py(), "<u4")
                known = np.zeros(int(row.max(initial=0)) + 1, np.int64)
                known[places.values.to_numpy(zero_copy_only=False) + 1] = ids.values.to_numpy(zero_copy_only=False)
                row = known[row]
                for at in range(0, len(row), SLICE_WORDS):
                    high, low = layout.permuted(_grams(row[at:at + SLICE_WORDS + 2], SLICE_WORDS))
                    if not len(high):
                        continue
                    held.append(added_up(high, low, np.ones(len(high), np.int64), layout.half))
                    if sum(len(h[0]) for h in held) >= limit:
                        held[:] = [merged()]
                        # What hardly shrank is handed on, else merging would begin to repeat itself.
                        if len(held[0][0]) >= limit // 2:
                            yield from out()
        if held:
            yield from out()
        give_back()

    return count


def _merger(layout: Layout, least: int) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        parts = [entries(layout, f.as_py()) for f in table.column("filter")]
        high, low, counts = added_up(*(np.concatenate(x) for x in zip(*parts)), layout.half)
        kept = counts >= least
        ids = layout.ids(high[kept], low[kept]).astype(np.int64)
        found = pa.table({"w1": ids[:, 0], "w2": ids[:, 1], "w3": ids[:, 2], "a": counts[kept].astype(np.int64)})
        give_back()
        return found

    return merge


def phrase_counts(blocks: DataFrame, words: DataFrame, settings: Phrases) -> DataFrame:
    """w1, w2, w3 (ids; 0 for phrases of two words) and a, the exact count, of every phrase with a >= least."""
    sizes = blocks.agg(F.coalesce(F.sum(F.expr("octet_length(numbers) div 4")), F.lit(0)).alias("n")).first()
    n_words = words.count()
    layout = Layout(max(1, n_words.bit_length()), max(0, (2 * sizes.n // settings.shard_entries).bit_length()))
    local = (
        blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
        .join(words.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("block", "lang").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))
    )
    filters = (
        blocks.select("block", "lang", "numbers").join(local, ["block", "lang"]).select("numbers", "places", "ids")
        .mapInArrow(_counter(layout, settings.held_entries), "shard long, filter binary")
    )
    return filters.groupBy("shard").applyInArrow(_merger(layout, settings.least), "w1 long, w2 long, w3 long, a long")


def _scored(frame: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """l, r and score of the lowest-scoring cut; of equal ones the first. Decimals hold the products of counts up to 10^15."""
    wide = "decimal(16,0)"

    def score(left: str, right: str) -> str:
        a = f"CAST(a AS {wide})"
        return f"CAST((CAST(1000000 AS decimal(7,0)) * ({a} * {a})) div (CAST({left} AS {wide}) * CAST({right} AS {wide})) AS long)"

    options = ", ".join(f"struct({score(left, right)} AS score, {k} AS k, {left} AS l, {right} AS r)" for k, (left, right) in enumerate(cuts))
    return frame.withColumn("cut", F.expr(f"array_min(array({options}))")).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def _top(scored: DataFrame, top: int, parts: int) -> DataFrame:
    """rank of the first rows of each language. Each of `parts` slices of a language gives its own first rows before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).drop("slice")


def collocations(docs: DataFrame, settings: Phrases = Phrases()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, then a, then the phrase's bytes.

    A-Z are lower-cased; pieces end at `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+`. Counts are exact and per language: n of all words,
    a of the phrase, l and r of the two parts at its lowest-scoring cut, score = floor(1000000*a*a/(l*r)). Candidates have two or
    three words and a >= least; one that a longer candidate holds goes if that has `absorbed` hundredths of its count or more.

    A null lang counts as `und`; null and empty texts have no words. Rows that repeat count as often as they occur. Ties in score and a
    go by phrase, so ranks are unique. An empty table, or one without frequent phrases, gives no rows. Very long texts make a block of their
    own. doc_id isn't used; further columns are left out.
    """
    spark: SparkSession = docs.sparkSession
    blocks = kept_table(text_blocks(docs, settings), "phrase-blocks")
    words = frequent_words(blocks, settings.least)
    counts = kept_table(phrase_counts(blocks, words, settings), "phrase-counts")
    totals = blocks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("n"))

    def word(n: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{n}"), F.col("word").alias(f"t{n}"), F.col("f").alias(f"f{n}"), *(["lang"] if n == 1 else []))

    two, three = counts.where("w3 = 0").drop("w3"), counts.where("w3 > 0")
    around = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longest = around.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    pairs = two.join(longest, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {settings.absorbed} * a")
    pairs = pairs.join(word(1), "w1").join(word(2), "w2").withColumn("phrase", F.concat_ws(" ", "t1", "t2"))
    heads = two.select("w1", "w2", F.col("a").alias("head"))
    tails = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail"))
    triples = three.join(heads, ["w1", "w2"]).join(tails, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    triples = triples.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    scored = _scored(pairs, [("f1", "f2")]).unionByName(_scored(triples, [("f1", "tail"), ("head", "f3")]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _top(scored, settings.top, parts).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def duckdb_sql(settings: Phrases = Phrases()) -> str:
    """The same over the table documents."""
    return f"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(body, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang,
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (
  SELECT lang, 1 AS size, w[i] AS w1, '' AS w2, '' AS w3 FROM placed
  UNION ALL SELECT lang, 2, w[i], w[i + 1], '' FROM placed WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i], w[i + 1], w[i + 2] FROM placed WHERE i + 2 <= len(w)),
counted AS (SELECT lang, size, w1, w2, w3, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang),
one AS (SELECT lang, w1, f FROM counted WHERE size = 1),
two AS (SELECT lang, w1, w2, f FROM counted WHERE size = 2),
three AS (SELECT * FROM counted WHERE size = 3 AND f >= {settings.least}),
around AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
pairs AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM two t LEFT JOIN around o USING (lang, w1, w2) JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE t.f >= {settings.least} AND (o.longer IS NULL OR 100 * o.longer < {settings.absorbed} * t.f)),
triples AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
cuts AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM (SELECT * FROM pairs UNION ALL SELECT * FROM triples)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN totals USING (lang)
WHERE rank <= {settings.top}"""
