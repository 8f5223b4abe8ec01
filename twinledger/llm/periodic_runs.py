"""Periodic stretches of words in whole texts: found by block convolution, reported as runs, and collapsed to one period."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .block_matches import Runs, seeds
from .shared import text_of

#: Words that are searched together, unless one document alone has more.
BATCH_WORDS = 1 << 17
OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as its words."""
    numbered = []
    for words in texts:
        number: dict[bytes, int] = {}
        numbered.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in numbered])]).astype(np.int64)
    found: dict[int, Runs] = {}
    for width, places, lags in seeds(np.concatenate([np.zeros(0, np.int64), *numbered]), starts):
        doc = np.searchsorted(starts, places, "right") - 1
        order = np.argsort(doc, kind="stable")
        doc, places, lags = doc[order], places[order], lags[order]
        held, begins = np.unique(doc, return_index=True)
        for d, lo, hi in zip(held.tolist(), begins, [*begins[1:], len(doc)]):
            found.setdefault(d, Runs(numbered[d])).extend(width, places[lo:hi] - starts[d], lags[lo:hi])
    return [found[d].listed() if d in found else [] for d in range(len(texts))]


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0)])


def _finder(rewrite: Rewrite | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], pa.list_(_RUN)),
            pa.array([without_repeats(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string()),
        ], schema=_SCHEMA)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                # Splitting bytes takes just the white space of the word pattern [^\x20\x09-\x0D]+.
                words = text.as_py().encode().split()
                if rewrite:
                    words = rewrite(doc_id.as_py(), words)
                ids.append(doc_id.as_py())
                texts.append(words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield out(ids, texts)

    return find


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, all runs of its whole text by start, then period, and the text collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch with smallest period q (words q apart are identical) of at least max(12, 2q)
    words that no neighbouring word extends; runs may overlap. `collapsed` holds the words that no run contains after its first
    q words, joined by one blank. `rewrite(doc_id, words)` may change a text's words before the search.

    Null and empty texts have no words, no runs and an empty collapsed text. A null doc_id stays null; rows that repeat are searched
    one by one; an empty table gives no rows; further columns are left out. Very long texts are searched whole, with memory in
    proportion to their words. Runs of the same start come by period.
    """
    return text_of(docs).mapInArrow(_finder(rewrite), OUT)


def planted_periods(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rewriting of the registered query: a tenth of the documents, by a checksum of doc_id, become periodic from a word on.
    Documents without doc_id stay as they are."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a:a + p]
    return words[:a] + (once * (-(-(n - a) // len(once))))[:n - a]


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.expr("(1000 * longest.length) div (-longest.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
