"""Removal of repeated word windows, found through difference-cover anchors.

A window is `window` consecutive words. Let `cover` be a difference cover modulo `period`: every difference modulo the period is
the difference of two of its members. Whatever places two equal windows start at, some offset under the period puts both on
a cover position, and an anchor of window - period + 1 words there lies inside both. So it is enough to
fingerprint anchors at cover positions (5 in 21 words): two equal windows share an aligned anchor. Where anchors meet, the
windows around them are fingerprinted, with other seeds, and what meets again is a repeated window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .meeting import TICKETS, bucket_count, covered, gathered, grouped_docs, marked_docs, meet, one_array, places_by_doc, ticket_rows
from .shared import kept_table, text_of
from .textscan import slices, window_sums, word_hashes, words

WINDOW_SEED = 0x5851F42D4C957F2D
CHECK_BASE = 0xD1342543DE82EF95


@dataclass(frozen=True)
class Cover:
    window: int = 35
    period: int = 21
    cover: tuple[int, ...] = (0, 1, 4, 14, 16)

    def __post_init__(self):
        if {(a - b) % self.period for a in self.cover for b in self.cover} != set(range(self.period)):
            raise ValueError("the cover misses a difference")
        if self.anchor < 1:
            raise ValueError("the period must not exceed the window")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def _anchor_tickets(docs: DataFrame, rule: Cover, buckets: int) -> DataFrame:
    on = np.zeros(rule.period, bool)
    on[list(rule.cover)] = True

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            ids, groups = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for lo, hi, data, offs in slices(b.column(1)):
                starts, ends, first = words(data, offs)
                h = word_hashes(data, starts, ends)
                runs = window_sums(h, rule.anchor)
                n = np.diff(first)
                doc = np.repeat(np.arange(hi - lo), n)
                place = np.arange(len(h)) - np.repeat(first[:-1], n)
                # Texts shorter than a window hold none.
                at = np.flatnonzero(on[place % rule.period] & (place + rule.anchor <= n[doc]) & (n[doc] >= rule.window))
                hashes = runs[at]
                if len(at):
                    yield hashes, np.zeros(len(at), np.uint32), ids[lo + doc[at]], place[at].astype(np.int32), groups[lo + doc[at]]

    return docs.select("doc_id", "text", "g").mapInArrow(lambda batches: gathered(parts(batches), buckets), TICKETS)


def _window_tickets(found: DataFrame, marks: DataFrame, rule: Cover, buckets: int) -> DataFrame:
    """Tickets of all windows that hold a met anchor at an aligned offset."""
    def scan(texts: pa.Table, table: pa.Table) -> pa.Table:
        anchors, out = places_by_doc(table), [[] for _ in range(4)]
        group = texts.column("g")[0].as_py() if len(texts) else 0
        ids = texts.column("doc_id").to_pylist()
        seen: set[int] = set()
        for lo, hi, data, offs in slices(one_array(texts.column("text"))):
            starts, ends, first = words(data, offs)
            h = word_hashes(data, starts, ends, WINDOW_SEED)
            one, two = window_sums(h, rule.window), window_sums(h, rule.window, CHECK_BASE)
            for d in range(hi - lo):
                doc, n = ids[lo + d], int(first[d + 1] - first[d])
                at = anchors.get(doc)
                # Rows that repeat a doc_id stand for the first of them.
                if at is None or n < rule.window or doc in seen:
                    continue
                seen.add(doc)
                at = at[at < n]
                begin = np.flatnonzero(covered(np.maximum(at - (rule.period - 1), 0), rule.period, n))
                begin = begin[begin <= n - rule.window]
                out[0].append(one[first[d] + begin])
                out[1].append((two[first[d] + begin] >> np.uint64(32)).astype(np.uint32))
                out[2].append(np.full(len(begin), doc, np.int64))
                out[3].append(begin.astype(np.int32))
        if not out[0]:
            empty = ticket_rows(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), buckets)
            return pa.Table.from_batches([empty])
        arrays = [np.concatenate(x) for x in out]
        return pa.Table.from_batches([ticket_rows(*arrays, np.full(len(arrays[0]), group, np.int32), buckets)])

    return found.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(scan, TICKETS)


def _digests(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1)):
                _, _, first = words(data, offs)
                kept = [hashlib.sha256(b" ".join(data[offs[i]:offs[i + 1]].tobytes().split())).hexdigest() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(kept)], ["doc_id", "n_words", "whole_sha256"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, whole_sha256 string")


def _removals(found: DataFrame, marks: DataFrame, rule: Cover, texts: bool) -> DataFrame:
    """doc_id, n_removed, kept_sha256 (and kept, the text that is left) of the documents that lose words."""
    def cut(rows: pa.Table, table: pa.Table) -> pa.Table:
        windows, out, seen = places_by_doc(table), [], set()
        for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
            at = windows.get(doc)
            if at is None or doc in seen:
                continue
            seen.add(doc)
            # bytes.split() cuts at the six white-space bytes of the word pattern.
            parts = text.encode().split()
            gone = covered(at, rule.window, len(parts)).tolist()
            left = b" ".join([p for p, x in zip(parts, gone) if not x])
            out.append((doc, sum(gone), hashlib.sha256(left).hexdigest(), left.decode() if texts else None))
        kinds = pa.int64(), pa.int64(), pa.string(), pa.string()
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["id", "n_removed", "kept_sha256", "kept"])

    return found.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(cut, "id long, n_removed long, kept_sha256 string, kept string")


def remove_repeated_windows(docs: DataFrame, rule: Cover = Cover(), texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space), and with
    texts=True also `kept`, those words (null if nothing was removed: the document stays as it is).

    A word goes if it lies in a window whose words also start anywhere else, in the same or another document; windows are
    judged on the input. Null and empty texts have no words. Rows without doc_id are returned unchanged and take no part. doc_id
    names a document: of rows that repeat it with the same text each gives the same row (their windows don't repeat each other).
    Further columns are left out; an empty table gives no rows.
    """
    buckets = bucket_count(docs)
    dealt = grouped_docs(docs, buckets)
    marks = kept_table(meet(_anchor_tickets(dealt, rule, buckets)), "anchors")
    found = marked_docs(dealt, marks)
    repeated = kept_table(meet(_window_tickets(found, marks, rule, buckets)), "windows")
    removed = _removals(found, repeated, rule, texts)
    result = _digests(text_of(docs)).join(removed, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")
    return result if texts else result.drop("kept")
