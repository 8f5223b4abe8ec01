"""Where equal fingerprints of a whole corpus meet: blobs of many fingerprints are dealt into buckets, not one row for each.

A task turns a slice of documents into numpy arrays (fingerprint, document, place, ...), splits them by bucket and emits one row
per bucket with an array in each column. What meets in a bucket is found with sorted arrays. Answers go back the same way,
in rows per group `g` of documents. A fingerprint that a slice holds several times is sent once (`known`), so a passage that
fills a third of the corpus costs its bucket one entry per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import kept_table, small_side, text_of
from .textscan import U64, give_back, mix

#: Bytes of text whose fingerprints share a bucket, on average; and of the documents of one group.
BUCKET_TEXT = 4 << 20
#: Documents up to which the list of concerned ids may be broadcast (8 bytes each).
ID_LIST = 500_000
TICKETS = "bucket int, hashes binary, checks binary, docs binary, places binary, groups binary, known binary"
_TICKETS = ("hashes", "<u8"), ("checks", "<u4"), ("docs", "<i8"), ("places", "<i4"), ("groups", "<i4"), ("known", "u1")
MARKS = "g int, docs binary, places binary"


def bucket_count(docs: DataFrame) -> int:
    """Buckets, and groups of documents, by the bytes of text alone."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // BUCKET_TEXT))


def grouped_docs(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text and g, the group in which a document's answers come back. Rows without doc_id aren't part of any search."""
    return text_of(docs).filter("doc_id IS NOT NULL").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))


def split_rows(key: np.ndarray, name: str, arrays: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """One row per value of key, with the bytes of each array's entries."""
    order = np.argsort(key, kind="stable")
    keys, starts = np.unique(key[order], return_index=True)
    cells = [pa.array(keys.astype(np.int32))]
    for _, a in arrays:
        raw, size = np.ascontiguousarray(a[order]).tobytes(), a.dtype.itemsize
        edges = [*(starts * size).tolist(), len(raw)]
        cells.append(pa.array([raw[x:y] for x, y in zip(edges, edges[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(cells, [name, *[n for n, _ in arrays]])


def joined_cells(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def ticket_rows(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray, groups: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of TICKETS; what repeats within the arrays is known at once: one entry of it is sent to its bucket, and all of
    them go back to their documents as rows of a bucket under 0. Entries keep the order of the documents, which packs well."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    first = np.concatenate([[True], ~same]) if len(h) else np.zeros(0, bool)
    known = np.zeros(len(h), np.uint8)
    known[:-1] |= same
    known[1:] |= same
    back = np.flatnonzero(known)
    pick = np.concatenate([np.flatnonzero(first), back])
    home = -1 - (int(groups[0]) % buckets if len(groups) else 0)
    to = np.concatenate([((mix(h[first]) + c[first]) % U64(buckets)).astype(np.int32), np.full(len(back), home, np.int32)])
    placed = np.argsort(order[pick], kind="stable")
    pick, to = pick[placed], to[placed]
    at = order[pick]
    return split_rows(to, "bucket", [("hashes", h[pick]), ("checks", c[pick]), ("docs", docs[at]), ("places", places[at]),
                                     ("groups", groups[at].astype(np.int32)), ("known", known[pick])])


def gathered(parts: Iterator[tuple[np.ndarray, ...]], buckets: int, entries: int = 150_000) -> Iterator[pa.RecordBatch]:
    """Rows of TICKETS from many small parts (hashes, checks, docs, places, groups), about `entries` fingerprints at a time:
    large blobs pack well, and more of what repeats is known at once."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= entries:
            yield ticket_rows(*(np.concatenate(x) for x in zip(*held)), buckets)
            held, n = [], 0
    if n:
        yield ticket_rows(*(np.concatenate(x) for x in zip(*held)), buckets)


def meet(tickets: DataFrame) -> DataFrame:
    """Rows of MARKS: every entry whose fingerprint occurs more than once in the corpus, by group of documents."""
    def repeated(table: pa.Table) -> pa.Table:
        h, c, docs, places, groups, known = (joined_cells(table, n, k) for n, k in _TICKETS)
        if table.column("bucket")[0].as_py() < 0:
            pick = np.arange(len(h))
        elif len(h) > 1:
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            met = np.zeros(len(h), bool)
            met[:-1] |= same
            met[1:] |= same
            # Known entries are back already.
            pick = order[met]
            pick = pick[known[pick] == 0]
        else:
            pick = np.zeros(0, np.int64)
        rows = pa.Table.from_batches([split_rows(groups[pick], "g", [("docs", docs[pick]), ("places", places[pick])])])
        del h, c, docs, places, groups, known
        give_back()
        return rows

    return tickets.groupBy("bucket").applyInArrow(repeated, MARKS)


def marked_ids(marks: DataFrame) -> DataFrame:
    """doc_id of every document with a mark; the marks of a group of documents meet first, so each id is made once."""
    def ids(table: pa.Table) -> pa.Table:
        return pa.table({"doc_id": np.unique(joined_cells(table, "docs", "<i8"))})

    return marks.select("g", "docs").groupBy("g").applyInArrow(ids, "doc_id long")


def marked_docs(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows (doc_id, text, g) of docs that have a mark, written once: later steps move only these texts."""
    ids = kept_table(marked_ids(marks), "ids")
    return kept_table(docs.join(small_side(ids, ID_LIST), "doc_id", "left_semi"), "marked")


def places_by_doc(table: pa.Table) -> dict[int, np.ndarray]:
    """Sorted distinct places of each document, from rows of MARKS."""
    docs, places = joined_cells(table, "docs", "<i8"), joined_cells(table, "places", "<i4")
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    ids, starts = np.unique(docs, return_index=True)
    ends = [*starts[1:].tolist(), len(docs)]
    return {int(d): np.unique(places[lo:hi]) for d, lo, hi in zip(ids, starts.tolist(), ends)}


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for any s in starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
