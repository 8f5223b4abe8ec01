"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

Every document (ids and an end id) is cut into full windows and a rest. Rests are cut into equal parts of at most
`part` tokens; each run of `block` parts is spread over k windows: partial partitions are merged largest spread first,
the fullest bin of one with the emptiest of the other, which leaves near-equal windows. k starts at the least count that
could hold the tokens and rises while the fullest window exceeds the capacity. Nothing is shuffled: a block is a run of
documents of one input partition, so the last block of each input partition is the only short one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import text_of
from .tokenizing import Encoder, default_path

WINDOW = 1024
PART = 256
BLOCK = 256
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def difference_bins(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Numbers of the sizes in each of k bins of near-equal sums, fullest first; equal input gives equal output."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-int(size), i, sums, [[i], *([[]] * (k - 1))]))
    heapq.heapify(heap)
    for made in range(len(heap), 2 * len(heap) - 1):
        _, _, sums, bins = heapq.heappop(heap)
        _, _, other_sums, other_bins = heap[0]
        sums = sums + other_sums[::-1]
        other_bins = other_bins[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), made, sums, [bins[j] + other_bins[j] for j in order.tolist()]))
    return heap[0][3] if heap else [[] for _ in range(k)]


def fitting_bins(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """As few of the counts from sum/capacity on as give bins that all fit; empty bins are left out."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        bins = difference_bins(sizes, k)
        if all(sum(sizes[i] for i in b) <= capacity for b in bins):
            return [b for b in bins if b]
        k += 1


def _packer(path: str, end_id: int, window: int, part: int, block: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(path).ids
        next_id = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        rests: list[tuple] = []

        def place() -> None:
            nonlocal next_id
            for one in fitting_bins([r[2] for r in rests], window):
                offset = 0
                for i in sorted(one):
                    rows.append((*rests[i], next_id, offset))
                    offset += rests[i][2]
                next_id += 1
            rests.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()
            return batch

        for batch in batches:
            ids_of = batch.column(0)
            texts = batch.column(1)
            for i in range(len(texts)):
                doc_id, ids = ids_of[i].as_py(), encode(texts[i].as_py()) + end
                n = len(ids) // 4
                full = n - n % window
                for start in range(0, full, window):
                    rows.append((doc_id, start, window, ids[4 * start:4 * (start + window)], n, next_id, 0))
                    next_id += 1
                    if len(rows) >= 4096:
                        yield out()
                count = -(-(n - full) // part)
                for j in range(count):
                    lo, hi = full + (n - full) * j // count, full + (n - full) * (j + 1) // count
                    rests.append((doc_id, lo, hi - lo, ids[4 * lo:4 * hi], n))
                    if len(rests) >= block:
                        place()
                if len(rows) >= 4096:
                    yield out()
        place()
        if rows:
            yield out()
        Encoder.at(path).forget()

    return pack


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, window: int = WINDOW, part: int = PART, block: int = BLOCK,
) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (little-endian unsigned 32 bit),
    doc_tokens (with the end id), sequence_id, offset (in the sequence).

    Every id lies in exactly one piece; the pieces of a sequence fill it from 0 without gaps. Null and empty texts give one
    piece with the end id alone. Repeated rows are packed as often as they occur; a null doc_id stays null. Further columns
    are left out, an empty table gives no rows. Sequence ids are unique, not consecutive.
    """
    if not 0 < part <= window or block < 1:
        raise ValueError("need 0 < part <= window and block >= 1")
    return text_of(docs).mapInArrow(_packer(tokenizer or default_path(), end_id, window, part, block), SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
