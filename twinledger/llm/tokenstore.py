"""A store of token ids: one zstandard frame per document, a shared dictionary trained on id arrays, an offset index.

Layout: `folder/shards` and `folder/dictionary` are Parquet tables that Spark writes, so any file system Spark knows will
do and a lost task is simply written anew. A row of `shards` is one shard of whole documents in ascending doc_id order:

    part, tokens_before   range partition, and the ids of that partition before this shard
    first_doc, last_doc   smallest and largest doc_id (null if it holds none); Parquet's own statistics skip shards
    n_docs, n_tokens      documents and ids in the shard
    dictionary_hash       blake2b-128 of the dictionary that the frames need
    index                 n_docs records INDEX: doc_id, whether it is null, offset and size of its frame, count of ids
    payload               the frames, one after the other; a frame holds the ids as little-endian integers of `width` bytes
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import kept_table, partitions, text_of
from .tokenizing import Encoder, default_path

INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8")])
#: The dictionary is fitted on about so many documents (chosen by hash), of each at most so many ids.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1500, 4096, 65536
SHARD_BYTES = 4 << 20
PART_BYTES = 128 << 20
LEVEL = 3
_SHARDS = ("part int, tokens_before long, first_doc long, last_doc long, n_docs long, n_tokens long, "
           "dictionary_hash string, width int, index binary, payload binary")


def _arrow(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], [n for n, _ in columns])


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.blake2b(dictionary, digest_size=16).hexdigest()


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, path: str, width: int) -> bytes:
    """A dictionary fitted on a bounded sample (SAMPLE_DOCS, SAMPLE_IDS); empty if there is too little to fit on."""
    import zstandard

    n = docs.count()
    if n < 16:
        return b""
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < SAMPLE_DOCS).select("text").limit(2 * SAMPLE_DOCS)
    kind = f"<u{width}"

    def encode(batches):
        column = Encoder.at(path).column
        for b in batches:
            got = [ids[:SAMPLE_IDS].astype(kind).tobytes() for ids in column(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["ids"])

    samples = sorted(bytes(r[0]) for r in chosen.mapInArrow(encode, "ids binary").collect() if r[0])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 20)), samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _encoder(path: str, end_id: int, dictionary: bytes, width: int, level: int):
    kind = f"<u{width}"
    columns = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        column = Encoder.at(path).column
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True).compress
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), column(b.column(1))):
                rows.append((doc, len(ids) + 1, press(np.append(ids, np.uint32(end_id)).astype(kind).tobytes())))
                if len(rows) >= 2048:
                    yield _arrow(columns, rows)
                    rows = []
            if rows:
                yield _arrow(columns, rows)

    return encode


def _sharder(digest: str, width: int, shard_bytes: int):
    columns = [("part", pa.int32()), ("tokens_before", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
               ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("dictionary_hash", pa.string()), ("width", pa.int32()),
               ("index", pa.binary()), ("payload", pa.binary())]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal before, held, size
            index = np.zeros(len(held), INDEX)
            sizes = np.array([len(f) for _, _, f in held], np.int64)
            index["doc_id"] = [0 if d is None else d for d, _, _ in held]
            index["null"] = [d is None for d, _, _ in held]
            index["size"], index["offset"] = sizes, np.cumsum(sizes) - sizes
            index["n_tokens"] = [n for _, n, _ in held]
            known = [d for d, _, _ in held if d is not None]
            tokens = sum(n for _, n, _ in held)
            row = (part, before, min(known, default=None), max(known, default=None), len(held), tokens, digest, width,
                   index.tobytes(), b"".join(f for _, _, f in held))
            before, held, size = before + tokens, [], 0
            return _arrow(columns, [row])

        for b in batches:
            docs, counts, frames = b.columns
            for i in range(len(docs)):
                held.append((docs[i].as_py(), counts[i].as_py(), frames[i].as_py()))
                size += len(held[-1][2])
                if size >= shard_bytes:
                    yield out()
        if held:
            yield out()

    return shard


def write_store(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, level: int = LEVEL, shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encodes the whole text of every document (null: empty), appends end_id, and writes the store to `folder`.

    Documents are encoded once, into frames; only the frames are dealt by ranges of doc_id and sorted there. A null doc_id
    comes first; rows with the same doc_id stand in order of their ids' count and bytes. Further columns are left out.
    """
    spark, path = docs.sparkSession, tokenizer or default_path()
    docs = text_of(docs)
    width = 2 if max(Encoder.at(path).tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
    dictionary = train_dictionary(docs, path, width)
    frames = kept_table(docs.mapInArrow(_encoder(path, end_id, dictionary, width, level), "doc_id long, n_tokens long, frame binary"), "frames")
    size = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    parts = max(1, min(-(-size // PART_BYTES), 100_000), min(partitions(spark), -(-size // shard_bytes)))
    shards = (frames.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")
              .mapInArrow(_sharder(dictionary_hash(dictionary), width, shard_bytes), _SHARDS))
    shards.write.option("compression", "none").parquet(f"{folder}/shards")
    spark.createDataFrame([(dictionary_hash(dictionary), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")


def _read_dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row["dictionary"])
    if dictionary_hash(data) != row["hash"]:
        raise ValueError(f"{folder}: the dictionary is damaged")
    return row["hash"], data


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids of every stored document."""
    digest, dictionary = _read_dictionary(spark, folder)
    shards = spark.read.parquet(f"{folder}/shards")
    # One row per range partition, at most as many as write_store makes.
    totals = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, total = {}, 0
    for part, n in totals:
        before[part] = total
        total += n
    columns = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_frame = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
        for b in batches:
            for part, ahead, found, width, index, payload in zip(*b.columns):
                if found.as_py() != digest:
                    raise ValueError(f"a shard of {folder} needs dictionary {found.as_py()}, the folder has {digest}")
                start, data, rows = before[part.as_py()] + ahead.as_py(), payload.as_buffer(), []
                kind = f"<u{width.as_py()}"
                for doc, null, offset, size, n in np.frombuffer(index.as_py(), INDEX).tolist():
                    ids = np.frombuffer(open_frame(data[offset:offset + size]), kind).astype("<u4")
                    if len(ids) != n:
                        raise ValueError(f"document {doc} has {len(ids)} ids, its index says {n}")
                    rows.append((None if null else doc, start, n, ids.tobytes()))
                    start += n
                    if len(rows) >= 1024:
                        yield _arrow(columns, rows)
                        rows = []
                if rows:
                    yield _arrow(columns, rows)

    return shards.select("part", "tokens_before", "dictionary_hash", "width", "index", "payload").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id (several if it repeats): only their frames are opened."""
    import zstandard

    digest, dictionary = _read_dictionary(spark, folder)
    open_frame = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
    found = []
    near = spark.read.parquet(f"{folder}/shards").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for row in near.select("dictionary_hash", "width", "index", "payload").toLocalIterator():
        if row["dictionary_hash"] != digest:
            raise ValueError(f"a shard of {folder} needs dictionary {row['dictionary_hash']}")
        index = np.frombuffer(bytes(row["index"]), INDEX)
        for one in index[(index["doc_id"] == doc_id) & (index["null"] == 0)]:
            frame = bytes(row["payload"][int(one["offset"]):int(one["offset"] + one["size"])])
            found.append(np.frombuffer(open_frame(frame), f"<u{row['width']}").astype("<u4").tolist())
    return found


def document_digests(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
