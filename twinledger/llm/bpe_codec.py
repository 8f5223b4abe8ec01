"""BPE encoding and decoding of whole texts with a word vocabulary: longest matches, pair compatibility, offset table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe_words import WordBpe, default_path
from .shared import text_of

#: Bytes of ids or text after which a task hands on what it has.
OUT_BYTES = 8 << 20
ENCODED = "doc_id long, ids binary"
DECODED = "doc_id long, ids binary, text string"


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe.at(path)
        for batch in batches:
            first, held, out = 0, 0, []
            for row, text in enumerate(batch.column(1)):
                out.append(codec.encode(text.as_py()))
                held += len(out[-1])
                if held >= OUT_BYTES or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:row + 1], pa.array(out, pa.binary())], schema=schema)
                    first, held, out = row + 1, 0, []

    return encode


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe.at(path)
        for batch in batches:
            ends = np.cumsum([len(b.as_py() or b"") for b in batch.column(1)])
            first = 0
            while first < batch.num_rows:
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + OUT_BYTES // 4, "right")))
                part = batch.slice(first, last - first)
                raw = b"".join(b.as_py() or b"" for b in part.column(1))
                text, stops = codec.decode(np.frombuffer(raw, "<u4"), (ends[first:last] - base) // 4)
                offsets = np.concatenate([[0], stops]).astype(np.int32)
                texts = pa.StringArray.from_buffers(len(part), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], schema=schema)
                first = last

    return decode


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32 bit) of every row's whole text, as the tokenizers library gives them for the
    vocabulary file without adding special tokens; special tokens spelt out in a text are found as the library finds them.

    Null and empty texts have no ids. A null doc_id stays null, rows that repeat are encoded as often as they occur, an empty
    table gives no rows, further columns are left out. Very long texts, and very long words, take time in proportion to their
    length. Nothing here depends on the order of rows, so there are no ties.
    """
    return text_of(docs).mapInArrow(_encoder(vocabulary or default_path()), ENCODED)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and text of every row of ids: the tokens' texts, joined by one blank, special tokens included.

    Null and empty ids give an empty text. Ids that the vocabulary does not have are an error. Else as `encode_documents`.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(vocabulary or default_path()), DECODED)


def round_trip_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.expr("CAST(octet_length(ids) / 4 AS LONG)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
