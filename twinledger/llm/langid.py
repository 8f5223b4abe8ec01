"""Language identification with a byte convolutional network, trained and applied in numpy.

A text is cut into windows of `window` bytes. Filters of several widths run over the bytes (one-hot, so a filter is a table
of weights per place and byte), the largest response of each filter in the window is kept, and a softmax layer reads
these. A document's language has the largest mean probability over its windows, weighted by their bytes.

Only the training sample, bounded by parameters, comes to the driver. Each task applies the tables to whole texts in batches of
fixed-length windows; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import text_of
from .textscan import slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Network:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    #: About so many documents of each language, and of each so many windows, are fitted on.
    sample_docs: int = 800
    sample_windows: int = 4
    epochs: int = 6
    batch: int = 64
    rate: float = 0.004
    seed: int = 11


@dataclass
class Weights:
    network: Network
    languages: list[str]
    #: Per width: (width, 256, filters), and (filters,).
    tables: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None


def windows_of(data: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, window) bytes, zero-padded at each document's end, and the first window of each document (count at the end)."""
    lengths = np.diff(offs)
    first = np.concatenate([[0], np.cumsum(-(-lengths // window))])
    flat = np.zeros(first[-1] * window, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * window - offs[:-1], lengths)] = data
    return flat.reshape(-1, window), first


def training_windows(labelled: DataFrame, network: Network) -> list[tuple[str, bytes]]:
    """(language, window bytes) from a sample by hash of about sample_docs documents a language, evenly placed in each text."""
    labelled = labelled.filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, network.sample_docs / n))])
    chosen = labelled.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("text", "lang")
    width, most = network.window, network.sample_windows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in slices(b.column(0)):
                rows = []
                for i in range(lo, hi):
                    text = data[offs[i - lo]:offs[i - lo + 1]].tobytes()
                    n = -(-len(text) // width)
                    places = sorted({n * j // most for j in range(most)}) if n > most else range(n)
                    rows += [(b.column(1)[i].as_py(), text[p * width:(p + 1) * width]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "part"])

    return sorted((r[0], bytes(r[1])) for r in chosen.mapInArrow(cut, "lang string, part binary").collect())


def _responses(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(windows, places, filters): the filter's weights at the bytes of each place, summed."""
    width, places = len(table), x.shape[1] - len(table) + 1
    got = table[0][x[:, :places]]
    for k in range(1, width):
        got += table[k][x[:, k:k + places]]
    return got


def train(samples: list[tuple[str, bytes]], network: Network = Network()) -> Weights:
    """Fits by Adam on cross-entropy; equal samples give equal weights."""
    languages = sorted({lang for lang, _ in samples})
    weights, rng = Weights(network, languages), np.random.default_rng(network.seed)
    if not languages:
        return weights
    window, f = network.window, network.filters
    x = np.zeros((len(samples), window), np.uint8)
    for i, (_, part) in enumerate(samples):
        x[i, :len(part)] = np.frombuffer(part[:window], np.uint8)
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[lang] for lang, _ in samples])
    weights.tables = [rng.normal(0, 0.1, (w, 256, f)).astype(np.float32) for w in network.widths]
    weights.biases = [np.zeros(f, np.float32) for _ in network.widths]
    weights.out = rng.normal(0, 0.1, (f * len(network.widths), len(languages))).astype(np.float32)
    weights.out_bias = np.zeros(len(languages), np.float32)
    params = [*weights.tables, *weights.biases, weights.out, weights.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(network.epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), network.batch):
            pick = order[lo:lo + network.batch]
            xb, yb = x[pick].copy(), y[pick]
            # Some windows are shortened, so that short texts are known too.
            for i in np.flatnonzero(rng.random(len(xb)) < 0.25):
                xb[i, rng.integers(16, window):] = 0
            b = len(xb)
            pooled, tops = [], []
            for table, bias in zip(weights.tables, weights.biases):
                r = _responses(xb, table)
                top = r.argmax(1)
                tops.append(top)
                pooled.append(np.take_along_axis(r, top[:, None, :], 1)[:, 0, :] + bias)
            raw = np.concatenate(pooled, 1)
            hidden = np.maximum(raw, 0)
            logits = hidden @ weights.out + weights.out_bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(b), yb] -= 1
            p /= b
            back = (p @ weights.out.T) * (raw > 0)
            grads = []
            for j, table in enumerate(weights.tables):
                g, part = np.zeros_like(table), back[:, j * f:(j + 1) * f]
                for k in range(len(table)):
                    np.add.at(g[k], (xb[np.arange(b)[:, None], tops[j] + k], np.arange(f)[None, :]), part)
                grads.append(g)
            grads += [back[:, j * f:(j + 1) * f].sum(0) for j in range(len(weights.tables))]
            grads += [hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= network.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


class Classifier:
    """Applies trained weights: byte pairs are looked up together, half the look-ups of single bytes."""

    BLOCK = 256  # windows at a time

    def __init__(self, weights: Weights):
        self.weights = weights
        self.pairs = []
        for table in weights.tables:
            steps = []
            for k in range(0, len(table) - 1, 2):
                steps.append((k, 2, (table[k][:, None, :] + table[k + 1][None, :, :]).reshape(65536, -1)))
            if len(table) % 2:
                steps.append((len(table) - 1, 1, table[-1]))
            self.pairs.append(steps)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        got = np.empty((len(x), len(w.languages)), np.float32)
        for lo in range(0, len(x), self.BLOCK):
            xb = x[lo:lo + self.BLOCK].astype(np.intp)
            pair = xb[:, :-1] * 256 + xb[:, 1:]
            pooled = []
            for steps, bias in zip(self.pairs, w.biases):
                places = xb.shape[1] - sum(n for _, n, _ in steps) + 1
                r = None
                for k, n, table in steps:
                    one = np.take(table, (pair if n == 2 else xb)[:, k:k + places], axis=0, mode="clip")
                    r = one if r is None else np.add(r, one, out=r)
                while places > 1:
                    half = places // 2
                    np.maximum(r[:, :half], r[:, places - half:places], out=r[:, :half])
                    places -= half
                pooled.append(r[:, 0] + bias)
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ w.out + w.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            got[lo:lo + self.BLOCK] = p / p.sum(1, keepdims=True)
        return got


def classify(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, lang_pred, score and n_windows of every document, from its whole text; `und` with score 0 if the text is null
    or has no letter, or if nothing was learned."""
    schema = "doc_id long, lang_pred string, score double, n_windows long"
    names = np.array([*weights.languages, UNKNOWN], object)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(weights) if weights.languages else None
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1), 1 << 18):
                x, first = windows_of(data, offs, weights.network.window)
                best, score = np.full(hi - lo, len(names) - 1), np.zeros(hi - lo)
                if classifier and len(x):
                    lengths = np.diff(offs)
                    used = np.full(len(x), float(weights.network.window))
                    some = lengths > 0
                    used[first[1:][some] - 1] = lengths[some] - (np.diff(first)[some] - 1) * weights.network.window
                    sums = np.add.reduceat(classifier.probabilities(x).astype(np.float64) * used[:, None], first[:-1][some], axis=0)
                    mean = sums / lengths[some][:, None]
                    letters = b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                    best[some], score[some] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
                    best[~letters], score[~letters] = len(names) - 1, 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score), pa.array(np.diff(first))],
                    ["doc_id", "lang_pred", "score", "n_windows"])

    return text_of(docs).withColumn("letters", F.expr("text RLIKE '\\\\p{L}'")).mapInArrow(apply, schema)


def held_out_rows() -> str:
    """SQL condition: rows that are never learned from."""
    return "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2"


def identify_languages(docs: DataFrame, network: Network = Network()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_windows of every document; learns from text and lang of the rows that aren't held
    out and have a lang.

    Rows with a null doc_id are never held out, and never learned from either; they are predicted like others. Repeated rows are predicted
    each. Further columns are left out; an empty table gives no rows.
    """
    fitted = docs.filter(f"doc_id IS NOT NULL AND NOT ({held_out_rows()})").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    weights = train(training_windows(fitted, network), network)
    found = classify(docs, weights)
    return found.select("doc_id", F.expr(f"coalesce({held_out_rows()}, false)").alias("held_out"), "lang_pred", "score", "n_windows")
