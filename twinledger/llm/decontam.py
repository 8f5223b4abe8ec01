"""Benchmark decontamination: BM25 over an inverted index of test items, searched with every training passage.

The index holds the items' terms with BM25 weights, divided by the item's own total: an item that a passage holds whole scores
1. Items are put into classes by length; the passages of a class are overlapping windows of words, long enough to hold any of its items
whole, so what is found of an item doesn't depend on the others. For each passage all items of at least `threshold` are retrieved, with
block maxima as in block-max WAND, done for the passages of a slice at once. The terms that may bring items in are fixed beforehand
(as MaxScore does), where WAND moves a pivot over cursors:

* Terms are ordered by how common they are in the corpus. For each item its common terms may bring up to C < threshold;
  an item can only be retrieved through its other, rarer lists, and only if those bring threshold - C (the pivot).
* Items lie in blocks; each list keeps its largest weight per block. A block is opened for a passage only if the block maxima of the
  rarer lists and the block's largest C reach the threshold. Only then item weights are read, and the same test holds per item.
* What is left is scored exactly, and verified: the word shingles of the item's question (all but its last sentence) and of its answer
  (the last sentence; the whole if there is one sentence) must both lie in the passage to `overlap`. Of an item of fewer words than a
  shingle the whole word sequence must.

Nothing is shuffled but counts and the findings. Items go to the tasks in shards of about `shard_items` items or `shard_chars` characters,
each one pass to count terms and one to search; document frequencies and the mean length are those of all items, whatever the shards.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import drop_ids, kept_table, text_of
from .textscan import LOWER, U64, slices, window_sums, word_hashes, words

#: Words are runs of ASCII letters and digits and of bytes of other letters; all else parts them.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Search:
    threshold: float = 0.5
    overlap: float = 0.8
    shingle: int = 5
    #: Items of fewer words aren't searched; every item that has a word is.
    least_words: int = 1
    #: Words from one passage to the next, doubled for longer classes of items; a passage has two strides.
    stride: int = 64
    k1: float = 1.2
    b: float = 0.75
    block: int = 32
    shard_items: int = 20_000
    shard_chars: int = 16_000_000


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of all items: how many there are, their mean length, and how many hold each term."""

    items: int
    mean: float
    holding: dict[int, int]


def _hashed(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), GAP)
    return word_hashes(data, starts, ends)


def stride_of(n_words: int, rule: Search) -> int:
    """The stride of the class of items of so many words: the rule's, doubled until it holds them."""
    stride = rule.stride
    while stride < n_words:
        stride *= 2
    return stride


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct fingerprints of `width` consecutive words; of all words if they are fewer."""
    return np.unique(window_sums(hashes, min(width, len(hashes)))) if len(hashes) else np.zeros(0, U64)


def question_and_answer(text: str) -> tuple[str, str]:
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


class Terms:
    """Numbers of the hashes in a sorted array. A table over 20 bits settles most words at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.table = hashes, np.zeros(1 << 20, bool)
        self.table[(hashes >> U64(44)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.table[(hashes >> U64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[maybe]
            found[maybe[hit]] = at[hit]
        return found


@dataclass
class Lists:
    """Posting lists in one array: list t is ids[ptr[t]:ptr[t + 1]] with its weights."""

    ptr: np.ndarray
    ids: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, postings: list[dict[int, float]]) -> "Lists":
        ptr = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64)
        flat = [x for p in postings for x in sorted(p.items())]
        return cls(ptr, np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.float64))

    def gather(self, passages: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, id, weight) of the lists of all terms."""
        n = self.ptr[terms + 1] - self.ptr[terms]
        at = np.arange(n.sum()) + np.repeat(self.ptr[terms] - (np.cumsum(n) - n), n)
        return np.repeat(passages, n), self.ids[at], self.weights[at]


def summed(passages: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(passages * n + ids, return_inverse=True)
    return keys, np.bincount(where, weights, len(keys))


@dataclass
class Index:
    rule: Search
    names: list = field(default_factory=list)
    terms: np.ndarray | None = None
    weights: list[dict[int, float]] = field(default_factory=list)
    sides: list[tuple[list[int], np.ndarray, np.ndarray]] = field(default_factory=list)
    stride: int = 0
    # Set by prune(): the rarer lists by item and by block, what the common ones may bring, and which terms have rarer lists.
    lists: Lists | None = None
    blocks: Lists | None = None
    common: np.ndarray | None = None
    block_common: np.ndarray | None = None
    rare: np.ndarray | None = None

    @classmethod
    def build(cls, items: list[tuple[int, str]], rule: Search, known: Statistics | None = None) -> "Index":
        """Items of one class of lengths. Without `known` statistics they are taken as all there are."""
        index = cls(rule, stride=rule.stride)
        texts = [(name, _hashed(text), text) for name, text in items]
        texts = [t for t in texts if len(t[1]) >= rule.least_words]
        index.terms = np.unique(np.concatenate([h for _, h, _ in texts])) if texts else np.zeros(0, U64)
        counts = [Counter(np.searchsorted(index.terms, h).tolist()) for _, h, _ in texts]
        if known is None:
            n, df = len(texts), Counter(t for c in counts for t in c)
            mean = sum(len(h) for _, h, _ in texts) / max(n, 1)
        else:
            n, df, mean = known.items, [known.holding[h] for h in index.terms.tolist()], known.mean
        for (name, h, text), tf in zip(texts, counts):
            norm = rule.k1 * (1 - rule.b + rule.b * len(h) / mean)
            w = {t: float(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (rule.k1 + 1) / (f + norm)) for t, f in tf.items()}
            total = sum(w.values())
            index.weights.append({t: x / total for t, x in w.items()})
            parts = question_and_answer(text) if len(h) >= rule.shingle else (text, text)
            question, answer = (_hashed(x) for x in parts)
            widths = sorted({min(rule.shingle, len(x)) for x in (question, answer) if len(x)})
            index.sides.append((widths, shingles(question, rule.shingle), shingles(answer, rule.shingle)))
            index.names.append(name)
            index.stride = max(index.stride, stride_of(len(h), rule))
        return index

    def prune(self, corpus: dict[int, int]) -> None:
        """corpus: how often each term occurs in the documents; only the order counts, any gives the same results."""
        n, size = len(self.names), self.rule.block
        self.common, lists = np.zeros(n), [{} for _ in self.terms]
        blocks: list[dict[int, float]] = [defaultdict(float) for _ in self.terms]
        self.block_common = np.zeros(-(-n // size) if n else 0)
        for i, w in enumerate(self.weights):
            for t, x in sorted(w.items(), key=lambda p: (-corpus.get(p[0], 0), p[0])):
                if self.common[i] + x < 0.7 * self.rule.threshold:
                    self.common[i] += x
                else:
                    lists[t][i] = x
                    blocks[t][i // size] = max(blocks[t][i // size], x)
            self.block_common[i // size] = max(self.block_common[i // size], self.common[i])
        self.lists, self.blocks = Lists.of(lists), Lists.of(blocks)
        self.rare = np.diff(self.lists.ptr) > 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each word, -1 for words that no item holds."""
        if not hasattr(self, "_numbered"):
            self._numbered = Terms(self.terms)
        return self._numbered.numbers(hashes)

    def retrieve(self, term: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
        """(doc, passage, item) that can reach the threshold; term, doc and place of every word of a slice."""
        stride, threshold = self.stride, self.rule.threshold - 1e-9
        hit = np.flatnonzero((term >= 0) & self.rare[np.maximum(term, 0)])
        if not len(hit):
            return []
        per_doc = int(place.max()) // stride + 1
        at = doc[hit] * per_doc + place[hit] // stride
        # A passage has two strides, so a word lies in two of them.
        at, number = np.concatenate([at, at[place[hit] >= stride] - 1]), np.concatenate([term[hit], term[hit][place[hit] >= stride]])
        pairs = np.unique(at * len(self.terms) + number)
        at, number = pairs // len(self.terms), pairs % len(self.terms)
        nb, n = len(self.block_common), len(self.names)
        keys, total = summed(*self.blocks.gather(at, number), nb)
        opened = keys[total + self.block_common[keys % nb] >= threshold]
        some = np.isin(at, opened // nb)
        passages, ids, weights = self.lists.gather(at[some], number[some])
        inside = np.isin(passages * nb + ids // self.rule.block, opened)
        keys, total = summed(passages[inside], ids[inside], weights[inside], n)
        keys = keys[total + self.common[keys % n] >= threshold]
        return [(int(k // n) // per_doc, int(k // n) % per_doc, int(k % n)) for k in keys]

    def judge(self, hashes: np.ndarray, term: np.ndarray, item: int) -> tuple[float, float, float]:
        """Exact score and the overlaps of question and answer, of a passage's words."""
        weights = self.weights[item]
        score = sum(weights[t] for t in set(term[term >= 0].tolist()) & weights.keys())
        if score < self.rule.threshold - 1e-9:
            return score, 0.0, 0.0
        widths, question, answer = self.sides[item]
        there = np.concatenate([window_sums(hashes, w) for w in widths]) if widths else np.zeros(0, U64)
        return score, *(float(np.isin(x, there).mean()) if len(x) else 1.0 for x in (question, answer))


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"


def _scan(docs: DataFrame, indexes: list[Index], rule: Search) -> DataFrame:
    kinds = pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()

    def held(index: Index, hashes: np.ndarray, first: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """(document of the slice, item, score, overlaps, passage's first word), of several passages the best."""
        term, best = index.numbers(hashes), {}
        for d, p, item in index.retrieve(term, doc, place):
            begin = int(first[d]) + p * index.stride
            end = min(begin + 2 * index.stride, int(first[d + 1]))
            score, question, answer = index.judge(hashes[begin:end], term[begin:end], item)
            if question >= rule.overlap and answer >= rule.overlap and score >= rule.threshold - 1e-9:
                best[d, item] = max(best.get((d, item), ()), (score, question, answer, -p * index.stride))
        for (d, item), x in best.items():
            yield d, index.names[item], *x[:3], -x[3]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0), []
            for lo, hi, data, offs in slices(b.column(1)):
                data = LOWER[data]
                starts, ends, first = words(data, offs, GAP)
                if not len(starts):
                    continue
                hashes, n = word_hashes(data, starts, ends), np.diff(first)
                doc, place = np.repeat(np.arange(hi - lo), n), np.arange(len(hashes)) - np.repeat(first[:-1], n)
                rows += [(ids[lo + d].as_py(), *x) for index in indexes for d, *x in held(index, hashes, first, doc, place)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"])

    return docs.mapInArrow(scan, FOUND)


def _corpus_counts(docs: DataFrame, hashes: np.ndarray) -> dict[int, int]:
    """Occurrences of the terms of a shard, by hash, in all documents; as many numbers come back as a shard has terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(hashes), np.zeros(len(hashes), np.int64)
        for b in batches:
            for _, _, data, offs in slices(b.column(0)):
                data = LOWER[data]
                starts, ends, _ = words(data, offs, GAP)
                if len(starts):
                    term = terms.numbers(word_hashes(data, starts, ends))
                    total += np.bincount(term[term >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    return {int(hashes[r[0]]): r[1] for r in counted}


def _terms_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, n_words, hash) of the different words of every item."""
    for b in batches:
        parts, n_words, found = [], [], []
        for part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = _hashed(text)
            different = np.unique(h)
            parts.append(np.full(len(different), part))
            # The length stands at the first term only, so that it is summed once.
            n_words.append(np.where(np.arange(len(different)) == 0, len(h), 0))
            found.append(different.view(np.int64))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in (parts, n_words, found)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "n_words", "term"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: Search = Search()) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap and passage_start (in words) of every document and test item that it holds;
    of several passages the best, of equal ones the first.

    Null or empty texts hold nothing; null items, and those without a word (or of under least_words words), are nowhere. Texts of any length
    are read whole. Rows that repeat a doc_id give one row per item; a null doc_id stays null, and all such rows count as one document.
    Further columns are left out; empty tables give no rows.
    """
    docs = text_of(docs)
    items = kept_table(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL"), "items")
    n_rows, n_chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    shards, found = max(1, -(-n_rows // rule.shard_items), -(-n_chars // rule.shard_chars)), None
    parted = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    terms = kept_table(parted.select("part", "text").mapInArrow(_terms_of_items, "part long, n_words long, term long"), "item-terms")
    n_items, mean = terms.agg(F.expr("count_if(n_words > 0)"), F.expr("coalesce(sum(n_words) / nullif(count_if(n_words > 0), 0), 1D)")).first()
    holding = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.collect_set("part").alias("parts"))
    for k in range(shards):
        classes: dict[int, list] = defaultdict(list)
        for name, text in sorted((tuple(r) for r in parted.filter(F.col("part") == k).select("item_id", "text").collect()), key=lambda r: (r[0] is not None, r)):
            n = len(_hashed(text))
            if n >= max(rule.least_words, 1):
                classes[stride_of(n, rule)].append((name, text))
        if not classes:
            continue
        here = holding.filter(F.array_contains("parts", F.lit(k))).select("term", "n").collect()
        known = Statistics(n_items, mean, {t % 2**64: n for t, n in here})
        indexes = [Index.build(classes[stride], rule, known) for stride in sorted(classes)]
        counts = _corpus_counts(docs, np.unique(np.concatenate([i.terms for i in indexes])))
        for index in indexes:
            index.prune({i: counts.get(h, 0) for i, h in enumerate(index.terms.tolist())})
        one = _scan(docs, indexes, rule)
        found = one if found is None else found.union(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("passage_start")).alias("at"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap", (-F.col("best.at")).alias("passage_start"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, rule: Search = Search()) -> DataFrame:
    """The rows of docs, columns unchanged, without those that hold a test item."""
    return drop_ids(docs, find_leaks(docs, benchmark, rule).select("doc_id"))
