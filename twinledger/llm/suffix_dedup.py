"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of `length` bytes around it also starts earlier. The suffixes of a whole corpus needn't be sorted in one
place: two equal strings of that length hold the same anchor, the string of `gram` bytes whose fingerprint is least in it
(winnowing), so suffixes only have to be sorted among the surroundings of equal anchors.

1. Anchors meet by fingerprint (meeting.py); those that occur once are done with. Only documents with a repeated anchor go on.
2. The surroundings of each repeated anchor, which hold every string of `length` bytes that it is the anchor of, meet by anchor. Equal
   surroundings are one text with its earliest place; the later places repeat it whole.
3. Different surroundings of an anchor, without the places that an earlier one of the same document shows already, are cut to what can repeat
   (strings whose fingerprint occurs twice among them); equal pieces are one again. An anchor with very many surroundings is first told
   apart by what stands on its longer side within a string (_narrowed), so memory follows what is really alike. Their suffixes are sorted (suffix_groups.py), strings of equal first `length` bytes stand side by side, and all but the earliest repeat.
4. The repeated strings go back to their documents.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .meeting import ID_LIST, TICKETS, bucket_count, gathered, grouped_docs, joined_cells, marked_docs, marked_ids, meet, one_array, places_by_doc, split_rows
from .shared import kept_table, text_of
from .suffix_groups import suffix_order
from .textscan import U64, byte_windows, give_back, mix, slices, text_buffers


#: Bytes that are fingerprinted at a time, at eight bytes and more for each.
BYTE_SLICE = 1 << 17


@dataclass(frozen=True)
class Repeats:
    length: int = 100
    gram: int = 32

    @property
    def reach(self) -> int:
        """Places that an anchor has within a string: the least of so many fingerprints is taken."""
        return self.length - self.gram + 1


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of `width` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def anchors(data: np.ndarray, offs: np.ndarray, rule: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints of the anchors: every string of rule.length bytes of a document holds its least gram.

    Documents stand side by side here; near their ends a few more anchors may be taken than needed, never fewer."""
    n = len(data) - rule.gram + 1
    if len(data) < rule.length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams = byte_windows(data, rule.gram)
    usable = np.ones(n, bool)
    lengths = np.diff(offs)
    for end in offs[1:-1]:
        usable[max(0, end - rule.gram + 1):end] = False
    for d in np.flatnonzero(lengths < rule.length):
        usable[offs[d]:offs[d + 1]] = False
    ranked = np.where(usable, grams, U64(2**64 - 1))
    least = _sliding(ranked, rule.reach, np.minimum)
    pad = np.zeros(rule.reach - 1, U64)
    most = _sliding(np.concatenate([pad, least, pad]), rule.reach, np.maximum)
    at = np.flatnonzero(usable & (ranked == most))
    return at, grams[at]


def _own_strings(whole: np.ndarray, at: np.ndarray, rule: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor place of one document the first string that has its least gram there, the number of such strings (side by side), and the fingerprint.

    Which gram is least depends on a string alone, so equal strings are found at equal anchors."""
    grams = byte_windows(whole, rule.gram)
    hashes = grams[at]
    if len(grams) < rule.reach:
        return at, np.zeros(len(at), np.int64), hashes
    least = _sliding(grams, rule.reach, np.minimum)
    string = at[:, None] + np.arange(1 - rule.reach, 1)
    own = (string >= 0) & (string < len(least)) & (least[np.clip(string, 0, len(least) - 1)] == hashes[:, None])
    return at + 1 - rule.reach + own.argmax(axis=1), own.sum(axis=1), hashes


def _anchor_tickets(docs: DataFrame, rule: Repeats, buckets: int) -> DataFrame:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            ids, groups = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for lo, _, data, offs in slices(b.column(1), BYTE_SLICE):
                at, hashes = anchors(data, offs, rule)
                if len(at):
                    doc = np.searchsorted(offs, at, "right") - 1
                    yield hashes, np.zeros(len(at), np.uint32), ids[lo + doc], (at - offs[doc]).astype(np.int32), groups[lo + doc]
        give_back()

    return docs.select("doc_id", "text", "g").mapInArrow(lambda batches: gathered(parts(batches), buckets), TICKETS)


_NEAR = ("hashes", "<u8"), ("docs", "<i8"), ("places", "<i4"), ("groups", "<i4"), ("lefts", "u1"), ("sizes", "u1")
NEAR = "bucket int, hashes binary, docs binary, places binary, groups binary, lefts binary, sizes binary, texts binary"
SPANS = "g int, docs binary, starts binary, counts binary"


def _surroundings(found: DataFrame, marks: DataFrame, rule: Repeats, buckets: int) -> DataFrame:
    """The surroundings of every repeated anchor by anchor (bucket >= 0); of equal ones in a group of documents the earliest, and for
    the others the strings that repeat (bucket < 0: docs, places of the first string, sizes the number of strings)."""
    if 2 * rule.length - rule.gram > 255:
        raise ValueError("surroundings must fit into 255 bytes")

    def scan(texts: pa.Table, table: pa.Table) -> pa.Table:
        by_doc, group = places_by_doc(table), texts.column("g")[0].as_py() if len(texts) else 0
        ids = texts.column("doc_id").to_numpy() if len(texts) else np.zeros(0, np.int64)
        data, offs = text_buffers(one_array(texts.column("text")))
        first: dict[tuple[bytes, int], int] = {}
        keep: list[tuple] = []
        spans: list[tuple[int, int, int]] = []
        last = None
        for i in np.argsort(ids, kind="stable").tolist():
            doc = int(ids[i])
            # Rows that repeat a doc_id stand for the first of them.
            if doc == last or doc not in by_doc:
                continue
            last = doc
            whole = data[offs[i]:offs[i + 1]]
            at = by_doc[doc]
            at = at[at <= len(whole) - rule.gram]
            if not len(at):
                continue
            first_string, strings, hashes = _own_strings(whole, at, rule)
            raw = whole.tobytes()
            for p, h, lo, k in zip(at.tolist(), hashes.tolist(), first_string.tolist(), strings.tolist()):
                if not k:
                    continue
                hi = lo + k - 1 + rule.length
                near = raw[lo:hi], p - lo
                if near in first:
                    spans.append((doc, lo, hi - lo - rule.length + 1))
                else:
                    first[near] = len(keep)
                    keep.append((h, doc, p, p - lo, hi - lo, near[0]))
        hashes = np.array([k[0] for k in keep], U64)
        sizes = np.array([k[4] for k in keep], np.int64)
        to = (mix(hashes) % U64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        rows = split_rows(to, "bucket", [
            ("hashes", hashes), ("docs", np.array([k[1] for k in keep], np.int64)), ("places", np.array([k[2] for k in keep], np.int32)),
            ("groups", np.full(len(keep), group, np.int32)), ("lefts", np.array([k[3] for k in keep], np.uint8)), ("sizes", sizes.astype(np.uint8))])
        at, text = 0, []
        for count in np.unique(to, return_counts=True)[1].tolist():
            text.append(b"".join([keep[j][5] for j in order[at:at + count].tolist()]))
            at += count
        rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array(text, pa.binary())], [*rows.schema.names, "texts"])
        out = [rows]
        if spans:
            a = np.array(spans, np.int64)
            cells = [[-1 - group], [b""], [a[:, 0].tobytes()], [a[:, 1].astype("<i4").tobytes()], [np.full(len(a), group, "<i4").tobytes()], [b""], [a[:, 2].astype("u1").tobytes()], [b""]]
            out.append(pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cells[1:]]], rows.schema.names))
        del first, keep, spans, data, by_doc
        give_back()
        return pa.Table.from_batches(out)

    return found.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(scan, NEAR)


def repeated_starts(pieces: list[tuple[bytes, int, int]], length: int) -> list[tuple[int, int]]:
    """(doc, start) of every string of `length` bytes in the pieces (text, doc, start of the text) that also starts earlier."""
    raw = b"\0".join(t for t, _, _ in pieces) + b"\0"
    symbols = np.frombuffer(raw, np.uint8).astype(np.int32) + 2
    # Of every symbol, its document and place, if a whole string starts there.
    doc_of, place_of, at = np.zeros(len(raw), np.int64), np.full(len(raw), -1), 0
    for text, doc, start in pieces:
        n = len(text) - length + 1
        doc_of[at:at + n], place_of[at:at + n] = doc, np.arange(start, start + n)
        at += len(text) + 1
        symbols[at - 1] = 1
    symbols = [*symbols.tolist(), 0]
    doc_of, place_of = array("q", doc_of.tobytes()), array("q", [*place_of.tolist(), -1])
    found: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    before = None
    for s in suffix_order(symbols):
        if place_of[s] < 0:
            continue
        head = raw[s:s + length]
        if head == before:
            run.append((doc_of[s], place_of[s]))
        else:
            if len(run) > 1:
                found += sorted(set(run))[1:]
            run, before = [(doc_of[s], place_of[s])], head
    if len(run) > 1:
        found += sorted(set(run))[1:]
    return found


#: Some strings of an entry: the entry, its first string and the one after the last.
Strings = tuple[int, int, int]


def _narrowed(group: list[Strings], text_at, lefts: np.ndarray, rule: Repeats) -> list[list[Strings]]:
    """The group in parts so that equal strings are in one part. A string holds `half` bytes next to its anchor on at least one side, and equal
    strings hold the same ones: every string goes by those on the left if it holds them, else by those on the right."""
    half, parts = (rule.length - rule.gram) // 2, {}
    for e, lo, hi in group:
        text, left = text_at(e), int(lefts[e])
        middle = min(hi, max(lo, left - half + 1))
        if lo < middle:
            parts.setdefault((0, text[left - half:left]), []).append((e, lo, middle))
        if middle < hi:
            parts.setdefault((1, text[left + rule.gram:left + rule.gram + half]), []).append((e, middle, hi))
    return [g for g in parts.values() if len(g) > 1]


def _batches(groups: list[list[Strings]], length: int, limit: int = BYTE_SLICE) -> Iterator[list[list[Strings]]]:
    """Runs of whole groups with about `limit` bytes of text."""
    held, size = [], 0
    for g in groups:
        held.append(g)
        size += sum(hi - lo + length - 1 for _, lo, hi in g)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _decide(near: DataFrame, rule: Repeats) -> DataFrame:
    """Rows of SPANS: runs of strings (first start and count) that also start earlier."""
    length, gram = rule.length, rule.gram

    def decide(table: pa.Table) -> pa.Table:
        hashes, docs, places, groups, lefts, sizes = (joined_cells(table, n, k) for n, k in _NEAR)
        if table.column("bucket")[0].as_py() < 0:
            return pa.Table.from_batches([split_rows(groups, "g", [("docs", docs), ("starts", places), ("counts", sizes)])])
        texts = b"".join(table.column("texts").to_pylist())
        ends = np.cumsum(sizes, dtype=np.int64)
        order = np.lexsort((places, docs, hashes))
        cuts = np.flatnonzero(np.diff(hashes[order])) + 1
        bounds = [0, *cuts.tolist(), len(order)]
        spans: list[tuple[int, int, int, int]] = []  # entry, doc, start, count
        open_groups: list[list[Strings]] = []

        def text_at(e: int) -> bytes:
            return texts[ends[e] - sizes[e]:ends[e]]

        for lo, hi in zip(bounds, bounds[1:]):
            different: dict[tuple[bytes, int], int] = {}
            held: list[Strings] = []
            last, shown = None, 0
            for e in order[lo:hi].tolist():
                doc, left, strings = int(docs[e]), int(lefts[e]), int(sizes[e]) - length + 1
                text, begin = text_at(e), int(places[e]) - left
                # Where an anchor comes twice within reach, its first place stands for the strings that hold both: equal strings then stand alike to their anchors.
                new = max(0, shown - begin) if doc == last else 0
                last, shown = doc, max(shown, begin + strings) if doc == last else begin + strings
                if (text, left) in different:
                    spans.append((e, doc, begin, strings))
                else:
                    different[text, left] = e
                    if new < strings:
                        held.append((e, new, strings))
            if len(held) < 2:
                continue
            size = sum(last - first + length - 1 for _, first, last in held)
            open_groups += [held] if size <= BYTE_SLICE else _narrowed(held, text_at, lefts, rule)
        for some in _batches(open_groups, length):
            compare(some, spans, docs, places, lefts, text_at)
        del texts, ends, order
        give_back()
        if not spans:
            return _span_table(np.zeros((0, 4), np.int64), groups)
        return _span_table(np.array(spans, np.int64), groups)

    def compare(open_groups, spans, docs, places, lefts, text_at) -> None:
        """Adds what repeats among the different surroundings of each group."""
        chosen = [x for g in open_groups for x in g]
        entries, first, stop = (np.array(x, np.int64) for x in zip(*chosen))
        number = np.repeat(np.arange(len(open_groups)), [len(g) for g in open_groups])
        strings = stop - first
        size = strings + length - 1
        base = np.cumsum(size) - size
        joined = np.frombuffer(b"".join([text_at(e)[lo:hi + length - 1] for e, lo, hi in chosen]), np.uint8)
        at = np.arange(strings.sum()) + np.repeat(base - (np.cumsum(strings) - strings), strings)
        whose = np.repeat(np.arange(len(entries)), strings)
        print_of = mix(byte_windows(joined, length)[at] + number[whose].astype(U64) * U64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(print_of, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(counts[inverse] > 1)
        if len(shared):
            breaks = np.flatnonzero((np.diff(at[shared]) != 1) | (np.diff(whose[shared]) != 0)) + 1
            starts = np.concatenate([[0], breaks])
            stops = np.concatenate([breaks, [len(shared)]])
            raw, pieces = joined.tobytes(), {}
            begin, finish, entry = at[shared[starts]], at[shared[stops - 1]] + length, whose[shared[starts]]
            for b, f, w in zip(begin.tolist(), finish.tolist(), entry.tolist()):
                e = int(entries[w])
                pieces.setdefault(int(number[w]), []).append((raw[b:f], int(docs[e]), int(places[e]) - int(lefts[e]) + int(first[w]) + b - int(base[w]), e))
            for some in pieces.values():
                some.sort(key=lambda x: x[1:3])
                different = {}
                for text, doc, start, e in some:
                    if text not in different:
                        different[text] = doc, start, e
                    # An anchor that comes twice within reach shows the same place of a document twice.
                    elif different[text][:2] != (doc, start):
                        spans.append((e, doc, start, len(text) - length + 1))
                # All strings were seen twice: one text left means that it only repeats as a whole, or overlaps itself.
                if len(different) > 1 or any(t.find(t[:length], 1) >= 0 for t in different):
                    by_place = {(doc, start): e for doc, start, e in different.values()}
                    owners = {doc: e for (doc, _), e in by_place.items()}
                    spans += [(owners[doc], doc, start, 1) for doc, start in repeated_starts([(t, *x[:2]) for t, x in different.items()], length)]

    def _span_table(a: np.ndarray, groups: np.ndarray) -> pa.Table:
        return pa.Table.from_batches([split_rows(groups[a[:, 0]], "g", [
            ("docs", a[:, 1]), ("starts", a[:, 2].astype(np.int32)), ("counts", a[:, 3].astype(np.uint8))])])

    return near.groupBy("bucket").applyInArrow(decide, SPANS)


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha256"))


def _removals(found: DataFrame, spans: DataFrame, rule: Repeats, texts: bool) -> DataFrame:
    def cut(rows: pa.Table, table: pa.Table) -> pa.Table:
        docs, starts, counts = (joined_cells(table, n, k) for n, k in (("docs", "<i8"), ("starts", "<i4"), ("counts", "u1")))
        order = np.argsort(docs, kind="stable")
        ids, begin = np.unique(docs[order], return_index=True)
        ends = [*begin[1:].tolist(), len(docs)]
        where = {int(d): order[lo:hi] for d, lo, hi in zip(ids, begin.tolist(), ends)}
        out, seen = [], set()
        data, offs = text_buffers(one_array(rows.column("text")))
        for i, doc in enumerate(rows.column("doc_id").to_pylist()):
            at = where.get(doc)
            if at is None or doc in seen:
                continue
            seen.add(doc)
            text = data[offs[i]:offs[i + 1]]
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, starts[at], 1)
            np.add.at(edge, starts[at].astype(np.int64) + counts[at] - 1 + rule.length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            left = text[~gone].tobytes()
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((doc, int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left if texts else None))
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(cut, "id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeated_strings(docs: DataFrame, rule: Repeats = Repeats(), texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal runs), kept_sha256 (of the bytes that stay), and with texts=True
    also `kept`, those bytes (null if nothing was removed).

    A byte goes if it is covered by a string of rule.length bytes that also starts earlier: in a document of smaller doc_id, or earlier in the same one; overlaps count.
    Strings are judged on the input and never cross documents. Null texts count as empty. Rows without doc_id are returned unchanged and take no part;
    rows that repeat a doc_id are taken to repeat its text and give the same row each. Further columns are left out; an empty
    table gives no rows.
    """
    buckets = bucket_count(docs)
    dealt = grouped_docs(docs, buckets)
    marks = kept_table(meet(_anchor_tickets(dealt, rule, buckets)), "anchors")
    found = marked_docs(dealt, marks)
    spans = kept_table(_decide(_surroundings(found, marks, rule, buckets), rule), "spans")
    # Only texts that lose something are moved once more, where the list of their ids is small enough to send around.
    ids = kept_table(marked_ids(spans), "ids")
    if ids.limit(ID_LIST + 1).count() <= ID_LIST:
        found = found.join(F.broadcast(ids), "doc_id", "left_semi")
    removed = _removals(found, spans, rule, texts)
    zero = F.lit(0).cast("long")
    result = _digests(text_of(docs)).join(removed, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")
    return result if texts else result.drop("kept")
