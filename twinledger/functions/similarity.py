"""Similarity of texts and of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_sorted(x: str) -> str:
    """SQL: lower case, words only, sorted, joined with a space."""
    return rf"array_join(array_sort(split(trim(regexp_replace(lower({x}), r'(?U)\W+', ' ')), ' ')), ' ')"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word row per character (Hyyrö 2004)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_percent(a: str, b: str) -> int:
    """``round(100 * 2*LCS / (len a + len b))``, halves to even; two empty texts are equal."""
    if a == b:
        return 100
    return round(200 * common_subsequence(a, b) / (len(a) + len(b)))


# Letters of a chunk of pairs that are compared at once.
TABLE = 4_000_000
_WORD = 64


def common_subsequences(left: list[str], right: list[str]) -> np.ndarray:
    """``common_subsequence`` of many pairs at once: the bit rows of all pairs are columns of machine words.

    Pairs are taken by length, so little is padded; a text of more than 64 characters has several words with a carry.
    """
    # The shorter text of a pair is the bit row.
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    sizes = np.array([(len(a), len(b)) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
    found = np.zeros(len(pairs), dtype=np.int64)
    order = np.lexsort((sizes[:, 1], -(-sizes[:, 0] // _WORD)))
    order = order[sizes[order, 0] > 0]
    start = 0
    while start < len(order):
        words = -(-sizes[order[start], 0] // _WORD)
        same = np.searchsorted(-(-sizes[order[start:], 0] // _WORD), words, "right")
        chunk = order[start:start + min(same, max(1, TABLE // (_WORD * words)))]
        found[chunk] = _of_equal_words([pairs[i] for i in chunk], int(words))
        start += len(chunk)
    return found


def _of_equal_words(pairs: list[tuple[str, str]], words: int) -> np.ndarray:
    """The same for pairs whose shorter texts fill so many words."""
    bits, n = words * _WORD, len(pairs)
    a, b = _codes([p[0] for p in pairs], bits, 0), _codes([p[1] for p in pairs], max(len(p[1]) for p in pairs), 1)
    row = np.full((n, words), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(b.shape[1]):
        equal = np.packbits(a == b[:, j:j + 1], axis=1, bitorder="little").view("<u8")
        hit = row & equal
        # row + hit over all words, low ones first.
        added = row + hit
        carry = added < row
        for k in range(1, words):
            more = added[:, k] + carry[:, k - 1]
            carry[:, k] |= more < added[:, k]
            added[:, k] = more
        row = added | (row ^ hit)
    return bits - np.bitwise_count(row).sum(axis=1).astype(np.int64)


def _codes(texts: list[str], width: int, filler: int) -> np.ndarray:
    """Code points, one row per text; what a text lacks is a number that is no letter and differs between the two sides."""
    out = np.full((len(texts), width), -1 - filler, dtype=np.int32)
    for i, text in enumerate(texts):
        out[i, :len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<i4")
    return out


def indel_percents(left: list[str], right: list[str]) -> np.ndarray:
    """``indel_percent`` of many pairs at once."""
    total = np.array([len(a) + len(b) for a, b in zip(left, right)], dtype=np.int64)
    share = 200.0 * common_subsequences(left, right) / np.maximum(total, 1)
    return np.where(total > 0, np.rint(share), 100).astype(np.int32)


@F.pandas_udf(T.IntegerType())
def _indel_scores(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        known = (left.notna() & right.notna()).to_numpy()
        scores = pd.Series(pd.NA, index=left.index, dtype="Int32")
        if known.any():
            scores[known] = indel_percents(list(left[known]), list(right[known]))
        yield scores


def similarity(a: Column, b: Column) -> Column:
    """Percent similarity (0-100) of two token-sorted texts."""
    return _indel_scores(a, b)


def similarity_bound(a: str, b: str) -> str:
    """SQL: no pair scores above this, as the shorter text may be contained in the longer one."""
    return f"200.0D * least(length({a}), length({b})) / (length({a}) + length({b}))"


def reaches(a: str, b: str, threshold: str) -> str:
    """SQL: whether two texts reach the threshold, as far as their edit distance says so; null if it doesn't.

    With n letters together, an edit distance d means a similarity of at least ``1 - 2d/n`` (a replacement is a removal and an
    addition) and at most ``1 - d/n``. Distances that can't reach the threshold are not worked out. A similarity of just half a
    point less than the threshold depends on rounding and stays open.
    """
    n, least = f"(length({a}) + length({b}))", f"(2 * {threshold} - 1)"
    furthest = f"CAST(floor({n} * (200 - {least}) / 200.0D) AS INT)"
    distance = f"levenshtein({a}, {b}, {furthest})"
    return (
        f"CASE WHEN {n} = 0 THEN true WHEN {a} = {b} THEN true WHEN {distance} = -1 THEN false "
        f"WHEN 200 * ({n} - 2 * {distance}) > {least} * {n} THEN true END"
    )


def cosine(a: str, b: str) -> str:
    """SQL: cosine of two vectors; 0 if either has no length."""
    return f"coalesce(try_divide({_dot(a, b)}, sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})), 0.0D)"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
