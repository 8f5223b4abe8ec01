"""Counting quotient filters over packed word-id n-grams, built and merged in numpy. Helpers for tasks; no Spark here.

An n-gram of up to three word ids (0 where there is none) is packed into 2w bits and permuted by a Feistel network, which can be
undone, so the filter is lossless. The highest bits of the permuted number name the shard, the next q bits are the quotient, all
others the remainder, kept in full. Remainders of one quotient stand together in sorted order from the quotient's own slot on,
pushed to the right where slots are taken. One bit per quotient says whether it is occupied, one bit per slot whether a run ends
there and one whether the slot holds a digit of the counter of the entry before. An entry that occurs once has no counter.
"""

from __future__ import annotations

import dataclasses

import numpy as np

from .textscan import mix

U64 = np.uint64
ROUNDS = 4
#: Entries per slot at most when a filter is built.
LOAD = 0.9


def _mask(bits: int) -> np.uint64:
    return U64((1 << bits) - 1)


@dataclasses.dataclass(frozen=True)
class Layout:
    """Bits of a word id, and of the shard number."""

    id_bits: int
    shard_bits: int

    def __post_init__(self):
        if not 1 <= self.id_bits <= 42:
            raise ValueError("word ids need 1 to 42 bits")

    @property
    def half(self) -> int:
        return -(-3 * self.id_bits // 2)

    @property
    def shards(self) -> int:
        return 1 << min(self.shard_bits, self.half)

    @property
    def rest(self) -> int:
        """Bits of the upper half under the shard number."""
        return self.half - min(self.shard_bits, self.half)

    def permuted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of each row of three ids, permuted."""
        k, w, (a, b, c) = U64(self.id_bits), self.half, ids.astype(U64).T
        # The packed number a b c, cut into its upper and lower w bits.
        spare = U64(w - self.id_bits)
        high = (a << (U64(2) * k - U64(w))) | (b >> spare) if 2 * self.id_bits >= w else a
        low = ((b & _mask(w - self.id_bits)) << k) | c
        for i in range(ROUNDS):
            high, low = low, high ^ (mix(low + U64(i * 0x9E3779B97F4A7C15 % 2**64)) & _mask(w))
        return high, low

    def ids(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The rows of three ids again."""
        k, w = U64(self.id_bits), self.half
        for i in reversed(range(ROUNDS)):
            high, low = low ^ (mix(high + U64(i * 0x9E3779B97F4A7C15 % 2**64)) & _mask(w)), high
        spare = U64(w - self.id_bits)
        c = low & _mask(self.id_bits)
        b = ((high << spare) | (low >> k)) & _mask(self.id_bits)
        a = high >> (U64(2) * k - U64(w))
        return np.stack([a, b, c], axis=1)


def added_up(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in sorted order, equal ones added up. Sorting is quick where the input consists of sorted stretches."""
    if not len(high):
        return high, low, counts
    if 2 * half <= 64:
        order = np.argsort((high << U64(half)) | low, kind="stable")
    else:
        order = np.lexsort((low, high))
    high, low, counts = high[order], low[order], counts[order]
    first = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    at = np.flatnonzero(first)
    return high[at], low[at], np.add.reduceat(counts, at)


def built(layout: Layout, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of one shard's entries, which come sorted and distinct; counts are at least 1."""
    n, rest, w = len(high), layout.rest, layout.half
    q = min(rest, max(0, int(np.ceil(np.log2(max(1, n) / LOAD)))))
    under = high & _mask(rest)
    quotient = (under >> U64(rest - q)).astype(np.int64)
    wide = _widths(rest - q, w)
    digit_bytes = sum(wide)
    if wide[0]:
        remainder = np.concatenate([_bytes(under & _mask(rest - q), wide[0]), _bytes(low, wide[1])], axis=1)
    else:
        remainder = _bytes(((under & _mask(rest - q)) << U64(w)) | low, wide[1])
    # Digits of the counters, in numbers of as many bytes as a remainder has.
    digits = np.zeros(n, np.int64)
    left = (counts - 1).astype(U64)
    shift = min(8 * digit_bytes, 63)
    levels = []
    while left.any():
        digits += left > 0
        levels.append(left & _mask(shift))
        left = left >> U64(shift)
    # Runs begin at their own slot or behind the run before.
    size = 1 + digits
    occupied, first = np.unique(quotient, return_index=True)
    lengths = np.add.reduceat(size, first) if n else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    begins = before + np.maximum.accumulate(occupied - before) if n else before
    within = np.concatenate([[0], np.cumsum(size)])[:-1]
    run = np.repeat(np.arange(len(occupied)), np.diff([*first, n])) if n else np.zeros(0, np.int64)
    slot = begins[run] + within - before[run] if n else within
    total = int(begins[-1] + lengths[-1]) if n else 0
    body = np.zeros((total, digit_bytes), np.uint8)
    body[slot] = remainder
    counter = np.zeros(total, bool)
    for i, level in enumerate(levels):
        has = digits > i
        counter[slot[has] + 1 + i] = True
        body[slot[has] + 1 + i] = _bytes(level[has], digit_bytes)
    ends = np.zeros(total, bool)
    ends[begins + lengths - 1] = True
    used = np.zeros(1 << q, bool)
    used[occupied] = True
    head = np.array([q, total, int(high[0] >> U64(rest)) if n else 0], "<i8")
    return b"".join([head.tobytes(), np.packbits(used).tobytes(), np.packbits(ends).tobytes(), np.packbits(counter).tobytes(), body.tobytes()])


def entries(layout: Layout, held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves and counts of all entries, in sorted order."""
    rest, w = layout.rest, layout.half
    q, total, shard = (int(x) for x in np.frombuffer(held, "<i8", 3))
    raw, at = np.frombuffer(held, np.uint8), 24
    quotients, slots = -(-(1 << q) // 8), -(-total // 8)
    used = np.flatnonzero(np.unpackbits(raw[at:at + quotients], count=1 << q))
    ends = np.flatnonzero(np.unpackbits(raw[at + quotients:at + quotients + slots], count=total))
    counter = np.unpackbits(raw[at + quotients + slots:at + quotients + 2 * slots], count=total).astype(bool)
    wide = _widths(rest - q, w)
    body = raw[at + quotients + 2 * slots:].reshape(total, sum(wide))
    begins = np.maximum(used, np.concatenate([[0], ends[:-1] + 1])) if len(used) else used
    lengths = ends - begins + 1
    taken = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(int(lengths.sum()))
    quotient, digit = np.repeat(used, lengths), counter[taken]
    body, quotient = body[taken], quotient[~digit].astype(U64)
    own = body[~digit]
    upper, low = _numbers(own[:, :wide[0]]), _numbers(own[:, wide[0]:])
    if not wide[0]:
        upper, low = low >> U64(w), low & _mask(w)
    high = (U64(shard) << U64(rest)) | (quotient << U64(rest - q)) | upper
    counts = np.ones(len(own), np.int64)
    if digit.any():
        entry = np.cumsum(~digit)[digit] - 1
        level = np.arange(int(digit.sum())) - np.searchsorted(entry, entry)
        shift = min(8 * body.shape[1], 63)
        np.add.at(counts, entry, (_numbers(body[digit]) << (level * shift).astype(U64)).astype(np.int64))
    return high, low, counts


def _widths(upper: int, lower: int) -> tuple[int, int]:
    """Bytes of both parts of a remainder; where they fit into one number of under 64 bits, that is the second."""
    return (0, -(-(upper + lower) // 8)) if upper + lower < 64 else (-(-upper // 8), -(-lower // 8))


def _bytes(numbers: np.ndarray, wide: int) -> np.ndarray:
    """Each number's lowest bytes, little end first."""
    out = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)
    return out[:, :wide] if wide <= 8 else np.concatenate([out, np.zeros((len(out), wide - 8), np.uint8)], axis=1)


def _numbers(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :min(8, raw.shape[1])] = raw[:, :8]
    return out.view("<u8")[:, 0].astype(U64)
