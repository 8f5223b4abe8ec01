"""Runs in sequences of words: zero-mismatch places of blocks by exact number-theoretic transforms, then extension. Helpers for tasks; no Spark here.

A run of period q and length at least max(12, 2q) holds, for a suitable scale, a whole aligned block that stands again q words
further on inside the run. Scales are dyadic: blocks of 4 words (one every 3 words) serve periods 1 to 14, blocks of B = 8, 16, ...
words (one every B words) periods 2B-1 to 4B-2. For each block the squared differences to the window that follows are summed for
all distances at once, sum x^2 + sum y^2 - 2 sum xy, with the last term by a transform modulo primes whose product exceeds
any possible sum; so a zero is a true zero. The distances found are extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U64 = np.uint64
#: Primes k * 2^e + 1 under 2^31 and a primitive root of each (fixed values of number theory).
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: Numbers in a transform's table at once.
TABLE = 1 << 18
#: Longest run looked for is at least this, and blocks of the first scale.
LEAST, FIRST, STEP = 12, 4, 3


@lru_cache(64)
def _roots(prime: int, root: int, size: int, inverse: bool) -> tuple[np.ndarray, ...]:
    """For each butterfly width the powers of its root of unity."""
    out, half = [], size // 2
    base = pow(root, (prime - 1) // size, prime)
    base = pow(base, -1, prime) if inverse else base
    powers = np.ones(half, U64)
    for i in range(half.bit_length() - 1):
        n = 1 << i
        powers[n:2 * n] = powers[:n] * U64(pow(base, n, prime)) % U64(prime)
    while half:
        out.append(powers[::size // 2 // half])
        half //= 2
    return tuple(out)


def transform(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    p, (n, size) = U64(prime), rows.shape
    x, width = rows.copy(), size // 2
    for powers in _roots(prime, root, size, False):
        v = x.reshape(n, -1, 2, width)
        low, high = v[:, :, 0], v[:, :, 1]
        total, less = low + high, (low + p - high) * powers
        v[:, :, 0], v[:, :, 1] = np.where(total >= p, total - p, total), less % p
        width //= 2
    return x


def back(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The inverse of `transform`."""
    p, (n, size) = U64(prime), rows.shape
    x, width = rows.copy(), 1
    for powers in reversed(_roots(prime, root, size, True)):
        v = x.reshape(n, -1, 2, width)
        low, high = v[:, :, 0], v[:, :, 1] * powers % p
        total, less = low + high, low + p - high
        v[:, :, 0], v[:, :, 1] = np.where(total >= p, total - p, total), np.where(less >= p, less - p, less)
        width *= 2
    return x * U64(pow(size, -1, prime)) % p


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray, lags: int) -> np.ndarray:
    """For each block and each of the first `lags` places of its window, whether the block stands there word for word."""
    n, width = blocks.shape
    size = 1 << (windows.shape[1] - 1).bit_length()
    most = int(max(blocks.max(initial=0), windows.max(initial=0))) ** 2 * width
    zero, product, k = np.ones((n, lags), bool), 1, 0
    while product <= most:
        if k == len(PRIMES):
            raise ValueError("sums of squared differences exceed the product of the primes")
        prime, root = PRIMES[k]
        p = U64(prime)
        x, y = np.zeros((n, size), U64), np.zeros((n, size), U64)
        x[:, 0], x[:, size - width + 1:] = blocks[:, 0], blocks[:, :0:-1]
        y[:, :windows.shape[1]] = windows
        cross = back(transform(x % p, prime, root) * transform(y % p, prime, root) % p, prime, root)[:, :lags]
        squares = np.zeros((n, windows.shape[1] + 1), U64)
        np.cumsum(windows.astype(U64) % p * (windows.astype(U64) % p) % p, axis=1, out=squares[:, 1:])
        there = (squares[:, width:width + lags] - squares[:, :lags]) % p
        here = (blocks.astype(U64) % p * (blocks.astype(U64) % p) % p).sum(axis=1) % p
        zero &= (here[:, None] + there + (p - cross) + (p - cross)) % p == 0
        product *= prime
        k += 1
    return zero


def _next_distance(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How far on each word stands again in its document; a very large number if it does not."""
    n = len(ids)
    order = np.lexsort((np.arange(n), ids, doc))
    far = np.full(n, np.iinfo(np.int64).max // 2)
    same = (ids[order[1:]] == ids[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def seeds(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per scale the width of its blocks, the places of blocks, and distances at which they stand again, over all documents of the batch.

    ids: word numbers, dense in each document; starts: each document's first place, with the number of words at the end.
    A block with a word that does not come again within the scale's distances can't stand again there and is not transformed.
    """
    n = len(ids)
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(starts[1:], sizes)
    far = _next_distance(ids, doc)
    width, longest = FIRST, int(sizes.max(initial=0))
    first = True
    while True:
        low, high, step = (1, 4 * FIRST - 2, STEP) if first else (2 * width - 1, 4 * width - 2, width)
        if longest < (LEAST if first else 2 * low):
            break
        at = np.arange(0, n - width + 1, step)
        if first:
            most = np.max([far[at + k] for k in range(width)], axis=0)
        else:
            most = far[:len(at) * width].reshape(-1, width).max(axis=1)
        at = at[(most <= high) & (at + low + width <= end[at])]
        reach = high - low + width
        places, lags = [], []
        each = max(1, TABLE // (1 << (reach - 1).bit_length()))
        for i in range(0, len(at), each):
            some = at[i:i + each]
            where = some[:, None] + low + np.arange(reach)
            windows = ids[np.minimum(where, n - 1)]
            row, lag = np.nonzero(zero_mismatches(ids[some[:, None] + np.arange(width)], windows, high - low + 1))
            place, lag = some[row], lag + low
            inside = place + lag + width <= end[place]
            places.append(place[inside])
            lags.append(lag[inside])
        if places:
            yield width, np.concatenate(places), np.concatenate(lags)
        first, width = False, width * 2


def _equal_to_the_right(ids: np.ndarray, at: int, lag: int) -> int:
    """How many words from `at` on equal the word `lag` further on; looked up in steps that double."""
    done, step = 0, 64
    most = len(ids) - lag - at
    while done < most:
        a = at + done
        m = min(step, most - done)
        differs = ids[a:a + m] != ids[a + lag:a + lag + m]
        k = int(differs.argmax())
        if differs[k]:
            return done + k
        done += m
        step *= 2
    return max(done, 0)


def _equal_to_the_left(ids: np.ndarray, at: int, lag: int) -> int:
    """The same before `at`, going left."""
    done, step = 0, 64
    while done < at:
        a = at - done
        m = min(step, a)
        differs = (ids[a - m:a] != ids[a - m + lag:a + lag])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return done + k
        done += m
        step *= 2
    return done


class Runs:
    """The runs of one document, from seeds that come by rising distance.

    A seed whose two blocks lie within a known run is done with if the run's period divides its distance: extending it would
    give that run again, whose smallest period is known. Runs of one period overlap by less than the period, so starts and ends rise together.
    """

    def __init__(self, ids: np.ndarray):
        self.ids, self.found = ids, {}

    def extend(self, width: int, places: np.ndarray, lags: np.ndarray) -> None:
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        held, begins = np.unique(lags, return_index=True)
        for lag, lo, hi in zip(held.tolist(), begins, [*begins[1:], len(lags)]):
            left = places[lo:hi]
            for period, (starts, ends) in self.found.items():
                if len(left) and lag % period == 0:
                    last = np.searchsorted(starts, left, "right") - 1
                    left = left[(last < 0) | (np.array(ends)[last] < left + width + lag)]
            k = 0
            while k < len(left):
                place = int(left[k])
                start = place - _equal_to_the_left(self.ids, place, lag)
                end = place + lag + _equal_to_the_right(self.ids, place, lag)
                if end - start >= max(LEAST, 2 * lag):
                    starts, ends = self.found.setdefault(lag, ([], []))
                    starts.append(start)
                    ends.append(end)
                # Seeds of the same distance within this stretch give it again.
                k = max(k + 1, int(np.searchsorted(left, end - lag - width, "right")))

    def listed(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        return sorted(((s, e - s, q) for q, (starts, ends) in self.found.items() for s, e in zip(starts, ends)), key=lambda r: (r[0], r[2]))
