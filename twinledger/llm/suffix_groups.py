"""Suffix sorting by grouping: linear time, no recursion and no renaming. Plain Python on one sequence of integers.

Phase 1. Suffixes start in groups by their first symbol. Groups are taken from the highest down. All suffixes of the group taken share
a context (the Lyndon prefix of each), and prev(i) of a suffix is the nearest suffix before it that lies in a lower group. The
previous ones are counted by how many suffixes of the group point to them; those with a count, taken group by group from the
largest count down, leave their group for a new one right above it: their context has grown by the group's, as often as the count says. A group that has
been taken never changes again.

Phase 2. Groups now hold suffixes with equal contexts, in the right order of groups. Reading the order from the front,
the suffix before each settled one, and its previous ones in turn, take the next free place of their groups.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence


def _numbers(n: int) -> array:
    return array("i", bytes(4 * n))


def suffix_order(symbols: Sequence[int]) -> list[int]:
    """Starts of all suffixes in ascending order. The last symbol has to be the only one of the least value."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    # A group is named by its first place in the final order; it fills size[group] places from there.
    # Only groups that haven't been taken keep a list of members.
    group, size, members = _numbers(n), _numbers(n), {}
    # begin[e]: the group whose last place is just before e.
    begin, at = _numbers(n + 1), 0
    for c in sorted(by_symbol):
        held = by_symbol.pop(c)
        for i in held:
            group[i] = at
        size[at], members[at] = len(held), held
        begin[at + len(held)] = at
        at += len(held)
    prev = array("i", [-1]) * n
    end = n
    while end > 0:
        g = begin[end]
        taken = [i for i in members.pop(g) if group[i] == g]
        taken.sort()
        counts: dict[int, int] = {}
        for i in taken:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            by_count: dict[int, list[int]] = {}
            for j, k in counts.items():
                by_count.setdefault(k, []).append(j)
            for k in sorted(by_count, reverse=True):
                leaving: dict[int, list[int]] = {}
                for j in by_count[k]:
                    leaving.setdefault(group[j], []).append(j)
                for h, some in leaving.items():
                    if len(some) == size[h]:
                        continue
                    new = h + size[h] - len(some)
                    begin[h + size[h]], begin[new] = new, h
                    size[h] -= len(some)
                    size[new], members[new] = len(some), some
                    for j in some:
                        group[j] = new
        end = g
    return _emit(n, group, prev)


def _emit(n: int, group: array, prev: array) -> list[int]:
    order, free, settled = array("i", [-1]) * n, array("i", range(n)), bytearray(n)
    order[0] = n - 1
    settled[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not settled[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            settled[j] = 1
            j = prev[j]
    return order.tolist()
