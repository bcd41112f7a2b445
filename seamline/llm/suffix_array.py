"""Suffix arrays by linear grouping.

First phase: suffixes are grouped by first symbol, and groups are taken in descending order. Each suffix of the group
at hand points to the nearest earlier suffix in a lower group (its previous smaller one). The suffixes pointed to have
the group's prefix after their own; they leave their groups for new ones right above them, those pointed to more often
higher. Once every group was taken, a group holds the suffixes with one longest Lyndon prefix.

Second phase: the suffix array is emitted from the left. Each emitted suffix places the one before it and then, along the
previous-smaller pointers, every suffix whose Lyndon prefix ends there, each at the first free place of its group. No
renaming and no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of an integer sequence in ascending order; a proper prefix sorts first."""
    n = len(symbols) + 1
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    rank = np.empty(n, dtype=np.int64)
    rank[:-1] = np.unique(symbols, return_inverse=True)[1].reshape(-1) + 1
    rank[-1] = 0  # the end, below every symbol
    order = np.argsort(rank, kind="stable")
    head = np.searchsorted(rank[order], np.arange(rank.max() + 1))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    sa: list[int] = order.tolist()
    isa: list[int] = place.tolist()
    group: list[int] = head[rank].tolist()  # of each suffix: where its group starts in sa
    last: dict[int, int] = dict(zip(head.tolist(), (np.append(head[1:], n) - 1).tolist(), strict=True))  # where a group ends
    prev = [-1] * n

    hi = n - 1
    while hi > 0:
        g = group[sa[hi]]
        if g == hi:  # a group of one
            i = sa[hi]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                h = group[j]
                e = last[h]
                if e != h:  # else it is alone already, and a new group would stand at the same place
                    at, other = isa[j], sa[e]
                    sa[at], isa[other] = other, at
                    sa[e], isa[j] = j, e
                    last[h] = e - 1
                    group[j] = last[e] = e
            hi = g - 1
            continue
        pointed: dict[int, int] = {}
        members = sa[g : hi + 1]
        members.sort()
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                moves.setdefault((times, group[j]), []).append(j)
            for times, h in sorted(moves, reverse=True) if len(moves) > 1 else moves:
                gone = moves[times, h]
                e = last[h]
                for j in gone:
                    at, other = isa[j], sa[e]
                    sa[at], isa[other] = other, at
                    sa[e], isa[j] = j, e
                    e -= 1
                if e >= h:
                    end = last[h]
                    last[h] = e
                    last[e + 1] = end
                    for j in gone:
                        group[j] = e + 1
        hi = g - 1

    free: list[int] = list(range(n))  # of each group start: its first free place
    out = [-1] * n
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
    return np.array(out[1:], dtype=np.int64)
