"""Suffix array by linear grouping.

Phase 1 sorts suffixes into groups that share their Lyndon prefix: groups are taken in
descending order, each suffix of the group finds its previous smaller suffix (the nearest
one to its left in a lower group), and the suffixes so found are split off their own groups
by how many of the group point at them. Phase 2 goes through the suffix array from the left
and puts the suffix before each entry, and then those its previous-smaller pointers lead to,
at the next free place of their groups. No recursion and no renaming.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int] | np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer string in ascending order."""
    text = np.asarray(symbols, dtype=np.int64)
    n = len(text) + 1
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    text = np.append(text - text.min() + 1, 0)  # a least symbol ends the string
    order = np.argsort(text, kind="stable")
    at: list[int] = order.tolist()  # suffixes by place
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    first = np.flatnonzero(np.append(True, np.diff(text[order]) > 0))
    size = [0] * n
    for a, b in zip(first.tolist(), np.append(first[1:], n).tolist()):
        size[a] = b - a
    group_of = np.empty(n, dtype=np.int64)
    group_of[order] = np.repeat(first, np.diff(np.append(first, n)))
    group: list[int] = group_of.tolist()  # a group is named by its first place
    before = [-1] * n

    end = n
    while end > 0:
        own = group[at[end - 1]]
        members = at[own:end] if end - own == 1 else sorted(at[own:end])
        hits: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = before[j]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        end = own
        if not hits:
            continue
        by_hits: dict[int, list[int]] = {}
        for j, k in hits.items():
            by_hits.setdefault(k, []).append(j)
        for k in sorted(by_hits, reverse=True):
            moved: dict[int, int] = {}
            for j in by_hits[k]:  # to the end of its group
                g = group[j]
                m = moved.get(g, 0) + 1
                moved[g] = m
                a, b = place[j], g + size[g] - m
                other = at[b]
                at[a], at[b], place[other], place[j] = other, j, a, b
            for g, m in moved.items():
                if m < size[g]:
                    new = g + size[g] - m
                    size[g] -= m
                    size[new] = m
                    for p in range(new, new + m):
                        group[at[p]] = new

    out = [-1] * n
    taken = [0] * n
    put = [False] * n
    out[0] = n - 1
    put[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[g + taken[g]] = j
            taken[g] += 1
            put[j] = True
            j = before[j]
    return np.array(out[1:], dtype=np.int64)
