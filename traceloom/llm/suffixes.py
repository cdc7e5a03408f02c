"""Suffix arrays of many short texts at once, by linear grouping.

Every text ends in a unique smallest symbol.  Suffixes start out grouped by
their first symbol.  Groups are then taken from the highest down; each suffix of
the group finds its previous smaller pointer, the nearest suffix ahead of it in
a lower group.  The suffixes pointed at, which thereby extend their Lyndon
prefix by as many copies of the group's as point at them, leave their groups for
new ones right above, the more copies the higher.  In the end, groups are of
equal Lyndon prefixes in order, and one ascending pass emits the order within
each group by following the pointers.  Nothing is renamed or recursed into.

The texts are independent, so one step takes the next group of every text.
"""

from __future__ import annotations

import numpy as np


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0].., start[1].., of the given sizes, end to end."""
    if not len(size):
        return np.empty(0, np.int64)
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def suffix_arrays(symbols: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array of each text, laid end to end as the texts are in ``symbols``.

    Text t is symbols[base[t] : base[t] + size[t]]; its last symbol is smaller
    than all its others and occurs once.  Positions are those of ``symbols``.
    """
    n = len(symbols)
    text = np.repeat(np.arange(len(base)), size)
    place = np.argsort(text * (int(symbols.max(initial=0)) + 1) + symbols, kind="stable")  # suffixes by group
    where = np.empty(n, np.int64)
    where[place] = np.arange(n)
    new = np.r_[True, (text[place][1:] != text[place][:-1]) | (symbols[place][1:] != symbols[place][:-1])] if n else np.empty(0, bool)
    first = np.flatnonzero(new)
    count = np.zeros(n, np.int64)  # of the group that starts here
    count[first] = np.diff(np.r_[first, n])
    group = np.empty(n, np.int64)  # a suffix's group, by where it starts
    group[place] = np.repeat(first, count[first])
    pointer = np.full(n, -1, np.int64)
    moved, target = np.zeros(n, bool), np.zeros(n, bool)

    active, top = np.arange(len(base)), base + size
    while len(active):
        end = top[active]
        start = group[place[end - 1]]
        many = end - start
        member = place[ranges(start, many)]
        own, low = np.repeat(start, many), np.repeat(base[active], many)
        p = member - 1
        pointer[member] = p
        look = np.arange(len(p))
        while len(look):
            at = p[look]
            look = look[(at >= low[look]) & (group[np.maximum(at, 0)] >= own[look])]
            p[look] = pointer[p[look]]
            pointer[member[look]] = p[look]
        top[active] = start
        active = active[start > base[active]]
        parent = p[p >= low]
        if not len(parent):
            continue
        parent.sort()
        edge = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        copies, parent = np.diff(np.r_[edge, len(parent)]), parent[edge]
        old = group[parent]
        order = np.lexsort((copies, old))
        parent, copies, old = parent[order], copies[order], old[order]
        lead = np.r_[True, old[1:] != old[:-1]]
        at = np.flatnonzero(lead)
        leaving = np.diff(np.r_[at, len(old)])
        to = ranges(old[at] + count[old[at]] - leaving, leaving)
        # those that stand where the leaving ones go take the places that these leave
        moved[parent], target[to] = True, True
        there, came = place[to], where[parent]
        out, gap = there[~moved[there]], came[~target[came]]
        place[gap], where[out] = out, gap
        place[to], where[parent] = parent, to
        moved[parent], target[to] = False, False
        fresh = np.flatnonzero(lead | np.r_[True, copies[1:] != copies[:-1]])
        width = np.diff(np.r_[fresh, len(old)])
        count[old[at]] -= leaving
        count[to[fresh]] = width
        group[parent] = np.repeat(to[fresh], width)

    out = np.full(n, -1, np.int64)
    head = np.arange(n)
    done = np.zeros(n, bool)
    out[base] = base + size - 1
    done[out[base]] = True
    head[base] += 1
    by_size = np.argsort(-size, kind="stable")
    base, size = base[by_size], size[by_size]
    left = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")  # texts longer than i
    for i in range(size.max(initial=0)):
        low = base[: left[i]]
        j = out[low + i] - 1
        while True:
            go = j >= low
            go[go] = ~done[j[go]]
            j, low = j[go], low[go]
            if not len(j):
                break
            g = group[j]
            out[head[g]] = j
            head[g] += 1
            done[j] = True
            j = pointer[j]
    return out
