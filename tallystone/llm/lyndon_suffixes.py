"""Suffix arrays of many strings at once, by grouping suffixes under their Lyndon prefixes.

The linear-time construction in two phases (grouping suffix array construction, Baier 2016):

1. Suffixes start out grouped by first symbol. Groups are taken in descending order. Each suffix of the
   current group points to its previous smaller one, the nearest to its left in a lower group; a
   suffix that l members point to has its prefix extended by l copies of the group's, and moves with
   its like into a new group just above its old one, more copies higher. At the end suffixes are
   grouped by their longest Lyndon prefix, and groups are in order.
2. From the sentinel upward, each placed suffix places its left neighbour and, along the pointers,
   those before, each at the front of what is left of its group. That is every group's order; nothing
   is renamed and nothing recurses.

Python runs that a symbol at a time far too slowly. Here many strings advance together: in one step
each takes its current highest group, and the groups of all are handled in the same array operations.
Every suffix is handled once as a member, as in the linear construction; the array operations sort the
targets of a step to count them and follow pointers one hop at a time, so the cost is linear but for
the logarithm of a step's size, and for hops in texts of one repeated symbol.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges(start, start + size)."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _grouped(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: each suffix's group (by the place where it begins) and its previous smaller suffix (-1: none)."""
    n, strings = len(symbols), np.diff(bounds)
    of = np.repeat(np.arange(len(strings)), strings)
    begin = bounds[of]
    key = of * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")  # suffixes by group
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    heads = np.flatnonzero(new)
    size = np.zeros(n, np.int64)  # of the group that begins at a place
    size[heads] = np.diff(np.append(heads, n))
    group = np.empty(n, np.int64)
    group[order] = heads[np.cumsum(new) - 1]
    previous = np.full(n, -1)
    moving = np.zeros(n, bool)
    tops = bounds[1:].copy()  # places from here on are done
    floors = bounds[:-1]
    while True:
        live = np.flatnonzero(tops > floors)
        if not len(live):
            return group, previous
        current = group[order[tops[live] - 1]]
        members = order[_ranges(current, tops[live] - current)]
        own = np.repeat(current, tops[live] - current)
        tops[live] = current
        # nearest to the left that isn't in a higher group; pointers of higher groups are known
        left = members - 1
        low = begin[members]
        at = np.flatnonzero(left >= low)
        at = at[group[left[at]] > own[at]]
        while len(at):
            left[at] = previous[left[at]]
            at = at[left[at] >= 0]
            at = at[group[left[at]] > own[at]]
        left[left < low] = -1
        previous[members] = left
        # a neighbour in the same group hands its own pointer on
        at = np.flatnonzero(left >= 0)
        at = at[group[left[at]] == own[at]]
        while len(at):
            to = previous[left[at]]
            left[at] = to
            previous[members[at]] = to
            at = at[to >= 0]
            at = at[group[left[at]] == own[at]]
        targets = left[left >= 0]
        if not len(targets):
            continue
        targets.sort()
        cut = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
        copies = np.diff(np.append(cut, len(targets)))
        targets = targets[cut]
        old = group[targets]
        by = np.lexsort((copies, old))
        targets, copies, old = targets[by], copies[by], old[by]
        first = np.concatenate([[True], old[1:] != old[:-1]])  # of an old group
        firsts = np.flatnonzero(first)
        movers = np.diff(np.append(firsts, len(old)))
        rest = size[old[firsts]] - movers
        spots = _ranges(old[firsts] + rest, movers)  # the upper end of each old group
        fresh = first | np.concatenate([[True], copies[1:] != copies[:-1]])
        fresh_at = np.flatnonzero(fresh)
        # what stands there and stays changes places with movers from below
        moving[targets] = True
        there = order[spots]
        stay = there[~moving[there]]
        moving[targets] = False
        gaps = place[targets]
        gaps = gaps[gaps < np.repeat(old[firsts] + rest, movers)]
        order[gaps] = stay
        place[stay] = gaps
        order[spots] = targets
        place[targets] = spots
        size[old[firsts]] = rest
        size[spots[fresh_at]] = np.diff(np.append(fresh_at, len(spots)))
        group[targets] = spots[fresh_at][np.cumsum(fresh) - 1]


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffixes of each string symbols[bounds[k] : bounds[k + 1]] in order, as places in ``symbols``.

    Every string must end with a symbol that is smaller than all its others and stands there only.
    """
    bounds = np.asarray(bounds, np.int64)
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    group, previous = _grouped(np.asarray(symbols, np.int64), bounds)
    free = np.arange(n)  # the next place of the group that begins here
    sorted_ = np.full(n, -1)
    done = np.zeros(n, bool)
    begins, lengths = bounds[:-1], np.diff(bounds)
    # longest first, so that the strings still running are a prefix
    by = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[by], lengths[by]
    last = begins + lengths - 1
    sorted_[begins] = last
    done[last] = True
    running = len(begins)
    for i in range(int(lengths[0])):
        while lengths[running - 1] <= i:
            running -= 1
        begin = begins[:running]
        j = sorted_[begin + i] - 1
        ok = j >= begin
        while True:
            j = j[ok]
            j = j[~done[j]]
            if not len(j):
                break
            g = group[j]
            spot = free[g]
            free[g] += 1
            sorted_[spot] = j
            done[j] = True
            j = previous[j]
            ok = j >= 0
    return sorted_
