"""Suffix arrays by induced sorting, and permuted longest common prefixes, with numpy.

The scans of induced sorting are taken in blocks: the entries of a block whose suffixes would be placed inside the
block end it there, so every entry is in place when it is read, and a block costs a few vector operations. Text that
repeats itself makes chains of such entries, and tiny blocks; there the scan goes on entry by entry for a while.
"""

from __future__ import annotations

import numpy as np

STRIDE = 16
#: Entries under which a block is not worth its operations; entries then taken one by one at first.
LEAST_BLOCK, SINGLE = 128, 512


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successors (S-type); the last suffix, the sentinel, is one."""
    n = len(t)
    s = np.ones(n, dtype=bool)
    if n > 1:
        differs = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
        at = np.minimum.accumulate(differs[::-1])[::-1]  # the next position that differs from its successor
        s[:-1] = t[at] < t[np.minimum(at + 1, n - 1)]
    return s


def _scan(sa: np.ndarray, t: np.ndarray, take: np.ndarray, place: np.ndarray, way: int) -> None:
    """Induces, along sa (way 1: left to right, -1: right to left), the predecessors that take selects.

    place: the next free slot of each bucket, moved on by way.
    """
    n, at, size, single = len(sa), 0, 1024, 0
    view = sa[::way]
    entries, letters, takes, free = memoryview(sa), memoryview(t), memoryview(take), memoryview(place)
    while at < n:
        if single:
            stop = min(n, at + single)
            for i in range(at, stop) if way == 1 else range(n - 1 - at, n - 1 - stop, -1):
                j = entries[i] - 1
                if j >= 0 and takes[j]:
                    c = letters[j]
                    slot = free[c]
                    entries[slot] = j
                    free[c] = slot + way
            at = stop
        block = view[at : at + size]
        idx = np.flatnonzero(block > 0)
        j = block[idx] - 1
        on = take[j]
        idx, j = idx[on], j[on]
        done = len(block)
        if len(j):
            c = t[j]
            order = np.argsort(c, kind="stable")
            c, j, idx = c[order], j[order], idx[order]
            head = np.concatenate(([True], c[1:] != c[:-1]))
            starts = np.flatnonzero(head)
            rank = np.arange(len(c)) - starts[np.cumsum(head) - 1]
            slot = place[c] + way * rank
            seen = slot if way == 1 else n - 1 - slot  # where the scan meets the slot
            first = int(seen.min()) - at
            if first < done:
                done = first
                on = idx < done
                c, j, slot = c[on], j[on], slot[on]
            sa[slot] = j
            place[c] = slot + way  # of equal characters the last, which is the furthest, stays
        at += done
        single = 0 if done == len(block) or done >= LEAST_BLOCK else min(4 * single or SINGLE, 64 * SINGLE)
        size = min(2 * size, 1 << 15) if done == len(block) else max(LEAST_BLOCK, 2 * done)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """All suffixes from the given order of the leftmost S-types."""
    sa = np.full(len(t), -1, dtype=np.int32)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    c = c[order]
    last = np.searchsorted(c, c, side="right")
    sa[tails[c] - (last - 1 - np.arange(len(c)))] = lms[order]
    _scan(sa, t, ~s, heads.copy(), 1)
    sa[1:][s[sa[1:]]] = -1  # S-types but the sentinel come anew (an empty slot reads the sentinel's type)
    _scan(sa, t, s, tails.copy(), -1)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: non-negative integers; the last one, 0, occurs only there. Of 16 bits, t is sorted by radix."""
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    s = classify(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    size = np.bincount(t)
    tails = np.cumsum(size) - 1
    heads = tails - size + 1
    if len(lms) > 1:
        sa = _induce(t, s, lms, heads, tails)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        length = np.empty(n, dtype=np.int32)
        length[lms[:-1]], length[lms[-1]] = lms[1:] - lms[:-1] + 1, 1
        # Neighbours in this order with equal substrings get equal names.
        a, b = ordered[:-1], ordered[1:]
        same = length[a] == length[b]
        for d in range(int(length[b[same]].max()) if same.any() else 0):
            at = np.flatnonzero(same & (length[b] > d))
            if not len(at):
                break
            same[at] = t[a[at] + d] == t[b[at] + d]
        names = np.concatenate(([0], np.cumsum(~same))).astype(np.int32)
        by_place = np.empty(n, dtype=np.int32)
        by_place[ordered] = names
        reduced = by_place[lms]
        lms = lms[np.argsort(reduced) if names[-1] == len(lms) - 1 else suffix_array(reduced)]
    return _induce(t, s, lms, heads, tails)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For every position, the characters (at most `most`) it shares with its predecessor in sa.

    A position whose left neighbour equals that of its predecessor shares one character less than the position
    before it, so only the others, the irreducible ones, are compared.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n, dtype=np.int32)
    lone = (place == 0) | (before <= 0)
    lone |= t[place - 1] != t[np.maximum(before - 1, 0)]
    at = np.flatnonzero(lone & (before >= 0))
    exact = np.zeros(n, dtype=np.int32)
    # Positions up to the next irreducible one subtract from the value found here, so that many more count.
    irreducible = np.flatnonzero(lone)
    reach = np.zeros(n, dtype=np.int64)
    reach[irreducible] = np.diff(np.append(irreducible, n)) + most
    padded = np.concatenate([t.astype(np.int32), np.arange(-1, -1 - STRIDE, -1, dtype=np.int32)])
    live, d = at, 0
    while len(live):
        x, y = live + d, before[live] + d
        eq = padded[np.minimum(x, n)[:, None] + np.arange(STRIDE)] == padded[np.minimum(y, n)[:, None] + np.arange(STRIDE)]
        many = np.where(eq.all(axis=1), STRIDE, eq.argmin(axis=1))
        exact[live] += many
        live = live[(many == STRIDE) & (d + STRIDE < reach[live])]
        d += STRIDE
    source = np.maximum.accumulate(np.where(lone, place, 0))
    return np.minimum(np.maximum(exact[source] - (place - source), 0), most)
