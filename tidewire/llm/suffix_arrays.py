"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

An induction scans the array from one end and writes each suffix's predecessor into its bucket. What lies before the first slot still empty depends on nothing that the scan has yet to
write, so that this whole stretch is taken in one numpy call; with m symbols such stretches hold about the square root of m entries or more.
"""

from __future__ import annotations

import numpy as np


def _classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour; the last one, the sentinel, counts as smaller."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    decides = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    small = np.ones(n, bool)
    inside = decides < n - 1
    small[:-1][inside] = step[decides[inside]] > 0
    return small


def _ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each entry among equal ones of a sorted array that isn't empty; first entry and length of each run. Called for every stretch, hence without numpy's slower helpers."""
    n = len(symbols)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    first = new.nonzero()[0]
    length = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=length[:-1])
    length[-1] = n - first[-1]
    return np.arange(n) - first.repeat(length), first, length


def _next_open(fill: np.ndarray, need: np.ndarray, at: int) -> int:
    """The first bucket from ``at`` on that still lacks entries, or their number."""
    width = 64
    while at < len(fill):
        found = (fill[at : at + width] < need[at : at + width]).nonzero()[0]
        if len(found):
            return at + int(found[0])
        at += width
        width *= 4
    return len(fill)


def _induce(text: np.ndarray, small: np.ndarray, counts: tuple[np.ndarray, np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """The suffix array that follows from leftmost-smaller suffixes in the order of ``seeds``."""
    n = len(text)
    of_large, of_small = counts
    end = np.cumsum(of_large + of_small)
    begin = end - of_large - of_small
    order = np.full(n, -1, np.int32)
    symbols = text[seeds]
    rank, first, length = _ranks(symbols)  # seeds of a bucket stand together
    order[end[symbols] - np.repeat(length, length) + rank] = seeds
    fill = np.zeros(len(end), np.int64)
    at = bucket = 0
    while at < n:
        bucket = _next_open(fill, of_large, bucket)
        stop = int(begin[bucket] + fill[bucket]) if bucket < len(fill) else n
        here = order[at:stop]
        before = here[here > 0] - 1
        before = before[~small[before]]
        at = stop
        if len(before):
            symbols = text[before]
            by = np.argsort(symbols, kind="stable")
            symbols = symbols[by]
            rank, first, length = _ranks(symbols)
            order[begin[symbols] + fill[symbols] + rank] = before[by]
            fill[symbols[first]] += length
    inner = np.repeat(begin + of_large, of_small)  # the slots of smaller suffixes are filled anew
    order[inner + np.arange(len(inner)) - np.repeat(np.cumsum(of_small) - of_small, of_small)] = -1
    order[0] = n - 1
    fill = np.zeros(len(end), np.int64)
    fill[text[n - 1]] = 1
    back, need = fill[::-1], of_small[::-1]  # buckets from the last to the first
    at, bucket = n, 0
    while at > 0:
        bucket = _next_open(back, need, bucket)
        stop = int(end[len(end) - 1 - bucket] - back[bucket]) if bucket < len(back) else 0
        here = order[stop:at][::-1]
        before = here[here > 0] - 1
        before = before[small[before]]
        at = stop
        if len(before):
            symbols = text[before]
            by = np.argsort(symbols, kind="stable")
            symbols = symbols[by]
            rank, first, length = _ranks(symbols)
            order[end[symbols] - 1 - fill[symbols] - rank] = before[by]
            fill[symbols[first]] += length
    return order


def _names(text: np.ndarray, small: np.ndarray, marks: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Numbers of the substrings from one leftmost-smaller place to the next, which ``by`` lists in order: equal ones share a number."""
    nearest = np.zeros(len(text), np.int32)
    nearest[marks[:-1]] = np.diff(marks) + 1
    nearest[marks[-1]] = 1
    length = nearest[by]
    new = np.ones(len(by), bool)
    pair = np.flatnonzero(length[1:] == length[:-1])
    left = by[pair], by[pair + 1], length[pair]
    for k in range(int(length.max())):
        a, b, m = left
        if not len(pair):
            break
        over = m == k
        new[pair[over] + 1] = False
        stay = ~over
        stay[stay] = (text[a[stay] + k] == text[b[stay] + k]) & (small[a[stay] + k] == small[b[stay] + k])
        pair, left = pair[stay], (a[stay], b[stay], m[stay])
    new[pair[left[2] == int(length.max())] + 1] = False
    return np.cumsum(new) - 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``text`` in ascending order; its last symbol must be smaller than all others, and symbols be small numbers from 0 on."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _classify(text)
    size = int(text.max()) + 1
    total, of_small = np.bincount(text, minlength=size), np.bincount(text[small], minlength=size)
    counts = total - of_small, of_small
    marks = np.flatnonzero(small & np.r_[False, ~small[:-1]]).astype(np.int32)
    order = _induce(text, small, counts, marks[np.argsort(text[marks], kind="stable")])
    if len(marks) <= 1:
        return order
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    by = order[is_mark[order]]
    names = _names(text, small, marks, by)
    if names[-1] + 1 < len(marks):  # some are equal: their order is that of the string of names
        place = np.empty(n, np.int32)
        place[by] = names
        by = marks[suffix_array(place[marks])]
    return _induce(text, small, counts, by)


def common_prefixes(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(permuted common prefixes, predecessor) of each suffix of the bytes ``data`` in text order; ``order`` is their suffix array, without the sentinel.

    A value is the one to its left, less one, where the bytes before the suffix and before its predecessor agree; only the others are found by comparison, eight bytes at a time.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    left = np.r_[0, data[:-1]]
    own = (before <= 0) | (np.arange(n) == 0)
    own |= left != data[np.where(before > 0, before, 1) - 1]
    at = np.flatnonzero(own & (before >= 0))
    padded = np.r_[data, np.zeros(16, np.uint8)]
    words = np.ndarray((n + 8,), "<u8", padded, strides=(1,)).copy()
    found = np.zeros(n, np.int64)
    a, b = at, before[at]
    k = 0
    while len(a):
        stay = np.maximum(a, b) + k + 8 <= n
        x = words[np.minimum(a + k, n)] ^ words[np.minimum(b + k, n)]
        go = stay & (x == 0)
        done = ~go
        # bytes that agree below the lowest bit that differs
        low = x[done] & (~x[done] + np.uint64(1))
        same = np.where(x[done] == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        found[a[done]] = k + np.minimum(same, n - np.maximum(a[done], b[done]) - k)
        a, b = a[go], b[go]
        k += 8
    reach = np.where(own, found + np.arange(n), 0)
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0), before
