"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes are classified as smaller or larger than their right neighbour; the
substrings between leftmost smaller suffixes are sorted by induction and named;
the string of names is sorted recursively; all suffixes are induced from it.
Over bytes, induction takes one bucket at a time as a whole array; over the
larger alphabets of names it goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Suffixes per symbol from which induction takes whole buckets.
DENSE = 64


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last symbol must be a unique least one."""
    n = len(t)
    differs = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    at = np.repeat(differs, np.diff(np.append(-1, differs)))
    smaller = np.ones(n, bool)
    inside = at < n - 1
    smaller[inside] = t[at[inside]] < t[at[inside] + 1]
    return smaller


def _deal(sa: np.ndarray, free: np.ndarray, items: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Put ``items`` in order at the free places of their symbols' buckets; ``step``: 1 upwards, -1 downwards."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    counts = np.diff(np.append(starts, len(s)))
    rank = np.arange(len(s)) - np.repeat(starts, counts)
    sa[free[s] + step * rank] = items[order]
    free[s[starts]] += step * counts


def _induce_dense(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    larger_counts = np.bincount(t[~smaller], minlength=size)
    sa = np.full(n, -1, np.int64)
    # Leftmost smaller suffixes at the ends of their buckets, in the order given.
    free = ends - 1
    _deal(sa, free, lms[::-1], t[lms[::-1]], -1)
    lms_from = free + 1
    head = starts.copy()
    for c in range(size):
        if not counts[c]:
            continue
        done = starts[c]
        while done < head[c]:
            now = sa[done : head[c]]
            done = head[c]
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _deal(sa, head, before, t[before], 1)
        now = sa[lms_from[c] : ends[c]]
        before = now[now > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            _deal(sa, head, before, t[before], 1)
    tail = ends - 1
    for c in range(size - 1, -1, -1):
        if not counts[c]:
            continue
        done = ends[c]
        while done - 1 > tail[c]:
            now = sa[tail[c] + 1 : done][::-1]
            done = tail[c] + 1
            before = now[now > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _deal(sa, tail, before, t[before], -1)
        now = sa[starts[c] : starts[c] + larger_counts[c]][::-1]
        before = now[now > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _deal(sa, tail, before, t[before], -1)
    # The last suffix, a symbol of its own, has no place that induction gives it.
    sa[0] = n - 1
    return sa


def _induce_sparse(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    text, small = t.tolist(), smaller.tolist()
    sa = [-1] * n
    free = (ends - 1).tolist()
    for j in lms[::-1].tolist():
        c = text[j]
        sa[free[c]] = j
        free[c] -= 1
    head = (ends - counts).tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = (ends - 1).tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = text[j]
            sa[tail[c]] = j
            tail[c] -= 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether t[a:a+length] equals t[b:b+length], for each pair."""
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    k = 0
    while len(live):
        live = live[lengths[live] > k]
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
    return same


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of ``t`` (integers below ``size``), whose last symbol must be a unique 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = classify(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_dense if n >= DENSE * size else _induce_sparse
    sa = induce(t, smaller, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    lengths = np.append(np.diff(lms) + 1, 1)
    k = number[ordered]
    same = np.zeros(len(ordered), bool)
    pair = lengths[k[1:]] == lengths[k[:-1]]
    same[1:][pair] = _same(t, ordered[1:][pair], ordered[:-1][pair], lengths[k[1:]][pair])
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(lms):
        reduced = np.zeros(len(lms), np.int64)
        reduced[k] = names
        ordered = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(t, smaller, ordered, size)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position the common prefix, up to ``most`` bytes, with the suffix that precedes it in order.

    Permuted: the result is in text order. Eight bytes are compared at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.uint8), np.zeros(most + 8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(np.uint64).ravel()
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(0, most, 8):
        a, b = words[live + k], words[before[live] + k]
        equal = a == b
        other = live[~equal]
        x = a[~equal] ^ b[~equal]
        low = x & (~x + np.uint64(1))
        out[other] = k + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        live = live[equal]
    out[live] = most
    return np.minimum(out, most)
