"""Suffix arrays by induced sorting, and common prefixes in text order."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last suffix is not."""
    n = len(s)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(np.diff(s))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(s: list[int], small: bytes, lms: list[int], starts: list[int], ends: list[int]) -> list[int]:
    """All suffixes in order, given the order of the leftmost-smaller ones: each is put before or behind the one that
    follows it in the text, in one sweep up (larger ones) and one sweep down (smaller ones)."""
    n = len(s)
    sa, tail, head = [-1] * n, ends.copy(), starts.copy()
    for p in reversed(lms):
        c = s[p]
        tail[c] -= 1
        sa[tail[c]] = p
    c = s[n - 1]
    sa[head[c]] = n - 1
    head[c] += 1
    for p in sa:
        if p > 0 and not small[p - 1]:
            p -= 1
            c = s[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends
    for i in range(n - 1, -1, -1):
        p = sa[i]
        if p > 0 and small[p - 1]:
            p -= 1
            c = s[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return sa


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a sequence of small non-negative integers, in order; linear time."""
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    if n < 2:
        return np.arange(n)
    kind = _types(values)
    counts = np.bincount(values)
    ends = np.cumsum(counts)
    starts, ends = (ends - counts).tolist(), ends.tolist()
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    s, small = values.tolist(), kind.tobytes()
    sa = _induce(s, small, lms.tolist(), starts, ends.copy())
    if len(lms) < 2:
        return np.array(sa)
    # name the substrings between leftmost-smaller positions in their sorted order
    place = np.full(n + 1, -1)
    place[lms] = np.arange(len(lms))
    order = np.array(sa)
    order = order[place[order] >= 0]
    stop = np.append(lms[1:], n - 1) + 1
    until = dict(zip(lms.tolist(), stop.tolist()))
    names, name, before = np.zeros(len(lms), dtype=np.int64), 0, None
    listed = order.tolist()
    fresh = np.zeros(len(listed), dtype=np.int64)
    for k, p in enumerate(listed):
        piece = s[p : until[p]]
        if piece != before:
            fresh[k] = 1
            before = piece
    names[place[order]] = np.cumsum(fresh) - 1
    name = int(fresh.sum())
    if name < len(lms):
        order = lms[suffix_array(names)]
    else:
        order = lms[np.argsort(names)]
    return np.array(_induce(s, small, order.tolist(), starts, ends))


def long_common_prefixes(data: np.ndarray, gap: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For every position in text order: does its suffix share `length` bytes with the one before it in the array?

    The permuted common prefixes, cut at `length`: eight bytes are compared at a time, and only for positions that
    agreed so far. `gap` marks separators, which are never common.
    """
    n = len(data)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + length + 8, dtype=np.uint8)
    padded[:n] = data
    packed = np.zeros(n + length, dtype=np.uint64)
    for k in range(8):
        packed |= padded[k : k + n + length].astype(np.uint64) << np.uint64(8 * k)
    gaps = np.zeros(n + length + 1, dtype=np.int64)
    np.cumsum(np.append(gap, np.ones(length, bool)), out=gaps[1:])
    whole = gaps[length : n + length] == gaps[:n]
    alive = np.flatnonzero((before >= 0) & whole)
    alive = alive[whole[before[alive]]]
    for k in [*range(0, length - 7, 8), *([max(0, length - 8)] if length % 8 else [])]:
        alive = alive[packed[alive + k] == packed[before[alive] + k]]
    out = np.zeros(n, dtype=bool)
    out[alive] = True
    return out
