"""NumPy views of Arrow text batches: bytes, lines, words and their hashes, without a Python loop over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; keeps the working arrays of a task at about 20 MB.
SLICE_BYTES = 1 << 18
#: An odd 64-bit multiplier, its inverse modulo 2**64, and the constants of a 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = {BASE: np.ones(1, dtype=U64), INVERSE: np.ones(1, dtype=U64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers[base]
    if len(have) < n:
        size = max(n, 2 * len(have), SLICE_BYTES)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 16 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(30))
    h = h * MIX[0]
    h ^= h >> U64(27)
    h *= MIX[1]
    h ^= h >> U64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which `span_hash` reads the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for every pair; equal content gives equal values wherever it lies."""
    inverse = powers(INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes, one row at least."""
    data, offs = text_buffers(column)
    at = 0
    while at < len(offs) - 1:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(offs) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def runs(flag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run ends with its row."""
    before = np.zeros(len(flag) + 1, dtype=bool)
    before[1:] = flag
    before[offs] = False
    after = np.zeros(len(flag) + 1, dtype=bool)
    after[:-1] = flag
    after[offs] = False
    start = np.flatnonzero(flag & ~before[:-1])
    return start, np.flatnonzero(flag & ~after[1:]) + 1


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in the row, start and end of every \\n-split line that holds a word."""
    breaks = np.flatnonzero(data == 10)
    n = len(offs) - 1
    counts = np.diff(np.searchsorted(breaks, offs)) + 1
    row = np.repeat(np.arange(n), counts)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    end = np.append(start[1:] - 1, len(data))
    last = np.cumsum(counts) - 1
    end[last] = offs[1:]
    number = np.arange(len(row)) - np.repeat(last - counts + 1, counts)
    solid = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    worded = solid[end] > solid[start]
    return row[worded], number[worded], start[worded], end[worded]


def per_row(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall into each row."""
    return np.diff(np.searchsorted(positions, offs))


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of per-byte values by row."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def characters(data: np.ndarray) -> np.ndarray:
    """True for every byte that begins a code point."""
    return (data & 0xC0) != 0x80


def words(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and length in bytes of every word (`[^\\x20\\x09-\\x0D]+`), in order."""
    start, end = runs(~SPACE[data], offs)
    hashes = span_hash(prefix_sums(LOWER[data] if lower else data), start, end)
    rows = np.repeat(np.arange(len(offs) - 1), per_row(start, offs))
    return rows, hashes, end - start


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every window of n consecutive words of one row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    last = len(hashes) - n + 1
    out = hashes[:last].copy()
    for k in range(1, n):
        out *= U64(BASE)
        out += hashes[k : last + k]
    keep = np.flatnonzero(rows[:last] == rows[n - 1 :])
    return keep, mix(out[keep])


def repeated(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, value) pairs: is the pair found twice or more, and did it occur before (in order)?"""
    if not len(values):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((np.arange(len(values)), values, rows))
    r, v = rows[order], values[order]
    same = np.zeros(len(v) + 1, dtype=bool)
    same[1:-1] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    twice, later = np.empty(len(v), bool), np.empty(len(v), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later
