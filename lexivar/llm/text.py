"""Vectorised words, shingles and code points of Arrow text columns (bytes in, NumPy arrays out).

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits: a polynomial over the
word's bytes, taken from prefix sums, then finished with an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = 0xD6E8FEB86659FD93
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `limit` bytes of text (one document at least): slice, bytes, offsets. Null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        if col.null_count:
            col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
        col = col.cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the index of each document's first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(((_LOWER[data] if lower else data).astype(_U) + _U(1)) * up[:n], out=sums[1:])
    hashed = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(_SHINGLE))
    return hashed, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashed: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles and the index of each document's first (one more at the end).

    A document of one to k - 1 words has one shingle, its whole word sequence; one without words has none.
    """
    counts = np.diff(bounds)
    out = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.zeros(len(bounds), np.int64)
    np.cumsum(out, out=to[1:])
    if not len(hashed):
        return np.zeros(0, _U), to
    m = len(hashed)
    rolled, factor = np.zeros(m, _U), 1
    for j in range(k):
        rolled[: m - j] += hashed[j:] * _U(factor)
        factor = factor * _SHINGLE % (1 << 64)
    doc = np.repeat(np.arange(len(counts)), out)
    pos = bounds[:-1][doc] + np.arange(to[-1]) - to[:-1][doc]
    result = rolled[pos]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        value, factor = int(counts[d]), 1
        for h in hashed[bounds[d] : bounds[d + 1]]:
            value, factor = (value + int(h) * factor) % (1 << 64), factor * _SHINGLE % (1 << 64)
        result[to[d]] = value
    return mix(result), to


def distinct_per_doc(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values, sorted and distinct, with new bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    to = np.zeros(len(bounds), np.int64)
    np.cumsum(np.bincount(d[keep], minlength=len(bounds) - 1), out=to[1:])
    return v[keep], to


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the bytes and each document's first (one more at the end)."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(cps) != lead[-1]:  # bytes that are not UTF-8: decode each document by itself
        each = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
        return (np.concatenate(each) if each else cps), np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return cps, lead[offsets]
