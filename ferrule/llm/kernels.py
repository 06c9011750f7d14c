"""Vectorised byte kernels over Arrow string columns: word spans and their 64-bit hashes.

A span's hash is the sum of its bytes, each mixed together with its place in the span to 64 bits, mixed again with the length. No two strings collide by
the form of the sum, and hashing costs a few operations a byte and none a word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the 64-bit murmur hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_FAR = 64


def _placed(key: np.ndarray) -> np.ndarray:
    return mix(key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))


_NEAR = _placed(np.arange(_FAR << 8))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every data[start:end]."""
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    key = (place << 8) | data[place + np.repeat(starts, size)]
    each = _NEAR[key] if not len(size) or size.max() <= _FAR else _placed(key)
    total = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        total[some] = np.add.reduceat(each, first[some])
    return mix(total + size.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and the offsets of each; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text and `rows` rows at most (a longer text makes a part of its own)."""
    column = batch.column(text)
    sizes = np.frombuffer(column.cast(pa.large_string()).fill_null("").buffers()[1], np.int64)
    ends = sizes[1 : len(column) + 1] - sizes[0]
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every run of bytes other than `space` ([\\x20\\x09-\\x0D]), which no text's end crosses."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = inner[inner > 0]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def terms(column: pa.Array, space: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Every run of bytes other than `space` as a string, A-Z lower-cased, in order, and its row."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, row = words(data, offsets, space)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[~space[data]])), row


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in order; A-Z are lower-cased if asked."""
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    starts, ends, row = words(data, offsets)
    return span_hashes(data, starts, ends), row


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every row's word runs of `width` (fewer words: the whole run as one), sorted, and the bounds of each row's."""
    counts = np.bincount(row, minlength=rows)
    h = np.zeros(0, np.uint64)
    r = np.zeros(0, np.int64)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        same = row[:n] == row[width - 1 :]
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total = mix(total + hashes[k : k + n] * np.uint64(2 * k + 3))
        h, r = total[same], row[:n][same]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))
        more = []
        for i in short:
            total = np.full(1, 0x5851F42D4C957F2D, np.uint64)
            for x in hashes[first[i] : first[i + 1]]:
                total = mix(total * np.uint64(31) + x)
            more.append(total[0])
        h, r = np.concatenate((h, np.array(more, np.uint64))), np.concatenate((r, short))
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(rows + 1))
