"""Vectorised byte and word work on Arrow columns, for use inside tasks.

Texts are handled as UTF-8 bytes.  White space and A-Z are single bytes there, so
splitting and lower-casing bytes equals doing it on characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

C1 = np.uint64(0x9E3779B97F4A7C15)
C2 = np.uint64(0xBF58476D1CE4E5B9)
C3 = np.uint64(0x94D049BB133111EB)
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
LONG_WORD = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the input moves every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * C2
    h = (h ^ (h >> np.uint64(27))) * C3
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(offsets) * ~np.asarray(column.is_null())
        if lengths.sum() != offsets[-1] - offsets[0]:
            return buffers(column.fill_null(b"" if pa.types.is_binary(column.type) else ""))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` holds about ``most`` bytes, one row at least."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (rows + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    text = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = text[:-1]
    starts = np.flatnonzero(text & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = text[1:]
    ends = np.flatnonzero(text & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    size = (ends - starts).astype(np.int64)
    h = np.full(len(starts), C1, np.uint64) ^ size.astype(np.uint64)
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(live):
        left = size[live] - at
        v = lanes[starts[live] + at] & MASKS[np.minimum(left, 8)]
        h[live] = mix((h[live] + C1) ^ v * C3)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        d = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(d, np.uint64)[0]
    return h


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, in order (rows are cut by the caller)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = mix((out + C1) ^ h[j : j + n] * C2)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct ``k``-word shingles of each row; fewer words make one shingle."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = span_hashes(data, starts, ends)
    s = shingle_hashes(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            out.append(shingle_hashes(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + counts[i] - 1``, one run after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def binary_column(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())
