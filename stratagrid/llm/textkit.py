"""Vectorised text kernels on Arrow batches: byte classes, word spans, position-free word hashes.

Everything works on the UTF-8 bytes of whole texts; a chunk is a run of whole documents of about
``CHUNK`` bytes (a longer document is a chunk of its own), which bounds the working memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for a, b in ranges:
        lut[a : b + 1] = True
    return lut


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


LONG = 512  # bytes from which a span is hashed on its own


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes [start, end) of each span, wherever it stands.

    Eight bytes at a time go through a multiply-and-fold round that depends on all before them, so no
    regular text cancels out as it would in a sum over the bytes; long spans go to BLAKE2.
    """
    left = np.asarray(ends - starts, np.int64)
    h = mix(left.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    own = np.flatnonzero(left > LONG)
    if len(own):
        raw = data.tobytes()
        h[own] = [int.from_bytes(blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[own].tolist(), ends[own].tolist())]
    live = np.flatnonzero((left > 0) & (left <= LONG))
    at, left = starts[live], left[live]
    while len(live):
        v = lanes[at] & _TAIL[np.minimum(left, 8)]
        x = (h[live] ^ v) * _P
        x ^= x >> np.uint64(32)
        x *= _M1
        h[live] = x ^ (x >> np.uint64(29))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(h)


def text_buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1] if offs is not None and len(arr) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def chunks(arr: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents."""
    data, offs = text_buffers(arr)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of class bytes inside documents, and where each document's words begin in them."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = lut[data]
    a = m.copy()
    a[1:] &= ~m[:-1]
    b = m.copy()
    b[:-1] &= ~m[1:]
    edge = offs[:-1][offs[:-1] < n]
    a[edge] = m[edge]
    edge = offs[1:][offs[1:] > 0] - 1
    b[edge] = m[edge]
    starts = np.flatnonzero(a)
    ends = np.flatnonzero(b) + 1
    return starts, ends, np.searchsorted(starts, offs)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, by its first word; across documents too, so callers mask."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    h = words[:k].copy()
    for j in range(1, n):
        h *= _P
        h ^= h >> np.uint64(29)
        h += words[j : j + k]
    return mix(h)
