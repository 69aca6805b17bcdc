"""Vectorised hashing of words and word shingles over Arrow string columns.

A chunk of texts is one byte buffer. Words are found with table look-ups and hashed
eight bytes at a time, each block mixed into what came before it, so no Python code
runs per word; only spans of more than SHORT bytes are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_MULT = _RNG.integers(1, 2**64, 64, dtype=U) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK_BYTES = 1 << 19
#: Spans of at most so many bytes are hashed all at once.
SHORT = 64
_REST = U(0xFFFFFFFFFFFFFFFF) >> np.arange(64, -1, -8).clip(0, 63).astype(U)
_REST[0] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works in place on uint64 arrays."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offsets per row). Words are runs without ASCII white space."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    if lower:
        data = LOWER[data]
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return hash_spans(data, starts, ends), np.searchsorted(starts, off)


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word shingle, offsets per row); a row of 1 to k-1 words has its whole sequence as one."""
    counts = np.diff(woff)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    soff = np.concatenate([[0], np.cumsum(n)])
    if not soff[-1]:
        return np.zeros(0, U), soff
    at = np.repeat(woff[:-1] - soff[:-1], n) + np.arange(soff[-1])
    padded = np.concatenate([h, np.zeros(k, U)])
    out = padded[at] * _MULT[0]
    for j in range(1, k):
        out += padded[at + j] * _MULT[j]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = h[woff[d] : woff[d + 1]]
        out[soff[d]] = np.sum(np.append(own, U(len(own))) * np.append(_MULT[: len(own)], _MULT[62]), dtype=U)
    return mix(out), soff


def distinct(sh: np.ndarray, soff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, with their offsets."""
    parts = [np.unique(sh[a:b]) for a, b in zip(soff[:-1], soff[1:], strict=True)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else sh), off


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over the segments between offsets; 0 for empty ones."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def list_array(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    size = ends - starts
    h = size.astype(U) * _MULT[63]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    which, long = None, size > SHORT
    for block in range(SHORT // 8):
        which = np.flatnonzero(~long & (size > 0)) if which is None else which[size[which] > 8 * block]
        if not len(which):
            break
        part = at_byte[starts[which] + 8 * block]
        part &= _REST[np.minimum(size[which] - 8 * block, 8)]
        part ^= h[which]
        h[which] = mix(part * _MULT[62 - block])
    for i in np.flatnonzero(long).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return mix(h)


def hash_runs(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes from one start to the next (the last to the end)."""
    return hash_spans(data, starts, np.append(starts[1:], len(data)))


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + count] for each pair."""
    off = np.cumsum(count)
    total = int(off[-1]) if len(off) else 0
    return flat[np.repeat(start - (off - count), count) + np.arange(total)]
