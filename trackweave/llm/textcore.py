"""Vectorised text primitives over Arrow string arrays: bytes, words, lines and their 64-bit hashes.

A batch is cut into slices of about SLICE_BYTES, always between documents, so memory follows the longest
document and not the batch.

Hashes are chains of a bijective mixer over 8-byte chunks, XXH3 for long spans, and windows are hashed by pairing the
hashes of their halves. None of them is linear in the text, so periodic and self-similar texts are as safe as others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 19
U = np.uint64
_FACTOR, _SPREAD = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Of the low 0..8 bytes of a chunk.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Spans of more bytes are hashed one by one, in C.
LONG_SPAN = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offs, body = texts.buffers()
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def lut(*members: int | range) -> np.ndarray:
    table = np.zeros(256, bool)
    for m in members:
        table[list(m) if isinstance(m, range) else m] = True
    return table


#: Words are runs of bytes other than space and 0x09-0x0D.
SPACE = lut(0x20, range(0x09, 0x0E))
#: ASCII letters to lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that cross no document, and each document's first run (n + 1 values)."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    return runs(~space[data], offsets)


def chunks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on (zeros after the end) as one integer."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; spans of one size up to 8 never collide. Other seeds give independent ones."""
    size = ends - starts
    at = chunks(data)
    h = mix(size.astype(U) * _SPREAD + U(seed))
    h = mix(h ^ (at[starts] & _MASKS[np.minimum(size, 8)])) if len(size) else h
    rest, done = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(rest):
        h[rest] = mix(h[rest] ^ (at[starts[rest] + done] & _MASKS[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        body, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        h[long] = np.fromiter((digest(body[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), U, len(long))
    return h


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _FACTOR + b
    h ^= h >> U(32)
    h *= _SPREAD
    h ^= h >> U(29)
    return h


def _doubled(level: np.ndarray, width: int, size: int) -> np.ndarray:
    """level[i] stands for `width` items from i on; the same for `size` items, by halves that may overlap."""
    while 2 * width <= size:
        level = _pair(level[:-width], level[width:])
        width *= 2
    return _pair(level[: len(level) - (size - width)], level[size - width :]) if size > width else level


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive item hashes (len(h) - size + 1 values, across documents too)."""
    return _doubled(h, 1, size) if len(h) >= size else np.zeros(0, U)


def byte_windows(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each `size` consecutive bytes."""
    if len(data) < size:
        return np.zeros(0, U)
    if size < 8:
        return _doubled(mix(data.astype(U) + U(seed)), 1, size)
    return _doubled(mix(chunks(data)[: len(data) - 7] + U(seed)), 8, size)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the items' first positions by document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur at least twice, and does it occur earlier."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(n + 1, bool)
    same[1:n] = k[1:] == k[:-1]
    twice, again = np.zeros(n, bool), np.zeros(n, bool)
    twice[order] = same[:n] | same[1:]
    again[order] = same[:n]
    return twice, again


def cover(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """True at the positions below n that some [start, start + length) covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:n]) > 0
