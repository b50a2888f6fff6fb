"""Words and shingles of many texts at once, as numpy arrays over the texts' UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 2 << 20


def _class(is_word) -> np.ndarray:
    return np.array([bool(is_word(i)) for i in range(256)])


#: Bytes of a word. Bytes from 0x80 belong to characters outside ASCII, which are word characters in both.
NOT_SPACE = _class(lambda i: i not in (0x20, *range(0x09, 0x0E)))
ALNUM = _class(lambda i: 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80)
LOWER = np.array([i + 32 if 0x41 <= i <= 0x5A else i for i in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; one-to-one."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def give_back() -> None:
    """What was allocated and is free again goes back to the system, as workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes a task's batches on and gives its memory back when it ends."""
    try:
        yield from batches
    finally:
        give_back()


def portions(batch: pa.RecordBatch, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about max_bytes of text, in order; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + max_bytes, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, SLICE_BYTES + (1 << 16))
            inverse = pow(BASE, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(m, b, U)])) for b in (BASE, inverse))
        return self.up, self.down


_powers = _Powers()


def slices(texts: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in slices of about max_bytes; a longer text is a slice of its own. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, first byte, end byte and hash of each word, index of each text's first word)."""
    low = LOWER[data]
    inside = is_word[low]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return low, none, none, none.astype(U), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] > 0)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))
    return low, starts, ends, hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, by the index of its first word."""
    if len(hashes) < width:
        return np.zeros(0, U)
    out = np.zeros(len(hashes) - width + 1, U)
    for k in range(width):
        out = (out ^ hashes[k : len(hashes) - width + 1 + k]) * U(0xC2B2AE3D27D4EB4F)
        out ^= out >> U(29)
    return mix(out + U(width))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; with fewer words the whole sequence is one shingle; none without words."""
    for lo, hi, data, offsets in slices(texts):
        _, _, _, hashes, first = words(data, offsets, NOT_SPACE)
        wide = windows(hashes, width)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                s = np.sort(wide[a : b - width + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield windows(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, U)
