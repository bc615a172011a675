"""Vectorised word scanning and hashing over Arrow string columns.

A *word* is a maximal run of bytes other than ASCII white space (tab, line
feed, vertical tab, form feed, carriage return, space). Nulls count as empty
texts. Everything here is numpy over the column's own buffer: no Python work
per word, so the cost is a few nanoseconds a byte whatever the vocabulary.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 5)
_WORD_BASE = U64(0xC2B2AE3D27D4EB4F)
#: glibc's; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = np.random.RandomState(20240607).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U64) | U64(1)

#: Texts are scanned in runs of about so many bytes; a longer text is a run of its own.
CHUNK_BYTES = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs get unrelated outputs."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """base**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i, or its inverse, for i below n."""
    return _BYTES.get(n)[int(inverse)]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about CHUNK_BYTES bytes together; each text is whole."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
    release()


def release() -> None:
    """Gives freed memory back to the system: a worker that is kept for later stages should hold little."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n + 1 offsets of each text's words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = np.ones(len(buf) + 1, dtype=bool)
    np.take(_SPACE, buf, out=gap[:-1])
    solid = ~gap[:-1]
    first = solid.copy()
    first[1:] &= gap[:-2]
    last = solid & gap[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    first[edges] |= solid[edges]
    last[edges - 1] |= solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, finalised."""
    if not len(start):
        return np.zeros(0, U64)
    up, down = _BYTES.get(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE_VALUE[buf] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width words that begin at each position of at."""
    up, down = _WORDS.get(len(hashes) + 1)
    total = np.empty(len(hashes) + 1, U64)
    total[0] = 0
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[at + width] - total[at]) * down[at])


def scan(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs [a, b) of texts: a, b, the hashes of their words, and b - a + 1 offsets into these."""
    buf, off = raw(texts)
    for a, b in chunks(off):
        part, local = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        start, end, word_off = words(part, local)
        yield a, b, word_hashes(part, start, end), word_off
