"""Vectorised scanning of whole texts inside Arrow batches.

A batch of texts is one UTF-8 buffer plus document offsets.  Words are maximal runs of bytes other than the ASCII white
space 0x20 and 0x09-0x0D.  Every word, line and window gets a 64-bit content hash from one prefix sum over the buffer,
so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, 1 << 16)
        _POW = np.concatenate([[_U(1)], np.cumprod(np.full(m - 1, _R, dtype=np.uint64))])
        _INV = np.concatenate([[_U(1)], np.cumprod(np.full(m - 1, _RINV, dtype=np.uint64))])
    return _POW, _INV


def forget_powers() -> None:
    """16 bytes for each byte of the longest buffer that was scanned."""
    global _POW, _INV
    _POW = _INV = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each piece holds about max_bytes of text (one longer text stands alone)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = text_buffer(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


class Scan:
    """Words of a batch of texts: starts, ends and hashes, with ptr[d]:ptr[d+1] the words of text d."""

    def __init__(self, texts: pa.Array, inside: np.ndarray | Callable | None = None, fold: np.ndarray | Callable | None = None):
        """inside: which byte values are part of words, instead of all but white space; fold: byte values to read instead.
        Each may be a table of 256 or a function of the buffer."""
        self.buf, self.off = text_buffer(texts)
        if fold is not None:
            self.raw = self.buf
            self.buf = fold(self.buf) if callable(fold) else fold[self.buf]
        n = len(self.buf)
        self.n_docs = len(self.off) - 1
        self.inside = ~SPACE[self.buf] if inside is None else inside(self.buf) if callable(inside) else inside[self.buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.off] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = self.inside[:-1]
        before &= ~edge[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = self.inside[1:]
        after &= ~edge[1:]
        self.starts = np.flatnonzero(self.inside & ~before)
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        self.ptr = np.searchsorted(self.starts, self.off)
        self._sum: np.ndarray | None = None
        self._hash: np.ndarray | None = None

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans."""
        up, down = _powers(len(self.buf) + 1)
        if self._sum is None:
            total = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=total[1:])
            self._sum = total
        return mix((self._sum[ends] - self._sum[starts]) * down[starts])

    @property
    def words(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.hash_spans(self.starts, self.ends)
        return self._hash

    @property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.ptr))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of k consecutive words of one text."""
        return windows(self.words, self.ptr, k)


def windows(words: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words that stays inside ptr[d]:ptr[d+1]."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h *= _U(0xD6E8FEB86659FD93)
        h += words[j : j + n]
    end = np.repeat(ptr[1:], np.diff(ptr))
    at = np.flatnonzero(np.arange(n) + k <= end[:n])
    return at, mix(h[at])


def per_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[d]:ptr[d+1]]."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def covered(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words stand in a window of k words that starts at one of `first`."""
    step = np.bincount(first, minlength=n + 1)
    end = np.minimum(first + k, n)
    step -= np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0
