"""Words of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D (UTF-8 never uses those
bytes inside a longer character); A-Z is lower-cased.  The work goes slice by slice, so
the memory beyond the batch itself is bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK = (1 << 64) - 1
SLICE = 1 << 20  # bytes hashed at once


def splitmix(x: int) -> int:
    """The splitmix64 output for state ``x`` (a public-domain 64-bit mixer)."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """:func:`splitmix` for an array of uint64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0]:o[-1]], o - o[0]


def doc_slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges of at most ``limit`` bytes (or one document)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class WordHasher:
    """Polynomial word hashes by one running sum over the bytes.  Built inside a task."""

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        lower = np.arange(256)
        lower[65:91] += 32
        self.code = np.array([splitmix(int(c) + 1) for c in lower], U64)
        self.base = splitmix(0xC0FFEE) | 1
        self._powers(SLICE)

    def _powers(self, n: int) -> None:
        def table(r: int) -> np.ndarray:
            t = np.full(n + 1, r, U64)
            t[0] = 1
            return np.multiply.accumulate(t)
        self.size, self.up, self.down = n, table(self.base), table(pow(self.base, -1, 1 << 64))

    def bounds(self, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of ``b``; no word crosses a position in ``cuts``."""
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = ~self.space[b]
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        c = cuts[(cuts > 0) & (cuts < len(b))]
        first[c] = inside[1:-1][c]
        last[c - 1] = inside[1:-1][c - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, i, n = np.empty(len(starts), U64), 0, len(starts)
        while i < n:
            j = max(int(np.searchsorted(ends, starts[i] + SLICE, side="right")), i + 1)
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo > self.size:
                self._powers(hi - lo)
            run = np.zeros(hi - lo + 1, U64)
            np.cumsum(self.code[b[lo:hi]] * self.up[:hi - lo], out=run[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (run[e] - run[s]) * self.down[s] + (e - s).astype(U64)
            i = j
        return mix(out)

    def documents(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For slices of a batch: (first document, end document, word hashes, word offsets)."""
        data, off = text_buffers(col)
        for i, j in doc_slices(off):
            b, cuts = data[off[i]:off[j]], off[i:j + 1] - off[i]
            starts, ends = self.bounds(b, cuts)
            yield i, j, self.hashes(b, starts, ends), np.searchsorted(starts, cuts)


def shingles(h: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per document, the sorted distinct hashes of its ``size``-word shingles; a shorter
    document has its whole sequence as one, an empty one none."""
    s = h[:max(len(h) - size + 1, 0)].copy()
    for k in range(1, size):
        s = mix(s) + h[k:k + len(s)]
    s = mix(s)
    for a, e in zip(off[:-1].tolist(), off[1:].tolist()):
        if e - a >= size:
            x = np.sort(s[a:e - size + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif e > a:
            v = 0
            for w in h[a:e].tolist():
                v = (splitmix(v) + w) & MASK
            yield np.array([splitmix(v ^ (e - a))], U64)
        else:
            yield s[:0]
