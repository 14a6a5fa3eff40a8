"""Vectorised word handling over Arrow string batches.

A batch is cut into slices of bounded size, each slice is one flat byte buffer,
and words are found, hashed and windowed with whole-buffer numpy operations.
All word classes used by the operators differ in ASCII bytes only, so bytes of
multi-byte characters always belong to a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled at once, if they are of more than one text; the working set is about 60 times as large.
SLICE_BYTES = 1 << 19
#: Bytes, or symbols, that are hashed at once, also in a longer text.
HASHED = 1 << 20
#: Words of more bytes are hashed by XXH64: the polynomial hash is for short words.
LONG_WORD = 64

_M64 = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F)


def _table(pattern: bytes) -> np.ndarray:
    word = re.compile(pattern)
    return np.array([bool(word.match(bytes([b]))) for b in range(256)])


#: Words that white space separates: bytes other than \\x20 and \\x09-\\x0D.
SPACED = _table(rb"[^\x20\x09-\x0D]")
#: Words of letters, digits and everything beyond ASCII, after lower-casing.
ALNUM = _table(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Hasher:
    """Position-free polynomial hashes modulo 2**64 of byte ranges, finished by a mixer."""

    def __init__(self, seed: int):
        self.base = _BASES[seed]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values = np.random.default_rng(7919 + seed).integers(1, _M64, 256, dtype=np.uint64, endpoint=True)
        self.lower_values = self.values[LOWER]
        self._up = self._down = np.zeros(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            self._up, self._down = (np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]) for b in (self.base, self.inverse))
            np.cumprod(self._up, out=self._up)
            np.cumprod(self._down, out=self._down)
        return self._up, self._down

    def ranges(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of buf[start[i] : end[i]], start sorted."""
        values, h = self.lower_values if lower else self.values, np.zeros(len(start), np.uint64)
        for first in range(0, len(buf), HASHED):
            i, j = np.searchsorted(start, (first, first + HASHED))
            if i < j:
                a, b = start[i:j] - first, np.minimum(end[i:j], start[i:j] + LONG_WORD) - first
                part = buf[first : first + int(b.max())]
                up, down = self.powers(len(part) + 1)
                run = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(values[part] * down[: len(part)], out=run[1:])
                h[i:j] = mix((run[b] - run[a]) * up[a] + (b - a).astype(np.uint64))
        for i in np.flatnonzero(end - start > LONG_WORD):
            raw = bytes(buf[start[i] : end[i]])
            h[i] = xxhash.xxh64_intdigest(raw.lower() if lower else raw, int(self.base & 0xFFFF))
        return h

    def windows(self, symbols: np.ndarray, starts: np.ndarray, width) -> np.ndarray:
        """Hashes of symbols[s : s + width] for s in starts; width is a number or one per start."""
        if len(symbols) <= HASHED:
            return self._windows(symbols, starts, width)
        width, h = np.broadcast_to(width, len(starts)), np.zeros(len(starts), np.uint64)
        order = np.argsort(starts, kind="stable")
        edges = np.searchsorted(starts[order], np.arange(0, len(symbols) + HASHED, HASHED))
        for first, i, j in zip(range(0, len(symbols), HASHED), edges, edges[1:]):
            if i < j:
                own = order[i:j]
                h[own] = self._windows(symbols[first : int((starts[own] + width[own]).max())], starts[own] - first, width[own])
        return h

    def _windows(self, symbols: np.ndarray, starts: np.ndarray, width) -> np.ndarray:
        up, down = self.powers(len(symbols) + 1)
        run = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * down[: len(symbols)], out=run[1:])
        return mix((run[starts + width] - run[starts]) * up[starts])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    return h


HASH = (Hasher(0), Hasher(1))


@dataclass
class Slice:
    """Some rows of a batch: buf holds their bytes, row i has buf[at[i] : at[i + 1]]."""

    first: int
    rows: int
    buf: np.ndarray
    at: np.ndarray

    def text(self, i: int) -> bytes:
        return self.buf[self.at[i] : self.at[i + 1]].tobytes()


@dataclass
class Words:
    """Word j is buf[start[j] : end[j]]; row i has words at[i] to at[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at


def slices(column, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of rows with about size bytes; a longer text is a slice of its own."""
    buf, at = flat(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Slice(i, j - i, buf[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def words(s: Slice, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of every row; lower: the class holds for the lower-cased bytes."""
    inside = (kind[LOWER] if lower else kind)[s.buf]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = s.at[(s.at > 0) & (s.at < len(s.buf))]
    begin[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(start, end, np.searchsorted(start, s.at))


def word_list(text: bytes) -> list[bytes]:
    """bytes.split() parts at exactly the white space of SPACED."""
    return text.split()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + c)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(shift - starts, counts)


def covered(starts: np.ndarray, width, n: int) -> np.ndarray:
    """Which of n places lie in some [s, s + width)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i] : at[i + 1]]."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[at[1:]] - run[at[:-1]]


def window_starts(w: Words, width: int) -> np.ndarray:
    """First words of the windows of width words that lie in one row."""
    return ranges(w.at[:-1], np.maximum(w.counts - width + 1, 0))
