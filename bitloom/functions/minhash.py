"""MinHash signatures of texts' character trigrams, banded for locality-sensitive hashing."""

from __future__ import annotations

import numpy as np

#: Values of a signature.
VALUES = 840
#: Chance, at least, that two sets as alike as the threshold share a band.
RECALL = 0.998
_SEEDS = np.random.default_rng(20061)
_A = _SEEDS.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEEDS.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Trigrams that are hashed at once: few, so that they stay in the processor's cache.
_CHUNK = 1 << 5
#: In place of a character of a text of fewer than three.
_NONE = 0x110000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def trigram_codes(text: str) -> np.ndarray:
    """The different trigrams, 21 bits a character; a shorter text is one itself, the empty text has one of its own."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        c = np.append(c, np.full(3 - len(c), _NONE, np.int64))
    return np.unique(c[:-2] | c[1:-1] << 21 | c[2:] << 42)


def trigram_hashes(codes: np.ndarray) -> np.ndarray:
    c = [(codes >> k & 0x1FFFFF).astype(np.uint64) for k in (0, 21, 42)]
    return _mix(_mix(_mix(c[0] * _C[0]) + c[1] * _C[1]) + c[2] * _C[2])


def rows_of(threshold: float) -> int:
    """Values in a band: as many as RECALL allows. Sets of Jaccard j share one of b bands of r values with chance 1 - (1 - j**r)**b."""
    fits = [r for r in range(1, VALUES + 1) if 1 - (1 - threshold**r) ** (VALUES // r) >= RECALL]
    return max(fits, default=1)


def bands_of(codes: np.ndarray, rows: int) -> np.ndarray:
    least = np.full(VALUES, np.uint64((1 << 64) - 1))
    h = trigram_hashes(codes)
    for k in range(0, len(h), _CHUNK):
        np.minimum(least, _mix(h[k : k + _CHUNK, None] * _A + _B).min(0), out=least)
    n = VALUES // rows
    out = np.zeros(n, np.uint64)
    for column in least[: n * rows].reshape(n, rows).T:
        out = _mix(out * _C[0] + column)
    return out.view(np.int64)
