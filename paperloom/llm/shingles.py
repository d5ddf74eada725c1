"""Word shingles as sets of 64-bit hashes, and their MinHash signatures (numpy, used on the executors)."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
HASHES, BANDS, ROWS = 128, 24, 5
_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MEMO_LIMIT = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO_LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """text -> sorted distinct shingle hashes. Words: runs without ASCII white space, A-Z lower-cased."""

    def __init__(self) -> None:
        self.words = _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = np.array([self.words[w] for w in words], dtype=np.uint64)
        if len(h) < WIDTH:
            return _mix((h * _PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
        s = h[: len(h) - WIDTH + 1] * _PLACE[0]
        for i in range(1, WIDTH):
            s += h[i : len(h) - WIDTH + 1 + i] * _PLACE[i]
        return np.unique(_mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (HASHES of 32 bits) of a set that isn't empty."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 2048):
        part = shingles[None, a : a + 2048] * _A[:, None]
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys, distinct by band."""
    parts = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((parts * _BAND[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    return len(np.intersect1d(a, b, assume_unique=True))
