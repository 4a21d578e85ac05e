"""Word shingles and minhashes of whole texts, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
#: Odd 64-bit constants of the mixing steps (any odd numbers would do).
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Distinct words that a task remembers; it forgets them when there are more.
WORDS = 500_000


class WordHashes(dict):
    """64-bit hash of each word, kept while it is asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word runs; fewer words make one run; none make none.

    A-Z are lower-cased, words are parted by ASCII white space (what ``bytes.lower`` and ``bytes.split`` do).
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        run = np.uint64(len(words))
        for w in h:
            run = mixed(np.array([run ^ w], np.uint64))[0]
        return np.array([run], np.uint64)
    run = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        run = mixed(run ^ h[i:len(h) - width + 1 + i])
    return np.unique(run)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of the set as two signed numbers."""
    low, high = divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 1 << 64)
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (low, high))


class MinHasher:
    """``n`` minimum hashes of a set under multiply-shift functions drawn from a seed."""

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for low in range(0, len(shingles), 4_096):
            part = shingles[low:low + 4_096]
            for k in range(len(out)):
                x = part * self.factor[k] + self.shift[k]
                out[k] = min(out[k], (x ^ (x >> np.uint64(31))).min())
        return out


def long_lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    """A list<int64> array from unsigned rows; None stays null."""
    filled = [r if r is not None else np.zeros(0, np.uint64) for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in filled], dtype=np.int64))).astype(np.int32)
    values = pa.array(np.concatenate(filled).view(np.int64) if filled else np.zeros(0, np.int64))
    mask = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)
