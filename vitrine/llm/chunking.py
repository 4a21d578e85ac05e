"""Content-defined chunks: normalised gear-hash boundaries, and sets of chunk digests weighted by length."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import xxhash

#: Bytes of the window that a gear hash of 32 bits looks back on.
WINDOW = 32
#: Bytes of a digest kept in a fingerprint; one more byte holds the chunk's length.
DIGEST_BYTES = 5


@dataclass(frozen=True)
class Chunker:
    """Chunks of ``least`` to ``most`` bytes. Up to ``normal`` bytes a boundary needs ``hard_bits`` zero bits, after that ``easy_bits``."""

    least: int = 8
    normal: int = 16
    most: int = 64
    hard_bits: int = 5
    easy_bits: int = 3
    seed: int = 11

    def gear(self) -> np.ndarray:
        """Random 32-bit numbers for the bytes; 256, which parts texts, has 0 so that no text looks back on another."""
        return np.append(np.random.default_rng(self.seed).integers(0, 1 << 32, 256, dtype=np.uint32), np.uint32(0))

    def ends(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(number of the text, end in the joined bytes) of all chunks, and the joined bytes with gaps between texts.

        All texts take a step together; a step finds each one's next boundary among the sorted candidates.
        """
        gap = b"\0" * WINDOW
        joined = gap.join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1])) if len(texts) else np.zeros(0, np.int64)
        codes = np.frombuffer(joined, np.uint8).astype(np.int16)
        for s in (starts[1:] - WINDOW).tolist():
            codes[s:s + WINDOW] = 256
        hash_at = self.gear()[codes]
        reach = 1
        while reach < WINDOW:
            earlier = np.zeros_like(hash_at)
            earlier[reach:] = hash_at[:-reach] << np.uint32(reach)
            hash_at += earlier
            reach *= 2
        top = hash_at >> np.uint32(32 - self.hard_bits)
        hard = np.flatnonzero(top == 0)
        easy = np.flatnonzero(top >> np.uint32(self.hard_bits - self.easy_bits) == 0)
        far = np.int64(len(joined) + self.most + 1)
        hard, easy = np.append(hard, far), np.append(easy, far)
        active = np.flatnonzero(sizes > 0)
        at, stop = starts[active].copy(), (starts + sizes)[active]
        of, ends = [], []
        while len(active):
            h = hard[np.searchsorted(hard, at + self.least - 1)] + 1
            e = easy[np.searchsorted(easy, at + self.normal - 1)] + 1
            cut = np.minimum(np.where(h <= at + self.normal, h, np.minimum(e, at + self.most)), stop)
            of.append(active)
            ends.append(cut)
            on = cut < stop
            active, at, stop = active[on], cut[on], stop[on]
        if not of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), joined
        of, ends = np.concatenate(of), np.concatenate(ends)
        order = np.lexsort((ends, of))
        return of[order], ends[order], joined

    def sets(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its distinct chunk digests, ascending, and the chunks' lengths."""
        of, ends, joined = self.ends(texts)
        first = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
        text_starts = np.concatenate(([0], np.cumsum([len(t) + WINDOW for t in texts])[:-1])) if texts else np.zeros(0)
        starts = np.where(first, text_starts[of], np.concatenate(([0], ends[:-1])) if len(ends) else 0).astype(np.int64)
        view = memoryview(joined)
        digest = xxhash.xxh3_64_intdigest
        digests = np.fromiter((digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))
        digests &= np.uint64((1 << 8 * DIGEST_BYTES) - 1)
        lengths = ends - starts
        order = np.lexsort((digests, of))
        of, digests, lengths = of[order], digests[order], lengths[order]
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (digests[1:] != digests[:-1]))) if len(of) else np.zeros(0, bool)
        of, digests, lengths = of[new], digests[new], lengths[new]
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        return [(digests[a:b], lengths[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def fingerprint(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of the digests in order, each with the length of its chunk."""
    digests, lengths = chunks
    cells = np.empty((len(digests), DIGEST_BYTES + 1), np.uint8)
    cells[:, :DIGEST_BYTES] = digests.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :DIGEST_BYTES]
    cells[:, DIGEST_BYTES] = lengths
    return base64.b64encode(cells.tobytes()).decode()


def read_fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    cells = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, DIGEST_BYTES + 1)
    wide = np.zeros((len(cells), 8), np.uint8)
    wide[:, :DIGEST_BYTES] = cells[:, :DIGEST_BYTES]
    return wide.reshape(-1).view("<u8").astype(np.uint64), cells[:, DIGEST_BYTES].astype(np.int64)


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Bytes in shared chunks against the bytes of the smaller set; 1 for two empty sets, 0 for one."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = a[1][b[0][at] == a[0]].sum()
    return float(shared / min(a[1].sum(), b[1].sum()))
