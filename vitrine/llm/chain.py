"""A two-state linear-chain conditional random field over words, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Buckets of hashed features.
BUCKETS = 1 << 18
#: Lengths of the word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6)
#: Own features of a word: itself and its beginnings.
OWN = 1 + len(BEGINNINGS)
EDGE = ".,;:!?\"'()[]{}<>*#$%&|_-~`/\\+=@^"
#: Words worked on side by side: columns of the grid that the recursion walks down.
STEPS = 128


@dataclass
class Words:
    """All words of a batch of texts in one row: number of the distinct word, start of each text, places in characters."""

    distinct: list[str]
    at: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def read_words(texts: pa.Array) -> Words:
    """Words are parted by white space and lose punctuation at their edges; marks alone are no words."""
    plain = texts
    for space in "\t\n\r\v\f ":
        plain = pc.replace_substring(plain, space, " ")
    chunks = pc.split_pattern(plain, " ")
    offsets = chunks.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = chunks.flatten().dictionary_encode()
    lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    lead = np.fromiter((len(c) - len(c.lstrip(EDGE)) for c in raw), np.int64, len(raw))
    bare = [c.strip(EDGE).lower() for c in raw]
    core = np.fromiter((len(c.strip(EDGE)) for c in raw), np.int64, len(raw))
    numbers: dict[str, int] = {}
    word_of = np.fromiter((numbers.setdefault(w, len(numbers)) for w in bare), np.int64, len(bare))
    at = coded.indices.to_numpy()
    ends = np.cumsum(lengths[at] + 1)
    firsts = np.concatenate(([0], ends))[offsets[:-1]]  # each text starts anew at 0
    places = ends - lengths[at] - 1 - np.repeat(firsts, np.diff(offsets))
    real = core[at] > 0
    bounds = np.concatenate(([0], np.cumsum(real)))[offsets]
    starts = (places + lead[at])[real]
    return Words(list(numbers), word_of[at][real], bounds, starts, starts + core[at][real])


def own_features(words: list[str]) -> np.ndarray:
    """Hashed features of each word: itself and its beginnings; a word shorter than a beginning has bucket 0 there."""
    out = np.zeros((len(words), OWN), np.int64)
    digest = xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        out[i, 0] = digest(w) % (BUCKETS - 1) + 1
        for k, n in enumerate(BEGINNINGS, 1):
            if len(w) >= n:
                out[i, k] = digest(w[:n] + "\0") % (BUCKETS - 1) + 1
    return out


@dataclass
class ChainModel:
    """Weights for state 1 against state 0: own features, word before, word after, step between states, start, bias."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray
    start: float
    bias: float

    @classmethod
    def empty(cls) -> ChainModel:
        return cls(*(np.zeros(BUCKETS, np.float32) for _ in range(3)), np.zeros((2, 2)), -2.0, -2.0)

    def potentials(self, words: Words, own: np.ndarray) -> np.ndarray:
        """Log potential of state 1 against 0 for each word of the row."""
        score = self.own[own].sum(axis=1) + self.bias
        out = score[words.at].astype(np.float64)
        if len(out):
            inner = np.ones(len(out), bool)
            inner[words.bounds[:-1][np.diff(words.bounds) > 0]] = False  # a text's first word has none before it
            before, after = self.before[own[:, 0]], self.after[own[:, 0]]
            out[1:] += np.where(inner[1:], before[words.at[:-1]], 0)
            out[:-1] += np.where(inner[1:], after[words.at[1:]], 0)
        return np.clip(out, -30, 30)

    def marginals(self, u: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over all texts at once: P(state 1) per word, and expected steps (2 x 2) summed over the texts.

        The row is one chain in which a text's first word forgets what was before. It is cut into rows of STEPS words;
        products of 2 x 2 matrices carry the state over the cuts, so the result is that of each whole text.
        """
        n = len(u)
        if n == 0:
            return np.zeros(0), np.zeros((2, 2))
        rows = -(-n // STEPS)
        size = rows * STEPS
        up = np.ones(size)
        up[:n] = np.exp(u)
        first = np.zeros(size, bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        first[n:] = True
        up, first = up.reshape(rows, STEPS), first.reshape(rows, STEPS)
        e = np.exp(self.step)
        s1 = np.exp(self.start)
        m00, m10 = np.where(first, 1.0, e[0, 0]), np.where(first, 1.0, e[1, 0])
        m01, m11 = np.where(first, s1, e[0, 1]) * up, np.where(first, s1, e[1, 1]) * up
        a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
        for t in range(STEPS):
            a, b = a * m00[:, t] + b * m10[:, t], a * m01[:, t] + b * m11[:, t]
            c, d = c * m00[:, t] + d * m10[:, t], c * m01[:, t] + d * m11[:, t]
            z = a + b + c + d
            a, b, c, d = a / z, b / z, c / z, d / z
        into, out = np.empty((rows, 2)), np.empty((rows, 2))
        x, y = 1.0, 0.0
        for r, (pa_, pb, pc_, pd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
            into[r] = x, y
            x, y = x * pa_ + y * pc_, x * pb + y * pd
            x, y = x / (x + y), y / (x + y)
        x, y = 1.0, 1.0
        for r in range(rows - 1, -1, -1):
            out[r] = x, y
            x, y = a[r] * x + b[r] * y, c[r] * x + d[r] * y
            x, y = x / (x + y), y / (x + y)
        ahead = np.empty((STEPS + 1, 2, rows))
        ahead[0] = into.T
        for t in range(STEPS):
            p, q = ahead[t]
            x, y = p * m00[:, t] + q * m10[:, t], p * m01[:, t] + q * m11[:, t]
            ahead[t + 1] = x / (x + y), y / (x + y)
        p, q = out.T
        one = np.empty((rows, STEPS))
        steps = np.zeros((2, 2))
        inside = ~first
        for t in range(STEPS - 1, -1, -1):
            x, y = ahead[t + 1, 0] * p, ahead[t + 1, 1] * q
            one[:, t] = y / (x + y)
            f0, f1 = ahead[t]
            w00, w01, w10, w11 = f0 * m00[:, t] * p, f0 * m01[:, t] * q, f1 * m10[:, t] * p, f1 * m11[:, t] * q
            z = np.where(inside[:, t], w00 + w01 + w10 + w11, np.inf)
            steps += [[(w00 / z).sum(), (w01 / z).sum()], [(w10 / z).sum(), (w11 / z).sum()]]
            p, q = m00[:, t] * p + m01[:, t] * q, m10[:, t] * p + m11[:, t] * q
            p, q = p / (p + q), q / (p + q)
        return one.reshape(-1)[:n], steps


def fit_chain(words: Words, tags: np.ndarray, rounds: int = 25, rate: float = 0.5, decay: float = 0.2) -> ChainModel:
    """Maximum likelihood with an L2 penalty, by AdaGrad steps on the whole sample."""
    model = ChainModel.empty()
    own = own_features(words.distinct)
    n = len(tags)
    lead = np.zeros(n, bool)
    lead[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
    inner = ~lead[1:]
    y = tags.astype(np.float64)
    held = np.zeros((2, 2))
    np.add.at(held, (tags[:-1][inner], tags[1:][inner]), 1)
    squares = {k: np.full(BUCKETS, 1e-6) for k in ("own", "before", "after")}
    small = np.full(6, 1e-6)
    first_id = own[:, 0]
    for _ in range(rounds):
        p, steps = model.marginals(model.potentials(words, own), words.bounds)
        gap = y - p
        per_word = np.bincount(words.at, gap, len(own))
        grads = {"own": np.zeros(BUCKETS)}
        for k in range(OWN):
            grads["own"] += np.bincount(own[:, k], per_word, BUCKETS)
        grads["before"] = np.bincount(first_id[words.at[:-1][inner]], gap[1:][inner], BUCKETS)
        grads["after"] = np.bincount(first_id[words.at[1:][inner]], gap[:-1][inner], BUCKETS)
        for k, g in grads.items():
            weight = getattr(model, k)
            g = g - decay * weight
            g[0] = 0
            squares[k] += g * g
            weight += (rate * g / np.sqrt(squares[k])).astype(np.float32)
        g = np.array([gap.sum(), gap[lead].sum(), *(held - steps).reshape(-1)])
        small += g * g
        move = rate * g / np.sqrt(small)
        model.bias += move[0]
        model.start += move[1]
        model.step += move[2:].reshape(2, 2)
    return model
