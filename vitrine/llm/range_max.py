"""Top-k over posting lists with range-maximum sparse tables: document intervals, best first, split at maximum-impact documents."""

from __future__ import annotations

import numpy as np

#: Intervals split at once at the most; the first step splits one.
STEP = 256


class PostingList:
    """Impacts of one term by document number, ascending, with a sparse table of the places of range maxima."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs, impacts
        self.table = [np.arange(len(docs), dtype=np.int32)]
        width = 1
        while 2 * width <= len(docs):
            below = self.table[-1]
            left, right = below[:-width], below[width:]
            level = np.where(impacts[left] >= impacts[right], left, right)
            self.table.append(np.concatenate((level, np.zeros(len(docs) - len(level), np.int32))))
            width *= 2
        self.table = np.stack(self.table)

    def maxima(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact in each range low[i]:high[i] of places and the place of it; 0 and -1 for empty ranges."""
        length = high - low
        some = length > 0
        level = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
        first = self.table[level, np.where(some, low, 0)]
        second = self.table[level, np.where(some, high - (1 << level), 0)]
        place = np.where(self.impacts[first] >= self.impacts[second], first, second)
        return np.where(some, self.impacts[place], 0), np.where(some, place, -1)


def bounded(lists: list[tuple[PostingList, int]], low: np.ndarray, high: np.ndarray, cuts: np.ndarray | None = None):
    """Upper bounds of the scores in document intervals low[i]:high[i], and where to split each.

    With ``cuts``, each interval is parted at its document cuts[i]: exact scores of those, then bounds and splits of the
    left and the right parts.
    """
    n = len(low) if cuts is None else 2 * len(low)
    bound, most, split, scores = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(len(low), np.int64)
    for postings, repeats in lists:
        docs = postings.docs
        a, b = np.searchsorted(docs, low), np.searchsorted(docs, high)
        if cuts is not None:
            at = np.searchsorted(docs, cuts)
            there = docs[np.minimum(at, len(docs) - 1)] == cuts
            scores += np.where(there, repeats * postings.impacts[np.minimum(at, len(docs) - 1)], 0)
            a, b = np.concatenate((a, at + there)), np.concatenate((at, b))
        value, place = postings.maxima(a, b)
        value = repeats * value
        bound += value
        better = value > most
        most = np.where(better, value, most)
        split = np.where(better, docs[place], split)
    return scores, bound, split


def best_documents(lists: list[tuple[PostingList, int]], n_docs: int, k: int) -> list[tuple[int, int]]:
    """The k documents (score, number) with the highest scores above 0, equal scores by number; each list counts ``repeats`` times.

    The bound of an interval is the sum of its lists' range maxima. The intervals with the highest bounds are split at the
    document of their largest single impact, whose score is then known; intervals bounded below the k-th score are dropped.
    """
    if not lists or n_docs == 0:
        return []
    low, high = np.zeros(1, np.int64), np.full(1, n_docs, np.int64)
    _, bound, split = bounded(lists, low, high)
    found_score, found_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, step = 1, 1
    while True:
        open_ = bound >= least
        low, high, bound, split = low[open_], high[open_], bound[open_], split[open_]
        if not len(low):
            return list(zip(found_score.tolist(), found_doc.tolist()))
        order = np.argsort(-bound, kind="stable") if len(bound) <= step else np.argpartition(-bound, step - 1)
        now, later = order[:step], order[step:]
        scores, more_bound, more_split = bounded(lists, low[now], high[now], split[now])
        found_score, found_doc = np.concatenate((found_score, scores)), np.concatenate((found_doc, split[now]))
        ranked = np.lexsort((found_doc, -found_score))[:k]
        found_score, found_doc = found_score[ranked], found_doc[ranked]
        if len(found_score) == k:
            least = max(int(found_score[-1]), 1)
        low, high = np.concatenate((low[later], low[now], split[now] + 1)), np.concatenate((high[later], split[now], high[now]))
        bound, split = np.concatenate((bound[later], more_bound)), np.concatenate((split[later], more_split))
        step = min(2 * step, STEP)
