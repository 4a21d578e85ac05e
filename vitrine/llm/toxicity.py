"""Toxicity: a chain of tags over words, its marginals gathered into document scores and offending places."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrow import sums_by_row, text_slices
from vitrine.llm.chain import OWN, ChainModel, Words, fit_chain, own_features, read_words
from vitrine.session import cut_lineage

#: Folds by crc32 of the id as text; fold 0 is never learned from.
FOLDS = 5
#: Most labelled rows of each label that the model is fitted on.
SAMPLE = 1_500
#: Marginal from which a word is an offending place.
OFFENDS = 0.5


def held_out(ident: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> tuple[pa.Array, np.ndarray, float]:
    """Whole texts and labels of at most ``per_label`` rows of each label outside the held-out fold, by hash of the id.

    The third value is the number of clean rows for each toxic one among all rows that could have been picked.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = cut_lineage(usable.where("y = 1").orderBy(*order).limit(per_label).unionByName(usable.where("y = 0").orderBy(*order).limit(per_label)))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    got = texts.select("y", "text", F.xxhash64("doc_id").alias("h"), "doc_id").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    toxic, clean = usable.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    return got["text"].combine_chunks().cast(pa.string()), got["y"].to_numpy().astype(np.int64), clean / max(1, toxic)


def tag_words(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Tags from document labels: 1 for words of toxic documents with a feature that clean documents hardly have, else 0.

    A feature (a word or its beginning) is an offending one if, in each half of the documents, it is in enough toxic ones
    and its rate there is at least twenty times its smoothed rate in clean ones. Two halves, so that words of one text
    that has copies do not pass.
    """
    own = own_features(words.distinct)
    doc_of = np.repeat(np.arange(len(toxic)), np.diff(words.bounds))
    half = np.arange(len(toxic)) % 2
    bad_word = np.zeros(len(own), bool)
    for k in range(OWN):
        features, inverse = np.unique(own[:, k], return_inverse=True)
        pairs = np.unique(doc_of * np.int64(len(features)) + inverse[words.at])
        feature = pairs % len(features)
        label = toxic[pairs // len(features)]
        part = half[pairs // len(features)]
        odd = features > 0
        for h in (0, 1):
            n_toxic, n_clean = (max(1, int(((toxic == y) & (half == h)).sum())) for y in (1, 0))
            bad, good = (np.bincount(feature[(label == y) & (part == h)], minlength=len(features)) for y in (1, 0))
            odd &= (bad >= max(2, n_toxic // 50)) & (bad / n_toxic >= 20 * (good + 0.5) / n_clean)
        bad_word |= odd[inverse]
    return (bad_word[words.at] & (toxic[doc_of] == 1)).astype(np.int64)


def gathered(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: sum of the marginals' log odds against none, highest marginal, expected offending words, their share."""
    n = np.diff(bounds)
    some = -np.log1p(-np.clip(p, 0, 1 - 1e-6))
    highest = np.zeros(len(n))
    if len(p):
        filled = np.flatnonzero(n > 0)
        highest[filled] = np.maximum.reduceat(p, bounds[:-1][filled])
    expected = sums_by_row_float(p, bounds)
    return np.stack([np.minimum(sums_by_row_float(some, bounds), 60.0) / 10, highest, np.log1p(expected), np.minimum(1.0, 20 * expected / np.maximum(n, 1))], axis=1)


def sums_by_row_float(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    totals = np.concatenate(([0.0], np.cumsum(values)))
    return totals[bounds[1:]] - totals[bounds[:-1]]


@dataclass
class ToxicityModel:
    """The chain, and the logistic weights that turn gathered marginals into a score. ``base`` is the score without a chain."""

    chain: ChainModel | None
    weights: np.ndarray
    base: float

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
        words = read_words(texts)
        if self.chain is None:
            return np.full(len(texts), self.base), [[] for _ in range(len(texts))]
        p, _ = self.chain.marginals(self.chain.potentials(words, own_features(words.distinct)), words.bounds)
        x = gathered(p, words.bounds)
        score = 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))
        places: list[list[dict[str, int]]] = [[] for _ in range(len(texts))]
        hits = np.flatnonzero(p >= OFFENDS)
        owner = np.searchsorted(words.bounds, hits, side="right") - 1
        last = -2
        for i, doc in zip(hits.tolist(), owner.tolist()):
            if i == last + 1 and places[doc]:
                places[doc][-1]["stop"] = int(words.ends[i])
            else:
                places[doc].append({"start": int(words.starts[i]), "stop": int(words.ends[i])})
            last = i
        return score, places


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton's method with weights and a ridge penalty."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (weight * (y - p)) - ridge * w)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold. With fewer than four of either label no chain is fitted."""
    texts, y, clean_per_toxic = labelled_sample(docs, labels, per_label)
    if min(int(y.sum()), int((1 - y).sum())) < 4:
        return ToxicityModel(None, np.zeros(5), float(y.mean()) if len(y) and y.min() == y.max() else 0.0)
    return fit_on(texts, y, clean_per_toxic)


def fit_on(texts: pa.Array, y: np.ndarray, clean_per_toxic: float) -> ToxicityModel:
    """The chain learns from two thirds of the sample, the weights of the score from the chain's marginals on the rest.

    In the score each clean row counts as often as clean rows occur for a toxic one.
    """
    words = read_words(texts)
    tags = tag_words(words, y)
    learn = np.arange(len(y)) % 3 != 2
    if min(int(y[~learn].sum()), int((1 - y[~learn]).sum())) < 2:
        learn[:] = True
    chain = fit_chain(*only(words, tags, learn))
    p, _ = chain.marginals(chain.potentials(words, own_features(words.distinct)), words.bounds)
    rest = ~learn if not learn.all() else learn
    x, label = gathered(p, words.bounds)[rest], y[rest]
    weight = np.where(label == 1, 1.0, clean_per_toxic * label.sum() / max(1, (1 - label).sum()))
    return ToxicityModel(chain, fit_logistic(x, label, weight), 0.0)


def only(words: Words, tags: np.ndarray, docs: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words and tags of the chosen documents."""
    sizes = np.diff(words.bounds)
    rows = np.repeat(docs, sizes)
    used, at = np.unique(words.at[rows], return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes[docs])))
    return Words([words.distinct[i] for i in used], at, bounds, words.starts[rows], words.ends[rows]), tags[rows]


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, spans``.

    The score is a function of the text alone. ``spans`` are the offending places, start and stop in characters of the text.
    A null text counts as empty; a text without words gets the score of no offending word. A null id counts as not held
    out. Repeated rows are scored each. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch, texts in text_slices(batches, "text"):
            score, places = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(places, kind)],
                ["doc_id", "held_out", "score", "predicted", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:long,stop:long>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns. Cases as in ``score_toxicity``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    given = docs.select(whole, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            score, _ = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["doc"]).filter(pa.array(score < 0.5))

    return given.mapInArrow(run, given.select("doc").schema).select("doc.*")
