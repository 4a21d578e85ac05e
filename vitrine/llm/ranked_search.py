"""Ranked lexical search: every document for every item, by range-maximum tables over slices of the documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.arrow import lengths_to_starts, text_slices
from vitrine.llm.range_max import PostingList, best_documents
from vitrine.session import cut_lineage

#: About how many different (item, term) entries are asked at once; more items are asked block by block.
BLOCK_TERMS = 200_000
#: Postings that a task indexes at once.
SLICE_POSTINGS = 1_000_000
#: Weight of a document's length in its norm, in hundredths.
LENGTH = 75
#: Bytes that stay in a term: A-Z become lower case, other ASCII signs become spaces.
_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """Rows (ask, item_id, terms, counts): the distinct terms of every item and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(pc.fill_null(batch.column(2), ""), pa.binary()).to_pylist()
            counted = [Counter(terms_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))],
                ["ask", "item_id", "terms", "counts"])

    given = cut_lineage(items.select("item_id", F.col("text").cast("string").alias("text"))).select(F.monotonically_increasing_id().alias("ask"), "item_id", "text")
    return cut_lineage(given.mapInArrow(run, f"ask long, item_id {given.schema['item_id'].dataType.simpleString()}, terms array<binary>, counts array<long>"))


def posted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows (doc_id, n, terms, tfs): every document's length in terms, and how often it has which terms of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            sizes, terms, tfs = [], [], []
            for text in pc.cast(texts, pa.binary()).to_pylist():
                words = terms_of(text)
                counted = Counter(map(vocabulary.get, words))
                counted.pop(None, None)
                sizes.append(len(words))
                terms.append(np.fromiter(counted.keys(), np.int32, len(counted)))
                tfs.append(np.fromiter(counted.values(), np.int32, len(counted)))
            offsets = pa.array(lengths_to_starts(np.array([len(t) for t in terms], np.int64)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents in slices of about SLICE_POSTINGS postings, each in order of doc_id, null ids last."""
    held, postings = [], 0
    for batch in batches:
        held.append(batch)
        postings += len(pc.list_flatten(batch.column(2)))
        if postings >= SLICE_POSTINGS:
            yield pa.Table.from_batches(held).sort_by("doc_id")
            held, postings = [], 0
    if held:
        yield pa.Table.from_batches(held).sort_by("doc_id")


def _index(table: pa.Table, weights: np.ndarray, documents: int, total: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per term the slice's documents, by number, and their impacts."""
    terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
    lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    term, tf = (pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs))
    norm = 100 - LENGTH + LENGTH * table.column("n").to_numpy().astype(np.int64) * documents // total
    doc = np.repeat(np.arange(len(lengths)), lengths)
    impact = weights[term] * (1_000_000_000 * tf // (1_000 * tf + 8 * norm[doc]))
    order = np.lexsort((doc, term))
    term, doc, impact = term[order], doc[order], impact[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    starts = np.concatenate(([0], cuts)) if len(term) else np.zeros(0, np.int64)
    return {int(term[a]): (doc[a:b], impact[a:b]) for a, b in zip(starts, [*cuts, len(term)])}


def _ranked_in_slices(posts: DataFrame, asked: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """Rows (ask, doc_id, score): the k best documents of each slice for each item."""
    kind = posts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches):
            index, lists = _index(table, weights, documents, total), {}
            asks, numbers, scores = [], [], []
            for ask, terms in asked:
                met = [t for t in terms if t[0] in index and weights[t[0]] > 0]
                for term, _ in met:
                    if term not in lists:
                        lists[term] = PostingList(*index[term])
                for score, number in best_documents([(lists[t], n) for t, n in met], table.num_rows, k):
                    asks.append(ask)
                    numbers.append(number)
                    scores.append(score)
            ids = table.column("doc_id").combine_chunks().take(pa.array(numbers, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(asks, pa.int64()), ids, pa.array(scores, pa.int64())], ["ask", "doc_id", "score"])

    return posts.mapInArrow(run, f"ask long, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of every item: ``item_id, rank, doc_id, score``.

    Terms, weights and scores are those of contract op11: integer impacts of term frequency against document length, summed
    over the item's terms with repeats. Scores above 0 alone are returned, equal ones by ascending doc_id, null ids last.
    A null or empty text has no terms: such an item has no rows, such a document is never returned and counts in no figure.
    Rows of ``items`` are items of their own, so a repeated row repeats its result. Empty tables give an empty result. Only
    doc_id, item_id and text are read. Items are asked in blocks of about ``block_terms`` entries, each a pass over all
    documents; a task indexes its documents slice by slice and returns at most k rows for each item and slice.
    """
    entries = _item_terms(items)
    size = entries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-size // block_terms)
    out = entries.sparkSession.createDataFrame([], f"ask long, item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for block in range(blocks):
        asked = entries.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == block)
        out = out.unionByName(_answered(docs, asked, k))
    return out.drop("ask")


def _answered(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.select("ask", "terms", "counts").collect()
    vocabulary: dict[bytes, int] = {}
    items = [(r.ask, [(vocabulary.setdefault(bytes(t), len(vocabulary)), n) for t, n in zip(r.terms, r.counts)]) for r in rows]
    posts = cut_lineage(posted(docs, vocabulary))
    documents, total = posts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in posts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    best = _ranked_in_slices(posts, items, weights, documents, max(total, 1), k)
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("ask", "item_id").hint("merge"), "ask").select("ask", "item_id", "rank", "doc_id", "score")
