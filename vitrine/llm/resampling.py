"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrow import gather, text_slices
from vitrine.llm.common import positions
from vitrine.llm.toxicity import held_out
from vitrine.session import cut_lineage

#: Buckets of hashed unigrams and bigrams.
BUCKETS = 10_000
#: Most labelled rows that the target model is fitted on.
TARGET_ROWS = 20_000
#: A token is a run of word characters or of marks.
TOKENS = re.compile(r"\n|\w+|[^\w\s]+").findall


def buckets_of(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of lower-cased texts, text after text, and the texts' bounds among them."""
    plain = pc.utf8_lower(texts)
    for space in "\t\n\r\v\f":
        plain = pc.replace_substring(plain, space, " ")
    chunks = pc.split_pattern(plain, " ")
    coded = chunks.flatten().dictionary_encode()
    tokens = pa.array(TOKENS("\n".join(coded.dictionary.to_numpy(zero_copy_only=False))), pa.string()).dictionary_encode()
    distinct = tokens.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in distinct), np.uint64, len(distinct))
    at = tokens.indices.to_numpy()
    ends = np.flatnonzero((distinct == "\n")[at]) if len(distinct) else np.zeros(0, np.int64)
    flat = np.delete(hashes[at], ends)
    chunk_starts = np.concatenate(([0], ends - np.arange(len(ends)), [len(flat)])).astype(np.int64)
    starts, row = gather(chunk_starts, flat, coded.indices.to_numpy())
    offsets = chunks.offsets.to_numpy()
    bounds = starts[offsets - offsets[0]]
    pairs = np.zeros(len(row), np.uint64)
    pairs[:-1] = (row[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (row[1:] + np.uint64(0x7F4A7C15))
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
    both = np.empty((len(row), 2), np.int64)
    both[:, 0] = row % np.uint64(buckets)
    both[:, 1] = pairs % np.uint64(buckets)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    both[last, 1] = -1  # a text's last token begins no pair
    return both, bounds


def count_models(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all documents and of the target rows. A task sends one row a bucket; ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch, texts in text_slices(batches, "text"):
            both, bounds = buckets_of(texts, buckets)
            chosen = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
            for k, rows in enumerate((both, both[chosen])):
                flat = rows.reshape(-1)
                counts[k] += np.bincount(flat[flat >= 0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])

    flagged = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(target.withColumn("t", F.lit(True))), "doc_id", "left")
    counted = flagged.select(F.coalesce("t", F.lit(False)).alias("t"), "text").mapInArrow(run, "bucket long, raw long, target long")
    raw, wanted = np.zeros(buckets), np.zeros(buckets)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], wanted[r["bucket"]] = r["raw"], r["target"]
    return raw, wanted


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket. The target model is drawn to the raw one where it has seen little."""
    prior = (raw + 1) / (raw.sum() + len(raw))
    wanted = (target + len(raw) * prior) / (target.sum() + len(raw))
    return np.log(wanted) - np.log(prior)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, seed: int = 3) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, log_weight, score, gumbel_key, rank, kept``.

    ``log_weight`` is the log of the ratio of the target's and the raw text's n-gram models for the document, ``score``
    its logistic. The target model is fitted on at most ``target_rows`` labelled rows of quality 1 outside the held-out
    fold, by hash of the id; the raw model counts all documents. The sample without replacement takes the highest
    ``log_weight`` plus Gumbel noise, a hash of seed and id: ``share`` of all documents, by default the share of quality 1
    among the labelled rows that may be learned from (1 without any). Ties go by id. A null text counts as empty; a text without tokens has weight 0. A null id
    gets the noise of its own hash. Repeated rows are weighed each. An empty table gives an empty result.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    if share is None:
        share = usable.agg(F.coalesce(F.avg("quality"), F.lit(1.0))).first()[0]
    target = cut_lineage(usable.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows))
    delta = docs.sparkSession.sparkContext.broadcast(log_ratio(*count_models(docs, target, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.append(delta.value, 0.0)  # bucket -1 has no weight
        for batch, texts in text_slices(batches, "text"):
            both, bounds = buckets_of(texts, buckets)
            totals = np.concatenate(([0.0], np.cumsum(known[both].sum(axis=1))))
            weight = np.round(totals[bounds[1:]] - totals[bounds[:-1]], 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(weight)], ["doc_id", "n_tokens", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    keyed = cut_lineage(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))))
    k = round(share * keyed.count())
    ranked = positions(keyed, [], [F.col("gumbel_key").desc(), F.col("doc_id")], "rank")
    return ranked.select("doc_id", "n_tokens", "log_weight", (1 / (1 + F.exp(-F.col("log_weight")))).alias("score"), "gumbel_key", "rank", (F.col("rank") < k).alias("kept"))
