"""Exact dedup: a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import ascii_lower, repeat_rows, row_key, whole_text, with_group_facts
from vitrine.session import cut_lineage

DIGEST = ["digest", "text_sha256", "n_bytes"]


def digest_runs(rows: DataFrame, keep: str) -> DataFrame:
    """Level 0: each input partition is a run with one entry per digest, carrying its retained row and its count."""
    rank = F.struct((F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()).alias("known"), "id", "nth")
    return rows.groupBy("run", *DIGEST).agg(_best(keep)(rank).alias("stays"), F.count(F.lit(1)).alias("group_size"))


def _best(keep: str):
    return F.max if keep == "largest" else F.min


def merge_runs(runs: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs meet, dealt by (merged run, digest), and merge into one sorted run.

    Entries merge only when SHA-256 and byte length agree as well as the 64-bit digest, so what a level retains is
    verified at that level. A run has one entry per text and a task combines before it sends, so copies that fill a
    third of all rows are a few entries per task from the first round on.
    """
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in))
        .groupBy("run", *DIGEST).agg(_best(keep)("stays").alias("stays"), F.sum("group_size").alias("group_size"))
        .sortWithinPartitions("run", *DIGEST)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "largest", fan_in: int = 16) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after lower-casing A-Z. Of each group the row with the largest (or smallest) id
    stays. A null text counts as empty; empty texts form one group. A null id loses to any other id. Of rows repeated
    with the same id and text exactly one is kept. An empty table gives an empty result. Other columns are not read.
    """
    if keep not in ("largest", "smallest") or fan_in < 2:
        raise ValueError("keep must be largest or smallest, fan_in at least 2")
    text = ascii_lower(whole_text(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("nth"), F.spark_partition_id().cast("long").alias("run"),
        text.alias("text"),
    ).select("id", "nth", "run", F.xxhash64("text").alias("digest"), F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"))
    return _decide(cut_lineage(rows), keep, fan_in).select(
        F.col("id").alias("doc_id"), F.col("stays.id").alias("keep_id"), "group_size",
        (F.col("nth") == F.col("stays.nth")).alias("kept"), "text_sha256")


def _decide(rows: DataFrame, keep: str, fan_in: int) -> DataFrame:
    total, runs_left = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("run") + 1, F.lit(1))).first()
    runs = digest_runs(rows, keep)
    while runs_left > 1:
        runs = merge_runs(runs, fan_in, keep)
        runs_left = -(-runs_left // fan_in)
    return with_group_facts(rows, runs.drop("run"), DIGEST, "group_size", total)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "largest", fan_in: int = 16) -> DataFrame:
    """The documents that stay, with all their columns. Cases as in ``exact_dedup``.

    The decisions are made on digests; the texts are dealt once, by row key, to meet them.
    """
    text = ascii_lower(whole_text(text_col))
    rows = docs.select(
        *row_key(docs), F.col(id_col).alias("id"), F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("nth"), text.alias("text"),
    ).select("_h1", "_h2", "id", "run", "nth", F.xxhash64("text").alias("digest"), F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"))
    kept = _decide(cut_lineage(rows), keep, fan_in).where(F.col("nth") == F.col("stays.nth"))
    return repeat_rows(docs, kept.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n")))
