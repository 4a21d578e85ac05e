"""Rank fusion and per-query score scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_list(df: DataFrame, score: str = "similarity", partition: Sequence[str] = ("qid", "list"), order_col: str = "id") -> DataFrame:
    """1-based rank within each query and retriever, by score then by ``order_col``."""
    spot = Window.partitionBy(*partition).orderBy(F.desc(score), order_col)
    return df.withColumn("rank", F.row_number().over(spot))


def rrf_fuse(lists: Sequence[DataFrame], k: int = 60, weights: Sequence[float] | None = None) -> DataFrame:
    """(qid, id, score, rank): reciprocal rank fusion of ranked (qid, id, rank) lists.

    An item absent from a list adds nothing; equal scores keep the order in which the lists first show them.
    """
    if not lists:
        raise ValueError("no ranked lists to fuse")
    if weights is not None and len(weights) != len(lists):
        raise ValueError("one weight per list is needed")
    if k < 0:
        raise ValueError("k must not be negative")
    weights = weights or [1.0] * len(lists)
    rows = None
    for position, (ranked, weight) in enumerate(zip(lists, weights)):
        part = ranked.select("qid", "id", "rank", F.lit(position).alias("list"), (F.lit(float(weight)) / (F.lit(k) + F.col("rank"))).alias("gain"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("qid", "id").agg(
        F.bround(F.sum("gain"), 12).alias("score"), F.min(F.struct("list", "rank")).alias("first_seen"))
    spot = Window.partitionBy("qid").orderBy(F.desc("score"), "first_seen")
    return fused.withColumn("rank", F.row_number().over(spot)).drop("first_seen")


def minmax_per_query(df: DataFrame, value: str, name: str, partition: str = "qid") -> DataFrame:
    return df.withColumn(name, minmax(F.col(value), partition))


def minmax(value: Column, partition: str = "qid") -> Column:
    """Scale to [0, 1] within the query; a query with a single distinct value scores 1."""
    w = Window.partitionBy(partition)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(1.0)


def candidate_union(lists: Sequence[DataFrame], keys: Sequence[str] = ("qid", "id")) -> DataFrame:
    """First-seen union by (qid, id): a product keeps the row of the first list that returned it."""
    rows = None
    for position, part in enumerate(lists):
        part = part.withColumn("_list", F.lit(position))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    spot = Window.partitionBy(*keys).orderBy("_list", "rank")
    return rows.withColumn("_n", F.row_number().over(spot)).where("_n = 1").drop("_n", "_list")
