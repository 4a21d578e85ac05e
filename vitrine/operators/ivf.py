"""A stored inverted-file index for vectors: cells of a spherical k-means, probed nearest first, exact on demand.

Every item stands in the cell of its nearest centroid, with its angle to it. On the sphere the angle between a query and
an item is at least the difference of their angles to a centroid, so a cell cannot hold anything better than its rim
allows, and within a cell only items in a shell of angles can. A query that probes until no bound beats its k-th best
similarity gets the exact answer; a fixed number of probes gets an approximate one, whose recall ``recall_at_k`` measures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.topk import _prepared, best_per_query, block_topk, unit_rows
from vitrine.session import cut_lineage

#: Rows on which centroids are fitted, at most: the ones with the smallest hashes of their ids.
SAMPLE = 20_000
ROUNDS = 10
#: Slack of the angle bounds against rounding, in radians.
SLACK = 1e-6


@dataclass(frozen=True)
class Centroids:
    """Unit rows, one for each cell."""

    matrix: np.ndarray

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(vectors @ self.matrix.T, -1.0, 1.0))


def fit_centroids(items: DataFrame, cells: int, *, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> Centroids:
    """Spherical k-means on at most ``sample`` rows. Only their vectors reach the driver, whatever the table's size."""
    rows = items.where("embedding IS NOT NULL").select("embedding", F.xxhash64(F.lit(seed), F.col("id").cast("string")).alias("_h"))
    vectors = unit_rows(rows.orderBy("_h").limit(sample).select("embedding").toArrow().column("embedding"))
    if len(vectors) == 0:
        raise ValueError("no vectors to fit centroids on")
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms == 0, 1.0, norms), centroids)
    return Centroids(centroids)


def assign_cells(items: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, embedding, category_id, cell, angle): every item with a vector in the cell of its nearest centroid."""
    _, rows = _prepared(items.select(F.col("id").alias("qid"), "embedding"), items)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = centroids.angles(unit_rows(batch.column("embedding"))) if batch.num_rows else np.zeros((0, 1))
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(cell)), cell], pa.float64())],
                names=[*batch.schema.names, "cell", "angle"])

    return rows.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, angle double")


def write_index(items: DataFrame, centroids: Centroids, path: str) -> None:
    """Store the index: a folder for each cell, so that a search reads the cells it probes and no other."""
    spark = items.sparkSession
    assign_cells(items, centroids).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    rows = [(n, row.tolist()) for n, row in enumerate(centroids.matrix)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, Centroids]:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    return spark.read.schema("id string, embedding array<float>, category_id bigint, angle double, cell int").parquet(f"{path}/items"), Centroids(unit_rows(rows.column("centroid")))


def probes_of(queries: DataFrame, centroids: Centroids, rims: DataFrame) -> DataFrame:
    """(qid, embedding, scope, cell, turn, bound): every query's cells, nearest first, and the best similarity each can hold.

    ``rims`` has one row per cell, (cell, lo, hi): the smallest and the largest angle of its items to its centroid.
    """
    low, high = np.full(len(centroids.matrix), np.nan), np.full(len(centroids.matrix), np.nan)
    for r in rims.toLocalIterator():
        low[r.cell], high[r.cell] = r.lo, r.hi
    q, _ = _prepared(queries, queries.select(F.col("qid").alias("id"), "embedding"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.flatnonzero(np.isfinite(high))
        for batch in batches:
            angles = centroids.angles(unit_rows(batch.column("embedding")))[:, held] if batch.num_rows else np.zeros((0, len(held)))
            least = np.maximum(0.0, np.maximum(angles - high[held], low[held] - angles) - SLACK)
            order = np.argsort(angles, axis=1, kind="stable")
            turn = np.empty_like(order)
            np.put_along_axis(turn, order, np.arange(len(held))[None, :] + np.zeros_like(order), axis=1)
            rows = np.repeat(np.arange(batch.num_rows), len(held))
            taken = [c.take(pa.array(rows)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(np.tile(held, batch.num_rows), pa.int32()), pa.array(turn.ravel(), pa.int32()), pa.array(np.cos(least).ravel(), pa.float64())],
                names=[*batch.schema.names, "cell", "turn", "bound"])

    return q.mapInArrow(probe, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.schema) + ", cell int, turn int, bound double")


def _in_cells(probed: DataFrame, index: DataFrame, k: int, threshold: float) -> DataFrame:
    return block_topk(probed.select("qid", "embedding", "scope", F.col("cell").alias("grp")), index.select("id", "embedding", "category_id", F.col("cell").alias("grp")), k, threshold)


def ivf_topk(queries: DataFrame, index: DataFrame, centroids: Centroids, k: int, *, probes: int, exact: bool = False, threshold: float = -2.0) -> DataFrame:
    """(qid, id, similarity, rank) from an index, by the ``probes`` nearest cells of every query.

    With ``exact``, a second round takes the cells whose bound is not below the k-th similarity found, or all of them if
    fewer than k were found: the answer is then that of a whole scan. Scores are rounded and ties go to the smaller id, as
    in ``exact_topk``. Crowded cells are split into blocks.
    """
    rims = index.groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    cells = cut_lineage(probes_of(queries, centroids, rims))
    first = best_per_query(_in_cells(cells.where(F.col("turn") < probes), index, k, threshold), k)
    if not exact:
        return first
    first = cut_lineage(first)
    floors = first.where(F.col("rank") == k).select("qid", F.col("similarity").alias("floor"))
    more = cells.where(F.col("turn") >= probes).join(floors, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    found = _in_cells(more, index, k, threshold)
    return best_per_query(first.select("qid", "id", "similarity").unionByName(found), k)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, recall): the share of the exact answer's rows that ``found`` has."""
    hit = exact.select("qid", "id").join(found.select("qid", "id").withColumn("_hit", F.lit(1)), ["qid", "id"], "left")
    return hit.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("wanted"), F.round(F.count("_hit") / F.count("*"), 4).alias("recall"))


def scanned_share(queries: DataFrame, index: DataFrame, centroids: Centroids, probes: int) -> DataFrame:
    """(share): the mean share of all items in the cells that a query probes."""
    sizes = index.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    probed = probes_of(queries, centroids, sizes).where(F.col("turn") < probes).select("qid", "cell")
    per_query = probed.join(sizes.select("cell", "n"), "cell").groupBy("qid").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n").alias("total")).first()["total"] or 1
    return per_query.agg(F.round(F.avg(F.col("n") / F.lit(total)), 4).alias("share"))
