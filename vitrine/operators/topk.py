"""Exact and approximate top-k by cosine, without materialising query x item pairs.

Spark partitions the items; each task scores its rows against a block of queries with one matrix product
and keeps k rows per query, so a task emits at most k x queries rows. A window then takes the k best over all
tasks. Scores are rounded to nine places and ties go to the smaller id, so the result does not depend on
partitioning or on the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.sizes import at_most, small_side

QUERY_BLOCK = 4_096
# A block join emits k rows per query and item block: larger blocks, fewer rows to merge.
JOIN_BLOCK = 8_192
ITEM_BLOCK = 131_072
#: Scores held at a time, and pairs scored again at a time.
CELLS, RESCORED = 1 << 22, 1 << 14
#: Parts whose largest scores bound the k-th best of all, at least; and for each of the k.
PARTS, PARTS_OF_K = 1_024, 8
DIGITS = 9
PAIRS = "qid string, id string, similarity double"


def unit_rows(column, keep: np.ndarray | None = None) -> np.ndarray:
    """A list<float> Arrow column as a matrix of unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, np.where(norms == 0, 1.0, norms), out=matrix if matrix.flags.writeable else None)


def raw_rows(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A list<float> Arrow column as it lies, the norms of its rows, its unit rows in single precision, and which of them are finite.

    Doubles are made for RESCORED rows at a time, so a block is held in single precision alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    norms, single, sound = np.ones((len(matrix), 1)), np.empty(matrix.shape, np.float32), np.zeros(len(matrix), bool)
    for start in range(0, len(matrix), RESCORED):
        at = slice(start, start + RESCORED)
        part = matrix[at].astype(np.float64)
        norms[at, 0] = np.sqrt(np.einsum("ij,ij->i", part, part))
        norms[at][norms[at] == 0] = 1.0
        part /= norms[at]
        single[at], sound[at] = part, np.isfinite(part).all(axis=1)
    return matrix, norms, single, sound


def reached_by(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k of its cells reach, near the k-th largest: that of the largest cells of many parts."""
    parts = max(PARTS, PARTS_OF_K * k)
    width = scores.shape[1] // parts
    if width > 1:
        scores = scores[:, :width * parts].reshape(len(scores), width, parts).max(axis=1)
    place = scores.shape[1] - k
    return np.partition(scores, place, axis=1)[:, place]


class BestPerQuery:
    """The k best (score, id) per query seen so far."""

    def __init__(self, queries: int, k: int, threshold: float):
        self.k, self.queries = k, queries
        self.floor = np.full(queries, threshold)
        self.q = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="U1")
        self.scores = np.zeros(0)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, scores: np.ndarray, first_query: int, ids: np.ndarray) -> None:
        """``scores`` has one row per item and one column per query, starting at ``first_query``."""
        n, width = scores.shape
        floor = self.floor[first_query:first_query + width]
        if n > self.k:
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=0)[n - self.k])
        rows, cols = np.nonzero((scores >= floor) & np.isfinite(scores))
        self.q = np.concatenate([self.q, cols + first_query])
        self.ids = np.concatenate([self.ids, ids[rows]])
        self.scores = np.concatenate([self.scores, scores[rows, cols]])
        if len(self.q) > 4 * self.k * self.queries + 10_000:
            self.compact()

    def keep(self, q: np.ndarray, nth: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take the k best of pairs with all candidates of their queries among ``ids``, which are sorted; ``nth`` are places there."""
        able = scores >= self.floor[q]
        q, nth, scores = q[able], nth[able], scores[able]
        order = np.lexsort((nth, -scores, q))
        q = q[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < self.k
        order = order[kept]
        self.pending.append((q[kept], ids[nth[order]], scores[order]))
        self.waiting += len(order)
        if self.waiting > 4 * self.k * self.queries + 10_000:
            self.compact()

    def compact(self) -> None:
        if self.pending:
            parts = [(self.q, self.ids, self.scores), *self.pending]
            self.q, self.ids, self.scores = (np.concatenate([part[i] for part in parts]) for i in range(3))
            self.pending, self.waiting = [], 0
        order = np.lexsort((self.ids, -self.scores, self.q))
        q = self.q[order]
        starts = np.searchsorted(q, q, side="left")
        kept = order[np.arange(len(q)) - starts < self.k]
        self.q, self.ids, self.scores = self.q[kept], self.ids[kept], self.scores[kept]
        full, counts = np.unique(self.q, return_counts=True)
        full = full[counts >= self.k]
        lowest = np.full(self.queries, np.inf)
        np.minimum.at(lowest, self.q, self.scores)
        self.floor[full] = np.maximum(self.floor[full], lowest[full])

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        self.compact()
        return pa.RecordBatch.from_arrays(
            [pa.array(qids[self.q], pa.string()), pa.array(self.ids, pa.string()), pa.array(self.scores, pa.float64())],
            names=["qid", "id", "similarity"])


class QueryBlock:
    """Queries of one block: unit vectors, and the queries of each distinct category scope."""

    def __init__(self, qids, matrix, scopes=None):
        self.qids = np.asarray(qids, dtype="U")
        self.matrix = matrix
        groups: dict[tuple | None, list[int]] = {}
        for i, scope in enumerate(scopes or [None] * len(self.qids)):
            groups.setdefault(None if scope is None else tuple(sorted(scope)), []).append(i)
        self.scopes = {scope: np.array(members) for scope, members in groups.items()}

    def score(self, items: pa.RecordBatch | pa.Table, best: BestPerQuery, exclude_self: bool) -> None:
        """Offer the items to their queries. Single precision picks the pairs that can be among the k best of their query, by a
        bound of its error; only those are scored in double precision, which alone decides. A query meets the items of its scope."""
        if items.num_rows == 0 or len(self.qids) == 0:
            return
        *vectors, units, sound = raw_rows(items.column("embedding"))
        ids, order = np.unique(np.asarray(items.column("id").to_pylist(), dtype="U"), return_inverse=True)
        categories = None
        if any(scope is not None for scope in self.scopes):
            categories = np.array([-1 if c is None else c for c in items.column("category_id").to_pylist()], dtype=np.int64)
        error = (units.shape[1] + 8) * 1.2e-7 + 10.0 ** -DIGITS
        single = self.matrix.astype(np.float32)
        for scope, members in self.scopes.items():
            inside = np.flatnonzero(sound if scope is None else sound & np.isin(categories, scope))
            members = members[np.isfinite(self.matrix[members]).all(axis=1)]
            if len(inside) == 0:
                continue
            columns = (units if len(inside) == len(units) else units[inside]).T
            place = np.argsort(order[inside], kind="stable")
            width = max(1, CELLS // len(inside))
            for start in range(0, len(members), width):
                chunk = members[start:start + width]
                rough = single[chunk] @ columns
                if exclude_self:
                    rough[self._own(chunk, ids, order[inside], place)] = -np.inf
                floor = np.maximum(best.floor[chunk] - error, -2.0)
                if len(inside) > best.k:
                    floor = np.maximum(floor, reached_by(rough, best.k) - 2 * error)
                able = rough >= floor[:, None].astype(np.float32) - np.float32(1e-7)
                if len(inside) > best.k and np.count_nonzero(able) > 4 * best.k * len(chunk) + RESCORED:  # the best lie together in few parts
                    last = len(inside) - best.k
                    floor = np.maximum(floor, np.partition(rough, last, axis=1)[:, last] - 2 * error)
                    able = rough >= floor[:, None].astype(np.float32) - np.float32(1e-7)
                rows, cols = np.nonzero(able)
                values = rough[rows, cols]
                ends = np.searchsorted(rows, np.arange(len(chunk) + 1))
                full = np.flatnonzero(np.diff(ends) >= best.k)
                floor[full] = np.maximum(floor[full], values[np.lexsort((-values, rows))][ends[full] + best.k - 1] - 2 * error)
                near = values >= floor[rows].astype(np.float32) - np.float32(1e-7)
                rows, cols = rows[near], cols[near]
                best.keep(chunk[rows], order[inside[cols]], self._exact(chunk[rows], vectors, inside[cols]), ids)

    def _own(self, chunk: np.ndarray, ids: np.ndarray, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of queries and the items with their own id."""
        found = np.minimum(np.searchsorted(ids, self.qids[chunk]), len(ids) - 1)
        rows = np.flatnonzero(ids[found] == self.qids[chunk])
        low, high = (np.searchsorted(order[place], found[rows], side=side) for side in ("left", "right"))
        counts = high - low
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(rows, counts), place[np.repeat(low, counts) + nth]

    def _exact(self, rows: np.ndarray, vectors: list[np.ndarray], cols: np.ndarray) -> np.ndarray:
        matrix, norms = vectors
        slices = [slice(i, i + RESCORED) for i in range(0, len(rows), RESCORED)]
        parts = [np.einsum("ij,ij->i", self.matrix[rows[at]], matrix[cols[at]] / norms[cols[at]]) for at in slices]
        return np.round(np.concatenate(parts), DIGITS) if parts else np.zeros(0)


def _prepared(queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    scope = F.col("scope") if "scope" in queries.columns else F.lit(None).cast("array<bigint>")
    category = F.col("category_id").cast("bigint") if "category_id" in items.columns else F.lit(None).cast("bigint")
    q = queries.where("embedding IS NOT NULL").select(F.col("qid").cast("string"), "embedding", scope.alias("scope"))
    i = items.where("embedding IS NOT NULL").select(F.col("id").cast("string"), "embedding", category.alias("category_id"))
    return q, i


def exact_topk(queries: DataFrame, items: DataFrame, k: int, *, threshold: float = -2.0, exclude_self: bool = False) -> DataFrame:
    """(qid, id, similarity, rank): the k most similar items of every query.

    ``queries`` holds qid, embedding and optionally ``scope`` (allowed category ids, null = any); ``items``
    holds id, embedding and optionally category_id. A query table proven to fit one block is broadcast and
    the items are scanned where they are. A larger one is joined block by block, which stays exact.
    """
    q, i = _prepared(queries, items)
    if at_most(q, QUERY_BLOCK):
        partial = _scan_with_broadcast(q, i, k, threshold, exclude_self)
    else:
        one = F.lit("all")
        partial = block_topk(q.withColumn("grp", one), i.withColumn("grp", one), k, threshold, exclude_self)
    return best_per_query(partial, k)


def best_per_query(partial: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def _scan_with_broadcast(q: DataFrame, i: DataFrame, k: int, threshold: float, exclude_self: bool) -> DataFrame:
    table = q.toArrow()
    block = QueryBlock(table.column("qid").to_pylist(), unit_rows(table.column("embedding")), table.column("scope").to_pylist())
    shared = q.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = BestPerQuery(len(queries.qids), k, threshold)
        for batch in batches:
            queries.score(batch, best, exclude_self)
        if len(best.q) or best.pending:
            yield best.batch(queries.qids)

    return i.mapInArrow(scan, PAIRS)


def block_topk(q: DataFrame, i: DataFrame, k: int, threshold: float = -2.0, exclude_self: bool = False) -> DataFrame:
    """Partial top-k inside each group ``grp``, as a block nested-loop join.

    A group is split into as many blocks as its size asks for, on both sides, so no task holds more than
    one block of each. Every query block meets every item block of its group exactly once.
    """
    counted = lambda df, name, rows: df.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias(name))
    blocks = counted(q, "q_blocks", min(JOIN_BLOCK, 2 * QUERY_BLOCK)).join(counted(i, "i_blocks", ITEM_BLOCK), "grp")
    blocks = small_side(blocks, 100_000)
    spread = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(blocks, "grp").withColumn("qb", spread("qid", "q_blocks")).withColumn("ib", every("i_blocks"))
    right = i.join(blocks, "grp").withColumn("ib", spread("id", "i_blocks")).withColumn("qb", every("q_blocks"))
    keys = ["grp", "qb", "ib"]

    def match(queries: pa.Table, items: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or items.num_rows == 0:
            return pa.table({"qid": pa.array([], pa.string()), "id": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        block = QueryBlock(queries.column("qid").to_pylist(), unit_rows(queries.column("embedding")), queries.column("scope").to_pylist())
        best = BestPerQuery(len(block.qids), k, threshold)
        block.score(items, best, exclude_self)
        return pa.Table.from_batches([best.batch(block.qids)])

    # Fresh aliases: both sides may come from the same table.
    left = left.select(*[F.col(c).alias(c) for c in (*keys, "qid", "embedding", "scope")])
    right = right.select(*[F.col(c).alias(c) for c in (*keys, "id", "embedding", "category_id")])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, PAIRS)


def approximate_topk(queries: DataFrame, items: DataFrame, k: int, *, dim: int, planes: int = 6, probes: int = 2, seed: int = 7,
                     exclude_self: bool = False) -> DataFrame:
    """Top-k among the items whose sign pattern over random planes is within ``probes`` flips of the query's.

    Candidates are scored exactly; a crowded bucket is split into blocks, so no bucket lands on one task.
    """
    q, i = _prepared(queries, items)
    normals = np.random.default_rng(seed).standard_normal((planes, dim))

    def bucket_bits(column: pa.Array) -> np.ndarray:
        return (unit_rows(column) @ normals.T > 0).astype(np.int64) @ (1 << np.arange(planes))

    def add_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bucket_bits(batch.column("embedding")), pa.int64())],
                names=[*batch.schema.names, "bits"])

    tag = lambda df: df.mapInArrow(add_bucket, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", bits bigint")
    near = [m for m in range(1 << planes) if bin(m).count("1") <= probes]
    flips = F.explode(F.array(*[F.lit(m).cast("bigint") for m in near]))
    probed = tag(q).withColumn("flip", flips).withColumn("grp", F.col("bits").bitwiseXOR(F.col("flip")).cast("string"))
    stored = tag(i).withColumn("grp", F.col("bits").cast("string"))
    return best_per_query(block_topk(probed, stored, k, exclude_self=exclude_self), k)


def nearest_prototype(products: DataFrame, prototypes: DataFrame, block: int = 10_000) -> DataFrame:
    """(id, label, similarity): the most similar class prototype of each product; ties take the first label.

    Any number of prototypes is taken, in blocks of about ``block`` that fit a broadcast.
    """
    blocks = max(1, -(-prototypes.count() // block))
    if blocks == 1:
        return _nearest_of(products, prototypes)
    parts = [_nearest_of(products, prototypes.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == n)) for n in range(blocks)]
    found = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "label")).alias("best"))
    return found.select("id", F.col("best.label").alias("label"), (-F.col("best.s")).alias("similarity"))


def _nearest_of(products: DataFrame, prototypes: DataFrame) -> DataFrame:
    table = prototypes.select(F.col("label").cast("string"), "embedding").orderBy("label").toArrow()
    if table.num_rows == 0:
        raise ValueError("at least one prototype is required")
    labels, matrix = np.asarray(table.column("label").to_pylist(), dtype="U"), unit_rows(table.column("embedding"))
    shared = products.sparkSession.sparkContext.broadcast((labels, matrix))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, protos = shared.value
        for batch in batches:
            scores = np.round(unit_rows(batch.column("embedding")) @ protos.T, DIGITS)
            best = scores.argmax(axis=1) if len(scores) else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names[best], pa.string()), pa.array(scores[np.arange(len(best)), best], pa.float64())],
                names=["id", "label", "similarity"])

    rows = products.where("embedding IS NOT NULL").select(F.col("id").cast("string"), "embedding")
    return rows.mapInArrow(assign, "id string, label string, similarity double")
