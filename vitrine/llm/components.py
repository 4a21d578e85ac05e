"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import cut_lineage

#: Once at most this many edges are left between the contracted names, one task joins them; before that, rounds go on.
LAST_EDGES = 10_000


def _last_names(edges: DataFrame) -> DataFrame:
    """Rows (old, new) for the ends of at most LAST_EDGES edges: each component's names under one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: dict = {}

        def find(x):
            while leader.setdefault(x, x) != x:
                leader[x] = leader[leader[x]]
                x = leader[x]
            return x

        known, kind = {}, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = (tuple(v.values()) if isinstance(v, dict) else v for v in (a, b))
                known[x], known[y] = a, b
                leader[find(y)] = find(x)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(known.values(), kind), pa.array([known[find(x)] for x in known], kind)], ["old", "new"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"old {kind}, new {kind}")


def connected_components(edges: DataFrame, seed: int = 0) -> DataFrame:
    """From undirected edges (a, b) of one type, rows (id, component) for every id in an edge; component is its smallest id.

    In a round every node joins the neighbour with the smallest hash, itself included, and edges are rewritten to those
    names; edges inside a name go. Hash order shortens chains by a constant factor a round on average, where id order
    could walk along them one by one. Minima are combined before each shuffle, so a node with any number of edges is one
    row per task. The last LAST_EDGES edges are joined by one task. Only a count of edges reaches the driver.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    names = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("name", F.col("id"))
    turn = 0
    while True:
        count = edges.count()
        if count == 0:
            break
        few = count <= LAST_EDGES

        def ranked(c, turn=turn):
            return F.struct(F.xxhash64(F.lit(seed + turn), F.col(c)).alias("rank"), F.col(c).alias("node"))

        if few:
            joined = cut_lineage(_last_names(edges))
        else:
            both = edges.select("a", ranked("b").alias("to")).union(edges.select(F.col("b").alias("a"), ranked("a").alias("to")))
            nearest = both.groupBy("a").agg(F.min("to").alias("to"))
            joined = cut_lineage(nearest.select(F.col("a").alias("old"), F.least(F.col("to"), ranked("a"))["node"].alias("new")))
        names = names.join(joined.hint("merge"), names["name"] == joined["old"], "left").select("id", F.coalesce("new", "name").alias("name"))
        if few:
            break
        left = edges.join(joined.withColumnsRenamed({"old": "a", "new": "x"}).hint("merge"), "a").join(joined.withColumnsRenamed({"old": "b", "new": "y"}).hint("merge"), "b")
        edges = cut_lineage(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        turn += 1
        if turn % 4 == 0:
            names = cut_lineage(names)
    names = cut_lineage(names)
    smallest = names.groupBy("name").agg(F.min("id").alias("component"))
    return cut_lineage(names.join(smallest.hint("merge"), "name").select("id", "component"))
