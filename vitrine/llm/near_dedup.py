"""MinHash near-dedup with tensored banding.

Joins between tables that grow with the corpus are merge joins by hint: they split skewed keys, and the driver builds no
broadcast for the many small tables of the last rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrow import text_slices
from vitrine.llm.common import repeat_rows, row_key, sifted, with_group_facts
from vitrine.llm.components import connected_components
from vitrine.llm.links import closed, neighbourhoods, spanning_cells, star_pairs, with_components
from vitrine.llm.shingles import SHINGLE, MinHasher, WordHashes, long_lists, mixed, set_digest, shingle_set
from vitrine.session import cut_lineage


@dataclass(frozen=True)
class Tensor:
    """Two collections of ``slots`` groups of ``width`` minhashes; each pair of a left and a right group keys one table.

    2 * slots * width minhashes make slots ** 2 tables of 2 * width minhashes. A pair with similarity s shares a table with
    probability (1 - (1 - s ** width) ** slots) ** 2: at 0.85 that is 0.99985 for 10 slots of 3, with 60 minhashes in
    place of 600.
    """

    slots: int = 10
    width: int = 3
    seed: int = 1

    @property
    def hashes(self) -> int:
        return 2 * self.slots * self.width


#: Similarity at which documents are linked, as per cent of the union of their shingles.
PER_CENT = 85
CLASS = "struct<a:bigint,b:bigint>"


def _groups(minima: np.ndarray, tensor: Tensor) -> np.ndarray:
    """One hash for each group of minhashes: the left groups, then the right ones."""
    groups = minima.reshape(2 * tensor.slots, tensor.width)
    out = groups[:, 0]
    for k in range(1, tensor.width):
        out = mixed(out) ^ groups[:, k]
    return mixed(out)


def _digests(sets: list[np.ndarray]) -> pa.StructArray:
    pairs = [set_digest(s) for s in sets]
    return pa.StructArray.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def signatures(docs: DataFrame, tensor: Tensor, width: int, passed: list[str]) -> DataFrame:
    """Per row the passed columns, ``n_shingles``, ``class`` (a digest of the set) and ``slots`` (group hashes; null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHasher(tensor.hashes, tensor.seed)
        for batch, texts in text_slices(batches, "text"):
            sets = [shingle_set(t, hashes, width) for t in pc.cast(texts, pa.binary()).to_pylist()]
            slots = [_groups(minhash.minima(s), tensor) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), _digests(sets), long_lists(slots)],
                [*passed, "n_shingles", "class", "slots"])

    given = docs.select(*passed, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in passed)
    return given.mapInArrow(run, f"{kinds}, n_shingles long, class {CLASS}, slots array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, shingles): the full set of every row under its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, texts in text_slices(batches, "text"):
            sets = [shingle_set(t, hashes, width) for t in pc.cast(texts, pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([_digests(sets), long_lists(sets)], ["id", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {CLASS}, shingles array<long>")


def shared_slots(classes: DataFrame, tensor: Tensor) -> DataFrame:
    """Classes (id, size, component, slots) with the group hashes that a class of another component has too.

    A group hash without such a partner can be part of no useful key. Most classes have none on one of the two sides, and
    go here, before any table is keyed.
    """
    slots = classes.select("id", "size", "component", F.explode("slots").alias("s"))
    shared = slots.groupBy("s").agg(F.min("component.a").alias("c0"), F.max("component.a").alias("c1")).where("c0 <> c1").select("s")
    met = slots.join(shared.hint("merge"), "s", "left_semi").groupBy("id", "size", "component").agg(F.collect_list("s").alias("slots"))
    return met.where(F.exists("slots", lambda s: s["slot"] < tensor.slots) & F.exists("slots", lambda s: s["slot"] >= tensor.slots))


def cells_of(classes: DataFrame, tensor: Tensor, diagonal: bool) -> DataFrame:
    """Rows (key, id, size, component): a class' cells in the tables on the tensor's diagonal, or in all of them."""
    left = classes.select("*", F.explode(F.filter("slots", lambda s: s["slot"] < tensor.slots)).alias("l"))

    def mate(right: Column) -> Column:
        mates = right["slot"] >= tensor.slots
        return mates & (right["slot"] - tensor.slots == F.col("l.slot")) if diagonal else mates

    both = left.select("id", "size", "component", "l", F.explode(F.filter("slots", mate)).alias("r"))
    return both.select(F.xxhash64("l", "r").alias("key"), "id", "size", "component")


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``a`` may repeat without bound: it is met last, by a join that can split it."""
    met = pairs.join(sets.withColumnsRenamed({"id": "b", "shingles": "set_b"}).hint("merge"), "b")
    met = met.join(sets.withColumnsRenamed({"id": "a", "shingles": "set_a"}).hint("merge"), "a")
    links = met.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return links.where((100 + per_cent) * F.col("both") >= per_cent * F.col("sum")).select("a", "b")


def class_components(classes: DataFrame, docs: DataFrame, tensor: Tensor, width: int, per_cent: int) -> DataFrame:
    """Rows (id, component) for the classes (id, doc, size, slots) that have a link.

    The tables on the tensor's diagonal come first. What they join to a pivot is one component in the next round, which keys
    all tables, so a large group of near copies is keyed ``slots`` times and not ``slots`` squared times. A round compares the
    members of a bucket with one pivot, at most one pair for each cell. In buckets that still span components after both rounds
    the members outside the largest component meet some of its own, and what is then apart goes to a join on rare shingles,
    which finds every link between components that is left.
    """
    numbered = F.transform("slots", lambda hash, at: F.struct(at.alias("slot"), hash.alias("hash")))
    alone = classes.select("id", "size", F.col("id").alias("component"), numbered.alias("slots"))
    shared = cut_lineage(shared_slots(alone, tensor))
    wanted = cut_lineage(classes.join(shared.select("id").hint("merge"), "id", "left_semi").select(F.col("doc").alias("doc_id")).distinct())
    sets = cut_lineage(full_sets(sifted(docs, wanted, "doc_id").join(wanted.hint("merge"), "doc_id"), width))
    spanning = cut_lineage(spanning_cells(cells_of(shared, tensor, True)))
    links = cut_lineage(verified(star_pairs(spanning, per_cent), sets, per_cent))
    shared = shared_slots(with_components(shared, neighbourhoods(links, 1)), tensor)
    spanning = cut_lineage(spanning_cells(cells_of(shared, tensor, False)))
    links = links.union(cut_lineage(verified(star_pairs(spanning, per_cent), sets, per_cent)))
    joined = connected_components(links)
    left = spanning.where("id <> pivot.id").select("key", "id", "size", "component")

    def shingles_of(members: DataFrame) -> DataFrame:
        return members.join(sets.hint("merge"), "id").select("id", "size", "component", F.explode("shingles").alias("s"))

    return closed(left, joined, per_cent, shingles_of, lambda pairs: verified(pairs, sets, per_cent))


def _decide(docs: DataFrame, passed: list[str], tensor: Tensor, width: int, per_cent: int) -> DataFrame:
    """The passed columns of every row with n_shingles, component_id, and component and class_id (null where nothing can be linked).

    ``component`` is the component itself, as one of its classes: two components have one component_id where an id repeats.
    """
    signed = cut_lineage(signatures(docs, tensor, width, passed)).withColumn("able", F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    total = signed.count()
    classes = cut_lineage(signed.where("able").groupBy(F.col("class").alias("id")).agg(
        F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"), F.first("slots").alias("slots")))
    components = class_components(classes, docs.select("doc_id", "text"), tensor, width, per_cent)
    named = classes.select("id", "doc", "copies")
    named = cut_lineage(with_components(named.withColumn("component", F.col("id")), components))
    named = named.join(named.groupBy("component").agg(F.min("doc").alias("component_id")).hint("merge"), "component")
    facts = named.select(F.col("id").alias("class"), F.col("doc").alias("class_id"), "copies", "component", "component_id")
    rows = signed.select(*passed, "n_shingles", "class", "able")
    linked = with_group_facts(rows.where("able"), facts, ["class"], "copies", total).select(*passed, "n_shingles", "class_id", "component", "component_id")
    kind = docs.schema["doc_id"].dataType
    alone = rows.where("NOT able").select(*passed, "n_shingles", F.lit(None).cast(kind).alias("class_id"), F.lit(None).cast(CLASS).alias("component"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, *, tensor: Tensor = Tensor(), width: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, class_id``.

    Documents with 100 * intersection >= per_cent * union of their distinct word shingles are linked, after A-Z are
    lower-cased; ``component_id`` is the smallest id reachable over links and ``class_id`` the smallest id with the same
    set. A null, empty or blank text has no shingles and is linked with nothing, as is a row with a null id, whose
    component is null and which is kept. Fewer words than ``width`` are one shingle. Repeated rows share a class. Links are
    found by tensored banding, checked on full sets, and none that a table shows is left out. An empty table gives an
    empty result. Only the columns doc_id and text are read.
    """
    out = _decide(docs, ["doc_id"], tensor, width, per_cent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def drop_near_copies(docs: DataFrame, *, tensor: Tensor = Tensor(), width: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """The documents that stay, with all their columns: one row of each component, the one with its smallest id.

    Cases as in ``near_duplicates``; of a component's rows repeated with that id one stays, and rows
    without words or id all stay. Texts that are no near copies stay under a common id too.
    """
    hashed = docs.select(*row_key(docs), F.col("doc_id"), F.col("text"))
    out = cut_lineage(_decide(hashed, ["_h1", "_h2", "doc_id"], tensor, width, per_cent).where("doc_id = component_id OR component_id IS NULL"))
    firsts = out.where("class_id IS NOT NULL").groupBy("component").agg(F.min(F.struct("_h1", "_h2")).alias("key")).select("key.*", F.lit(1).cast("long").alias("n"))
    alone = out.where("class_id IS NULL").groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n"))
    return repeat_rows(docs, firsts.unionByName(alone))
