"""Exact Jaccard join of word n-gram sets by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. Cut into fragments, it cuts every set into segments. Two
linked sets differ in at most (100 - p) / (100 + p) of their sizes' sum, so among one fragment more than that, one segment
at least is the same in both: those fragments' segment digests are the keys under which sets meet. Sets that met are
compared fragment by fragment, and the partial overlaps are summed per pair. Nothing depends on chance: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrow import text_slices
from vitrine.llm.common import sifted, with_group_facts
from vitrine.llm.components import connected_components
from vitrine.llm.links import closed, prefix_pairs, spanning_cells, star_pairs, with_components
from vitrine.llm.shingles import WordHashes, long_lists, mixed, set_digest, shingle_set
from vitrine.session import cut_lineage

#: Words of an n-gram, and similarity at which sets are linked, as per cent of their union.
WIDTH, PER_CENT = 3, 90
#: Fragments in which partial overlaps are counted.
FRAGMENTS = 16
CLASS = "struct<a:bigint,b:bigint>"


class Bands:
    """Size bands such that linked sets are in one band or in neighbouring ones, and the fragments that each band needs."""

    def __init__(self, per_cent: int):
        self.per_cent, self.starts = per_cent, np.array([1, 2], np.int64)

    def reach(self, size: int) -> int:
        """The largest size that a set of this size can be linked with."""
        return 100 * size // self.per_cent

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            low, high = (int(x) for x in self.starts[-2:])
            self.starts = np.append(self.starts, max(high + 1, self.reach(high - 1) + 1))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def fragments(self, band: int) -> int:
        """One more than the most shingles in which a set of the band and a linked one, no smaller, can differ."""
        largest = int(self.starts[band + 1]) - 1
        return (100 - self.per_cent) * (largest + self.reach(largest)) // (100 + self.per_cent) + 1


def segment_keys(shingles: np.ndarray, band: int, fragments: int) -> np.ndarray:
    """One key for each segment of a sorted set: its digest, salted with the band and the fragment. Empty segments have one too."""
    ends = np.arange(1, fragments, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // fragments)
    at = np.concatenate(([0], np.searchsorted(shingles, ends), [len(shingles)]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(shingles), dtype=np.uint64)))
    salt = mixed(np.arange(fragments, dtype=np.uint64) + np.uint64(band << 32))
    return mixed((sums[at[1:]] - sums[at[:-1]]) ^ salt)


def set_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys of a set in its own band, and in the one below, where smaller partners may be."""
    band = bands.of(len(shingles))
    return np.concatenate([segment_keys(shingles, b, bands.fragments(b)) for b in (band - 1, band) if b >= 0])


def _digests(sets: list[np.ndarray]) -> pa.StructArray:
    pairs = [set_digest(s) for s in sets]
    return pa.StructArray.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def keyed_documents(docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Rows (doc_id, n_shingles, class, keys): a digest of the row's set, and its segment keys (null without words or id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands = WordHashes(), Bands(per_cent)
        for batch, texts in text_slices(batches, "text", 2 << 20):
            sets = [shingle_set(t, hashes, width) for t in pc.cast(texts, pa.binary()).to_pylist()]
            named = batch.column(0).is_valid().to_pylist()
            keys = [set_keys(s, bands) if len(s) and ok else None for s, ok in zip(sets, named)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _digests(sets), long_lists(keys)], ["doc_id", "n_shingles", "class", "keys"])

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_shingles long, class {CLASS}, keys array<long>")


def segments(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, fragment, shingles): the sets of the given texts, cut into FRAGMENTS segments; empty ones have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ends = WordHashes(), np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // FRAGMENTS)
        for _, texts in text_slices(batches, "text", 2 << 20):
            sets = [shingle_set(t, hashes, width) for t in pc.cast(texts, pa.binary()).to_pylist()]
            cut = [(row, n, part) for row, s in enumerate(sets) for n, part in enumerate(np.split(s, np.searchsorted(s, ends))) if len(part)]
            ids = _digests(sets).take(pa.array([row for row, _, _ in cut], pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n, _ in cut], pa.int32()), long_lists([p for _, _, p in cut])], ["id", "fragment", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {CLASS}, fragment int, shingles array<long>")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b, size_a, size_b) with ``overlap``: partial overlaps are counted in every fragment and summed per pair.

    ``a`` may repeat without bound: it is met last, by a join that can split it.
    """
    met = pairs.join(parts.select(F.col("id").alias("b"), "fragment", F.col("shingles").alias("part_b")).hint("merge"), "b")
    met = met.join(parts.select(F.col("id").alias("a"), "fragment", F.col("shingles").alias("part_a")).hint("merge"), ["a", "fragment"])
    partial = met.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("both"))
    return partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("both").alias("overlap"))


def linked(pairs: DataFrame, parts: DataFrame, per_cent: int) -> DataFrame:
    found = overlaps(pairs, parts).where((100 + per_cent) * F.col("overlap") >= per_cent * (F.col("size_a") + F.col("size_b")))
    return cut_lineage(found.select("a", "b"))


def numbered_classes(signed: DataFrame) -> DataFrame:
    """Rows (class, doc, copies, size, id): every set that can be linked, its smallest doc_id and a number of its own."""
    able = signed.where("keys IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("size"))
    return cut_lineage(able).withColumn("id", F.monotonically_increasing_id())


def met_classes(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Cells (key, id, size, component) of the keys that more than one class has; most sets have none.

    Cells are dealt by key once, for the count and for the join with it, as two numbers each: the key and half of the class
    digest, which is enough to tell the classes of one key apart. The few that are left get their classes' numbers. A key has
    one row for each of its documents, of which every document has as many as a fifth of its n-grams: a key of a third of
    all documents is no more than a few tasks' mean.
    """
    able = signed.where("keys IS NOT NULL")
    cells = able.select(F.explode("keys").alias("key"), F.col("class.a").alias("half")).repartition("key")
    shared = cells.groupBy("key").agg(F.min("half").alias("h0"), F.max("half").alias("h1")).where("h0 <> h1").select("key")
    met = cells.join(shared.hint("merge"), "key", "left_semi").distinct()
    halves = classes.select(F.col("class.a").alias("half"), "id", "size")
    return cut_lineage(met.join(halves.hint("merge"), "half").select("key", "id", "size", F.col("id").alias("component")))


def parts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, fragment, shingles) for the given ids of classes."""
    wanted = cut_lineage(classes.join(ids.select("id").distinct().hint("merge"), "id", "left_semi"))
    named = wanted.select(F.col("doc").alias("doc_id")).distinct()
    cut = segments(sifted(docs, named, "doc_id").join(named.hint("merge"), "doc_id"), width).withColumnRenamed("id", "class")
    return cut_lineage(cut.join(wanted.select("class", "id").hint("merge"), "class").select("id", "fragment", "shingles").dropDuplicates(["id", "fragment"]))


def joined_classes(cells: DataFrame, classes: DataFrame, docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Components (id, component) of the classes that have a link.

    A round compares a key's members with one pivot: at most one pair for each cell. In keys that still span components the
    members outside the largest one meet some of its own; what is then apart meets by rare shingles. All are exact together,
    and no key is expanded into its pairs.
    """
    parts = parts_of(cells, classes, docs, width)
    spanning = cut_lineage(spanning_cells(cells))
    links = linked(star_pairs(spanning, per_cent), parts, per_cent)
    joined = connected_components(links)
    left = spanning.where("id <> pivot.id").select("key", "id", "size", "component")

    def shingles_of(members: DataFrame) -> DataFrame:
        return members.join(parts.hint("merge"), "id").select("id", "size", "component", F.explode("shingles").alias("s"))

    return closed(left, joined, per_cent, shingles_of, lambda pairs: linked(pairs, parts, per_cent))


def jaccard_join(docs: DataFrame, *, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id``.

    Documents with 100 * intersection >= per_cent * union of their distinct word n-grams are linked, after A-Z are
    lower-cased; fewer words than ``width`` are one n-gram. ``component_id`` is the smallest id reachable over links and
    ``class_id`` the smallest id with the same set. A null, empty or blank text has no n-grams and is linked with nothing,
    as is a row with a null id (its component is null). Repeated rows share a class; ties cannot occur. An empty table
    gives an empty result. Only the columns doc_id and text are read, whole.
    """
    signed = cut_lineage(keyed_documents(docs, width, per_cent))
    classes = numbered_classes(signed)
    components = joined_classes(met_classes(signed, classes), classes, docs.select("doc_id", "text"), width, per_cent)
    rows = signed.drop("keys").withColumn("able", F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    named = cut_lineage(with_components(classes.select("class", "doc", "copies", "id", F.col("id").alias("component")), components))
    named = named.join(named.groupBy("component").agg(F.min("doc").alias("component_id")).hint("merge"), "component")
    facts = cut_lineage(named.select("class", F.col("doc").alias("class_id"), "copies", "component_id"))
    met = with_group_facts(rows.where("able"), facts, ["class"], "copies", signed.count()).select("doc_id", "n_shingles", "component_id", "class_id")
    alone = rows.where("NOT able").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("class_id"))
    return met.unionByName(alone)


def jaccard_links(docs: DataFrame, *, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """The links themselves: ``class_a, class_b, overlap, size_a, size_b`` between different sets, each named by its smallest doc_id.

    Every pair of different sets at ``per_cent`` or more has one row; documents with the same set are not expanded into
    pairs. Candidates are sets that share a rare shingle at places that leave room for the overlap. The result is as large
    as there are links, so a group of near copies has a row for each of its pairs. Cases as in ``jaccard_join``.
    """
    signed = cut_lineage(keyed_documents(docs, width, per_cent))
    classes = numbered_classes(signed)
    cells = met_classes(signed, classes).select("id", "size").distinct()
    parts = parts_of(cells, classes, docs.select("doc_id", "text"), width)
    names = classes.select("id", "doc")
    shingles = cells.join(parts.hint("merge"), "id").select("id", "size", F.col("id").alias("component"), F.explode("shingles").alias("s"))
    found = overlaps(prefix_pairs(shingles, per_cent), parts).where((100 + per_cent) * F.col("overlap") >= per_cent * (F.col("size_a") + F.col("size_b")))
    named = found.join(names.withColumnsRenamed({"id": "a", "doc": "class_a"}).hint("merge"), "a").join(names.withColumnsRenamed({"id": "b", "doc": "class_b"}).hint("merge"), "b")
    return named.select("class_a", "class_b", "overlap", "size_a", "size_b")
