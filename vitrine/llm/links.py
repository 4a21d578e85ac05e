"""Links between similar sets without all pairs of a group: one pair a cell and round, then rare-shingle prefixes for the rest.

Cells are rows (key, id, size, component): ``id`` names a distinct set, ``component`` what it is known to be joined to.
Joins between tables that grow with the corpus are merge joins by hint, which split skewed keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.components import connected_components
from vitrine.session import cut_lineage

#: Members of a key's largest component that the key's other members are dealt to.
HEADS = 16


def spanning_cells(cells: DataFrame) -> DataFrame:
    """The cells of keys that hold several components, with the key's pivot: the member whose id has the smallest hash.

    Facts of a key are combined before the shuffle, and one row comes back for each cell, however large the key is.
    """
    ranked = F.struct(F.xxhash64(F.lit(7), "id").alias("rank"), "id", "size", "component")
    facts = cells.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min(ranked).alias("pivot")).where("c0 <> c1")
    return cells.join(facts.select("key", "pivot").hint("merge"), "key")


def star_pairs(spanning: DataFrame, per_cent: int) -> DataFrame:
    """Distinct pairs (a, b, size_a, size_b) of a pivot and a member of its key in another component, if their sizes allow a link."""
    apart = (F.col("pivot.component") != F.col("component")) & (100 * F.least("pivot.size", "size") >= per_cent * F.greatest("pivot.size", "size"))
    return spanning.where(apart).select(F.col("pivot.id").alias("a"), F.col("id").alias("b"), F.col("pivot.size").alias("size_a"), F.col("size").alias("size_b")).distinct()


def settling_pairs(cells: DataFrame, per_cent: int) -> DataFrame:
    """Distinct pairs (a, b, size_a, size_b) of a member of the key's largest component and one outside it, at most one a cell.

    A text that misses one pivot of a large group of near copies is linked with many others of the group; each of its keys
    deals it to another of at most HEADS members. Keys whose components have one member each give no pairs: their members are
    left to the prefix join, which finds every link either way.
    """
    head = F.struct(F.xxhash64("key", "id").alias("rank"), "id", "size")
    parts = cells.groupBy("key", "component", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(HEADS)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(head).alias("head"))
    groups = parts.groupBy("key", "component").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("head")).alias("heads"))
    largest = groups.groupBy("key").agg(F.max(F.struct("n", "component", "heads")).alias("largest")).where("largest.n > 1")
    met = cells.join(largest.hint("merge"), "key").where("component <> largest.component")
    met = met.select("id", "size", F.expr("largest.heads[cast(pmod(xxhash64(id, key), size(largest.heads)) AS int)]").alias("head"))
    met = met.where(100 * F.least("head.size", "size") >= per_cent * F.greatest("head.size", "size"))
    return met.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.size").alias("size_a"), F.col("size").alias("size_b")).distinct()


def neighbourhoods(links: DataFrame, hops: int = 0) -> DataFrame:
    """Rows (id, component): each id under the smallest pivot it is linked to, or that pivot's own, ``hops`` times. Parts of components."""
    names = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    for _ in range(hops):
        above = names.select(F.col("id").alias("component"), F.col("component").alias("above"))
        names = names.join(above.hint("merge"), "component", "left").select("id", F.coalesce("above", "component").alias("component"))
    return names


def with_components(rows: DataFrame, named: DataFrame) -> DataFrame:
    named = named.withColumnRenamed("component", "merged")
    return rows.drop("component").join(named.hint("merge"), "id", "left").withColumn("component", F.coalesce("merged", "id")).drop("merged")


def prefix_pairs(sets: DataFrame, per_cent: int) -> DataFrame:
    """Distinct pairs (a, b, size_a, size_b) of other components that share a rare shingle; every link between components is among them.

    ``sets`` has rows (id, size, component, s), one for each shingle of a set. Shingles are ordered by whether another
    component has them at all, then by frequency. Two linked sets share one of the first ``size - ceil(per_cent * size /
    100) + 1`` of each, at places that leave room for the overlap that a link needs. A text's own words come first in this
    order, so a passage that many texts share is no key unless little else is in them.
    """
    facts = sets.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    met = sets.join(facts.select("s", "n").hint("merge"), "s")
    ranked = met.groupBy("id", "size", "component").agg(F.array_sort(F.collect_set(F.struct("n", "s"))).alias("known"))
    own = F.col("size") - F.size("known")
    prefix = F.col("size") - F.ceil(F.lit(per_cent) * F.col("size") / 100) + 1
    keyed = ranked.where(own < prefix).select(
        "id", "size", "component", own.alias("own"), F.posexplode(F.slice("known", F.lit(1), (prefix - own).cast("int"))).alias("at", "shingle"))
    keyed = cut_lineage(keyed.select("id", "size", "component", F.col("shingle.s").alias("s"), (F.col("size") - F.col("own") - F.col("at")).alias("room")))
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = (F.col("a.s") == F.col("b.s")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
    alike = (100 + per_cent) * F.least("a.room", "b.room") >= per_cent * (F.col("a.size") + F.col("b.size"))
    met = a.join(b.hint("merge"), apart & alike)
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.size").alias("size_a"), F.col("b.size").alias("size_b")).distinct()


def crowded_members(cells: DataFrame) -> DataFrame:
    """Distinct members (id, size, component) of keys that hold several components.

    A member of a large group has a cell in many such keys, and one of them is enough: members show it by their first key,
    and only the others' cells are met with all keys.
    """
    crowded = cut_lineage(cells.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key"))
    first = cells.groupBy("id", "size", "component").agg(F.min("key").alias("key"))
    seen = cut_lineage(first.join(crowded.hint("merge"), "key", "left_semi").select("id", "size", "component"))
    others = cells.join(seen.select("id").hint("merge"), "id", "left_anti").join(crowded.hint("merge"), "key", "left_semi")
    return seen.union(others.select("id", "size", "component").distinct())


def extended(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) of what ``joined`` says and the links (a, b) together."""
    if links.isEmpty():
        return joined
    return connected_components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))


def closed(cells: DataFrame, joined: DataFrame, per_cent: int, shingles_of: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (id, component) of ``joined`` and of every link between members of the cells' keys.

    ``shingles_of`` gives rows (id, size, component, s) for members (id, size, component); ``check`` keeps the pairs that are
    links. What a large component is linked with joins it first, so that the prefix join meets only what is apart.
    """
    left = cut_lineage(with_components(cells, joined))
    joined = extended(joined, cut_lineage(check(settling_pairs(left, per_cent))))
    members = crowded_members(cut_lineage(with_components(left, joined)))
    return extended(joined, cut_lineage(check(prefix_pairs(cut_lineage(shingles_of(members)), per_cent))))
