"""Merkle manifest of a dataset, with inclusion proofs by pointer jumping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import ascii_lower, positions
from vitrine.session import cut_lineage

#: Consecutive nodes that become one node of the next level.
ARITY = 16
#: Columns that a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
#: Name of the tree over all sources; those of sources are empty or start with "=".
TOP = "*"
#: Every so many rows, by hash of the id, are tampered with in ``tampered_manifest``.
TAMPERED = 5


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def build(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Trees over nodes (tree, idx, digest), idx gapless from 0: their inner nodes (tree, level, idx, digest, run) and tops (tree, level, digest).

    ``run`` holds the digests of the node's children, one after the other. A level is one grouping into runs of ARITY, of
    any tree's size; the loop ends with the tallest tree.
    """
    inner, tops, level = None, None, 0
    while True:
        runs = nodes.groupBy("tree", F.floor(F.col("idx") / ARITY).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        runs = cut_lineage(runs.select("tree", "idx", F.size("kids").alias("n"), F.array_join(F.col("kids.digest"), "").alias("run")))
        alone = (F.col("idx") == 0) & (F.col("n") == 1)
        done = runs.where(alone).select("tree", F.lit(level).alias("level"), F.col("run").alias("digest"))
        tops = done if tops is None else tops.union(done)
        level += 1
        made = runs.where(~alone).select("tree", F.lit(level).alias("level"), "idx", F.sha2("run", 256).alias("digest"), "run")
        if made.isEmpty():
            return inner, tops
        inner = made if inner is None else inner.union(made)
        nodes = made.select("tree", "idx", "digest")


def _key(tree: Column, level: Column, idx: Column) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


def _segment(pos: Column, run: Column, top: bool) -> Column:
    return F.array(F.struct(pos.cast("int").alias("pos"), run.alias("run"), F.lit(top).alias("top")))


def jumped(nodes: DataFrame) -> DataFrame:
    """Nodes (key, run, seg, ptr) with their segments up to the root: pointer jumping.

    A node holds the runs between itself and ``ptr``, an ancestor. A round joins every node with its ancestor, appends the
    ancestor's segment and takes over its pointer, so distances double. Nodes that have reached the root rest.
    """
    ended = None
    while True:
        rest = nodes.where("ptr IS NULL")
        ended = rest if ended is None else ended.union(rest)
        open_ = nodes.where("ptr IS NOT NULL")
        if open_.isEmpty():
            return ended
        known = ended.union(open_).select(F.col("key").alias("ptr"), F.col("seg").alias("more"), F.col("ptr").alias("next"))
        nodes = cut_lineage(open_.join(known.hint("merge"), "ptr").select("key", "run", F.concat("seg", "more").alias("seg"), F.col("next").alias("ptr")))


def _linked(inner: DataFrame, top: bool) -> DataFrame:
    """Nodes of a tree under its top, each with the run of its parent and a pointer to it."""
    key = _key(F.col("tree"), F.col("level"), F.col("idx"))
    up = _key(F.col("tree"), F.col("level") + 1, F.floor(F.col("idx") / ARITY))
    below = inner.select(key.alias("key"), "run", up.alias("ptr"), (F.col("idx") % ARITY).alias("pos"))
    return below.join(inner.select(key.alias("ptr"), F.col("run").alias("above")).hint("merge"), "ptr").select("key", "run", _segment(F.col("pos"), F.col("above"), top).alias("seg"), "ptr")


def merkle_proofs(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, the carried columns, ``leaf``, ``subroot``, ``root``, and ``path``, its inclusion proof.

    A leaf is the SHA-256 of FIELDS, each as null mark or with its byte count. Per source, leaves stand in order of doc_id
    (nulls first, equal ids by leaf); every ARITY consecutive nodes become one until one is left, the subroot. Subroots in
    bytewise order of source, null first, become the root in the same way. ``path`` has a step (pos, run, top) for each level
    up to the root: the digests of the node's run, and the place of its own among them; ``top`` marks steps over sources.
    Only FIELDS are read. Rows repeated are leaves of their own. An empty table gives an empty result.

    Leaves reach the root last, by one join with the parents, whose paths are found by pointer jumping first: the paths of
    a sixteenth of the nodes travel, and no key has more than ARITY leaves. Numbering deals rows by range of (source,
    doc_id), so a source may hold any part of them.
    """
    carried = carried or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select("doc_id", *[c.alias(n) for n, c in carried.items()], tree.alias("tree"), leaf([F.col(f) for f in FIELDS]).alias("leaf"))
    leaves = cut_lineage(leaves).withColumn("row", F.monotonically_increasing_id())
    leaves = cut_lineage(positions(leaves, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")], "idx").drop("row"))
    inner, tops = build(leaves.select("tree", "idx", F.col("leaf").alias("digest")))
    tops = cut_lineage(positions(tops, [], [F.col("tree")], "at"))
    above, root = build(tops.select(F.lit(TOP).alias("tree"), F.col("at").alias("idx"), "digest"))
    root = root.first()
    if root is None:
        digest = F.lit(None).cast("string")
        return leaves.select("doc_id", *carried, "leaf", digest.alias("subroot"), digest.alias("root"), F.expr("CAST(array() AS array<struct<pos:int,run:string,top:boolean>>)").alias("path"))
    parts = [_linked(inner, False)] if inner is not None else []
    runs = tops.select("tree", F.col("level").alias("height"), "at", F.lit(None).cast("string").alias("run"))
    if inner is not None:  # a source of one leaf has a step without a run in place of its top node
        runs = runs.drop("run").join(inner.select("tree", F.col("level").alias("height"), "run", "idx").where("idx = 0").drop("idx").hint("merge"), ["tree", "height"], "left")
    name = _key(F.col("tree"), F.greatest("height", F.lit(1)), F.lit(0))
    if above is None:
        none = F.expr("CAST(array() AS array<struct<pos:int,run:string,top:boolean>>)")
        parts.append(runs.select(name.alias("key"), "run", none.alias("seg"), F.lit(None).cast("struct<tree:string,level:int,idx:bigint>").alias("ptr")))
    else:
        key = _key(F.col("tree"), F.col("level"), F.col("idx"))
        last = above.agg(F.max("level")).first()[0]
        parts.append(_linked(above, True))
        parts.append(above.where(F.col("level") == last).select(key.alias("key"), "run", F.expr("CAST(array() AS array<struct<pos:int,run:string,top:boolean>>)").alias("seg"), F.lit(None).cast("struct<tree:string,level:int,idx:bigint>").alias("ptr")))
        up = runs.select(name.alias("key"), "run", "at", _key(F.lit(TOP), F.lit(1), F.floor(F.col("at") / ARITY)).alias("ptr"))
        parts.append(up.join(above.select(key.alias("ptr"), F.col("run").alias("above")).hint("merge"), "ptr").select("key", "run", _segment(F.col("at") % ARITY, F.col("above"), True).alias("seg"), "ptr"))
    nodes = jumped(cut_lineage(reduce(DataFrame.union, [p.select("key", "run", "seg", "ptr") for p in parts])))
    parents = nodes.where(F.col("key.level") == 1).select(F.col("key.tree").alias("tree"), F.col("key.idx").alias("up"), "run", "seg")
    met = leaves.withColumn("up", F.floor(F.col("idx") / ARITY)).join(parents.hint("merge"), ["tree", "up"])
    own = F.when(F.col("run").isNotNull(), _segment(F.col("idx") % ARITY, F.col("run"), False))
    met = met.withColumn("path", F.coalesce(F.concat(own, "seg"), "seg"))
    over = F.filter("path", lambda s: s["top"])
    subroot = F.when(F.size(over) > 0, over[0]["run"].substr(over[0]["pos"] * HEX + 1, F.lit(HEX))).otherwise(F.lit(root.digest))
    return met.select("doc_id", *carried, "leaf", subroot.alias("subroot"), F.lit(root.digest).alias("root"), "path")


def _left(step: Column) -> Column:
    return step["run"].substr(F.lit(1), step["pos"] * HEX)


def _right(step: Column) -> Column:
    return step["run"].substr((step["pos"] + 1) * HEX + 1, F.length(step["run"]))


def siblings(path: Column) -> Column:
    """The digests of a proof, level by level and left to right, without the nodes' own."""
    return F.array_join(F.transform(path, lambda s: F.concat(_left(s), _right(s))), "")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf_digest, lambda node, s: F.sha2(F.concat(_left(s), node, _right(s)), 256))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Proofs put to the test: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Where TAMPERED divides the crc32 of the decimal doc_id, the leaf is made anew from the text with A-Z lower-cased; every
    other row keeps its leaf, rows without an id too. ``folded_root`` is what the row's proof makes of it, and ``verified``
    tells whether that is the root. Cases as in ``merkle_proofs``.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    changed = leaf([ascii_lower(F.col("text").cast("string")) if f == "text" else F.col(f) for f in FIELDS])
    rows = merkle_proofs(docs, {"forged": F.when(chosen, changed)})
    rows = rows.withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
