"""Sharding by histogram sort: splitters from exact byte counts below probes, then one exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import positions, whole_text
from vitrine.session import cut_lineage

LEAST = -(1 << 63)
#: Probes per interval and round; a round brings back at most (shards - 1) * PROBES counts.
PROBES = 1_024
#: A splitter is good when the bytes below it miss their target by at most this part of a shard.
TOLERANCE = 0.001
#: The text key is the upper 63 bits of the text's 64-bit hash, so that intervals are differences of longs.
KEY_BITS = 63


@dataclass(frozen=True)
class Interval:
    """Keys that may hold a splitter. ``text`` is set once one text's rows (or equal hashes) are split by id."""

    low: int
    high: int
    below: int
    text: int | None = None

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low) // PROBES))

    def holds(self) -> Column:
        if self.text is None:
            return (F.col("k_text") >= self.low) & (F.col("k_text") <= self.high - 1)
        return (F.col("k_text") == self.text) & (F.col("k_id") >= self.low) & (F.col("k_id") <= self.high - 1)

    def probe(self) -> Column:
        if self.text is None:
            return F.expr(f"cast((k_text - {self.low}L) div {self.step}L as int)")
        wide = F.col("k_id").cast("decimal(20,0)") - F.lit(self.low).cast("decimal(20,0)")  # ids may span more than a long
        return F.floor(wide / F.lit(self.step).cast("decimal(20,0)")).cast("int")

    def splitter(self, edge: int) -> tuple[int, int]:
        return (edge, LEAST) if self.text is None else (self.text, edge)


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("k_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("k_id"))


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The shards - 1 keys (text key, id) at which a new shard begins.

    ``keys`` has k_text, k_id and size. Each round counts the exact bytes between probes in all open intervals with one
    combined aggregate, takes a probe that is near enough to a splitter's target, and otherwise opens the bin that the
    target lies in. A bin that is down to one text key is split by id, so one text may hold any part of all rows.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = {s: total * s // shards for s in range(1, shards)}
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    open_at = {s: Interval(0, 1 << KEY_BITS, 0) for s in targets} if total else {}
    while open_at:
        intervals = sorted(set(open_at.values()), key=lambda i: (i.text is not None, i.text or 0, i.low))
        where = F.lit(None).cast("struct<at:int,bin:int>")
        for n, interval in enumerate(intervals):
            where = F.when(interval.holds(), F.struct(F.lit(n).alias("at"), interval.probe().alias("bin"))).otherwise(where)
        counted = keys.select(where.alias("probe"), "size").where("probe IS NOT NULL").groupBy("probe.at", "probe.bin").agg(F.sum("size").alias("bytes")).collect()
        bins: dict[Interval, list[tuple[int, int]]] = {i: [] for i in intervals}
        for row in counted:
            bins[intervals[row["at"]]].append((row["bin"], row["bytes"]))
        crowded = set()
        for s, interval in list(open_at.items()):
            below = interval.below
            for number, held in sorted(bins[interval]):
                if below + held >= targets[s]:
                    break
                below += held
            low = interval.low + number * interval.step
            high = min(low + interval.step, interval.high)
            near_low, near_high = targets[s] - below, below + held - targets[s]
            if min(near_low, near_high) <= slack or (high - low == 1 and interval.text is not None):
                found[s] = interval.splitter(low if near_low <= near_high else high)
                del open_at[s]
            elif high - low == 1:
                crowded.add(low)
                open_at[s] = Interval(0, 0, below, low)
            else:
                open_at[s] = Interval(low, high, below, interval.text)
        if crowded:
            ends = {r["k_text"]: (r["a"], r["b"]) for r in keys.where(F.col("k_text").isin(sorted(crowded))).groupBy("k_text").agg(
                F.min("k_id").alias("a"), F.max("k_id").alias("b")).collect()}
            for s, interval in open_at.items():
                if interval.text in crowded and interval.low == interval.high == 0:
                    first, last = ends[interval.text]
                    open_at[s] = Interval(first, last + 1, interval.below, interval.text)
    return [found[s] for s in sorted(found)]


def shard_of(splitters: list[tuple[int, int]]) -> Column:
    number = F.lit(0)
    for text, ident in splitters:
        after = (F.col("k_text") > text - 1) if ident == LEAST else (F.col("k_text") > text) | ((F.col("k_text") == text) & (F.col("k_id") > ident - 1))
        number = number + after.cast("int")
    return number


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: shards hold near equal bytes, where a document counts its UTF-8 bytes plus 1. Documents stand in
    order of (text hash, id), so equal texts are neighbours and share a shard unless their group must be cut to keep
    the law. A null text counts as empty; a null id stands first among equal texts. Repeated rows are documents of
    their own. A shard may be empty when there are fewer documents than shards, and one document is never cut. An
    empty table gives an empty result.
    """
    keys = cut_lineage(keyed_documents(docs, id_col, text_col))
    placed = keys.withColumn("shard", shard_of(find_splitters(keys, shards, tolerance)).cast("int"))
    numbered = positions(placed, ["shard"], [F.col("k_text"), F.col("k_id"), F.col("text_crc32")], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> None:
    """Write whole rows to ``path/shard=N`` in key order; the rows cross the network once. Cases as in ``shard_documents``."""
    slim = cut_lineage(keyed_documents(docs, id_col, text_col).select("k_text", "k_id", "size"))
    splitters = find_splitters(slim, shards, tolerance)
    text = whole_text(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("k_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("k_id"))
    dealt = rows.withColumn("_shard", shard_of(splitters)).repartitionByRange("_shard", "k_text", "k_id").sortWithinPartitions("_shard", "k_text", "k_id")
    dealt.select("doc", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
