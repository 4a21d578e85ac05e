"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, positions, repeat_rows, row_key, whole_text
from vitrine.session import cut_lineage

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_COPIES = 3
#: Bits of the random offset: few, so that offset plus prefix sum stays exact in a double.
OFFSET_BITS = 16


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source its size and its target: weighted shares of the whole, each at most ``most`` times its source.

    Excess is shared again by weight until no source is above. The level only rises, so a round is one sum over the
    per-source table, and two numbers come back to the driver.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(sources.withColumn("_null", F.col("source").isNull()), [], [F.col("_null"), F.col("source")], "nth")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = cut_lineage(ranked.select("source", "source_size", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int")).alias("weight")))
    top = F.col("source_size") * most
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped, rest, weight = 0.0, -1, total, 0
    while True:
        full = top < F.lit(level) * F.col("weight")
        now, held, left = ranked.agg(
            F.coalesce(F.sum(full.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(full, top)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        rest, weight = total - held, left
        if now == capped or weight == 0:
            break
        capped, level = now, rest / weight
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(weight, 1)))
    return ranked.select("source", "source_size", F.when(full, top.cast("double")).otherwise(share).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), from a hash of seed and source."""
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, OFFSET_BITS // 4), 16, 10).cast("double") / float(1 << OFFSET_BITS)


def mixing_plan(sized: DataFrame, order: Sequence[str], weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """Add source_size, target and copies to (source, size, ...) rows.

    Every document of a source expects target / source_size copies. Documents stand in order of size, the prefix sum of
    expected copies starts at the source's offset, and a document is taken once per integer that its interval crosses.
    By size, the words taken stay within a few of the longest documents' words of the target.
    """
    targets = source_targets(sized, weights, most)
    ranked = positions(sized, ["source"], [F.col("size"), *[F.col(c) for c in order]], "nth")
    facts = targets.withColumn("_name", F.col("source")).drop("source")
    joined = ranked.join(F.broadcast(facts) if _few(facts) else facts, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("source"), seed)
    copies = F.floor(rate * (F.col("nth") + 1) + start) - F.floor(rate * F.col("nth") + start)
    return joined.withColumn("copies", copies.cast("long")).drop("nth")


def _few(facts: DataFrame, rows: int = 10_000) -> bool:
    return facts.limit(rows + 1).count() <= rows


def text_size(text_col: str = "text") -> Column:
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    Size is the number of words of the text, 0 for null. Null is a source of its own, last in order. A source without
    words has target 0 and nothing is taken. Ties in size go by id, repeated rows are documents of their own. An empty
    table gives an empty result. Reruns agree: the offset is a hash of seed and source.
    """
    sized = docs.select("doc_id", "source", text_size().alias("size"))
    plan = mixing_plan(cut_lineage(sized), ["doc_id"], weights, most, seed)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as the plan takes it, with all its columns. Cases as in ``mix_sources``."""
    sized = cut_lineage(docs.select(*row_key(docs), F.col("doc_id").alias("id"), F.col("source").alias("source"), text_size().alias("size")))
    plan = mixing_plan(sized, ["id", "_h1", "_h2"], weights, most, seed)
    return repeat_rows(docs, plan.groupBy("_h1", "_h2").agg(F.sum("copies").alias("n")))
