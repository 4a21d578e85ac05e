"""What the corpus operators share: ASCII folding, gapless positions, joins with per-group facts, row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: At most this many groups are called hot, so that their facts fit a broadcast.
HOT_GROUPS = 1_000
#: Bits for each wanted key in the bitmap that sifts rows, and at most; a fuller bitmap lets more rows through.
BITS, MOST_BITS = 8, 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of each group from 0 in the given order; no task holds a whole group.

    Rows are dealt by range of (group, order); a partition's rows are numbered on their own and shifted by the
    group's rows in earlier partitions. The shift table has one row per partition and group that meet, which is at
    most partitions + groups. The dealt rows are checkpointed, because the ranges are sampled.
    """
    keys = [F.col(g) for g in group]
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_shift_part"),
                           F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(*group, "_part").orderBy(*order)
    numbered = dealt.withColumn("_own", F.row_number().over(own).cast("long") - 1)
    met = F.col("_part") == F.col("_shift_part")
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return numbered.join(shifts, met).select(*df.columns, (F.col("_own") + F.col("_shift")).alias(name))


def with_group_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Join every row with its group's facts (one row per group); groups of any size.

    A group with more than ``total`` / HOT_GROUPS rows is hot. There are fewer than HOT_GROUPS of them, so their facts
    are broadcast; the other groups are small against a partition and meet by shuffle.
    """
    bound = total // HOT_GROUPS + 1
    given = [c for c in facts.columns if c not in keys]
    hot = facts.where(F.col(size) > bound).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), list(keys), "left")
    crowded = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot IS NULL").drop("_hot", *given).join(facts.where(F.col(size) <= bound), list(keys))
    return crowded.unionByName(rest)


def sifted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``wanted``, and about an eighth of the others: what is worth a shuffle for an exact join.

    A bitmap of hashed keys is broadcast as 64-bit words, at most MOST_BITS / 64 of them. No wanted row is lost.
    Join the result with distinct keys: Spark would push a semi join below the broadcast, and shuffle everything.
    """
    bits = min(MOST_BITS, max(64, BITS * wanted.count()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)).alias("_place")
    words = wanted.select(place).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 AS int))")).alias("_bits"))
    met = rows.select("*", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(words), "_word")
    return met.where("_bits & shiftleft(1L, cast(_place & 63 AS int)) <> 0").select(*rows.columns)


def _hashed(value: Column, kind: T.DataType, seed: int) -> list[Column]:
    """What to hash of a value, so that unequal values give unequal lists: hashes skip nulls and run nested values together."""
    null = value.isNull()
    if isinstance(kind, T.StructType):
        return [null, *[c for f in kind.fields for c in _hashed(value[f.name], f.dataType, seed)]]
    if isinstance(kind, T.ArrayType):
        return [null, F.size(value), F.transform(value, lambda x: F.xxhash64(F.lit(seed), *_hashed(x, kind.elementType, seed)))]
    if isinstance(kind, T.MapType):
        entry = T.StructType().add("key", kind.keyType).add("value", kind.valueType)
        return [null, F.size(value), F.array_sort(F.transform(F.map_entries(value), lambda e: F.xxhash64(F.lit(seed), *_hashed(e, entry, seed))))]
    if isinstance(kind, T.VariantType):
        return [null, F.schema_of_variant(value), F.to_json(value)]
    return [null] if isinstance(kind, T.NullType) else [null, value]


def row_key(docs: DataFrame) -> list[Column]:
    """Two hashes with different seeds over all columns, nulls and nested values included. Rows that agree in both are interchangeable."""
    return [F.xxhash64(F.lit(seed), *[c for f in docs.schema.fields for c in _hashed(F.col(f"`{f.name}`"), f.dataType, seed)]).alias(f"_h{seed}") for seed in (1, 2)]


def repeat_rows(docs: DataFrame, times: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``times`` (_h1, _h2, n) says for all rows of a key together; others go.

    A row travels once, as one struct, so that no added column can clash with one of its own. Rows with one key are
    equal in all columns, and the first stands for them all.
    """
    whole = docs.select(*row_key(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    met = whole.join(times.select("_h1", "_h2", "n").where("n > 0"), ["_h1", "_h2"])
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy(F.lit(0)))).where("nth = 1")
    return first.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))).select("doc.*")
