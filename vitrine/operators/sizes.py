"""Size checks before a side is broadcast, and joins that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000
HOT_ROWS = 500_000
SALTS = 64


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most ``rows`` rows. Reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the side is proven small; otherwise the plain table and a shuffle join."""
    return F.broadcast(df) if at_most(df, rows) else df


def skew_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_key: str, how: str = "inner") -> DataFrame:
    """Join where ``right`` has one row per key and says in ``rows_per_key`` how many left rows it meets.

    Keys with more than HOT_ROWS left rows are salted: their right row is repeated SALTS times and their
    left rows spread over the salts. There are at most (left rows / HOT_ROWS) such keys, so marking them on
    the left is a join with a short list; that list is broadcast when it is proven short.
    """
    hot = right.where(F.col(rows_per_key) > HOT_ROWS).select(*keys).withColumn("_hot", F.lit(True))
    marked = left.join(small_side(hot), list(keys), "left")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c not in keys]), F.lit(SALTS))
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0).cast("long"))).drop("_hot")
    copies = F.when(F.col(rows_per_key) > HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("_salt", F.explode(copies.cast("array<bigint>")))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
