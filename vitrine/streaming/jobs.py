"""Structured Streaming jobs: the batch expressions over streams of posts, events and search-log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.functions.text import or_else
from vitrine.operators.discovery import EVENT_NAMES, EVENTS
from vitrine.operators.sizes import small_side
from vitrine.plans.ingest import KEYS, dedupe_posts, ingest_decisions, post_keys, product_payload
from vitrine.sources.files import audit_rows, failure_rows
from vitrine.sources.store import BUCKETS, KeyedStore


def dedupe_stream(posts: DataFrame, out: str, seen: str, checkpoint: str, order_col: str = "doc_id", buckets: int = BUCKETS):
    """Start the dedupe of a post stream: posts whose id, URL and brand with image all occur for the first time.

    The rule of ``dedupe_posts``, over all batches: a post that is dropped still claims its keys, and absent keys match
    nothing. The keys seen so far are a store at ``seen``; a micro-batch looks up the buckets of its own keys and
    adds one delta, so nothing of the past is held in memory or rewritten. The kept posts go to ``out`` in folders named
    by the batch, before its keys are committed: a replay before that overwrites them, one after it is left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = KeyedStore(spark, seen, StructType().add("key", "string"), ("key",), buckets=buckets)
        if batch_id <= store.state().batch:
            return
        keyed = post_keys(batch)
        named = F.array(*[F.concat(F.lit(f"{k}="), F.col(k)) for k in KEYS])
        keys = keyed.select(F.explode(F.array_compact(named)).alias("key")).distinct().persist()
        try:
            known = store.read(store.touched(keys)).join(keys, "key", "left_semi").persist()
            fresh = post_keys(dedupe_posts(batch, order_col))
            for k in KEYS:
                old = small_side(known.where(F.col("key").startswith(f"{k}=")).select(F.substring("key", len(k) + 2, 2**31 - 1).alias(k)))
                fresh = fresh.join(old, k, "left_anti")
            fresh.select(*batch.columns, *KEYS).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            store.commit(keys.join(known, "key", "left_anti"), batch_id)
            known.unpersist()
        finally:
            keys.unpersist()

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def engagement_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Event totals per product, event and day; the decay is applied when the totals are read."""
    name = F.coalesce(*[F.when(F.col("action") == a, F.lit(n)) for a, n in EVENT_NAMES.items()], F.col("action"))
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("day"), "product_id", name.alias("event")).agg(F.count("*").alias("n")).select(
        F.col("day.start").alias("day"), "product_id", "event", "n")


def engagement_from_daily(daily: DataFrame, now: Column, tau: float = 30.0) -> DataFrame:
    """Decayed engagement per product from daily totals. With ``now`` at a UTC midnight this equals the event-level sum."""
    age = F.datediff(F.to_date(now), F.to_date("day")) - 1
    weight = F.col("n") * F.exp(-F.greatest(F.lit(0), age) / F.lit(tau))
    sums = daily.groupBy(F.col("product_id").alias("id")).agg(*[
        F.bround(F.sum(F.when(F.col("event") == e, weight).otherwise(0.0)), 9).alias(n) for e, n in zip(EVENTS, ("saves", "clicks", "impressions"))])
    points = F.col("saves") * 3 + F.col("clicks") * 1.5 + F.col("impressions") * 0.15
    return sums.withColumns({"engagement": F.when(points > 0, F.least(F.lit(1.0), points / 20)), "exposure_boost": 1 / (1 + F.col("impressions"))})


def search_metrics_stream(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Searches, zero-result searches and cache-hit rate per hour."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("searches"), F.count_if(F.col("result_count") == 0).alias("zero_results"),
        F.bround(F.avg(F.col("cache_hit").cast("double")), 9).alias("cache_hit_rate")).select(F.col("w.start").alias("hour"), "searches", "zero_results", "cache_hit_rate")


def product_store(spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS) -> KeyedStore:
    """The stored products of an ingest: one row per (source, product_url), in buckets of the URL."""
    return KeyedStore(spark, path, schema, ("source", "product_url"), ("product_url",), buckets)


def product_schema(posts: DataFrame, categories: DataFrame, taxonomy, words) -> StructType:
    """The schema of the products that posts of this schema become."""
    spark = posts.sparkSession
    none = spark.createDataFrame([], posts.schema)
    return product_payload(ingest_decisions(none, _no_urls(spark), categories, taxonomy, words)).schema


def ingest_stream(posts: DataFrame, paths: dict[str, str], checkpoint: str, categories: DataFrame, taxonomy, words, now: Column, order_col: str, buckets: int = BUCKETS):
    """Start the ingest of a post stream. ``paths`` names the folders: products, audit, failures, brands.

    Each micro-batch is deduplicated, decided and upserted on (source, product_url). It reads the buckets of its own URLs
    and writes one delta, whatever the size of the catalog; ``product_store`` reads the products back. The commit comes
    after the audit and failure rows, which are named by the batch: a batch replayed before its commit overwrites them,
    and one replayed after it is left out.
    """

    schema = product_schema(posts, categories, taxonomy, words)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = product_store(spark, paths["products"], schema, buckets)
        if batch_id <= store.state().batch:
            return
        incoming = dedupe_posts(batch, order_col).persist()
        stored = store.read(store.touched(incoming)).select("product_url")
        decided = ingest_decisions(incoming, stored, categories, taxonomy, words).persist()
        try:
            audit_rows(decided, str(batch_id), now).write.mode("overwrite").json(f"{paths['audit']}/batch={batch_id}")
            brands = spark.read.parquet(paths["brands"])
            failure_rows(decided, brands, now).write.mode("overwrite").json(f"{paths['failures']}/batch={batch_id}")
            store.commit(product_payload(decided.where(F.col("decision").isin("INSERT", "UPDATE"))), batch_id)
        finally:
            decided.unpersist()
            incoming.unpersist()

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def upsert_stream(totals: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...], buckets: int = BUCKETS):
    """Start a stream of windowed totals in update mode: a micro-batch sends the windows it changed, upserted by ``keys``.

    State is freed once the watermark has passed a window, and its last totals stay in the store. A replayed batch is
    left out. ``totals_store`` reads them back, windows that are still open included.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        totals_store(batch.sparkSession, path, batch.schema, keys, buckets).commit(batch, batch_id)

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def totals_store(spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, path, schema, keys, buckets=buckets)


def _no_urls(spark) -> DataFrame:
    return spark.createDataFrame([], "product_url string")
