"""Registered streaming jobs: the driver's tables replayed as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry import views
from registry.core import Tables, query
from registry.ingest_queries import DECIDED, KEYED
from registry.post_queries import price_sql

from vitrine.session import scratch_folder
from vitrine.streaming import jobs as J
from vitrine.taxonomy import FASHION, FASHION_WORDS


def as_stream(t: Tables, table: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of part files: a path with a pattern may name either."""
    source = getattr(t, table)
    return t.spark.readStream.schema(source.schema).parquet(f"{t.sf_dir}/{{{table}}}.parquet")


def stream_view(t: Tables, view: str, table: str) -> DataFrame:
    return t.spark.sql(views.spark_sql(view), **{table: as_stream(t, table)})


def totals(t: Tables, df: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    """Run windowed totals in update mode over what is there, and read their store."""
    out = scratch_folder(t.spark, name)
    run = J.upsert_stream(df, out, f"{out}-state", keys).trigger(availableNow=True).start()
    run.awaitTermination()
    return J.totals_store(t.spark, out, df.schema, keys).read()


@query("stream_engagement", f"""
    WITH e AS (SELECT product_id AS id, action, exp(-greatest(0, date_diff('day', ts::DATE, DATE '2024-02-01') - 1) / 30.0) AS w FROM interactions)
    SELECT id, round_even(sum(CASE WHEN action = 'save' THEN w ELSE 0 END), 6) AS saves, round_even(sum(CASE WHEN action = 'click' THEN w ELSE 0 END), 6) AS clicks, round_even(sum(CASE WHEN action = 'view' THEN w ELSE 0 END), 6) AS impressions FROM e GROUP BY 1""")
def _(t):
    daily = totals(t, J.engagement_stream(stream_view(t, "interactions", "events")), "engagement", ("day", "product_id", "event"))
    rows = J.engagement_from_daily(daily, t.now)
    return rows.select("id", *[F.bround(c, 6).alias(c) for c in ("saves", "clicks", "impressions")])


@query("stream_search_metrics", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS searches, count(*) FILTER (CASE WHEN event_type = 'error' THEN 0 ELSE user_id % 16 END = 0) AS zero_results, round_even(avg(CAST(event_id % 2 = 0 AS INT)), 6) AS cache_hit_rate FROM events GROUP BY 1""")
def _(t):
    log = as_stream(t, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 0).otherwise(F.col("user_id") % 16).alias("result_count"), (F.col("event_id") % 2 == 0).alias("cache_hit"))
    rows = totals(t, J.search_metrics_stream(log), "search-metrics", ("hour",))
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "searches", "zero_results", F.bround("cache_hit_rate", 6).alias("cache_hit_rate"))


@query("stream_dedupe_posts", f"WITH {KEYED} SELECT doc_id, k_id, k_url, k_image FROM pu")
def _(t):
    base = scratch_folder(t.spark, "posts")
    run = J.dedupe_stream(stream_view(t, "posts", "documents"), f"{base}/kept", f"{base}/seen", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.parquet(f"{base}/kept").select("doc_id", "k_id", "k_url", "k_image")


@query("stream_ingest", f"""
    WITH {KEYED}, {DECIDED} SELECT product_url, product_name, coalesce({price_sql('description')}, 0)::DOUBLE AS price, nullif(slug, '') AS normalized_subcategory
    FROM dd WHERE decision IN ('INSERT', 'UPDATE') AND doc_id IN (SELECT doc_id FROM pu)""")
def _(t):
    base = scratch_folder(t.spark, "ingest")
    paths = {n: f"{base}/{n}" for n in ("products", "audit", "failures", "brands")}
    t.brands.write.mode("overwrite").parquet(paths["brands"])
    posts = stream_view(t, "posts", "documents")
    job = J.ingest_stream(posts, paths, f"{base}/state", t.categories, FASHION, FASHION_WORDS, t.now, "doc_id")
    run = job.trigger(availableNow=True).start()
    run.awaitTermination()
    schema = J.product_schema(posts, t.categories, FASHION, FASHION_WORDS)
    return J.product_store(t.spark, paths["products"], schema).read().select("product_url", "product_name", "price", "normalized_subcategory")
