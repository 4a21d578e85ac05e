"""Registered search-log, ingestion-run, user-activity and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import hardware as H
from registry.core import NOW, query
from registry.discovery_queries import GEM_SQL, RAIL_SQL, diversify_sql, scored
from registry.hardware import lit, part
from registry.scalar_queries import enriched, joined
from vitrine.operators import activity as A
from vitrine.operators import discovery as D
from vitrine.session import scratch_folder
from vitrine.sources.files import append_audit, read_ingestion_audit


def nearest(p: float) -> str:
    return f"(SELECT latency_ms FROM o WHERE r = (SELECT CAST(round_even({p} * (count(*) - 1), 0) AS BIGINT) FROM o))::DOUBLE"


@query("search_analytics", f"""
    WITH o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS r FROM search_log WHERE latency_ms IS NOT NULL), c AS (SELECT query, count(*) AS n, count(*) FILTER (result_count = 0) AS z FROM search_log GROUP BY 1)
    SELECT 'summary' AS section, 'total_queries' AS key, count(*)::DOUBLE AS value FROM search_log UNION ALL SELECT 'summary', 'cache_hit_rate', round_even(avg(cache_hit::INT), 9) FROM search_log
    UNION ALL SELECT 'summary', 'p50_latency_ms', {nearest(.5)} UNION ALL SELECT 'summary', 'p95_latency_ms', {nearest(.95)}
    UNION ALL (SELECT 'top_queries', query, n::DOUBLE FROM c ORDER BY n DESC, query LIMIT 20) UNION ALL (SELECT 'zero_result_queries', query, z::DOUBLE FROM c WHERE z > 0 ORDER BY z DESC, query LIMIT 20)""")
def _(t):
    return A.search_analytics(t.search_log)


OUTCOMES = "CASE event_type WHEN 'purchase' THEN 'INSERTED' WHEN 'click' THEN 'UPDATED' WHEN 'error' THEN 'FAILED_IMAGE' WHEN 'view' THEN 'REVIEW' ELSE NULL END"


RUNS_SQL = f"""
    WITH a AS (SELECT 'batch_' || user_id AS batch_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tm, coalesce({OUTCOMES}, 'UNKNOWN') AS outcome FROM events), c AS (SELECT batch_id, outcome, count(*) AS n, min(tm) AS lo, max(tm) AS hi FROM a GROUP BY 1, 2)
    SELECT batch_id, min(lo) AS started_at, max(hi) AS finished_at, CAST(coalesce(sum(n) FILTER (outcome IN ('INSERTED', 'UPDATED')), 0) AS BIGINT) AS products_added, CAST(coalesce(sum(n) FILTER (outcome = 'FAILED_IMAGE'), 0) AS BIGINT) AS failures, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcomes FROM c GROUP BY 1"""


def audit_events(t):
    return t.events.select(F.concat(F.lit("batch_"), F.col("user_id").cast("string")).alias("batch"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.expr(OUTCOMES).alias("outcome"))


def run_rows(audit):
    rows = A.ingestion_runs(audit)
    entries = F.transform(F.map_entries("outcomes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.withColumn("outcomes", F.array_join(F.array_sort(entries), ","))


@query("ingestion_runs", RUNS_SQL)
def _(t):
    return run_rows(audit_events(t))


@query("read_ingestion_audit", RUNS_SQL)
def _(t):
    path = scratch_folder(t.spark, "audit-log")
    append_audit(audit_events(t), path)
    return run_rows(read_ingestion_audit(t.spark, path))


@query("stale_brands", f"""
    WITH l AS (SELECT brand_id, max(coalesce(scraped_at, created_at)) AS last FROM products WHERE brand_id IS NOT NULL GROUP BY 1), a AS (SELECT b.id AS brand_id, b.instagram_username, l.last, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(l.last)) / 86400000000.0) AS BIGINT) AS age_days FROM brands b LEFT JOIN l ON l.brand_id = b.id)
    SELECT brand_id, instagram_username, age_days, CASE WHEN age_days IS NULL THEN 'NEVER_REFRESHED' ELSE 'STALE' END AS status FROM a WHERE age_days IS NULL OR age_days >= 70""")
def _(t):
    return A.stale_brands(t.brands, t.products, t.now, 70).select("brand_id", "instagram_username", "age_days", "status")


@query("batch_quality", """
    WITH p AS (SELECT source AS handle, doc_id % 5 <> 0 AS product_post, image_url, source_hashtag, CASE WHEN doc_id % 4 = 0 THEN 0.8 ELSE 0.75 END::DOUBLE AS niche FROM posts), s AS (SELECT handle, count(*) AS posts, count(*) FILTER (product_post) AS pp, count(*) FILTER (product_post AND image_url <> '') AS img, max(CAST(coalesce(source_hashtag, '') <> '' AS INT)) AS cat, max(niche) AS niche FROM p GROUP BY 1),
    q AS (SELECT *, CAST(round_even(round_even(15 + CASE WHEN pp > 0 THEN 15 ELSE 0 END + 15 * (pp / greatest(1, posts)::DOUBLE) + 10 + 15 * (img / greatest(1, pp)::DOUBLE) + 10 * cat + 10 * least(1.0, pp / 10.0) + CASE WHEN handle = 'web' THEN 0 ELSE 5 END + 5 * niche, 9), 0) AS INT) AS score FROM s)
    SELECT handle, posts, pp AS product_posts, score, CASE WHEN score >= 80 THEN 'APPROVE' WHEN score >= 60 THEN 'REVIEW' ELSE 'SKIP' END AS recommendation FROM q""")
def _(t):
    posts = t.posts.select(F.col("source").alias("handle"), (F.col("doc_id") % 5 != 0).alias("product_post"), "image_url", "source_hashtag", F.when(F.col("doc_id") % 4 == 0, 0.8).otherwise(0.75).alias("niche_score"))
    return A.batch_quality(posts, t.spark.createDataFrame([("web",)], "handle string"))


CAND_TEXT = "lower(concat_ws(' ', coalesce(brand_name, ''), coalesce(handle, ''), coalesce(description, ''), coalesce(source_hashtag, '')))"


@query("brand_candidate_score", f"""
    WITH c AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '@' || coalesce(brand_name, '') ELSE brand_name END AS handle FROM posts), s AS (SELECT doc_id, handle, {CAND_TEXT} AS txt, doc_id % 2 = 0 AS act FROM c),
    r AS (SELECT doc_id, CASE WHEN {part('txt', *A.REJECT_TERMS)} THEN 0.0 ELSE CASE WHEN {part('txt', *A.COMMERCE_TERMS)} THEN 0.35 ELSE 0 END + CASE WHEN {part('txt', 'jewellery')} OR {part("regexp_replace(txt, '[^a-z]', '', 'g')", *[x.lower() for x in A.CATEGORY_SEEDS['jewellery']])} THEN 0.25 ELSE 0 END
      + CASE WHEN act THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(regexp_replace(ltrim(coalesce(handle, ''), '@'), '[._]', '', 'g'), '^[\\p{{L}}\\p{{N}}]+$') THEN 0.2 ELSE 0 END END::DOUBLE AS raw FROM s)
    SELECT doc_id, round_even(raw, 2) AS confidence, round_even(raw, 2) >= 0.6 AS accepted FROM r""")
def _(t):
    candidates = t.posts.select("doc_id", F.col("brand_name").alias("name"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@"), F.coalesce("brand_name", F.lit("")))).otherwise(F.col("brand_name")).alias("handle"),
                                F.col("description").alias("bio"), F.col("source_hashtag").alias("recent_posts"), (F.col("doc_id") % 2 == 0).alias("recent_activity"))
    return A.brand_candidate_score(candidates, "jewellery").select("doc_id", "confidence", "accepted")


@query("dedupe_candidates", """
    SELECT min(doc_id) AS doc_id FROM posts WHERE trim(coalesce(brand_name, '')) <> '' GROUP BY ltrim(lower(trim(brand_name)), '@')""")
def _(t):
    return A.dedupe_candidates(t.posts.select("doc_id", F.col("brand_name").alias("handle"), F.lit(None).cast("string").alias("name")), "doc_id").select("doc_id")


@query("similar_brands", """
    WITH b AS (SELECT brand_id, category_id, count(*) AS n FROM products WHERE brand_id IS NOT NULL GROUP BY 1, 2), m AS (SELECT brand_id, round_even(avg(coalesce(niche_score, 0)), 12) AS niche FROM products WHERE brand_id IS NOT NULL GROUP BY 1),
    tc AS (SELECT brand_id, count(*) AS k FROM b WHERE category_id IS NOT NULL GROUP BY 1), sh AS (SELECT x.brand_id AS target_id, y.brand_id, sum(y.n) AS shared FROM b x JOIN b y ON x.category_id = y.category_id AND x.brand_id <> y.brand_id GROUP BY 1, 2),
    sc AS (SELECT a.brand_id AS target_id, c.brand_id, round_even(0.65 * (coalesce(shared, 0) / greatest(k, 1)::DOUBLE) + 0.35 * (1 - least(1.0, abs(c.niche - a.niche))), 9) AS similarity_score FROM m a JOIN m c ON a.brand_id <> c.brand_id LEFT JOIN tc ON tc.brand_id = a.brand_id LEFT JOIN sh ON sh.target_id = a.brand_id AND sh.brand_id = c.brand_id)
    SELECT target_id, brand_id, round_even(similarity_score, 6) AS similarity_score, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY similarity_score DESC, brand_id) AS INT) AS position FROM sc) WHERE position <= 8""")
def _(t):
    return A.similar_brands(t.brands, t.brands, t.products).withColumn("similarity_score", F.bround("similarity_score", 6))


@query("last_n_interactions", "SELECT user_id, event_id, recency FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS recency FROM interactions) WHERE recency <= 50")
def _(t):
    return A.last_n_interactions(t.interactions, 50).select("user_id", "event_id", "recency")


@query("interaction_category_counts", "SELECT i.user_id, c.name AS category, count(*) AS interactions FROM interactions i JOIN products p ON p.id = i.product_id JOIN categories c ON c.id = p.category_id GROUP BY 1, 2")
def _(t):
    return A.interaction_category_counts(t.interactions, enriched(t))


@query("for_you_rail", f"""
    WITH RECURSIVE {GEM_SQL}, {RAIL_SQL}, {diversify_sql("(SELECT * FROM rl WHERE rail = 'hidden_gems')")}, fy_e AS ({H.ENRICHED}),
    fy_n AS (SELECT i.user_id, fy_e.category, i.ts, i.event_id FROM interactions i JOIN fy_e ON fy_e.id = i.product_id WHERE fy_e.category IS NOT NULL), fy_l AS (SELECT user_id, max_by(category, (ts, event_id)) AS label FROM fy_n GROUP BY 1),
    fy_h AS (SELECT category, id, CAST(row_number() OVER (PARTITION BY category ORDER BY CAST(id AS BIGINT)) AS INT) AS position FROM fy_e WHERE category IS NOT NULL),
    fy_u AS (SELECT DISTINCT user_id FROM interactions WHERE user_id NOT IN (SELECT user_id FROM fy_l))
    SELECT l.user_id, l.label, h.id, h.position FROM fy_l l JOIN fy_h h ON h.category = l.label AND h.position <= 8 UNION ALL SELECT u.user_id, NULL, d.id, d.position FROM fy_u u, diversified d WHERE d.position <= 8""")
def _(t):
    gems = D.diversify(D.rail_scores(scored(t)).where("rail = 'hidden_gems'"), 16, seed="guest-1")
    return A.for_you_rail(t.interactions, enriched(t), gems)


@query("list_brands", """
    SELECT id, (SELECT count(*) FROM brands WHERE contains(lower(concat_ws(' ', name, instagram_username, category)), 'brand#1')) AS total FROM brands WHERE contains(lower(concat_ws(' ', name, instagram_username, category)), 'brand#1') ORDER BY coalesce(niche_score, 0) DESC, coalesce(followers, 0) DESC, id LIMIT 5 OFFSET 2""")
def _(t):
    return A.list_brands(t.brands, query=" Brand#1", limit=5, offset=2).select("id", "total")


@query("list_products", """
    SELECT id, TRUE AS has_more FROM (SELECT * FROM products ORDER BY CAST(id AS BIGINT) LIMIT 64 OFFSET 10) WHERE coalesce(catalog_status, '') <> 'NON_PRODUCT' UNION ALL SELECT id, FALSE FROM (SELECT * FROM products WHERE brand_id = 'Brand#4' ORDER BY CAST(id AS BIGINT) LIMIT 100) WHERE coalesce(catalog_status, '') <> 'NON_PRODUCT'""")
def _(t):
    return A.list_products(t.products, offset=10).select("id", "has_more").union(A.list_products(t.products, brand_id="Brand#4", limit=500).select("id", "has_more"))


PAGE = "lower(concat_ws(' ', coalesce(product_name, ''), coalesce(description, ''), coalesce(subcategory, '')))"


@query("category_page", f"SELECT id, scraped_at::VARCHAR AS scraped_at FROM products WHERE {part(PAGE, 'gear', 'bolt')}")
def _(t):
    return A.category_page(t.products, ["gear", "bolt"], "newest").select("id", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))
