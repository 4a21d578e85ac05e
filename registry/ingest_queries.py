"""Registered ingest, upsert, proposal and reclassification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.classify_queries import CLASSIFIED, COMPACT_SQL, NAME_SQL, nouns_sql
from registry.core import NOW, STORAGE, query
from registry.hardware import HARDWARE, WORDS, lit
from registry.post_queries import POST_ERRORS_SQL, bare_sql, brand_sql, clean_name_steps, ladder_sql, likely_sql, post_id_sql, price_sql, user_sql
from registry.scalar_queries import joined
from registry.search_queries import discover
from vitrine.functions import classify as C
from vitrine.functions import posts as P
from vitrine.operators import quality as Q
from vitrine.plans import discover as D
from vitrine.plans import ingest as I
from vitrine.session import cut_lineage, scratch_folder
from vitrine.sources import files as S
from vitrine.taxonomy import FASHION, FASHION_WORDS

KEYED = f"""pk AS (SELECT *, nullif(lower({bare_sql('product_url')}), '') AS k_url, coalesce(nullif(instagram_post_id, ''), nullif({post_id_sql("lower(" + bare_sql('product_url') + ")")}, '')) AS k_id,
    CASE WHEN lower(split_part(coalesce(image_url, ''), '?', 1)) <> '' THEN {user_sql('brand_name')} || '|' || lower(split_part(image_url, '?', 1)) END AS k_image FROM posts),
    pf AS (SELECT *, min(doc_id) OVER (PARTITION BY k_url) AS f1, min(doc_id) OVER (PARTITION BY k_id) AS f2, min(doc_id) OVER (PARTITION BY k_image) AS f3 FROM pk),
    pu AS (SELECT * FROM pf WHERE NOT ((k_url IS NOT NULL AND f1 < doc_id) OR (k_id IS NOT NULL AND f2 < doc_id) OR (k_image IS NOT NULL AND f3 < doc_id)))"""


@query("dedupe_posts", f"WITH {KEYED} SELECT doc_id FROM pu")
def _(t):
    return I.dedupe_posts(t.posts, "doc_id").select("doc_id")


@query("dedupe_posts_exact")
def _(t):
    return I.dedupe_posts_exact(t.posts, "doc_id").select("doc_id")


CAND = f"""{clean_name_steps('posts', 'doc_id', 'description')}, cd0 AS (SELECT p.*, cn.name AS cname, {ladder_sql('description')} AS slug FROM posts p JOIN cn ON cn.doc_id = p.doc_id),
    cd AS (SELECT cd0.*, c.id AS category_id, c.name AS category, CASE WHEN cd0.slug = 'uncategorized' THEN 0.35::DOUBLE ELSE 0.85 END AS conf, {brand_sql('brand_name')} AS brand, coalesce(nullif(instagram_username, ''), {user_sql('brand_name')}) AS username FROM cd0 LEFT JOIN categories c ON c.slug = cd0.slug),
    ce AS (SELECT *, coalesce(cname, category, array_to_string(list_transform(string_split(slug, '-'), lambda w: upper(w[1]) || w[2:]), ' ')) AS product_name FROM cd)"""


@query("extract_product", f"""
    WITH {CAND} SELECT doc_id, product_name, brand AS brand_name, category_id, slug AS normalized_subcategory, {price_sql('description')} AS price, username AS instagram_username, coalesce(nullif(instagram_post_id, ''), {post_id_sql('product_url')}) AS instagram_post_id,
      CASE WHEN slug = 'uncategorized' THEN slug ELSE split_part(slug, '-', 1) END AS normalized_main_category, CASE WHEN regexp_matches(slug, '^(women|men|unisex)-') THEN upper(split_part(slug, '-', 1)) ELSE '' END AS audience FROM ce""")
def _(t):
    return I.candidate_products(t.posts, t.categories, FASHION, FASHION_WORDS).select(
        "doc_id", "product_name", "brand_name", "category_id", "normalized_subcategory", "price", "instagram_username", "instagram_post_id", "normalized_main_category", "audience")


@query("product_payload", f"""
    WITH {CAND} SELECT product_name AS name, product_name AS item_name, brand, product_url, product_url AS source_url, coalesce({price_sql('description')}, 0)::DOUBLE AS price,
      CASE WHEN regexp_matches(slug, '^(women|men|unisex)-') THEN upper(split_part(slug, '-', 1)) END AS audience, nullif(source_hashtag, '') AS source_hashtag, category AS subcategory FROM ce""")
def _(t):
    payload = I.product_payload(I.candidate_products(t.posts, t.categories, FASHION, FASHION_WORDS))
    return payload.select("name", "item_name", "brand", "product_url", "source_url", "price", "audience", "source_hashtag", "subcategory")


GENERIC = ", ".join(lit(x) for x in P.GENERIC_POST_NAMES)
NM = "lower(trim(regexp_replace(product_name, '\\s+', ' ', 'g')))"
DECIDED = f"""{CAND}, g AS (SELECT *, {POST_ERRORS_SQL} AS errs, {likely_sql('description', 'image_url')} AS likely,
      concat_ws(',', CASE WHEN brand = '' OR username = 'unknown_brand' THEN 'invalid_brand_relation' END, CASE WHEN length({NM}) < 4 OR {NM} IN ({GENERIC}) OR regexp_matches({NM}, '^(?:look|product)\\s*\\d*$') THEN 'generic_product_name' END,
        CASE WHEN NOT starts_with(product_url, 'https://www.instagram.com/') THEN 'invalid_source_post' END, CASE WHEN NOT coalesce(regexp_matches(image_url, '^https?://'), FALSE) THEN 'missing_or_unrecoverable_image' END,
        CASE WHEN NOT {likely_sql('description', 'image_url')} THEN 'non_product_post' END, CASE WHEN category_id IS NULL THEN 'missing_category' END, CASE WHEN conf < 0.45 AND slug <> 'uncategorized' THEN 'contradictory_or_weak_category' END) AS held FROM ce),
    dd AS (SELECT *, CASE WHEN errs <> '' THEN 'REJECT' WHEN NOT likely THEN 'SKIP' WHEN held <> '' THEN 'HOLD' WHEN doc_id % 2 = 0 THEN 'UPDATE' ELSE 'INSERT' END AS decision,
      CASE WHEN errs <> '' THEN errs WHEN NOT likely THEN 'no reliable fashion product signal' ELSE held END AS reasons FROM g)"""


def decided(t):
    stored = t.posts.where("doc_id % 2 = 0").select("product_url")
    return I.ingest_decisions(t.posts, stored, t.categories, FASHION, FASHION_WORDS)


@query("quality_gate", f"WITH {DECIDED} SELECT doc_id, held AS reasons FROM g")
def _(t):
    rows = I.candidate_products(t.posts, t.categories, FASHION, FASHION_WORDS)
    return rows.select("doc_id", joined(P.quality_gate(rows)).alias("reasons"))


@query("ingest_decisions", f"WITH {DECIDED} SELECT doc_id, decision, reasons FROM dd")
def _(t):
    return decided(t).select("doc_id", "decision", joined(F.col("reasons")).alias("reasons"))


@query("ingestion_summary", f"""
    WITH {DECIDED}, k AS (SELECT *, username IN (SELECT instagram_username FROM brands UNION SELECT 'shop.one') AS old, decision IN ('INSERT', 'UPDATE') AS ok FROM dd),
    s AS (SELECT count(*) AS posts_scanned, count(*) FILTER (decision IN ('HOLD', 'INSERT', 'UPDATE')) AS product_posts_detected, count(*) FILTER (decision = 'INSERT') AS products_inserted, count(*) FILTER (decision = 'UPDATE') AS products_updated,
      count(*) FILTER (decision = 'HOLD') AS quality_rejections, count(*) FILTER (decision IN ('REJECT', 'SKIP', 'HOLD')) AS skipped, count(DISTINCT username) AS brands_attempted, count(DISTINCT username) FILTER (ok) AS brands_successful,
      count(DISTINCT username) FILTER (ok AND old) AS brands_updated, count(*) FILTER (decision = 'REJECT') AS errors FROM k)
    SELECT *, 0 AS duplicates_skipped, brands_attempted - brands_successful AS brands_failed, brands_successful - brands_updated AS brands_inserted FROM s""")
def _(t):
    brands = t.brands.select("instagram_username").union(t.spark.createDataFrame([("shop.one",)], "instagram_username string"))
    return I.ingestion_summary(t.posts, decided(t), brands)


@query("failure_sink", f"""
    WITH {DECIDED} SELECT NULL::VARCHAR AS brand_id, brand AS brand_name, 'product_processing' AS stage, replace(errs, ',', ', ') AS message, TRUE AS recoverable FROM dd WHERE decision = 'REJECT'""")
def _(t):
    return S.failure_rows(decided(t), t.brands, t.now).drop("occurred_at")


@query("append_audit")
def _(t):
    path = scratch_folder(t.spark, "audit")
    S.append_audit(S.audit_rows(decided(t), "batch_001", t.now), path)
    return S.read_ingestion_audit(t.spark, path)


@query("append_search_log", """
    SELECT 1706745600.0::DOUBLE AS ts, substr(trim(query), 1, 200) AS query, CAST(coalesce(n, 0) AS INT) AS result_count, 12.3::DOUBLE AS latency_ms, FALSE AS cache_hit
    FROM search_queries LEFT JOIN (SELECT qid, count(*) AS n FROM runs GROUP BY 1) USING (qid) WHERE query IS NOT NULL""")
def _(t):
    path = scratch_folder(t.spark, "search-log")
    S.append_json(S.search_log_rows(t.runs, t.search_queries, 1706745600.0, 12.34), path)
    return S.read_search_log(t.spark, path)


@query("read_search_log", """
    SELECT floor(epoch(ts))::DOUBLE AS ts, query, CAST(result_count AS INT) AS result_count, CAST(latency_ms AS DOUBLE) AS latency_ms, cache_hit FROM search_log WHERE query IS NOT NULL""")
def _(t):
    path = scratch_folder(t.spark, "log")
    rows = t.search_log.select(F.unix_timestamp("ts").cast("double").alias("ts"), "query", "result_count", "latency_ms", "cache_hit")
    good = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    good.unionByName(t.documents.select(F.concat(F.lit("{broken "), F.substring("lang", 1, 2)).alias("value"))).write.text(path)
    return S.read_search_log(t.spark, path)


@query("search_evaluation_log")
def _(t):
    queries = cut_lineage(D.resolve_queries(t.search_queries, HARDWARE, WORDS))
    return S.search_evaluation_rows(discover(t, queries), queries, HARDWARE, "good")


UPSERT_IN = """inc AS (SELECT 1 AS arrived, source, product_url, upper(product_name) AS product_name, NULL::DOUBLE AS price FROM products WHERE coalesce(product_url, '') <> 'not a url' AND CAST(id AS INT) % 3 = 0
      UNION ALL SELECT 1, source, product_url || 'new', product_name, price FROM products WHERE coalesce(product_url, '') <> 'not a url' AND CAST(id AS INT) % 50 = 0),
    st AS (SELECT 1 AS known, source, product_url, product_name, price, likes_count FROM products WHERE coalesce(product_url, '') <> 'not a url')"""


@query("upsert_products", f"""
    WITH {UPSERT_IN} SELECT source, product_url, CASE WHEN arrived = 1 THEN i.product_name ELSE s.product_name END AS product_name, CASE WHEN arrived = 1 THEN i.price ELSE s.price END AS price, s.likes_count,
      CASE WHEN arrived IS NULL THEN 'KEPT' WHEN known IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action FROM st s FULL JOIN inc i USING (source, product_url)""")
def _(t):
    valid = t.products.where("coalesce(product_url, '') <> 'not a url'")
    stored = valid.select("source", "product_url", "product_name", "price", "likes_count")
    k = F.col("id").cast("int")
    changed = valid.where(k % 3 == 0).select("source", "product_url", F.upper("product_name").alias("product_name"), F.lit(None).cast("double").alias("price"))
    new = valid.where(k % 50 == 0).select("source", F.concat("product_url", F.lit("new")).alias("product_url"), "product_name", "price")
    return S.upsert_products(stored, changed.union(new)).withColumnRenamed("_action", "action")


@query("upsert_brands", """
    WITH inc AS (SELECT instagram_username, 'Changed' AS category, followers + 1 AS followers FROM brands WHERE followers % 4 = 0 UNION ALL SELECT instagram_username || '.new', 'Fresh', followers FROM brands WHERE followers % 9 = 0)
    SELECT instagram_username, CASE WHEN s.id IS NULL THEN i.category ELSE s.category END AS category, coalesce(i.followers, s.followers) AS followers, CASE WHEN i.category IS NULL THEN 'KEPT' WHEN s.id IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action
    FROM brands s FULL JOIN inc i USING (instagram_username)""")
def _(t):
    old = t.brands.where("followers % 4 = 0").select("instagram_username", F.lit("Changed").alias("category"), (F.col("followers") + 1).alias("followers"))
    new = t.brands.where("followers % 9 = 0").select(F.concat("instagram_username", F.lit(".new")).alias("instagram_username"), F.lit("Fresh").alias("category"), "followers")
    rows = S.upsert_brands(t.brands, old.union(new))
    return rows.select("instagram_username", "category", "followers", F.col("_action").alias("action"))


@query("merge_brand_cache", f"""
    WITH f AS (SELECT coalesce(nullif(instagram_username, ''), {user_sql('brand_name')}) AS u, doc_id, {brand_sql('brand_name')} AS brand, followers, coalesce(source_hashtag, '') AS tag FROM posts),
    l AS (SELECT u, max(doc_id) AS d FROM f WHERE u <> 'unknown_brand' GROUP BY 1)
    SELECT f.u AS instagram_username, brand AS brand_name, followers, printf('%.2f', CASE WHEN brand = 'unknown_brand' THEN 0.5 WHEN followers >= 5000 THEN 1.0 WHEN followers >= 1000 THEN 0.8 ELSE 0.75 END) AS niche_score, tag AS source_hashtag FROM f JOIN l ON l.u = f.u AND l.d = f.doc_id
    UNION ALL SELECT instagram_username, name, followers, '0.90', 'cache' FROM brands WHERE instagram_username NOT IN (SELECT u FROM l)""")
def _(t):
    cache = t.brands.select("instagram_username", F.col("name").alias("brand_name"), "followers", F.lit("0.90").alias("niche_score"), F.lit("cache").alias("source_hashtag"))
    return S.merge_brand_cache(cache, t.posts, "doc_id")


BATCH_SQL = """bt AS (SELECT doc_id AS line, 'batch_' || (doc_id % 3) AS batch_id, brand_name, CASE WHEN doc_id % 3 = 0 THEN 'https://www.instagram.com/shop' || (doc_id % 40) || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END END AS instagram_url, CASE WHEN doc_id % 3 = 1 THEN 'Handle' || (doc_id % 30) END AS instagram_handle,
    CASE doc_id % 20 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' User_Curated ' ELSE 'inventory_gap' END AS source, CASE doc_id % 15 WHEN 0 THEN '' WHEN 1 THEN 'odd' WHEN 2 THEN 'Approved' ELSE 'pending' END AS status FROM posts),
    b2 AS (SELECT *, lower(trim(source)) AS s, lower(trim(coalesce(nullif(status, ''), 'pending'))) AS st, trim(coalesce(instagram_url, instagram_handle, '')) AS value FROM bt),
    b3 AS (SELECT *, s IN ('user_curated', 'automatic_discovery', 'inventory_gap', 'manual_research') AND st IN ('pending', 'approved', 'ingested', 'skipped', 'failed', 'review') AS legal FROM b2)"""


def batch_rows(t):
    return t.posts.select(
        F.col("doc_id").alias("line"), F.expr("concat('batch_', doc_id % 3)").alias("batch_id"), "brand_name",
        F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('https://www.instagram.com/shop', doc_id % 40, CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END) END").alias("instagram_url"),
        F.expr("CASE WHEN doc_id % 3 = 1 THEN concat('Handle', doc_id % 30) END").alias("instagram_handle"), F.lit("kurtas").alias("category_hint"), F.lit(None).cast("string").alias("priority"),
        F.expr("CASE doc_id % 20 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' User_Curated ' ELSE 'inventory_gap' END").alias("source"),
        F.expr("CASE doc_id % 15 WHEN 0 THEN '' WHEN 1 THEN 'odd' WHEN 2 THEN 'Approved' ELSE 'pending' END").alias("status"))


@query("read_brand_batch", f"""
    WITH {BATCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, rtrim(lower(value), '/') ORDER BY line DESC) AS n FROM b3 WHERE legal AND value <> '')
    SELECT 'kept' AS kind, batch_id, value, st AS status, line FROM r WHERE n = 1 UNION ALL SELECT 'rejected', batch_id, value, st, line FROM b3 WHERE NOT legal""")
def _(t):
    kept, rejected = S.brand_batch(batch_rows(t))
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), "batch_id", "value", "status", "line")
    return shape(kept, "kept").unionByName(shape(rejected, "rejected"))


@query("read_curated_brands", f"""
    WITH {BATCH_SQL}, i AS (SELECT *, CASE WHEN starts_with(value, 'http') THEN regexp_extract(value, 'com/([A-Za-z0-9._]+)', 1) ELSE lower(value) END AS u FROM b3 WHERE value <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY line DESC) AS n FROM i)
    SELECT u AS instagram_username, coalesce(CASE WHEN coalesce(brand_name, '') <> '' THEN {brand_sql('brand_name')} END, u) AS brand_name, 'curated:kurtas:normal' AS source_hashtag FROM r WHERE n = 1""")
def _(t):
    return S.curated_brands(batch_rows(t)).select("instagram_username", "brand_name", "source_hashtag")


# ---------------------------------------------------------------- proposals and reclassification

MAIN_SQL = "WITH RECURSIVE up AS (SELECT id, slug, id AS cur, parent_id FROM categories UNION ALL SELECT u.id, u.slug, c.id, c.parent_id FROM up u JOIN categories c ON c.id = u.parent_id), mains AS (SELECT u.slug, c.slug AS main_slug FROM up u JOIN categories c ON c.id = u.cur WHERE u.parent_id IS NULL)"
SLUG_X = "CASE CAST(id AS INT) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no-such' WHEN 2 THEN 'women-kurtis' WHEN 3 THEN 'watches' ELSE normalized_subcategory END"
MAIN_X = "CASE CAST(id AS INT) % 9 WHEN 0 THEN 'women' WHEN 1 THEN 'men' ELSE NULL END"
AUD_X = "CASE CAST(id AS INT) % 8 WHEN 0 THEN 'WOMEN' WHEN 1 THEN 'Men' ELSE NULL END"


@query("check_proposals", f"""
    {MAIN_SQL}, pp AS (SELECT id, normalized_subcategory AS stored, {SLUG_X} AS slug, {MAIN_X} AS claimed, lower({AUD_X}) AS aud, coalesce(classifier_confidence, 0) AS conf, [split_part(item_name, ' ', 1), '#kurti', 'zzz'] AS ev, {COMPACT_SQL} AS txt,
      greatest(0, CAST(coalesce(product_name, '') <> '' AS INT) + CAST(coalesce(description, '') <> '' AS INT) + CAST(coalesce(len(metadata.hashtags), 0) > 0 AS INT) - 1) AS agree FROM products),
    pj AS (SELECT pp.*, m.main_slug, lower(c.audience) AS row_aud, m.slug IS NOT NULL AS known, len(list_filter(ev, lambda e: trim(lower(e), ' "''#') <> '' AND contains(txt, trim(lower(e), ' "''#')))) AS explicit FROM pp LEFT JOIN mains m ON m.slug = pp.slug LEFT JOIN categories c ON c.slug = pp.slug),
    pg AS (SELECT *, coalesce({' OR '.join(f"(slug = {lit(k)} AND stored IN ({', '.join(lit(x) for x in v)}))" for k, v in C.INCOMPATIBLE.items())}, FALSE) AS bad, least(greatest(0, least(1, conf)), 0.70 + least(explicit, 2) * 0.08 + agree * 0.02) AS grounded FROM pj)
    SELECT id, CASE WHEN slug IS NULL OR NOT known OR slug = 'uncategorized' OR (claimed IS NOT NULL AND claimed <> main_slug) OR coalesce(aud <> row_aud, FALSE) THEN NULL ELSE slug END AS slug,
      CASE WHEN slug IS NULL THEN least(CASE WHEN conf = 0 THEN 0.35 ELSE conf END, 0.79) WHEN NOT known OR slug = 'uncategorized' THEN 0.25 WHEN claimed IS NOT NULL AND claimed <> main_slug THEN 0.25 WHEN coalesce(aud <> row_aud, FALSE) THEN 0.35
        ELSE round_even(round_even(CASE WHEN bad THEN least(grounded, 0.55) ELSE grounded END, 9), 2) END::DOUBLE AS confidence FROM pg""")
def _(t):
    proposals = t.products.select(
        "id", F.expr(SLUG_X).alias("category_slug"), F.expr(MAIN_X).alias("main_category_slug"), F.expr(AUD_X).alias("audience"), F.col("classifier_confidence").alias("confidence"),
        F.filter(F.array(F.substring_index("item_name", " ", 1), F.lit("#kurti"), F.lit("zzz")), lambda x: x.isNotNull()).alias("evidence"), F.lit(None).cast("string").alias("reason"))
    return I.check_proposals(proposals, t.products, t.categories).select("id", "slug", "confidence")


@query("parent_fallback", """
    WITH p AS (SELECT id, CASE WHEN CAST(id AS INT) % 7 = 0 THEN 9999 ELSE coalesce(category_id, 3) END AS cid, coalesce(classifier_confidence, 0) AS conf FROM products), j AS (SELECT p.id, cid, c.parent_id, c.id IS NOT NULL AS known, CASE WHEN c.id IS NULL THEN least(conf, 0.69) ELSE conf END AS conf FROM p LEFT JOIN categories c ON c.id = p.cid)
    SELECT id, CASE WHEN NOT known THEN 1 WHEN conf < 0.7 THEN coalesce(parent_id, cid) ELSE cid END AS category_id, round_even(conf, 4)::DOUBLE AS confidence FROM j""")
def _(t):
    proposals = t.products.select("id", F.when(F.col("id").cast("int") % 7 == 0, 9999).otherwise(F.coalesce("category_id", F.lit(3))).cast("bigint").alias("category_id"), F.coalesce("classifier_confidence", F.lit(0.0)).alias("confidence"))
    return I.parent_fallback(proposals, t.categories)


PRINT_PARTS = (
    "coalesce(nullif(product_name, ''), nullif(item_name, ''))", "brand_name", "coalesce(nullif(metadata.caption, ''), nullif(metadata.post_text, ''), nullif(description, ''))",
    "source_hashtag", "metadata.alt_text", "CAST(price AS DECIMAL(18,4))", "category_id", "'v1'")


@query("context_fingerprint", f"""
    SELECT id, CAST(id AS INT) % 2 = 0 AS cache_hit, sha256(concat_ws(chr(31), {', '.join(f"coalesce(CAST({p} AS VARCHAR), chr(26))" for p in PRINT_PARTS)})) AS fingerprint FROM products""")
def _(t):
    prints = I.context_fingerprint(t.products, "v1")
    changed = t.products.where("CAST(id AS INT) % 2 = 1").withColumn("price", F.coalesce("price", F.lit(0.0)) + 1)
    cached = I.context_fingerprint(t.products.where("CAST(id AS INT) % 2 = 0").unionByName(changed), "v1")
    rows = I.reuse_proposals(prints, cached)
    return rows.select("id", "cache_hit", "fingerprint")


RECLASS = f"""{CLASSIFIED}, rc AS (SELECT cls.*, c.slug AS old_slug, n.id AS new_category_id, CASE WHEN cname = '' OR regexp_matches(cname, '{C.WEAK_NAME}') THEN {nouns_sql('txt')} END AS new_name FROM cls LEFT JOIN categories c ON c.id = cls.category_id LEFT JOIN categories n ON n.slug = cls.p_slug WHERE coalesce(classifier_confidence, 0) < 0.8),
    ra AS (SELECT *, CASE WHEN nonprod THEN 'MARK_NON_PRODUCT' WHEN p_slug IS NULL OR p_conf < 0.8 THEN 'LEAVE' WHEN new_category_id IS NULL THEN 'MIGRATION_REQUIRED' ELSE 'UPDATE' END AS action FROM rc)"""


@query("reclassify_catalog", f"WITH {RECLASS} SELECT id, action, new_category_id, p_slug AS new_slug, p_conf AS new_confidence, p_source AS new_source, CASE WHEN p_main IN ('women', 'men', 'unisex') THEN upper(p_main) END AS new_audience, new_name FROM ra")
def _(t):
    return I.reclassify_catalog(t.products, t.categories).drop("new_main")


@query("apply_reclassification", f"""
    WITH {RECLASS} SELECT p.id, CASE WHEN a.action = 'UPDATE' THEN a.new_category_id ELSE p.category_id END AS category_id, CASE WHEN a.action = 'UPDATE' THEN a.p_conf ELSE p.classifier_confidence END AS classifier_confidence,
      CASE WHEN a.action = 'MARK_NON_PRODUCT' THEN 'NON_PRODUCT' ELSE p.catalog_status END AS catalog_status, CASE WHEN a.action = 'UPDATE' THEN coalesce(a.new_name, p.product_name) ELSE p.product_name END AS product_name FROM products p LEFT JOIN ra a ON a.id = p.id""")
def _(t):
    rows = I.apply_reclassification(t.products, I.reclassify_catalog(t.products, t.categories))
    return rows.select("id", "category_id", "classifier_confidence", "catalog_status", "product_name")
