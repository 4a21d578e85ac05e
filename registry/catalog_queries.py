"""Registered projections, predicates, worklists and joins over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import hardware as H
from registry.classify_queries import COMPACT_SQL
from registry.core import DIM, STORAGE, query
from registry.hardware import HARDWARE, part, term
from registry.post_queries import bare_sql, brand_sql, source_post_sql, user_sql
from registry.scalar_queries import (
    DISCOVERY_STABLE_SQL, TRAINING_STABLE_SQL, USABLE_SQL, enriched, gender_score_sql, image_class_sql, joined, valid_url_sql,
)
from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.functions.posts import bare_url
from vitrine.operators import catalog as C
from vitrine.operators import filters as P


@query("scan_catalog", """
    SELECT 'brands' AS table_name, count(*) AS row_count, count(DISTINCT id) AS ids FROM brands UNION ALL
    SELECT 'products', count(*), count(DISTINCT id) FROM products UNION ALL SELECT 'failures', count(*), count(DISTINCT brand_id) FROM failures
    UNION ALL SELECT 'missing', 0, 0""")
def _(t):
    from vitrine.sources.tables import failures_or_empty

    def row(name, df, key):
        return df.agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("ids")).select(F.lit(name).alias("table_name"), "row_count", "ids")

    return (row("brands", t.brands, "id").union(row("products", t.products, "id")).union(row("failures", t.failures, "brand_id"))
            .union(row("missing", failures_or_empty(t.spark, f"{t.sf_dir}/no-such-table.parquet"), "brand_id")))


@query("format_product", f"""
    SELECT id, coalesce(nullif(brand_name, ''), nullif(brand, ''), 'Unknown brand') AS brand_name,
           coalesce(nullif(product_name, ''), nullif(item_name, ''), 'Untitled item') AS product_name, coalesce(description, '') AS description,
           coalesce(image_url, '') AS image_url, coalesce(nullif(product_url, ''), nullif(source_url, ''), '') AS product_url,
           price, niche_score, coalesce(scraped_at, created_at)::VARCHAR AS scraped_at,
           coalesce(category, 'Category ' || category_id, '') AS category, coalesce(category_audience, '') AS category_audience,
           coalesce(audience, '') AS audience, coalesce(nullif(normalized_subcategory, ''), nullif(subcategory, ''), '') AS subcategory,
           coalesce(currency, 'INR') AS currency, 0.0::DOUBLE AS similarity, 0.0::DOUBLE AS final_score
    FROM ({H.ENRICHED})""")
def _(t):
    return P.format_product(enriched(t)).select(
        "id", "brand_name", "product_name", "description", "image_url", "product_url", "price", "niche_score",
        F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"), "category", "category_audience", "audience",
        "subcategory", "currency", "similarity", "final_score")


@query("format_brand", """
    SELECT id, coalesce(nullif(name, ''), brand_name) AS name, coalesce(instagram_username, '') AS instagram_username,
           coalesce(nullif(category, ''), 'Fashion') AS category, coalesce(followers, 0) AS followers, coalesce(niche_score, 0.0)::DOUBLE AS niche_score,
           coalesce(profile_picture_url, '') AS image_url, coalesce(instagram_profile_url, profile_url, '') AS profile_url, '' AS post_url FROM brands""")
def _(t):
    return P.format_brand(t.brands)


@query("product_search_text", f"""
    SELECT id, {H.SEARCH_TEXT} AS search_text, {H.DISCOVERY_TEXT} AS discovery_text, {H.INVENTORY_TEXT} AS inventory_text, {H.TRAINING_TEXT} AS training_text FROM ({H.ENRICHED})""")
def _(t):
    p = enriched(t)
    return p.select("id", X.product_search_text(p).alias("search_text"), X.discovery_text(p).alias("discovery_text"),
                    X.inventory_text(p).alias("inventory_text"), X.training_text(p).alias("training_text"))


ENRICHED_BRANDS = """SELECT p.*, c.name AS category, c.audience AS category_audience, b.followers AS brand_follower_count, b.niche_score AS brand_niche_score,
    b.profile_picture_url AS brand_profile_picture_url, coalesce(b.instagram_profile_url, b.profile_url) AS brand_instagram_profile_url
    FROM products p LEFT JOIN brands b ON b.id = p.brand_id LEFT JOIN categories c ON c.id = p.category_id"""


@query("filter_products", f"""
    SELECT id, price FROM ({ENRICHED_BRANDS}) WHERE price >= 905 AND price <= 1050 AND niche_score >= 0.2 AND brand_follower_count >= 3000
      AND contains(lower(trim(coalesce(brand_name, ''))), 'brand#1') AND contains(lower(concat_ws(' ', coalesce(audience, ''), coalesce(category, ''),
          coalesce(normalized_main_category, ''), coalesce(normalized_subcategory, ''))), 'men')""")
def _(t):
    p = C.enrich_products(t.products, t.brands, t.categories)
    return P.filter_products(p, min_price=905, max_price=1050, min_niche=0.2, min_followers=3000, brand=" Brand#1", gender="men").select("id", "price")


@query("catalog_status_filters", """
    SELECT id, coalesce(catalog_status, 'ACTIVE') = 'ACTIVE' AS is_active, coalesce(catalog_status, '') <> 'NON_PRODUCT' AS is_not_non_product FROM products""")
def _(t):
    s = F.col("catalog_status")
    return t.products.select("id", P.is_active(s).alias("is_active"), P.is_not_non_product(s).alias("is_not_non_product"))


@query("is_active", "SELECT id FROM products WHERE coalesce(catalog_status, 'ACTIVE') = 'ACTIVE'")
def _(t):
    return t.products.where(P.is_active(F.col("catalog_status"))).select("id")


@query("usable_image", f"SELECT id, {USABLE_SQL} AS usable FROM products")
def _(t):
    return t.products.select("id", S.usable_image(F.col("image_url"), F.col("image_status")).alias("usable"))


@query("stable_image", f"""
    SELECT id, coalesce(starts_with(image_url, '{STORAGE}/storage/v1/object/public/'), FALSE) AS in_storage, {DISCOVERY_STABLE_SQL} AS discovery,
           {TRAINING_STABLE_SQL} AS training, {USABLE_SQL} AND coalesce(starts_with(image_url, '{STORAGE}/storage/v1/object/public/product-images/'), FALSE) AS tile FROM products""")
def _(t):
    u, s = F.col("image_url"), F.col("image_status")
    return t.products.select("id", S.in_storage(u, STORAGE).alias("in_storage"), S.discovery_stable_image(u, s, STORAGE).alias("discovery"),
                             S.training_stable_image(u, s, STORAGE).alias("training"), S.tile_stable_image(u, s, STORAGE + "/").alias("tile"))


D_RANK = H.term_rank("lower(txt)", HARDWARE)


@query("discovery_eligible", f"""
    WITH s AS (SELECT *, {H.DISCOVERY_TEXT} AS txt FROM ({H.ENRICHED}))
    SELECT id, {DISCOVERY_STABLE_SQL} AND coalesce(len(embedding), 0) = {DIM} AND coalesce(classifier_confidence, 0) >= 0.8
           AND ({D_RANK}) IS NOT NULL AND coalesce(brand_id, '') <> '' AND coalesce(catalog_status, '') <> 'NON_PRODUCT' AS eligible FROM s""")
def _(t):
    p = enriched(t)
    kind = X.identify_product(X.discovery_text(p), HARDWARE)["type"]
    return p.select("id", P.discovery_eligible(p, kind, STORAGE, DIM).alias("eligible"))


@query("browse_catalog", f"""
    WITH s AS (SELECT *, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED}))
    SELECT id FROM s WHERE coalesce(catalog_status, '') <> 'NON_PRODUCT' AND contains(lower(coalesce(category, '')), 'nation_1') AND {term('txt', 'gear')} AND contains(txt, 'red')""")
def _(t):
    return P.browse_catalog(enriched(t), HARDWARE, category="NATION_1", product_type="gear", colour="Red").select("id")


@query("rail_filter", f"""
    WITH s AS (SELECT *, {H.DISCOVERY_TEXT} AS txt, {H.AUDIENCE_TEXT} AS aud FROM ({H.ENRICHED})), r AS (SELECT *, {D_RANK} AS k FROM s)
    SELECT 'women-fasteners' AS rail, id FROM r WHERE {gender_score_sql('aud', "'women'")} > 0 AND {term('lower(txt)', *HARDWARE.family_terms('fasteners'))}
    UNION ALL SELECT 'type-gear', id FROM r WHERE {H.type_of('k', HARDWARE)} = 'gear'
    UNION ALL SELECT 'loose', id FROM r WHERE contains(replace(lower(txt), '-', ' '), 'home decor')""")
def _(t):
    p = enriched(t)
    rail = lambda name, **kw: P.rail_filter(p, HARDWARE, **kw).select(F.lit(name).alias("rail"), "id")
    return rail("women-fasteners", category="Women_fasteners").union(rail("type-gear", product_type="gear")).union(rail("loose", category="home-decor"))


@query("schema_checks", """
    SELECT 'image_status_domain' AS rule, count(*) FILTER (image_status NOT IN ('VALID','MISSING','BROKEN','EXPIRED_OR_FORBIDDEN','TIMEOUT','INVALID_URL','RECOVERY_REQUIRED','UNRECOVERABLE','UNKNOWN')) AS violations FROM products
    UNION ALL SELECT 'classification_source_domain', count(*) FILTER (classification_source NOT IN ('deterministic','metadata','ai','heuristic','openai','manual','legacy')) FROM products
    UNION ALL SELECT 'catalog_status_domain', count(*) FILTER (catalog_status NOT IN ('ACTIVE','NON_PRODUCT','MANUAL_REVIEW')) FROM products
    UNION ALL SELECT 'image_status_present', count(*) FILTER (image_status IS NULL) FROM products
    UNION ALL SELECT 'catalog_status_present', count(*) FILTER (catalog_status IS NULL) FROM products
    UNION ALL SELECT 'confidence_range', count(*) FILTER (classifier_confidence NOT BETWEEN 0 AND 1) FROM products
    UNION ALL SELECT 'likes_not_negative', count(*) FILTER (likes_count < 0) FROM products
    UNION ALL SELECT 'comments_not_negative', count(*) FILTER (comments_count < 0) FROM products
    UNION ALL SELECT 'niche_range', count(*) FILTER (niche_score NOT BETWEEN 0 AND 1) FROM products
    UNION ALL SELECT 'price_range', count(*) FILTER (min_price > max_price) FROM preferences
    UNION ALL SELECT 'mapping_source_domain', 0 UNION ALL SELECT 'mapping_confidence_range', 0""")
def _(t):
    return P.schema_checks(t.products).union(P.preference_checks(t.preferences)).union(P.mapping_checks(t.brand_categories))


@query("reclassify_scope", """
    SELECT 'default' AS scope, id FROM products WHERE coalesce(classifier_confidence, 0) < 0.8
    UNION ALL SELECT 'brand', id FROM products WHERE contains(lower(coalesce(brand_name, '')), 'brand#2') AND coalesce(category_id, 0) = 0""")
def _(t):
    scope = lambda name, **kw: P.reclassify_scope(t.products, **kw).select(F.lit(name).alias("scope"), "id")
    return scope("default").union(scope("brand", brand="Brand#2", only_uncategorized=True, force=True))


@query("public_projection", """
    SELECT id, product_name FROM products""")
def _(t):
    p = t.products.select("id", "product_name", F.struct(F.lit(1).alias("x")).alias("score_breakdown"), F.lit(None).alias("rerank_detail"))
    return P.public_projection(p)


@query("backfill_columns", """
    SELECT id, coalesce(brand_name, brand) AS name_a, coalesce(item_name, p_legacy) AS name_b, coalesce(product_name, item_name, p_legacy) AS name_c
    FROM (SELECT id, brand_name, brand, item_name, nullif(product_name, '') AS product_name, upper(brand) AS p_legacy FROM products)
    UNION ALL SELECT id, coalesce(brand_name, name), coalesce(instagram_username, lower(regexp_replace(name, '[^a-zA-Z0-9._]', '', 'g'))), 'brand' FROM brands""")
def _(t):
    p = t.products.withColumns({"name": F.upper("brand"), "product_name": F.nullif("product_name", F.lit(""))})
    rows = P.backfill_columns(p).select("id", F.col("brand_name").alias("name_a"), F.col("item_name").alias("name_b"), F.col("product_name").alias("name_c"))
    return rows.union(P.backfill_brand_columns(t.brands).select("id", "brand_name", "instagram_username", F.lit("brand")))


@query("image_sample_audit", f"""
    SELECT 'product' AS kind, id AS owner_id, coalesce(nullif(product_name, ''), nullif(item_name, '')) AS owner, 'image_url' AS db_field, image_url AS db_value, image_url IS NULL AS is_null,
           {image_class_sql('image_url')} AS classification, coalesce(contains(image_url, 'instagram') OR contains(image_url, 'fbcdn'), FALSE) AS social_cdn,
           coalesce(starts_with(image_url, '{STORAGE}/storage/v1/object/public/'), FALSE) AS in_storage FROM products
    UNION ALL SELECT 'brand', id, name, 'profile_picture_url', profile_picture_url, profile_picture_url IS NULL, {image_class_sql('profile_picture_url')}, FALSE, FALSE FROM brands""")
def _(t):
    return P.image_sample_audit(t.products, t.brands, STORAGE)


@query("recovery_worklist", f"""
    WITH s AS (SELECT *, {COMPACT_SQL} AS txt FROM products)
    SELECT id, image_url, image_status, {part('txt', *P.PRIORITY_TERMS)} AS priority, {source_post_sql('product_url', 'source_url')} AS source_post_url,
           CASE WHEN {source_post_sql('product_url', 'source_url')} IS NOT NULL THEN 'RECOVERABLE' ELSE 'UNRECOVERABLE' END AS recovery FROM s
    WHERE NOT coalesce(starts_with(image_url, '{STORAGE}/storage/v1/object/public/'), FALSE) AND (coalesce(image_status IN ('BROKEN','EXPIRED_OR_FORBIDDEN','INVALID_URL','RECOVERY_REQUIRED','UNRECOVERABLE'), FALSE)
      OR coalesce(source = 'instagram' AND contains(image_url, 'unsplash.com'), FALSE) OR NOT {valid_url_sql('image_url')})""")
def _(t):
    return P.recovery_worklist(t.products, STORAGE)


@query("embed_worklist", """
    SELECT id, item_name FROM products WHERE embedding IS NULL AND brand_name IS NOT NULL AND item_name IS NOT NULL AND category_id IS NOT NULL""")
def _(t):
    return P.embed_worklist(t.products).select("id", "item_name")


@query("brand_scrape_worklist", f"""
    SELECT brand AS brand_name, u AS instagram_username, url AS instagram_profile_url, pic AS profile_picture_url, followers, niche_score FROM (
      SELECT {brand_sql('name')} AS brand, {user_sql("coalesce(nullif(instagram_username, ''), name)")} AS u,
             coalesce(instagram_profile_url, profile_url) AS url, coalesce(profile_picture_url, '') AS pic, followers,
             CASE WHEN coalesce(niche_score, 0) = 0 THEN CASE WHEN followers >= 5000 THEN 1.0 WHEN followers >= 1000 THEN 0.8 ELSE 0.75 END ELSE niche_score END::DOUBLE AS niche_score FROM brands)""")
def _(t):
    return C.normalized_brand_batch(t.brands)


# ---------------------------------------------------------------- joins

ENRICHED_LIST = ("id, brand_id, brand_name, category, category_audience, item_name, description, image_url, product_url, price, source, niche_score, "
                 "likes_count, comments_count, source_hashtag, scraped_at::VARCHAR AS scraped_at, brand_follower_count, brand_niche_score, "
                 "brand_profile_picture_url, brand_instagram_profile_url, category_id")


@query("enrich_products", f"SELECT {ENRICHED_LIST} FROM ({ENRICHED_BRANDS})")
def _(t):
    rows = C.enrich_products(t.products, t.brands, t.categories).select(*C.ENRICHED_COLUMNS)
    return rows.withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss"))


CLOSURE_SQL = """WITH RECURSIVE closure AS (SELECT id AS root_id, id FROM categories UNION
    SELECT c.root_id, k.id FROM closure c JOIN categories k ON k.parent_id = c.id)"""


@query("category_closure", CLOSURE_SQL + " SELECT root_id, id FROM closure")
def _(t):
    return C.category_closure(t.categories)


@query("filter_category_scope", CLOSURE_SQL + " SELECT p.id, p.category_id FROM products p WHERE p.category_id IN (SELECT id FROM closure WHERE root_id = 2)")
def _(t):
    return C.filter_category_scope(t.products, t.categories, 2).select("id", "category_id")


@query("attach_category_audience", """
    SELECT p.id, c.audience AS category_audience FROM products p LEFT JOIN categories c ON c.id = p.category_id""")
def _(t):
    return C.attach_category_audience(t.products, t.categories).select("id", "category_audience")


BRAND_KEYS = "(SELECT id, lower(name) AS k FROM brands UNION SELECT id, lower(brand_name) FROM brands UNION SELECT id, lower(instagram_username) FROM brands)"


@query("link_brands", f"""
    SELECT p.id, coalesce(p.brand_id, (SELECT min(b.id) FROM {BRAND_KEYS} b WHERE b.k = lower(p.brand_name) OR b.k = lower(regexp_replace(p.brand_name, '[^a-zA-Z0-9._]', '', 'g')))) AS brand_id FROM products p""")
def _(t):
    return C.link_brands(t.products, t.brands).select("id", "brand_id")


@query("missing_brands", f"""
    WITH odd AS (SELECT CASE WHEN CAST(id AS INT) % 5 = 0 THEN 'New Label ' || CAST(CAST(id AS INT) % 7 AS STRING) ELSE brand_name END AS brand_name, niche_score FROM products WHERE brand_id IS NULL OR CAST(id AS INT) % 5 = 0),
    n AS (SELECT brand_name, min(coalesce(niche_score, 0)) AS niche_score FROM odd WHERE brand_name IS NOT NULL GROUP BY 1)
    SELECT brand_name AS name, lower(regexp_replace(brand_name, '[^a-zA-Z0-9._]', '', 'g')) AS instagram_username, 'Fashion' AS category, 0 AS followers, niche_score FROM n
    WHERE NOT EXISTS (SELECT 1 FROM {BRAND_KEYS} b WHERE b.k = lower(n.brand_name) OR b.k = lower(regexp_replace(n.brand_name, '[^a-zA-Z0-9._]', '', 'g')))""")
def _(t):
    k = F.col("id").cast("int")
    odd = t.products.withColumn("brand_name", F.when(k % 5 == 0, F.concat(F.lit("New Label "), (k % 7).cast("string"))).otherwise(F.col("brand_name")))
    odd = odd.withColumn("brand_id", F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("brand_id")))
    return C.missing_brands(odd, t.brands).drop("brand_name")


@query("hydrate_candidates", """
    SELECT id, coalesce(scraped_at, created_at)::VARCHAR AS scraped_at, coalesce(nullif(product_url, ''), nullif(source_url, '')) AS product_url FROM products""")
def _(t):
    candidates = t.products.select("id", "scraped_at", "product_url")
    rows = C.hydrate_candidates(candidates, t.products)
    return rows.withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss"))


@query("brand_validated_category", """
    SELECT b.id, coalesce((SELECT max_by(c.name, m.category_id) FROM brand_categories m JOIN categories c ON c.id = m.category_id WHERE m.is_primary AND m.brand_id = b.id),
           nullif(b.category, ''), 'Fashion') AS category FROM brands b""")
def _(t):
    return C.brand_validated_category(t.brands, t.brand_categories, t.categories).select("id", "category")


@query("reuse_embeddings", f"""
    WITH s AS (SELECT {bare_sql('product_url')} AS u, arg_max_null(embedding, (length(id), id)) AS e FROM products WHERE product_url IS NOT NULL GROUP BY 1)
    SELECT p.id, coalesce(len(s.e) = {DIM} AND abs(sqrt(list_sum(list_transform(s.e::DOUBLE[], lambda x: x * x))) - 1) <= 0.02, FALSE) AS reused
    FROM products p LEFT JOIN s ON s.u = {bare_sql('p.product_url')} AND s.u <> ''""")
def _(t):
    incoming = t.products.select("id", F.concat(bare_url(F.col("product_url")), F.lit("/?utm=1")).alias("product_url"))
    incoming = incoming.withColumn("product_url", F.when(F.col("product_url") == "/?utm=1", None).otherwise(F.col("product_url")))
    return C.reuse_embeddings(incoming, t.products, DIM).select("id", "reused")


@query("related_by_category_or_brand", """
    WITH o AS (SELECT id, CAST(id AS BIGINT) AS k, category_id, brand_id FROM products),
    pairs AS (SELECT a.id AS source_id, b.id AS related_id, b.k FROM o a JOIN o b ON a.category_id = b.category_id AND a.id <> b.id
              UNION SELECT a.id, b.id, b.k FROM o a JOIN o b ON a.brand_id = b.brand_id AND a.id <> b.id)
    SELECT source_id, related_id, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY k, related_id) AS INT) AS position FROM pairs) WHERE position <= 6""")
def _(t):
    return C.related_by_category_or_brand(t.products, t.products)


@query("category_leaves", """
    SELECT id, parent_id, name, slug, NOT EXISTS (SELECT 1 FROM categories k WHERE k.parent_id = c.id) AS is_leaf FROM categories c""")
def _(t):
    return C.category_leaves(t.categories)


@query("personalized_join", """
    SELECT i.user_id, p.id, coalesce(list_contains(f.saved_brand_ids, p.brand_id), FALSE) AS saved_brand, f.gender_preference
    FROM (SELECT DISTINCT user_id, product_id FROM interactions) i JOIN products p ON p.id = i.product_id LEFT JOIN preferences f ON f.user_id = i.user_id""")
def _(t):
    pairs = t.interactions.select("user_id", F.col("product_id").alias("id")).distinct()
    rows = C.personalized_products(t.products, t.preferences, pairs)
    saved = F.coalesce(F.array_contains("saved_brand_ids", F.col("brand_id")), F.lit(False))
    return rows.select("user_id", "id", saved.alias("saved_brand"), "gender_preference")
