"""Registered catalog-quality, inventory and category audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import hardware as H
from registry.catalog_queries import CLOSURE_SQL
from registry.classify_queries import AMBIGUITY_SQL, CLASSIFIED, COMPACT_SQL
from registry.core import DIM, STORAGE, query
from registry.hardware import HARDWARE, lit, part, term
from registry.post_queries import source_post_sql
from registry.scalar_queries import (
    PRODUCT_NAME_SQL, QUALITY_SQL, SOURCE_URL_SQL, USABLE_SQL, enriched, gem_label_sql, gender_score_sql, image_class_sql, joined,
    price_status_sql, valid_url_sql,
)
from vitrine.operators import catalog as C
from vitrine.operators import quality as Q
from vitrine.taxonomy import FASHION

KEYS_SQL = f"""dk AS (SELECT id, brand_id, brand_name, reason, lower(trim(v)) AS match_value FROM (
      SELECT id, brand_id, brand_name, 'same_instagram_post' AS reason, instagram_post_id AS v FROM products
      UNION ALL SELECT id, brand_id, brand_name, 'same_source_url', source_url FROM products
      UNION ALL SELECT id, brand_id, brand_name, 'same_product_url', product_url FROM products
      UNION ALL SELECT id, brand_id, brand_name, 'same_brand_normalized_name', CASE WHEN coalesce(trim(brand_id), '') <> '' AND {PRODUCT_NAME_SQL} <> ''
                THEN brand_id || ':' || trim(regexp_replace(lower({PRODUCT_NAME_SQL}), '[^a-z0-9]+', ' ', 'g')) END FROM products
      UNION ALL SELECT id, brand_id, brand_name, 'same_image_url', image_url FROM products) WHERE trim(coalesce(v, '')) <> ''),
    dg AS (SELECT reason, match_value, count(*) AS product_count, min(id) AS first_id FROM dk GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("duplicate_groups", f"""
    WITH {KEYS_SQL} SELECT g.*, k.brand_id, k.brand_name FROM dg g JOIN dk k ON k.reason = g.reason AND k.match_value = g.match_value AND k.id = g.first_id""")
def _(t):
    return Q.duplicate_groups(t.products)


@query("duplicate_members", f"WITH {KEYS_SQL} SELECT k.reason, k.match_value, k.id, g.product_count FROM dk k JOIN dg g USING (reason, match_value)")
def _(t):
    return Q.duplicate_members(t.products)


DUP_IDS_SQL = """tk AS (SELECT id, coalesce(brand_id, '') AS brand, coalesce(nullif(lower(trim(coalesce(nullif(instagram_post_id, ''), nullif(product_url, ''), ''))), ''),
    nullif(lower(trim(split_part(coalesce(image_url, ''), '?', 1))), '')) AS key FROM products),
    tdup AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY brand, key ORDER BY id) AS n FROM tk WHERE key IS NOT NULL) WHERE n > 1)"""


@query("duplicate_ids", f"WITH {DUP_IDS_SQL} SELECT id FROM tdup")
def _(t):
    return Q.duplicate_ids(t.products)


WARN_SQL = f"""{KEYS_SQL}, di AS (SELECT DISTINCT k.id FROM dk k JOIN dg g USING (reason, match_value)),
    wn AS (SELECT id, brand_id, concat_ws(',', CASE WHEN {PRODUCT_NAME_SQL} = '' THEN 'MISSING_NAME' END, CASE WHEN NOT {valid_url_sql('image_url')} THEN 'MISSING_IMAGE' END,
      CASE WHEN category_id IS NULL THEN 'MISSING_CATEGORY' END, CASE WHEN coalesce(len(embedding), 0) <> {DIM} THEN 'MISSING_EMBEDDING' END,
      CASE {price_status_sql('price')} WHEN 'INVALID' THEN 'INVALID_PRICE' WHEN 'SUSPICIOUS' THEN 'SUSPICIOUS_PRICE' END,
      CASE WHEN coalesce(trim(brand_id), '') = '' THEN 'MISSING_BRAND' END, CASE WHEN NOT {valid_url_sql(SOURCE_URL_SQL)} THEN 'INVALID_SOURCE_URL' END,
      CASE WHEN id IN (SELECT id FROM di) THEN 'DUPLICATE_CANDIDATE' END) AS warnings, {QUALITY_SQL} AS catalog_quality_score FROM products)"""


@query("catalog_issues", f"WITH {WARN_SQL} SELECT id, warnings, catalog_quality_score FROM wn WHERE warnings <> ''")
def _(t):
    rows = Q.catalog_issues(t.products, DIM)
    return rows.select("id", joined(F.col("warnings")).alias("warnings"), "catalog_quality_score")


@query("catalog_issues_filtered", f"WITH {WARN_SQL} SELECT id, warnings FROM wn WHERE contains(warnings, 'INVALID_PRICE') AND brand_id = 'Brand#3'")
def _(t):
    return Q.catalog_issues(t.products, DIM, issue="invalid_price", brand_id="Brand#3").select("id", joined(F.col("warnings")).alias("warnings"))


def pct(a: str, b: str = "total_products", d: int = 1) -> str:
    return f"CASE WHEN {b} > 0 THEN round_even({a} / {b}::DOUBLE * 100, {d}) ELSE 0.0 END"


@query("catalog_summary", f"""
    WITH {WARN_SQL}, m AS (SELECT count(*) AS total_products, count(*) FILTER ({valid_url_sql('image_url')}) AS products_with_images, count(*) FILTER ({price_status_sql('price')} IN ('VALID', 'SUSPICIOUS')) AS products_with_price,
      count(*) FILTER (category_id IS NOT NULL) AS products_with_category, count(*) FILTER (coalesce(len(embedding), 0) = {DIM}) AS products_with_embedding, count(*) FILTER ({price_status_sql('price')} = 'SUSPICIOUS') AS suspicious_price_count FROM products),
    b AS (SELECT count(*) AS total_brands, count(*) FILTER (id IN (SELECT brand_id FROM products)) AS brands_with_products FROM brands),
    x AS (SELECT m.*, b.*, (SELECT count(*) FROM dg) AS possible_duplicates, (SELECT count(*) FROM wn WHERE warnings <> '') AS products_with_issues FROM m, b),
    y AS (SELECT *, total_brands - brands_with_products AS brands_without_products, total_products - products_with_images AS products_without_images, total_products - products_with_price AS products_without_price,
      total_products - products_with_category AS products_without_category, total_products - products_with_embedding AS products_without_embedding, {pct('products_with_images')} AS image_coverage_percent,
      {pct('products_with_price')} AS price_coverage_percent, {pct('products_with_category')} AS category_coverage_percent, {pct('products_with_embedding')} AS embedding_coverage_percent FROM x)
    SELECT *, CASE WHEN total_products < 10 OR image_coverage_percent < 50 OR embedding_coverage_percent < 50 THEN 'NOT_READY'
      WHEN total_products >= 100 AND image_coverage_percent >= 90 AND category_coverage_percent >= 90 AND embedding_coverage_percent >= 95 THEN 'READY' ELSE 'NEEDS_ATTENTION' END AS catalog_status FROM y""")
def _(t):
    return Q.catalog_summary(t.brands, t.products, DIM)


@query("brand_health", f"""
    WITH s AS (SELECT brand_id, count(*) AS product_count, count(*) FILTER ({valid_url_sql('image_url')}) AS i, count(*) FILTER (coalesce(len(embedding), 0) = {DIM}) AS e, count(*) FILTER (category_id IS NOT NULL) AS c,
      sum({QUALITY_SQL}) AS q, max(coalesce(scraped_at, created_at)) AS last FROM products GROUP BY 1),
    r AS (SELECT b.id AS brand_id, coalesce(nullif(b.name, ''), b.brand_name) AS brand_name, coalesce(product_count, 0) AS product_count, coalesce(i, 0) AS products_with_images, coalesce(e, 0) AS products_with_embeddings,
      coalesce(c, 0) AS products_with_categories, CASE WHEN product_count > 0 THEN round_even(q / product_count::DOUBLE, 1) ELSE 0.0 END AS average_catalog_quality_score, last::VARCHAR AS last_product_ingested_at,
      b.id IN (SELECT brand_id FROM failures) AS failed FROM brands b LEFT JOIN s ON s.brand_id = b.id)
    SELECT * EXCLUDE (failed), CASE WHEN failed AND product_count = 0 THEN 'FAILED' WHEN product_count = 0 THEN 'EMPTY' WHEN product_count >= 3 AND least(products_with_images, products_with_embeddings, products_with_categories) / product_count::DOUBLE * 100 >= 90
      AND average_catalog_quality_score >= 85 THEN 'HEALTHY' ELSE 'PARTIAL' END AS ingestion_health FROM r""")
def _(t):
    rows = Q.brand_health(t.brands, t.products, t.failures, DIM)
    return rows.withColumn("last_product_ingested_at", F.date_format("last_product_ingested_at", "yyyy-MM-dd HH:mm:ss"))


I_RANK = H.term_rank("lower(txt)", HARDWARE)


def inventory_sql(source: str, name: str) -> str:
    types = ", ".join(f"({i}, {lit(HARDWARE.family_label(f))}, {lit(k)})" for i, (f, k) in enumerate(HARDWARE.types))
    return f"""{name}_s AS (SELECT *, {H.INVENTORY_TEXT} AS txt FROM {source} WHERE coalesce(catalog_status, '') <> 'NON_PRODUCT'), {name}_r AS (SELECT brand_id, {I_RANK} AS k FROM {name}_s),
    {name}_c AS (SELECT {H.type_of('k', HARDWARE)} AS type, count(*) AS products, count(DISTINCT nullif(brand_id, '')) AS brands FROM {name}_r WHERE k IS NOT NULL GROUP BY 1),
    {name}_j AS (SELECT v.position, v.family, v.type, coalesce(c.products, 0) AS products, coalesce(c.brands, 0) AS brands FROM (VALUES {types}) AS v(position, family, type) LEFT JOIN {name}_c c ON c.type = v.type),
    {name} AS (SELECT *, CASE WHEN products >= 40 AND brands >= 5 THEN 'HEALTHY' WHEN products >= 20 AND brands >= 3 THEN 'ADEQUATE' ELSE 'NEED_MORE' END AS status FROM {name}_j)"""


@query("inventory_report", f"WITH {inventory_sql('products', 'inv')} SELECT *, CASE WHEN status = 'NEED_MORE' THEN lower(family) END AS acquisition_category FROM inv")
def _(t):
    return Q.inventory_report(t.products, HARDWARE)


@query("compare_inventory", f"""
    WITH old_products AS (SELECT * FROM products WHERE scraped_at < TIMESTAMP '2023-11-15'), {inventory_sql('old_products', 'old')}, {inventory_sql('products', 'cur')}
    SELECT cur.type, cur.products, cur.brands, old.products AS before_products, old.brands AS before_brands, cur.products - old.products AS product_change, cur.brands - old.brands AS brand_change FROM cur LEFT JOIN old ON old.type = cur.type""")
def _(t):
    before = Q.inventory_report(t.products.where("scraped_at < TIMESTAMP '2023-11-15'"), HARDWARE)
    return Q.compare_inventory(before, Q.inventory_report(t.products, HARDWARE)).select(
        "type", "products", "brands", "before_products", "before_brands", "product_change", "brand_change")


@query("confidence_distribution", " UNION ALL ".join(
    f"SELECT '{n}' AS bucket, count(*) FILTER (classifier_confidence >= {a} AND classifier_confidence < {b}) AS products FROM products" for a, b, n in Q.CONFIDENCE_BUCKETS)
    + " UNION ALL SELECT 'missing', count(*) FILTER (classifier_confidence IS NULL) FROM products")
def _(t):
    return Q.confidence_distribution(t.products)


@query("category_audience_breakdown", """
    SELECT coalesce(c.name, 'Uncategorized') AS category, lower(coalesce(nullif(p.audience, ''), 'unspecified')) AS audience, count(*) AS "count" FROM products p LEFT JOIN categories c ON c.id = p.category_id GROUP BY 1, 2""")
def _(t):
    return Q.category_audience_breakdown(t.products, t.categories)


@query("brand_category_breakdown", """SELECT coalesce(nullif(category, ''), 'Uncategorized') AS category, count(*) AS "count" FROM brands GROUP BY 1""")
def _(t):
    return Q.brand_category_breakdown(t.brands)


from vitrine.functions import classify as K  # noqa: E402

GENERIC_SQL = f"lower(trim(coalesce(product_name, ''))) IN ({', '.join(lit(x) for x in K.GENERIC_NAMES)})"


@query("caption_like_names", f"""
    SELECT id, product_name, brand_id, (SELECT count(*) FROM products WHERE {GENERIC_SQL}) AS flagged FROM products WHERE {GENERIC_SQL} ORDER BY id LIMIT 25""")
def _(t):
    return Q.caption_like_names(t.products)


S_RANK = H.term_rank("txt", HARDWARE)
SCALE_SQL = f"""
    sa AS (SELECT *, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED}) WHERE coalesce(catalog_status, '') <> 'NON_PRODUCT'),
    sb AS (SELECT *, {S_RANK} AS k, {USABLE_SQL} AND contains(image_url, '/storage/v1/object/public/') AS stable, coalesce(price, 0) AS pr FROM sa),
    sc AS (SELECT *, {H.family_of('k', HARDWARE)} AS fam, {H.type_of('k', HARDWARE)} AS kind FROM sb),
    r AS (SELECT 'coverage' AS section, 'products' AS key, count(*) AS value FROM sc UNION ALL SELECT 'coverage', 'stable_images', count(*) FILTER (stable) FROM sc
      UNION ALL SELECT 'coverage', 'valid_embeddings', count(*) FILTER (len(embedding) = {DIM}) FROM sc UNION ALL SELECT 'coverage', 'classified_type', count(*) FILTER (k IS NOT NULL) FROM sc
      UNION ALL SELECT 'coverage', 'categorized', count(*) FILTER (category IS NOT NULL) FROM sc UNION ALL SELECT 'coverage', 'brands', count(*) FROM brands
      UNION ALL SELECT 'price_brackets', CASE WHEN pr <= 0 THEN 'missing' WHEN pr < 1000 THEN 'under_1000' WHEN pr <= 2500 THEN '1000_2500' WHEN pr <= 5000 THEN '2500_5000' ELSE 'over_5000' END, count(*) FROM sc GROUP BY 2
      UNION ALL SELECT 'categories', coalesce(category, 'uncategorized'), count(*) FROM sc GROUP BY 2 UNION ALL SELECT 'families', fam, count(*) FROM sc WHERE k IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'trusted_types', kind, count(*) FROM sc WHERE stable AND coalesce(classifier_confidence, 0) >= 0.8 AND k IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'brand_sizes', CASE WHEN coalesce(followers, 0) <= 0 THEN 'unknown' WHEN followers < 10000 THEN 'micro' WHEN followers < 50000 THEN 'small' WHEN followers < 250000 THEN 'medium' ELSE 'larger_independent' END, count(*) FROM brands GROUP BY 2),
    r2 AS (SELECT * FROM r UNION ALL SELECT 'brands_milestones', t, greatest(0, t::INT - value) FROM r, (VALUES ('150'), ('200'), ('250')) AS v(t) WHERE section = 'coverage' AND key = 'brands'
      UNION ALL SELECT 'products_milestones', t, greatest(0, t::INT - value) FROM r, (VALUES ('2000'), ('3000'), ('5000')) AS v(t) WHERE section = 'coverage' AND key = 'products'
      UNION ALL SELECT 'weak_families', key, value FROM r WHERE section = 'families' AND value < 20)"""


@query("catalog_scale_report", f"""
    WITH {SCALE_SQL} SELECT section, key, value, CASE WHEN section = 'trusted_types' THEN CASE WHEN value >= 100 THEN 'SUFFICIENT' WHEN value >= 50 THEN 'DEVELOPING' ELSE 'WEAK' END END AS status FROM r2""")
def _(t):
    return Q.catalog_scale_report(t.brands, enriched(t), HARDWARE, STORAGE, DIM)


# ---------------------------------------------------------------- categories

F_RANK = H.term_rank("txt", FASHION)
CLOSURE = CLOSURE_SQL.replace("WITH RECURSIVE ", "", 1)
FAM_RULES = " ".join(f"WHEN '{s}' THEN coalesce(fam IN ({', '.join(lit(f) for f in fs)}), FALSE)" for s, fs in Q.CATEGORY_FAMILIES.items())
SUPPORT_SQL = f"""{CLOSURE}, {CLASSIFIED},
    ev AS (SELECT cls.*, {F_RANK} AS k, {H.AUDIENCE_TEXT.replace("coalesce(category_audience,'')", "coalesce(ca.audience,'')").replace("coalesce(audience,'')", "coalesce(cls.audience,'')").replace("coalesce(category,'')", "coalesce(ca.name,'')")} AS aud
           FROM cls LEFT JOIN categories ca ON ca.id = cls.category_id WHERE coalesce(catalog_status, '') <> 'NON_PRODUCT' AND coalesce(classifier_confidence, 0) >= 0.8 AND d_conf >= 0.8 AND d_slug IS NOT NULL),
    ev2 AS (SELECT *, {H.family_of('k', FASHION)} AS fam, {H.type_of('k', FASHION)} AS kind FROM ev),
    req AS (SELECT id AS rid, slug AS requested FROM categories UNION SELECT NULL, s FROM (VALUES ('accessories-jewellery'), ('accessories-bags')) AS v(s)),
    acc AS (SELECT requested, requested AS a FROM req UNION SELECT 'accessories-jewellery', 'women-jewelry' UNION SELECT 'accessories-bags', 'women-bags'),
    ok AS (SELECT DISTINCT e.id, acc.requested FROM ev2 e, acc WHERE acc.a = e.d_slug OR EXISTS (SELECT 1 FROM categories d JOIN closure x ON x.id = d.id JOIN categories a ON a.id = x.root_id WHERE d.slug = e.d_slug AND a.slug = acc.a)),
    support AS (SELECT e.id, e.brand_id, e.category_id, ok.requested AS slug, e.classifier_confidence FROM ok JOIN ev2 e ON e.id = ok.id
      WHERE (NOT starts_with(ok.requested, 'women-') OR {gender_score_sql('aud', "'women'")} > 0) AND (NOT starts_with(ok.requested, 'men-') OR {gender_score_sql('aud', "'men'")} > 0)
        AND (NOT starts_with(ok.requested, 'unisex-') OR {gender_score_sql('aud', "'unisex'")} > 0) AND (CASE ok.requested {FAM_RULES} ELSE TRUE END) AND (NOT ends_with(ok.requested, 'jeans') OR coalesce(kind IN ('jeans', 'wide-leg-jeans'), FALSE)))"""


def support(t):
    products = C.attach_category(t.products, t.categories)
    return Q.category_support(products, t.categories, FASHION)


@query("product_supports_category", f"WITH RECURSIVE {SUPPORT_SQL} SELECT id, brand_id, slug FROM support")
def _(t):
    return support(t).select("id", "brand_id", "slug")


@query("category_brands", f"""
    WITH RECURSIVE {SUPPORT_SQL}, d AS (SELECT s.*, coalesce(p.scraped_at, p.created_at) AS ts FROM support s JOIN products p ON p.id = s.id WHERE s.slug = 'accessories' AND s.brand_id IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY ts DESC NULLS LAST, id) AS n FROM d)
    SELECT n.brand_id, any_value(b.name) AS name, count(*) AS supporting_product_count, string_agg(n.id, ',' ORDER BY n.n) FILTER (n.n <= 5) AS supporting_products, round_even(avg(classifier_confidence), 4) AS average_confidence
    FROM n JOIN brands b ON b.id = n.brand_id GROUP BY 1""")
def _(t):
    rows = Q.category_brands(support(t), t.brands, t.products, "accessories")
    return rows.withColumn("supporting_products", joined(F.col("supporting_products")))


MAPPED_SQL = f"""{SUPPORT_SQL}, mp AS (SELECT s.brand_id, s.category_id, count(*) AS n, max(s.classifier_confidence) AS confidence FROM support s JOIN categories c ON c.id = s.category_id AND c.slug = s.slug WHERE s.brand_id IS NOT NULL GROUP BY 1, 2),
    pm AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY n DESC, category_id) = 1 AS is_primary FROM mp)"""


@query("primary_category", f"WITH RECURSIVE {MAPPED_SQL} SELECT brand_id, category_id, n, is_primary FROM pm")
def _(t):
    return Q.primary_category(Q.supported_mappings(support(t), t.categories)).select("brand_id", "category_id", "n", "is_primary")


@query("rebuild_brand_categories", f"""
    WITH RECURSIVE {MAPPED_SQL} SELECT brand_id, category_id, is_primary, 'product_derived' AS source, confidence FROM pm
    UNION ALL SELECT brand_id, category_id, is_primary, source, confidence FROM brand_categories m WHERE source <> 'product_derived' AND NOT EXISTS (SELECT 1 FROM pm WHERE pm.brand_id = m.brand_id AND pm.category_id = m.category_id)""")
def _(t):
    return Q.rebuild_brand_categories(support(t), t.categories, t.brand_categories)


@query("invalid_brand_mappings", f"""
    WITH RECURSIVE {SUPPORT_SQL} SELECT m.brand_id, m.category_id, c.slug FROM brand_categories m JOIN categories c ON c.id = m.category_id WHERE NOT EXISTS (SELECT 1 FROM support s WHERE s.brand_id = m.brand_id AND s.slug = c.slug)""")
def _(t):
    return Q.invalid_mappings(t.brand_categories, support(t), t.categories)


OVERLAP = ("accessories", "watches", "home-decor", "women-kurtis")


@query("category_overlaps", f"""
    WITH RECURSIVE {SUPPORT_SQL}, o AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(OVERLAP))}) AS v(i, slug)), h AS (SELECT DISTINCT s.brand_id, o.i, o.slug FROM support s JOIN o ON o.slug = s.slug WHERE s.brand_id IS NOT NULL)
    SELECT a.brand_id, a.slug AS left_slug, b.slug AS right_slug FROM h a JOIN h b ON a.brand_id = b.brand_id AND a.i < b.i""")
def _(t):
    return Q.category_overlaps(support(t), OVERLAP)


HEALTH_CONF = "coalesce(classifier_confidence, 0) >= 0.8"


@query("category_health", f"""
    WITH p AS (SELECT p.*, c.slug AS cslug FROM products p LEFT JOIN categories c ON c.id = p.category_id), n AS (SELECT count(*) AS n FROM p),
    cat AS (SELECT 'categories' AS section, CASE WHEN {HEALTH_CONF} THEN coalesce(nullif(normalized_subcategory, ''), cslug, 'UNCATEGORIZED') ELSE 'UNCATEGORIZED' END AS key, count(*) AS value FROM p GROUP BY 2)
    SELECT * FROM cat UNION ALL SELECT 'suspicious_category', key, value FROM cat, n WHERE value > greatest(100, n.n * 0.35)
    UNION ALL SELECT 'sources', CASE WHEN {HEALTH_CONF} THEN CASE lower(coalesce(nullif(classification_source, ''), 'legacy')) WHEN 'heuristic' THEN 'deterministic' WHEN 'openai' THEN 'ai' ELSE lower(coalesce(nullif(classification_source, ''), 'legacy')) END ELSE 'unresolved' END, count(*) FROM p GROUP BY 2
    UNION ALL SELECT 'products', 'total', count(*) FROM p UNION ALL SELECT 'products', 'confident', count(*) FILTER ({HEALTH_CONF}) FROM p
    UNION ALL SELECT 'images', 'stable', count(*) FILTER (starts_with(image_url, '{STORAGE}/storage/v1/object/public/')) FROM p UNION ALL SELECT 'images', 'missing', count(*) FILTER (coalesce(image_url, '') = '') FROM p
    UNION ALL SELECT 'images', 'broken', count(*) FILTER (image_status IN ('BROKEN','EXPIRED_OR_FORBIDDEN','INVALID_URL','RECOVERY_REQUIRED','UNRECOVERABLE') OR (source = 'instagram' AND contains(image_url, 'unsplash.com'))) FROM p
    UNION ALL SELECT 'brands', 'with_products', count(*) FILTER (id IN (SELECT brand_id FROM products)) FROM brands UNION ALL SELECT 'brands', 'total', count(*) FROM brands
    UNION ALL SELECT 'brands', 'with_mappings', count(DISTINCT brand_id) FROM brand_categories WHERE confidence >= 0.8
    UNION ALL SELECT 'suspicious_brand', brand_id, count(*) FROM brand_categories WHERE confidence >= 0.8 GROUP BY 2 HAVING count(*) > 6""")
def _(t):
    return Q.category_health(t.products, t.brands, t.categories, t.brand_categories, STORAGE)


@query("image_health", f"""
    WITH r AS (SELECT 'product' AS owner, {image_class_sql('image_url')} AS class, count(*) AS images FROM products GROUP BY 2 UNION ALL SELECT 'brand', {image_class_sql('profile_picture_url')}, count(*) FROM brands GROUP BY 2)
    SELECT owner, class, images, round_even(images * 100 / (sum(images) OVER (PARTITION BY owner))::DOUBLE, 2) AS percent, class IN ('EXTERNAL_WORKING', 'STOCK_PHOTO') AS recoverable FROM r""")
def _(t):
    return Q.image_health(t.products, t.brands, STORAGE)


OUTCOME = "CASE WHEN nonprod THEN 'non_product' WHEN p_slug IS NOT NULL AND p_conf >= 0.8 THEN 'resolved_without_ai' ELSE 'would_require_ai' END"


@query("ambiguity_audit", f"""
    WITH {CLASSIFIED}, a AS (SELECT id, {AMBIGUITY_SQL} AS reason, {OUTCOME} AS outcome FROM cls WHERE coalesce(classifier_confidence, 0) < 0.8), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY id) AS n FROM a)
    SELECT reason, count(*) AS products, count(*) FILTER (outcome = 'non_product') AS non_product, count(*) FILTER (outcome = 'resolved_without_ai') AS resolved_without_ai, count(*) FILTER (outcome = 'would_require_ai') AS would_require_ai,
      string_agg(id, ',' ORDER BY id) FILTER (n <= 3) AS examples FROM n GROUP BY 1""")
def _(t):
    rows = Q.ambiguity_audit(t.products)
    return rows.withColumn("examples", joined(F.col("examples")))


@query("manual_review", f"""
    WITH {CLASSIFIED} SELECT cls.id, product_name, brand_name, {source_post_sql('product_url', 'source_url')} AS source_post_url, coalesce(metadata.caption, description) AS caption, c.slug AS current_category, p_slug AS proposed_category, p_conf AS confidence, {AMBIGUITY_SQL} AS reason
    FROM cls LEFT JOIN categories c ON c.id = cls.category_id WHERE coalesce(classifier_confidence, 0) < 0.8 AND contains(lower(coalesce(brand_name, '')), 'brand#1') AND contains({AMBIGUITY_SQL}, 'ambiguous')""")
def _(t):
    return Q.manual_review(t.products, t.categories, brand="Brand#1", reason="Ambiguous")


@query("classification_errors", f"""
    WITH {CLASSIFIED} SELECT cls.id, c.slug AS stored, d_slug AS evidence_based, c.slug <> d_slug AS obvious_mismatch FROM cls JOIN categories c ON c.id = cls.category_id WHERE coalesce(classifier_confidence, 0) >= 0.8 AND d_slug IS NOT NULL""")
def _(t):
    return Q.classification_errors(t.products, t.categories)


TILE_SQL = f"{USABLE_SQL} AND coalesce(starts_with(image_url, '{STORAGE}/storage/v1/object/public/product-images/'), FALSE)"


@query("type_tiles", f"""
    WITH s AS (SELECT *, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED})), r AS (SELECT *, {S_RANK} AS k FROM s), y AS (SELECT *, {H.type_of('k', HARDWARE)} AS slug, {TILE_SQL} AS ok FROM r WHERE k IS NOT NULL),
    o AS (SELECT slug, image_url, ok, row_number() OVER (PARTITION BY slug, ok ORDER BY coalesce(classifier_confidence, 0) DESC, coalesce(niche_score, 0) DESC, least(1.0, (coalesce(likes_count, 0) + coalesce(comments_count, 0) * 3) / 10000.0) DESC, coalesce(scraped_at::VARCHAR, '') DESC, id DESC) AS n FROM y)
    SELECT {H.type_label('slug', HARDWARE)} AS name, slug, max(CASE WHEN ok AND n = 1 THEN image_url END) AS image_url, count(*) AS product_count FROM o GROUP BY 2""")
def _(t):
    return Q.type_tiles(enriched(t), HARDWARE, STORAGE)


@query("pilot_report", f"""
    WITH p AS (SELECT * FROM products WHERE brand_id IN (SELECT id FROM brands WHERE lower(instagram_username) IN ('brand3', 'brand8')))
    SELECT 'images' AS section, CASE WHEN starts_with(image_url, '{STORAGE}/storage/v1/object/public/') THEN 'stable' WHEN coalesce(image_url, '') = '' THEN 'missing' ELSE 'external' END AS key, count(*) AS value FROM p GROUP BY 2
    UNION ALL SELECT 'embeddings', CASE WHEN coalesce(len(embedding), 0) = {DIM} THEN 'valid' ELSE 'invalid' END, count(*) FROM p GROUP BY 2
    UNION ALL SELECT 'categories', coalesce(nullif(normalized_subcategory, ''), 'unresolved'), count(*) FROM p GROUP BY 2
    UNION ALL SELECT 'confidence', CASE WHEN coalesce(classifier_confidence, 0) < 0.8 THEN 'low' ELSE 'ok' END, count(*) FROM p GROUP BY 2""")
def _(t):
    return Q.pilot_report(t.products, t.brands, ["brand3", "brand8"], STORAGE, DIM)


@query("feed_isolation", f"""
    WITH s AS (SELECT *, {H.INVENTORY_TEXT} AS txt FROM products), r AS (SELECT {I_RANK} AS k FROM s), f AS (SELECT {H.family_of('k', HARDWARE)} AS fam FROM r)
    SELECT count(*) AS total, count(*) FILTER (fam IN ('jewellery', 'metalware')) AS valid, round_even(count(*) FILTER (fam IN ('jewellery', 'metalware')) / count(*)::DOUBLE, 4) AS precision FROM f""")
def _(t):
    return Q.feed_isolation(t.products, HARDWARE, ("jewellery", "metalware"))
