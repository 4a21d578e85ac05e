"""Domain tables over the driver's parquet tables.

One text per view serves both engines; the few spellings that differ come from a ``Dialect``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

CAPTIONS = (
    "Red silk dress for women Rs. 2,499 /- onwards. Shop now",
    "Photo by linen.barn on Instagram: Oversized linen shirt. ₹1,899",
    "Minimal analog watch in black, INR 4500. Order today",
    "Silver hoop earrings and a gold ring for women! #jewellery #party",
    "Men's straight leg jeans in blue denim 2.5k",
    "Giveaway winner announced behind the scenes",
    "Graphic tee, streetwear, size M available",
    "New drop launching soon @paper.moth",
    "Embroidered kurti for women with floral print, festive wedding wear",
    "Hiring a store manager, quote of the day",
    "Unisex hoodie oversized beige cotton",
    "May be an image of tunic, dress",
    "Tote bag and sling bag in leather, everyday work bag",
    "What should we wear to a date night?",
    "1,204 likes, 33 comments - quillhaven.in",
    "VelvetBreeze CoastalWear AutumnTones",
    "White sneakers for men, relaxed sporty fit rs 3k",
    "Handmade ceramic lamp, home decor vase",
    "Black blazer for women, formal wear collection",
    "Crop top and mini skirt for ladies, y2k vintage style",
    "A very long caption that keeps going on and on without any real product title or any clear end of the thought",
    "Sunglasses, shades and eyewear in brown",
    "Co-ord set matching set for women in green satin 12.5k followers 8 likes",
    "Look 12",
)
SLUGS = ("women-dresses", "men-shirts", "accessories-jewellery", "women-kurtis", "unisex-hoodies", "women-jeans",
         "watches-minimal", "home-decor", "women-tops", "men-jeans", "accessories-bags", "uncategorized")
#: Hour of a product's last refresh: two brands were last refreshed long ago, so that stale ones occur.
AGED = "(CASE WHEN p_brand IN ('Brand#4', 'Brand#9') THEN k % 300 ELSE k END)"
HANDLES = ("ferngrove.label", "@Paper  Moth", "_sunloom_", "quillhaven.in", "Harbour Tailors", "linen.barn", "", "mira_threads")



class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark
        self.struct_open, self.struct_close = ("named_struct(", ")") if spark else ("{", "}")

    def text(self, value: str) -> str:
        return "NULL" if value == "" else "'" + value.replace("'", "\\'" if self.spark else "''") + "'"

    def pick(self, index: str, values) -> str:
        """The constant at a zero-based index; an empty entry is null."""
        items = [self.text(v) for v in (values.split("|") if isinstance(values, str) else values)]
        cells = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(items[:-1]))
        return f"CAST(CASE CAST(({index}) AS INT) % {len(items)} {cells} ELSE {items[-1]} END AS STRING)"

    def list(self, body: str) -> str:
        return f"array({body})" if self.spark else f"[{body}]"

    def field(self, name: str) -> str:
        return f"'{name}'," if self.spark else f"'{name}':"

    def hours(self, n: str) -> str:
        """The instant n hours after 2023-10-01."""
        if self.spark:
            return f"timestampadd(HOUR, CAST({n} AS INT), TIMESTAMP '2023-10-01 00:00:00')"
        return f"(TIMESTAMP '2023-10-01 00:00:00' + to_hours(CAST({n} AS INT)))"

    def json(self, column: str, key: str) -> str:
        function = "get_json_object" if self.spark else "json_extract_string"
        return f"{function}({column}, '$.{key}')"

    def each(self, *values) -> str:
        """One row per value."""
        cells = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
        return f"explode(array({cells}))" if self.spark else f"unnest([{cells}])"


VIEWS: dict[str, Callable[[Dialect], str]] = {
    "brands": lambda d: f"""
        SELECT p_brand AS id, p_brand AS name,
               CASE WHEN n % 4 = 0 THEN NULL ELSE p_brand END AS brand_name,
               lower(regexp_replace(p_brand, '[^a-zA-Z0-9._]', '')) AS instagram_username,
               {d.pick('n', 'Fashion|Jewellery||Decor')} AS category,
               CAST(n * 1500 AS INT) AS followers,
               CASE WHEN n % 7 = 0 THEN NULL ELSE CAST(n AS DOUBLE) / 25 END AS niche_score,
               CASE WHEN n % 3 = 0 THEN NULL ELSE concat('https://img.example.com/b/', p_brand, '.jpg') END AS profile_picture_url,
               CASE WHEN n % 5 = 0 THEN NULL ELSE concat('https://www.instagram.com/brand', CAST(n AS STRING), '/') END AS instagram_profile_url,
               concat('https://brand', CAST(n AS STRING), '.example.com') AS profile_url
        FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS n FROM part)
    """,
    "categories": lambda d: f"""
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name,
               {d.pick('r_regionkey', 'women|men|accessories|unisex|watches')} AS slug,
               {d.pick('r_regionkey % 3', 'WOMEN|MEN|UNISEX')} AS audience, CAST(r_regionkey AS INT) AS display_order
        FROM region
        UNION ALL
        SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey + 1 AS BIGINT), n_name,
               CASE WHEN n_nationkey < {len(SLUGS)} THEN {d.pick(f'n_nationkey % {len(SLUGS)}', SLUGS)}
                    ELSE lower(replace(n_name, '_', '-')) END,
               {d.pick('n_regionkey % 3', 'WOMEN|MEN|UNISEX')}, CAST(n_nationkey AS INT)
        FROM nation
    """,
    "products": lambda d: f"""
        SELECT CAST(k AS STRING) AS id,
               CASE WHEN k % 43 = 0 THEN NULL ELSE p_brand END AS brand_id,
               CASE WHEN k % 31 = 0 THEN NULL ELSE p_brand END AS brand_name, p_brand AS brand,
               CASE WHEN k % 53 = 0 THEN '' WHEN k % 59 = 0 THEN 'Ring' ELSE p_name END AS product_name,
               CASE WHEN k % 47 = 0 THEN NULL ELSE p_name END AS item_name,
               CASE WHEN k % 61 = 0 THEN '' ELSE p_type END AS description,
               CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('https://cdn.example.com/', CAST(k AS STRING), '.jpg?x=1')
                    ELSE concat('https://storage.example.com/storage/v1/object/public/product-images/', CAST(k - CAST(k % 10 = 7 AS INT) AS STRING), '.jpg') END AS image_url,
               {d.pick('k % 11', 'VALID|VALID|VALID|VALID|BROKEN|UNKNOWN|RECOVERY_REQUIRED||VALID|MISSING|EXPIRED_OR_FORBIDDEN')} AS image_status,
               CASE WHEN k % 23 = 0 THEN NULL WHEN k % 19 = 0 THEN 'not a url'
                    ELSE concat('https://www.instagram.com/shop', CAST(k % 9 AS STRING), '/p/', CAST(k AS STRING), '/') END AS product_url,
               CASE WHEN k % 13 = 0 THEN NULL ELSE concat('https://src.example.com/', CAST(k - CAST(k % 10 = 5 AS INT) AS STRING)) END AS source_url,
               {d.pick('k % 3', 'instagram|manual|feed')} AS source,
               CASE WHEN k % 17 = 0 THEN '' ELSE concat('post', CAST(k - CAST(k % 10 = 3 AS INT) AS STRING)) END AS instagram_post_id,
               CASE WHEN k % 37 = 0 THEN NULL WHEN k % 10 = 0 THEN CAST(0 AS DOUBLE) WHEN k % 71 = 0 THEN CAST(50 AS DOUBLE) ELSE p_retailprice END AS price,
               CASE WHEN k % 3 = 0 THEN NULL ELSE 'INR' END AS currency,
               CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(k % 21 AS DOUBLE) / 20 END AS niche_score,
               CASE WHEN k % 41 = 0 THEN NULL ELSE 100 + k % 25 END AS category_id,
               {d.pick('k % 7', 'Rings|Bolts||Gears|Plates|Widgets|Anvils')} AS subcategory,
               {d.pick('k % 12', 'women|men|accessories|women|unisex|women|watches|home-decor|women|men|accessories|')} AS normalized_main_category,
               {d.pick(f'k % {len(SLUGS)}', SLUGS)} AS normalized_subcategory,
               {d.pick('k % 6', 'WOMEN||MEN|UNISEX||women')} AS audience,
               CASE WHEN k % 67 = 0 THEN NULL ELSE CAST(k % 101 AS DOUBLE) / 100 END AS classifier_confidence,
               {d.pick('k % 7', 'deterministic|heuristic|openai|manual|legacy||metadata')} AS classification_source,
               CASE k % 20 WHEN 0 THEN 'NON_PRODUCT' WHEN 1 THEN 'MANUAL_REVIEW' WHEN 2 THEN NULL ELSE 'ACTIVE' END AS catalog_status,
               CAST((k * 7) % 500 AS INT) AS likes_count, CAST(k % 40 AS INT) AS comments_count,
               {d.pick('k % 5', '|summer|festive||office')} AS source_hashtag,
               CASE WHEN k % 73 = 0 THEN NULL ELSE {d.hours(AGED)} END AS scraped_at, {d.hours(f'{AGED} - 12')} AS created_at,
               embedding,
               {d.struct_open}{d.field('colour')} {d.pick('k % 4', 'red|blue||black')}, {d.field('color')} {d.pick('k % 5', '|||gold|')},
                      {d.field('style')} CASE k % 4 WHEN 0 THEN {d.list("'minimal', 'party'")} WHEN 1 THEN {d.list("'vintage'")} WHEN 2 THEN NULL ELSE {d.list("'minimal'")} END,
                      {d.field('fit')} {d.pick('k % 3', 'small||large')}, {d.field('primary_colour')} {d.pick('k % 6', 'red|blue|||green|black')},
                      {d.field('secondary_colours')} CASE WHEN k % 3 = 0 THEN {d.list("'gold'")} ELSE NULL END,
                      {d.field('product_type')} {d.pick('k % 4', 'ring||bolt|')}, {d.field('product_family')} {d.pick('k % 4', 'jewellery||fasteners|')},
                      {d.field('caption')} CASE WHEN k % 5 = 0 THEN NULL ELSE {d.pick(f'k % {len(CAPTIONS)}', CAPTIONS)} END,
                      {d.field('hashtags')} CASE k % 3 WHEN 0 THEN {d.list("'jewellery', 'party'")} WHEN 1 THEN NULL ELSE {d.list("'kurti'")} END,
                      {d.field('alt_text')} CASE WHEN k % 8 = 0 THEN 'May be an image of bag, dress' WHEN k % 9 = 0 THEN 'women in a dress' ELSE NULL END,
                      {d.field('post_text')} {d.pick('k % 7', '|for men|for women||unisex|girl|')}{d.struct_close} AS metadata
        FROM (SELECT p_partkey AS k, p_name, p_brand, p_type, p_retailprice, embedding
              FROM part LEFT JOIN embeddings ON p_partkey = vec_id)
    """,
    "interactions": lambda d: f"""
        SELECT event_id, CAST(user_id AS STRING) AS user_id, {d.json('props', 'k')} AS product_id,
               CASE event_type WHEN 'purchase' THEN 'save' ELSE event_type END AS action, CAST(ts AS TIMESTAMP) AS ts
        FROM events
    """,
    "search_queries": lambda d: f"""
        SELECT CAST(vec_id AS STRING) AS qid,
               CASE WHEN vec_id % 5 = 0 THEN concat(p_name, ' under 950') WHEN vec_id % 7 = 0 THEN concat(p_name, ' for women')
                    WHEN vec_id % 11 = 0 THEN concat('cute ', p_name, ' from 920 for men') ELSE p_name END AS query,
               embedding, CASE WHEN vec_id % 3 = 0 THEN CAST(1 + vec_id % 5 AS BIGINT) ELSE NULL END AS category_id, label
        FROM embeddings JOIN part ON p_partkey = vec_id
    """,
    "qrels": lambda d: f"""
        SELECT CAST(q.vec_id AS STRING) AS qid, CAST(p.vec_id AS STRING) AS product_id,
               CASE WHEN p.label = q.label THEN 2 ELSE 1 END AS grade
        FROM (SELECT vec_id, label, (vec_id + step) % (SELECT count(*) FROM embeddings) AS target
              FROM (SELECT vec_id, label, {d.each(1, 4, 6, 9, 15, 30)} AS step FROM embeddings WHERE vec_id % 23 <> 0)) q
        JOIN embeddings p ON p.vec_id = q.target
    """,
    "judged": lambda d: f"""
        SELECT CAST(vec_id AS STRING) AS qid, CAST((vec_id + step) % (SELECT count(*) FROM embeddings) AS STRING) AS product_id
        FROM (SELECT vec_id, {d.each(1, 2, 3, 4, 6, 9, 15, 16, 30)} AS step FROM embeddings)
        WHERE vec_id % 13 <> 0 OR vec_id % 23 = 0
    """,
    "runs": lambda d: f"""
        SELECT run_id, CAST(vec_id AS STRING) AS qid, CAST(r AS INT) AS rank,
               CAST((vec_id + CASE WHEN run_id = 'a' THEN r * r ELSE CAST(r * (r + 1) / 2 AS BIGINT) END)
                    % (SELECT count(*) FROM embeddings) AS STRING) AS product_id
        FROM (SELECT vec_id, r, {d.each('a', 'b')} AS run_id
              FROM (SELECT vec_id, {d.each(*range(1, 21))} AS r FROM embeddings))
        WHERE vec_id % 19 <> 0 AND NOT (run_id = 'b' AND vec_id % 17 = 0) AND NOT (run_id = 'a' AND vec_id % 29 = 0)
    """,
    "search_log": lambda d: f"""
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, p_name AS query,
               CASE WHEN event_type = 'error' THEN 0 ELSE CAST(user_id % 16 AS INT) END AS result_count,
               value AS latency_ms, event_id % 2 = 0 AS cache_hit
        FROM events JOIN part ON p_partkey = CAST({d.json('props', 'k')} AS BIGINT)
    """,
    "posts": lambda d: f"""
        SELECT doc_id,
               CASE WHEN doc_id % 17 = 0 THEN concat('ftp://bad/', CAST(doc_id AS STRING))
                    WHEN doc_id % 11 = 4 THEN concat('https://www.instagram.com/shop/p/ID', CAST(doc_id - 1 AS STRING), '/?igsh=', CAST(doc_id AS STRING))
                    ELSE concat('https://www.instagram.com/shop/p/ID', CAST(doc_id AS STRING), '/') END AS product_url,
               CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('https://cdn.example.com/i/', CAST(doc_id - CAST(doc_id % 7 = 5 AS INT) AS STRING), '.jpg?sig=', CAST(doc_id AS STRING)) END AS image_url,
               concat({d.pick(f'doc_id % {len(CAPTIONS)}', CAPTIONS)}, '. ', text) AS description,
               {d.pick(f'doc_id % {len(HANDLES)}', HANDLES)} AS brand_name,
               {d.pick('doc_id % 3', 'summer||sale')} AS source_hashtag,
               CAST((doc_id * 37) % 9000 AS INT) AS followers,
               CASE WHEN doc_id % 4 = 0 THEN 'shop.one' ELSE '' END AS instagram_username,
               CASE WHEN doc_id % 5 = 0 THEN concat('ID', CAST(doc_id AS STRING)) ELSE '' END AS instagram_post_id,
               CAST(doc_id % 700 AS INT) AS likes_count, CAST(doc_id % 60 AS INT) AS comments_count,
               {d.hours('doc_id')} AS scraped_at, source
        FROM documents
    """,
    "brand_categories": lambda d: f"""
        SELECT p_brand AS brand_id, CAST(100 + n AS BIGINT) AS category_id, n % 2 = 0 AS is_primary,
               {d.pick('n % 3', 'manual|product_derived|ai_classified')} AS source, CAST(n AS DOUBLE) / 25 AS confidence
        FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 25 AS n FROM part)
        UNION ALL
        SELECT p_brand, CAST(100 + (n * 3 + 1) % 25 AS BIGINT), FALSE, 'manual', CAST(0.9 AS DOUBLE)
        FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 25 AS n FROM part)
        WHERE (n * 3 + 1) % 25 <> n
    """,
    "failures": lambda d: f"""
        SELECT p_brand AS brand_id, {d.pick('n % 2', 'product_processing|scrape')} AS stage, 'boom' AS message
        FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS n FROM part) WHERE n % 6 = 0
    """,
    "preferences": lambda d: f"""
        SELECT CAST(c_custkey AS STRING) AS user_id,
               CASE WHEN c_custkey % 3 = 0 THEN {d.list("'rings', 'women'")} WHEN c_custkey % 3 = 1 THEN {d.list("'gear'")} ELSE NULL END AS favourite_categories,
               CASE WHEN c_custkey % 4 = 0 THEN {d.list("'small', 'old'")} ELSE NULL END AS preferred_styles,
               CASE WHEN c_custkey % 2 = 0 THEN {d.list("'red'")} ELSE {d.list("'blue', 'green'")} END AS preferred_colours,
               CASE WHEN c_custkey % 5 = 0 THEN CAST(905 AS DOUBLE) ELSE NULL END AS min_price,
               CASE WHEN c_custkey % 7 = 0 THEN CAST(950 AS DOUBLE) ELSE NULL END AS max_price,
               {d.pick('c_custkey % 4', 'women||men|')} AS gender_preference,
               CASE WHEN c_custkey % 6 = 0 THEN {d.list("concat('Brand#', CAST(1 + c_custkey % 25 AS STRING))")} ELSE NULL END AS saved_brand_ids
        FROM customer
    """,
    "annotations": lambda d: f"""
        SELECT CAST(vec_id AS STRING) AS query, CAST(1 + (vec_id * r) % 12 + r AS INT) AS rank,
               CAST((vec_id + r) % (SELECT count(*) FROM embeddings) AS STRING) AS product_id,
               CASE WHEN (vec_id + r) % 9 = 0 THEN '' ELSE CAST((vec_id * 3 + r * r) % 4 AS STRING) END AS label
        FROM (SELECT vec_id, {d.each(*range(1, 13))} AS r FROM embeddings)
    """,
}


def _relations(text: str) -> list[str]:
    names = re.findall(r"(?is)\b(?:from|join)\s+([a-z_]+)\b", text)
    return list(dict.fromkeys(n for n in names if n in VIEWS or n in BASE_TABLES))


def dependencies(text: str) -> list[str]:
    """Views and base tables a statement reads, in order of appearance."""
    return _relations(text)


def view_dependencies(name: str) -> list[str]:
    return _relations(VIEWS[name](Dialect(False)))


def spark_sql(name: str) -> str:
    """The view for Spark, with its inputs as named DataFrame parameters."""
    text = VIEWS[name](Dialect(True))
    for dep in view_dependencies(name):
        text = re.sub(rf"(?i)\b(from|join)\s+{dep}\b", rf"\1 {{{dep}}}", text)
    return text


def duckdb_sql(name: str) -> str:
    return VIEWS[name](Dialect(False)).strip()
