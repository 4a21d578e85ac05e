"""Registered post-parsing functions over the posts built from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import hardware as H
from registry.core import query
from registry.hardware import first_word, lit, part, word, words_list
from registry.scalar_queries import joined
from vitrine.functions import posts as P
from vitrine.taxonomy import FASHION, FASHION_WORDS, escape_regex

RANK = H.term_rank("lower(txt)", FASHION)

BRAND_SQL = "coalesce(nullif(regexp_replace(regexp_replace(trim(coalesce({b}, '')), '^@+', ''), '\\s+', ' ', 'g'), ''), 'unknown_brand')"
USER_SQL = "coalesce(nullif(regexp_replace(lower({b}), '[^a-z0-9._]', '', 'g'), ''), 'unknown_brand')"


def brand_sql(column: str) -> str:
    return BRAND_SQL.format(b=column)


def user_sql(column: str) -> str:
    return USER_SQL.format(b=brand_sql(column))


@query("normalize_brand", f"""
    SELECT doc_id, {brand_sql('brand_name')} AS brand, {user_sql('brand_name')} AS username FROM posts""")
def _(t):
    return t.posts.select("doc_id", P.normalize_brand(F.col("brand_name")).alias("brand"),
                          P.normalize_username(F.col("brand_name")).alias("username"))


IDENTITY_INPUT = """CASE doc_id % 7 WHEN 0 THEN 'https://www.instagram.com/mira_threads/?hl=en' WHEN 1 THEN 'https://instagram.com/p/abc'
    WHEN 2 THEN '@Linen.House' WHEN 3 THEN product_url WHEN 4 THEN 'two words' WHEN 5 THEN '' ELSE brand_name END"""


@query("parse_identity", f"""
    WITH s AS (SELECT doc_id, trim(coalesce({IDENTITY_INPUT}, '')) AS r FROM posts),
    h AS (SELECT doc_id, r, regexp_extract(r, '^https?://(?:www\\.)?instagram\\.com/([A-Za-z0-9._]+)/?(?:\\?.*)?$', 1) AS h, regexp_replace(r, '^@+', '') AS bare FROM s),
    u AS (SELECT doc_id, CASE WHEN regexp_matches(r, '^https?://') THEN CASE WHEN h <> '' AND lower(h) NOT IN ('p', 'reel', 'explore', 'accounts') THEN {user_sql('h')} END
          WHEN r <> '' AND {user_sql('bare')} <> 'unknown_brand' AND {user_sql('bare')} = lower(bare) THEN {user_sql('bare')} END AS username FROM h)
    SELECT doc_id, username, 'https://www.instagram.com/' || username || '/' AS profile_url FROM u""")
def _(t):
    value = F.expr(IDENTITY_INPUT)
    found = P.parse_identity(value)
    return t.posts.select("doc_id", found["username"].alias("username"), found["profile_url"].alias("profile_url"))


def count_sql(label: str) -> str:
    t = "replace(lower(description), ',', '')"
    rx = f"([0-9]+(?:\\.[0-9]+)?)\\s*([kmb])?\\s+{label}"
    unit = f"CASE regexp_extract({t}, '{rx}', 2) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'b' THEN 1000000000 ELSE 1 END"
    return f"CAST(floor(coalesce(TRY_CAST(regexp_extract({t}, '{rx}', 1) AS DOUBLE) * {unit}, 0)) AS BIGINT)"


@query("parse_counts", f"""
    SELECT doc_id, {count_sql('followers')} AS followers, {count_sql('likes')} AS likes, {count_sql('comments')} AS comments FROM posts""")
def _(t):
    c = F.col("description")
    return t.posts.select("doc_id", *[P.parse_count(c, x).alias(x) for x in ("followers", "likes", "comments")])


PRICE_RX = r"(?i)(?:₹|rs\.?|inr)\s*([0-9][0-9,]*(?:\.\d{1,2})?)\s*([kK])?"


def price_sql(text: str) -> str:
    amount = f"TRY_CAST(replace(regexp_extract({text}, {lit(PRICE_RX)}, 1), ',', '') AS DOUBLE)"
    short = rf"(^|[^\p{{L}}\p{{N}}_₹])([0-9]+(?:\.[0-9]+)?)\s*[kK]([^\p{{L}}\p{{N}}_]|$)"
    return (f"coalesce({amount} * CASE WHEN regexp_extract({text}, {lit(PRICE_RX)}, 2) <> '' THEN 1000 ELSE 1 END, "
            f"TRY_CAST(regexp_extract({text}, {lit(short)}, 2) AS DOUBLE) * 1000)")


@query("extract_price", f"SELECT doc_id, {price_sql('description')} AS price FROM posts")
def _(t):
    return t.posts.select("doc_id", P.extract_price(F.col("description")).alias("price"))


def post_id_sql(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '(?i)instagram\\.com/(?:[^/?#]+/)?(?:p|reel)/([^/?#]+)', 1)"


def bare_sql(u: str) -> str:
    return f"rtrim(split_part(coalesce({u}, ''), '?', 1), '/')"


def source_post_sql(*urls: str) -> str:
    rx = "(?i)^https://(?:www\\.)?instagram\\.com/(?:[^/]+/)?(?:p|reel)/[^/]+$"
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({bare_sql(u)}, '{rx}') THEN {bare_sql(u)} END" for u in urls) + ")"


@query("post_id", f"""
    SELECT 'd' || doc_id AS key, {post_id_sql('product_url')} AS post_id, {source_post_sql('image_url', 'product_url')} AS source_post_url FROM posts
    UNION ALL SELECT 'p' || id, {post_id_sql('product_url')}, {source_post_sql('product_url', 'source_url')} FROM products
    UNION ALL SELECT 'w' || page_id, {post_id_sql('url')}, {source_post_sql('url')} FROM pages""")
def _(t):
    def rows(df, prefix, key, *urls):
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"),
                         P.post_id(F.col(urls[0])).alias("post_id"),
                         P.source_post_url(*[F.col(u) for u in (urls[1:] or urls)]).alias("source_post_url"))

    return (rows(t.posts, "d", "doc_id", "product_url", "image_url", "product_url")
            .unionByName(rows(t.products, "p", "id", "product_url", "product_url", "source_url"))
            .unionByName(rows(t.pages, "w", "page_id", "url")))


@query("infer_brand", f"""
    WITH s AS (SELECT doc_id, followers, regexp_extract(description, '(?i)Photo by\\s+(.+?)\\s+on\\s+', 1) AS c FROM posts)
    SELECT doc_id, {brand_sql('c')} AS brand_name, {user_sql('c')} AS username,
           CASE WHEN {user_sql('c')} <> 'unknown_brand' THEN 'https://www.instagram.com/' || {user_sql('c')} || '/' ELSE '' END AS profile_url,
           greatest(followers, 0) AS followers,
           CASE WHEN {brand_sql('c')} = 'unknown_brand' THEN 0.5::DOUBLE WHEN followers >= 5000 THEN 1.0 WHEN followers >= 1000 THEN 0.8 ELSE 0.75 END AS niche_score FROM s""")
def _(t):
    return t.posts.select("doc_id", P.infer_brand(F.col("description"), F.col("followers")).alias("b")).select("doc_id", "b.*")


W = FASHION_WORDS
META_SQL = f"""
    WITH s AS (SELECT doc_id, description, description AS txt, lower(description) AS low FROM posts), r AS (SELECT *, {RANK} AS k FROM s),
    c AS (SELECT *, {words_list('low', W.caption_colours)} AS colours FROM r)
    SELECT doc_id, array_to_string(regexp_extract_all(description, '#([A-Za-z0-9_]+)', 1), ',') AS hashtags,
           {H.family_of('k', FASHION)} AS product_family, {H.type_of('k', FASHION)} AS product_type,
           nullif(split_part(colours, ',', 1), '') AS primary_colour,
           CASE WHEN contains(colours, ',') THEN substr(colours, strpos(colours, ',') + 1) ELSE '' END AS secondary_colours,
           {words_list('low', W.caption_styles)} AS style, {first_word('low', W.caption_fits)} AS fit,
           {first_word('low', W.caption_materials)} AS material, {first_word('low', W.caption_patterns)} AS pattern,
           {words_list('low', W.caption_occasions)} AS occasion FROM c"""


@query("fashion_metadata", META_SQL)
def _(t):
    m = P.fashion_metadata(F.col("description"), FASHION, FASHION_WORDS)
    rows = t.posts.select("doc_id", m.alias("m"))
    lists = ("hashtags", "secondary_colours", "style", "occasion")
    names = ("hashtags", "product_family", "product_type", "primary_colour", "secondary_colours", "style", "fit",
             "material", "pattern", "occasion")
    return rows.select("doc_id", *[joined(F.col(f"m.{n}")).alias(n) if n in lists else F.col(f"m.{n}").alias(n) for n in names])


def title(word: str) -> str:
    return word.title()


def fallback_name_sql(text: str) -> str:
    low = f"lower(regexp_replace({text}, '(?i)^Photo by .+? on Instagram:\\s*', ''))"
    colours = ", ".join(f"CASE WHEN {word(low, w)} THEN {lit(title(w))} END" for w in P.FALLBACK_COLOURS)
    materials = ", ".join(f"CASE WHEN {word(low, w)} THEN {lit(title(w))} END" for w in P.FALLBACK_MATERIALS)
    nouns = "CASE " + " ".join(f"WHEN {word(low, w, suffix='s?')} THEN {lit(title(w))}"
                               for w in sorted(P.PRODUCT_TERMS, key=len, reverse=True)) + " END"
    return f"nullif(concat_ws(' ', {colours}, {materials}, {nouns}), '')"


def clean_name_steps(source: str, key: str, text: str) -> str:
    """SQL steps of the title cleaner, ending in a table cn(key, name)."""
    return f"""
    c1 AS (SELECT {key}, {text} AS raw, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS t FROM {source}),
    c2 AS (SELECT {key}, raw, regexp_replace(regexp_replace(t, '(?i)^Photo by .+? on Instagram:\\s*', ''), '^[ \\-—:|]+|[ \\-—:|]+$', '', 'g') AS t FROM c1),
    c3 AS (SELECT {key}, raw, regexp_replace(t, {lit(P.PRICE_TEXT)}, '', 'g') AS t FROM c2),
    c4 AS (SELECT {key}, raw, regexp_replace(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{P.CALL_TO_ACTION})([^\\p{{L}}\\p{{N}}_].*$|$)', '\\1') AS t FROM c3),
    c5 AS (SELECT {key}, raw, regexp_replace(t, '#[A-Za-z0-9_]+', '', 'g') AS txt FROM c4),
    c6 AS (SELECT *, lower(txt) AS low, {RANK} AS k, regexp_replace(regexp_replace(txt, '(?s)(?:[.!?]|\\s+[|•]\\s+).*$', ''), '^[ \\-—:|,.]+|[ \\-—:|,.]+$', '', 'g') AS clause FROM c5),
    c7 AS (SELECT *, length(clause) BETWEEN 4 AND 100 AND NOT {word('lower(clause)', *P.MARKETING_WORDS)}
        AND NOT (regexp_matches(lower(clause), '^(?:photo|video|reel)s?\\s+(?:by|shared by)([^\\p{{L}}\\p{{N}}_]|$)') OR contains(lower(clause), 'may be an image of')
                 OR regexp_matches(lower(clause), '@[a-z0-9_.]+') OR regexp_matches(lower(clause), '^[\\d,]+\\s+likes?,\\s*[\\d,]+\\s+comments?([^\\p{{L}}\\p{{N}}_]|$)'))
        AND lower(clause) NOT IN ({', '.join(lit(x) for x in P.REJECTED_CANDIDATES)}) AS good FROM c6),
    cn AS (SELECT {key}, CASE WHEN good THEN clause WHEN k IS NOT NULL THEN concat_ws(' ', {_cap(first_word('low', W.caption_colours))},
        {_cap(first_word('low', W.caption_materials))}, {H.type_label(H.type_of('k', FASHION), FASHION)}) ELSE {fallback_name_sql('raw')} END AS name FROM c7)"""


def _cap(expr: str) -> str:
    return f"(upper(({expr})[1]) || ({expr})[2:])"


@query("clean_product_name", f"WITH {clean_name_steps('posts', 'doc_id', 'description')} SELECT doc_id, name FROM cn")
def _(t):
    return t.posts.select("doc_id", P.clean_product_name(F.col("description"), FASHION, FASHION_WORDS).alias("name"))


@query("fallback_product_name", f"SELECT doc_id, {fallback_name_sql('description')} AS name FROM posts")
def _(t):
    return t.posts.select("doc_id", P.fallback_product_name(F.col("description")).alias("name"))


def likely_sql(text: str, image: str) -> str:
    t = f"regexp_replace(lower({text}), '[_#]', ' ', 'g')"
    commerce = " + ".join(f"CAST({part(t, s)} AS INT)" for s in P.COMMERCE_SIGNALS)
    return (f"(NOT ({part(t, *P.SOCIAL_POST_TERMS)} AND NOT {part(t, *P.PRODUCT_TERMS)}) AND ({word(t, *P.PRODUCT_TERMS, suffix='s?')} "
            f"OR (({commerce}) >= 2 AND coalesce(regexp_matches({image}, '^https?://'), FALSE))))")


@query("is_likely_product_post", f"SELECT doc_id, {likely_sql('description', 'image_url')} AS product_post FROM posts")
def _(t):
    return t.posts.select("doc_id", P.is_likely_product_post(F.col("description"), F.col("image_url")).alias("product_post"))


POST_ERRORS_SQL = """concat_ws(',', CASE WHEN NOT starts_with(product_url, 'https://www.instagram.com/') THEN 'invalid_product_url' END,
    CASE WHEN NOT coalesce(regexp_matches(image_url, '^https?://'), FALSE) THEN 'invalid_image_url' END, CASE WHEN trim(coalesce(description, '')) = '' THEN 'missing_description' END)"""


@query("validate_post", f"SELECT doc_id, {POST_ERRORS_SQL} AS errors FROM posts")
def _(t):
    return t.posts.select("doc_id", joined(P.post_errors(t.posts)).alias("errors"))


def ladder_sql(text: str) -> str:
    low = f"lower({text})"
    men = part(low, *P.MEN_MARKS)
    rungs = []
    for words, slug, men_slug in P.INGEST_LADDER:
        value = f"CASE WHEN {men} THEN {lit(men_slug)} ELSE {lit(slug)} END" if men_slug else lit(slug)
        rungs.append(f"WHEN {part(low, *words)} THEN {value}")
    return "CASE " + " ".join(rungs) + " ELSE 'uncategorized' END"


@query("fallback_category", f"""
    SELECT doc_id, slug AS category_slug, CASE WHEN slug = 'uncategorized' THEN 0.35::DOUBLE ELSE 0.85 END AS confidence_score
    FROM (SELECT doc_id, {ladder_sql('description')} AS slug FROM posts)""")
def _(t):
    return t.posts.select("doc_id", P.fallback_category(F.col("description")).alias("c")).select("doc_id", "c.*")


@query("validate_category", f"""
    WITH s AS (SELECT doc_id, description, CASE doc_id % 4 WHEN 0 THEN 'women-dresses' WHEN 1 THEN 'no-such-slug' WHEN 2 THEN NULL ELSE 'watches' END AS slug,
               CASE doc_id % 5 WHEN 0 THEN '1.7' WHEN 1 THEN 'high' WHEN 2 THEN '-0.2' ELSE '0.6' END AS conf FROM posts),
    f AS (SELECT *, {ladder_sql('description')} AS ladder, slug IN (SELECT slug FROM categories) AS known FROM s)
    SELECT doc_id, CASE WHEN known THEN slug ELSE ladder END AS category_slug,
           CASE WHEN known THEN greatest(0.0, least(1.0, coalesce(TRY_CAST(conf AS DOUBLE), 0.0)))::DOUBLE WHEN ladder = 'uncategorized' THEN 0.35 ELSE 0.85 END AS confidence_score FROM f""")
def _(t):
    from vitrine.operators.sizes import small_side

    slug = F.expr("CASE doc_id % 4 WHEN 0 THEN 'women-dresses' WHEN 1 THEN 'no-such-slug' WHEN 2 THEN NULL ELSE 'watches' END")
    conf = F.expr("CASE doc_id % 5 WHEN 0 THEN '1.7' WHEN 1 THEN 'high' WHEN 2 THEN '-0.2' ELSE '0.6' END")
    known = small_side(t.categories.select("slug", F.lit(True).alias("known")).distinct())
    rows = t.posts.withColumns({"slug": slug, "conf": conf}).join(known, "slug", "left")
    return rows.select("doc_id", P.validate_category(
        F.col("slug"), F.col("conf"), F.col("known"), F.col("description")).alias("c")).select("doc_id", "c.*")
