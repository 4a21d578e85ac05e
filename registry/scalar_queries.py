"""Registered scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import hardware as H
from registry.core import DIM, NOW, STORAGE, query
from registry.hardware import HARDWARE, WORDS, lit, part, term, word
from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.operators.catalog import attach_category
from vitrine.taxonomy import FASHION, FASHION_WORDS


def enriched(t):
    return attach_category(t.products, t.categories)


def joined(column):
    return F.concat_ws(",", column)


RANK = H.term_rank("txt", HARDWARE)


@query("identify_product", f"""
    WITH s AS (SELECT id, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED})), r AS (SELECT id, {RANK} AS k FROM s)
    SELECT id, {H.family_of('k', HARDWARE)} AS family, {H.type_of('k', HARDWARE)} AS type FROM r""")
def _(t):
    p = enriched(t)
    found = X.identify_product(X.product_search_text(p), HARDWARE)
    return p.select("id", found["family"].alias("family"), found["type"].alias("type"))


FASHION_RANK = H.term_rank("txt", FASHION)


@query("identify_product_in_posts", f"""
    WITH s AS (SELECT doc_id, lower(description) AS txt FROM posts), r AS (SELECT doc_id, {FASHION_RANK} AS k FROM s)
    SELECT doc_id, {H.family_of('k', FASHION)} AS family, {H.type_of('k', FASHION)} AS type FROM r""")
def _(t):
    found = X.identify_product(F.col("description"), FASHION)
    return t.posts.select("doc_id", found["family"].alias("family"), found["type"].alias("type"))


@query("contains_term", f"""
    SELECT id, {term('txt', 'ring')} AS has_ring, {term('txt', 'red', 'blue')} AS has_colour, {term('txt', 'women')} AS has_women
    FROM (SELECT id, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED}))""")
def _(t):
    p = enriched(t)
    text = X.product_search_text(p)
    return p.select("id", X.contains_term(text, "ring").alias("has_ring"),
                    X.contains_term(text, "red", "blue").alias("has_colour"),
                    X.contains_term(text, "women").alias("has_women"))


@query("type_match", f"""
    SELECT id, {H.matched('txt', H.TYPE_TERMS)} AS types, {term('txt', 'gear')} AS is_gear, TRUE AS no_type, FALSE AS unknown_type
    FROM (SELECT id, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED}))""")
def _(t):
    p = enriched(t)
    text = X.product_search_text(p)
    types = X.matched_types(text, HARDWARE)
    in_order = F.filter(F.array(*[F.lit(k) for _, k in HARDWARE.types]), lambda k: F.array_contains(types, k))
    return p.select("id", joined(in_order).alias("types"), X.type_match(text, "gear", HARDWARE).alias("is_gear"),
                    X.type_match(text, None, HARDWARE).alias("no_type"), X.type_match(text, "sofa", HARDWARE).alias("unknown_type"))


@query("family_match", f"""
    SELECT id, {H.matched('txt', H.FAMILY_TERMS)} AS families, {term('txt', *HARDWARE.family_terms('fasteners'))} AS is_fastener
    FROM (SELECT id, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED}))""")
def _(t):
    p = enriched(t)
    text = X.product_search_text(p)
    families = X.matched_families(text, HARDWARE)
    in_order = F.filter(F.array(*[F.lit(f) for f in HARDWARE.families]), lambda f: F.array_contains(families, f))
    return p.select("id", joined(in_order).alias("families"), X.family_match(text, "fasteners", HARDWARE).alias("is_fastener"))


def gender_score_sql(audience: str, gender: str) -> str:
    named = " ".join(f"WHEN {gender} = '{g}' THEN {term(audience, g)}" for g in ("women", "men", "unisex"))
    return (f"CASE WHEN {gender} IS NULL THEN 0.5::DOUBLE WHEN (CASE {named} END) THEN 1.0 "
            f"WHEN {term(audience, 'unisex')} THEN 0.75 ELSE 0.0 END")


@query("gender_match_score", f"""
    SELECT id, {gender_score_sql('txt', "'women'")} AS women, {gender_score_sql('txt', "'men'")} AS men,
           {gender_score_sql('txt', 'NULL')} AS unset
    FROM (SELECT id, {H.AUDIENCE_TEXT} AS txt FROM ({H.ENRICHED}))""")
def _(t):
    p = enriched(t)
    text = X.audience_text(p)
    score = lambda g: X.gender_match_score(text, F.lit(g).cast("string"))
    return p.select("id", score("women").alias("women"), score("men").alias("men"), score(None).alias("unset"))


def audience_signal_sql(txt: str, wanted: str) -> str:
    has = lambda ws: "regexp_matches(" + txt + ", '(^|[^a-z])(" + "|".join(ws) + ")([^a-z]|$)')"
    match, other = (has(X.WOMEN_WORDS), has(X.MEN_WORDS)) if wanted == "women" else (has(X.MEN_WORDS), has(X.WOMEN_WORDS))
    return f"CASE WHEN {has(('unisex',))} OR {match} THEN 1.0::DOUBLE WHEN {other} THEN -1.0 ELSE 0.0 END"


@query("audience_signal", f"""
    SELECT id, {audience_signal_sql('txt', 'women')} AS women, {audience_signal_sql('txt', 'men')} AS men, 0.0::DOUBLE AS other
    FROM (SELECT id, {H.AUDIENCE_TEXT} AS txt FROM ({H.ENRICHED}))""")
def _(t):
    p = enriched(t)
    text = X.audience_text(p)
    signal = lambda g: X.audience_signal(text, F.lit(g))
    return p.select("id", signal(" Ladies").alias("women"), signal("MALE").alias("men"), signal("kids").alias("other"))


@query("slugify", r"""
    SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages""")
def _(t):
    return t.pages.select("page_id", X.slugify(F.col("url")).alias("slug"))


def attributes_sql(text: str, tax, words, source: str, key: str) -> str:
    rank = H.term_rank("txt", tax)
    amount = lambda leads: (
        f"TRY_CAST(replace(regexp_extract(txt, '(?:{leads})\\s*(?:₹|rs\\.?|inr)?\\s*([\\d,]+)', 1), ',', '') AS DOUBLE)")
    gender = "CASE " + " ".join(
        f"WHEN {word('txt', g, suffix=chr(40) + '?:' + chr(39) + 's)?')} THEN '{g}'" for g in ("women", "men", "unisex")) + " END"
    stop = ", ".join(lit(w) for w in words.token_stopwords)
    return f"""
    WITH s AS (SELECT {key}, trim(lower({text}), E' \\t\\n\\r') AS txt FROM {source}), r AS (SELECT *, {rank} AS k FROM s)
    SELECT {key}, {H.family_of('k', tax)} AS product_family, {H.type_of('k', tax)} AS product_type,
           {H.words_list('txt', words.colours)} AS colours, {H.words_list('txt', words.styles)} AS styles,
           {H.parts_list('txt', words.fits)} AS fits, {gender} AS gender,
           {amount('under|below|less than|up to')} AS max_price, {amount('over|above|more than|from')} AS min_price,
           {H.first_part('txt', words.occasions)} AS occasion, {H.first_word('txt', words.materials)} AS material,
           {H.parts_list('txt', words.aesthetics)} AS aesthetic_terms,
           array_to_string(list_filter(regexp_extract_all(txt, '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({stop})), ',') AS query_tokens
    FROM r"""


def attribute_columns(a):
    return [joined(a[c]).alias(c) if c in ("colours", "styles", "fits", "aesthetic_terms", "query_tokens") else a[c].alias(c)
            for c in ("product_family", "product_type", "colours", "styles", "fits", "gender", "max_price", "min_price",
                      "occasion", "material", "aesthetic_terms", "query_tokens")]


@query("extract_query_attributes", attributes_sql("query", HARDWARE, WORDS, "search_queries", "qid"))
def _(t):
    rows = t.search_queries.select("qid", X.extract_query_attributes(F.col("query"), HARDWARE, WORDS).alias("a"))
    return rows.select("qid", *attribute_columns(F.col("a")))


@query("extract_caption_attributes", attributes_sql("description", FASHION, FASHION_WORDS, "posts", "doc_id"))
def _(t):
    rows = t.posts.select("doc_id", X.extract_query_attributes(F.col("description"), FASHION, FASHION_WORDS).alias("a"))
    return rows.select("doc_id", *attribute_columns(F.col("a")))


PHRASES = ("red", "minimal", "small")


@query("phrase_match_score", f"""
    SELECT id, ({' + '.join(f"CAST(contains(txt, {lit(p)}) AS INT)" for p in PHRASES)}) / 3.0::DOUBLE AS score,
           0.5::DOUBLE AS empty_default, 0.0::DOUBLE AS empty_rerank
    FROM (SELECT id, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED}))""")
def _(t):
    p = enriched(t)
    text = X.product_search_text(p)
    phrases, none = F.array(*[F.lit(x) for x in PHRASES]), F.array().cast("array<string>")
    return p.select("id", X.phrase_match_score(text, phrases).alias("score"),
                    X.phrase_match_score(text, none).alias("empty_default"),
                    X.phrase_match_score(text, none, 0.0).alias("empty_rerank"))


@query("lexical_token_score", f"""
    WITH q AS (SELECT qid, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('under','below','with','from','this','that')) AS toks FROM search_queries)
    SELECT p.id, CASE WHEN len(toks) = 0 THEN 0.5::DOUBLE ELSE len(list_filter(toks, lambda x: contains(txt, x))) / len(toks)::DOUBLE END AS score
    FROM (SELECT id, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED})) p JOIN q ON q.qid = p.id""")
def _(t):
    p = enriched(t).join(t.search_queries.select(F.col("qid").alias("id"), "query"), "id")
    tokens = X.extract_query_attributes(F.col("query"), HARDWARE, WORDS)["query_tokens"]
    return p.select("id", X.lexical_token_score(X.product_search_text(p), tokens).alias("score"))


CATEGORY_WORDS_SQL = ("lower(concat_ws(' ', coalesce(category,''), coalesce(subcategory,''), "
                      "coalesce(normalized_main_category,''), coalesce(normalized_subcategory,'')))")


def category_score_sql(family: str, category_id: str, txt: str) -> str:
    fams = " ".join(f"WHEN {lit(f)} THEN CAST({part(txt, *HARDWARE.words_for_category(f))} AS INT)::DOUBLE" for f in HARDWARE.families)
    return (f"CASE WHEN {category_id} IS NOT NULL THEN coalesce(CAST(category_id = {category_id} AS INT), 0)::DOUBLE "
            f"WHEN {family} IS NULL THEN 0.5 ELSE CASE {family} {fams} ELSE 0 END END")


@query("category_match_score", f"""
    SELECT id, {category_score_sql("'jewellery'", 'NULL', 'txt')} AS by_family,
           {category_score_sql("'jewellery'", '105', 'txt')} AS by_id, {category_score_sql('NULL', 'NULL', 'txt')} AS unset
    FROM (SELECT id, category_id, {CATEGORY_WORDS_SQL} AS txt FROM ({H.ENRICHED}))""")
def _(t):
    p = enriched(t)
    words = category_words(p)
    none = F.lit(None).cast("long")
    score = lambda fam, cid: X.category_match_score(p["category_id"], X.category_families(words, HARDWARE), F.lit(fam).cast("string"), cid)
    return p.select("id", score("jewellery", none).alias("by_family"), score("jewellery", F.lit(105)).alias("by_id"),
                    score(None, none).alias("unset"))


def category_words(p):
    return F.lower(X.join_words([p["category"], p["subcategory"], p["normalized_main_category"], p["normalized_subcategory"]]))


@query("type_signal", f"""
    SELECT id, CASE WHEN {term('txt', 'rod')} THEN 1.0::DOUBLE WHEN {term('txt', *HARDWARE.family_terms('fasteners'))} THEN 0.5 ELSE 0.0 END AS rod
    FROM (SELECT id, {H.SEARCH_TEXT} AS txt FROM ({H.ENRICHED}))""")
def _(t):
    p = enriched(t)
    text = X.product_search_text(p)
    return p.select("id", X.type_signal(X.matched_types(text, HARDWARE), X.matched_families(text, HARDWARE),
                                        F.lit("rod"), F.lit("fasteners")).alias("rod"))


@query("price_signal", """
    SELECT id, CASE WHEN price IS NULL OR price <= 0 THEN 0.0::DOUBLE WHEN price < 905 OR price > 990 THEN -1.0 ELSE 1.0 END AS both_bounds,
           CASE WHEN price IS NULL OR price <= 0 THEN 0.0::DOUBLE WHEN price > 990 THEN -1.0 ELSE 1.0 END AS max_only, 0.0::DOUBLE AS unset
    FROM products""")
def _(t):
    p = t.products
    none = F.lit(None).cast("double")
    return p.select("id", S.price_signal(p["price"], F.lit(905.0), F.lit(990.0)).alias("both_bounds"),
                    S.price_signal(p["price"], none, F.lit(990.0)).alias("max_only"),
                    S.price_signal(p["price"], none, none).alias("unset"))


@query("confidence_signal", """
    SELECT id, coalesce(least(1.0, greatest(0.0, classifier_confidence * 1.5 - 0.2)), 0.0)::DOUBLE AS signal FROM products""")
def _(t):
    return t.products.select("id", S.confidence_signal(F.col("classifier_confidence") * 1.5 - 0.2).alias("signal"))


@query("engagement_score", """
    SELECT id, least(1.0, (coalesce(likes_count, 0) * 20 + coalesce(comments_count, 0) * 60) / 10000.0)::DOUBLE AS engagement FROM products""")
def _(t):
    return t.products.select("id", S.engagement_score(F.col("likes_count") * 20, F.col("comments_count") * 20).alias("engagement"))


def price_status_sql(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN 'MISSING' WHEN {p} <= 0 THEN 'INVALID' "
            f"WHEN {p} < 100 OR {p} > 500000 THEN 'SUSPICIOUS' ELSE 'VALID' END")


@query("price_status", f"""
    SELECT id, {price_status_sql('price')} AS status,
           CASE WHEN CAST(id AS INT) % 3 = 0 THEN 'INVALID' WHEN CAST(id AS INT) % 3 = 1 THEN 'VALID' ELSE 'MISSING' END AS text_status
    FROM products""")
def _(t):
    text = F.when(F.col("id").cast("int") % 3 == 0, "n/a").when(F.col("id").cast("int") % 3 == 1, "2499.00").otherwise("")
    return t.products.select("id", S.price_status(F.col("price")).alias("status"), S.price_status(text).alias("text_status"))


def valid_url_sql(u: str) -> str:
    return f"coalesce(regexp_matches(trim({u}), '^https?://[^/?#]+'), FALSE)"


@query("valid_http_url", f"""
    SELECT CAST(page_id AS STRING) AS key, {valid_url_sql('url')} AS valid FROM pages
    UNION ALL SELECT 'p' || id, {valid_url_sql('product_url')} FROM products
    UNION ALL SELECT 'd' || doc_id, {valid_url_sql('product_url')} FROM posts""")
def _(t):
    check = lambda df, key, c: df.select(key.alias("key"), S.valid_http_url(F.col(c)).alias("valid"))
    return (check(t.pages, F.col("page_id").cast("string"), "url")
            .unionByName(check(t.products, F.concat(F.lit("p"), "id"), "product_url"))
            .unionByName(check(t.posts, F.concat(F.lit("d"), F.col("doc_id").cast("string")), "product_url")))


@query("embedding_status", f"""
    WITH v AS (SELECT id, embedding::DOUBLE[] AS e, CAST(id AS INT) % 9 = 0 AS scaled FROM products),
         w AS (SELECT id, CASE WHEN scaled THEN list_transform(e, lambda x: x * 2) ELSE e END AS e FROM v),
         n AS (SELECT id, coalesce(len(e), 0) AS d, CASE WHEN e IS NULL THEN 0.0 ELSE sqrt(list_sum(list_transform(e, lambda x: x * x))) END AS norm FROM w)
    SELECT id, d > 0 AS "exists", CAST(d AS INT) AS dimensions, d > 0 AS finite, round_even(norm, 6) AS l2_norm,
           d = {DIM} AND abs(norm - 1) <= 0.02 AS valid, d = {DIM} AS has_embedding FROM n""")
def _(t):
    e = F.when(F.col("id").cast("int") % 9 == 0, F.transform("embedding", lambda x: x.cast("double") * 2)).otherwise(
        F.col("embedding").cast("array<double>"))
    s = S.embedding_status(F.col("e"), DIM)
    return t.products.select("id", e.alias("e")).select(
        "id", *[s[c].alias(c) for c in ("exists", "dimensions", "finite", "l2_norm", "valid")],
        S.has_embedding(F.col("e"), DIM).alias("has_embedding"))


@query("has_embedding", f"SELECT id, coalesce(len(embedding), 0) = {DIM} AS has_embedding FROM products")
def _(t):
    return t.products.select("id", S.has_embedding(F.col("embedding"), DIM).alias("has_embedding"))


@query("parse_embedding", """
    SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN 0 ELSE 64 END AS dims,
           CASE WHEN vec_id % 4 = 3 THEN 0.0 ELSE round_even(list_sum(list_transform(embedding::DOUBLE[], lambda x: round_even(x, 4))), 3) END AS total,
           vec_id % 4 <> 2 AS text_has_embedding FROM embeddings""")
def _(t):
    body = F.array_join(F.transform("embedding", lambda x: S.half_even(x.cast("double"), 4).cast("string")), ", ")
    text = (F.when(F.col("vec_id") % 4 == 3, F.concat(F.lit("[bad,"), body, F.lit("]")))
            .when(F.col("vec_id") % 4 == 2, F.concat(body, F.lit(",")))
            .otherwise(F.concat(F.lit(" ["), body, F.lit("]"))))
    rows = t.embeddings.select("vec_id", text.alias("text"))
    parsed = S.parse_embedding(F.col("text"))
    total = S.half_even(F.aggregate(parsed, F.lit(0.0), lambda a, v: a + v), 3)
    without_junk = F.regexp_replace("text", "bad,", "")
    return rows.select("vec_id", F.size(parsed).alias("dims"), total.alias("total"),
                       S.has_embedding_text(without_junk, DIM).alias("text_has_embedding"))


IMAGE_CLASS_SQL = """CASE WHEN trim(coalesce({u}, '')) = '' THEN 'MISSING' WHEN contains(lower({u}), 'unsplash.com') THEN 'STOCK_PHOTO'
    WHEN NOT regexp_matches(trim({u}), '^https?://[^/?#]+') THEN 'MALFORMED'
    WHEN starts_with({u}, '{s}/storage/v1/object/public/') THEN 'STABLE_STORAGE' ELSE 'EXTERNAL_WORKING' END"""


def image_class_sql(u: str) -> str:
    return IMAGE_CLASS_SQL.format(u=u, s=STORAGE)


def odd_image(p):
    k = p["id"].cast("int")
    return (F.when(k % 33 == 0, "https://images.Unsplash.com/x.jpg").when(k % 27 == 0, "ftp://x/y.jpg")
            .otherwise(p["image_url"]))


@query("image_class", f"""
    SELECT id, {image_class_sql('u')} AS class FROM (SELECT id, CASE WHEN CAST(id AS INT) % 33 = 0 THEN 'https://images.Unsplash.com/x.jpg'
           WHEN CAST(id AS INT) % 27 = 0 THEN 'ftp://x/y.jpg' ELSE image_url END AS u FROM products)
    UNION ALL SELECT 'page' || page_id, {image_class_sql('url')} FROM pages""")
def _(t):
    p = t.products
    rows = p.select("id", S.image_class(odd_image(p), STORAGE).alias("class"))
    return rows.unionByName(t.pages.select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("id"), S.image_class(F.col("url"), STORAGE).alias("class")))


BAD6 = "('BROKEN','EXPIRED_OR_FORBIDDEN','INVALID_URL','RECOVERY_REQUIRED','UNRECOVERABLE','MISSING')"
BAD4 = "('BROKEN','MISSING','RECOVERY_REQUIRED','UNRECOVERABLE')"
BUCKET = f"{STORAGE}/storage/v1/object/public/product-images/"
USABLE_SQL = (f"(coalesce(regexp_matches(image_url, '^https?://'), FALSE) AND NOT coalesce(contains(image_url, 'unsplash.com'), FALSE) "
              f"AND upper(coalesce(image_status, '')) NOT IN {BAD6})")
DISCOVERY_STABLE_SQL = (f"(coalesce(starts_with(image_url, '{BUCKET}'), FALSE) AND NOT contains(coalesce(image_url, ''), 'unsplash.com') "
                        f"AND upper(coalesce(image_status, '')) NOT IN {BAD4})")
TRAINING_STABLE_SQL = (f"(coalesce(starts_with(image_url, '{BUCKET}'), FALSE) AND coalesce(image_status, '') NOT IN {BAD6})")


@query("normalize_name", r"""
    SELECT id, trim(regexp_replace(lower(concat_ws('  ', product_name, brand, product_url)), '[^a-z0-9]+', ' ', 'g')) AS name FROM products""")
def _(t):
    return t.products.select("id", X.normalize_name(F.concat_ws("  ", "product_name", "brand", "product_url")).alias("name"))


PRODUCT_NAME_SQL = "trim(coalesce(nullif(product_name, ''), nullif(item_name, ''), ''))"
SOURCE_URL_SQL = "coalesce(nullif(product_url, ''), nullif(source_url, ''))"
QUALITY_SQL = f"""(CASE WHEN {PRODUCT_NAME_SQL} <> '' THEN 20 ELSE 0 END + CASE WHEN {valid_url_sql('image_url')} THEN 20 ELSE 0 END
    + CASE WHEN category_id IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN brand_id IS NOT NULL AND brand_id <> '' THEN 15 ELSE 0 END
    + CASE WHEN coalesce(len(embedding), 0) = {DIM} THEN 20 ELSE 0 END + CASE WHEN {valid_url_sql(SOURCE_URL_SQL)} THEN 5 ELSE 0 END
    + CASE WHEN {price_status_sql('price')} IN ('MISSING', 'VALID') THEN 5 ELSE 0 END)"""


@query("catalog_quality_score", f"SELECT id, {QUALITY_SQL} AS score FROM products")
def _(t):
    return t.products.select("id", S.catalog_quality_score(t.products, DIM).alias("score"))


def gem_label_sql(s: str) -> str:
    return (f"CASE WHEN {s} >= 90 THEN 'Exceptional Gem' WHEN {s} >= 80 THEN 'Hidden Gem' "
            f"WHEN {s} >= 70 THEN 'Worth Discovering' WHEN {s} >= 60 THEN 'Promising' END")


@query("gem_label", f"SELECT l_orderkey, l_linenumber, {gem_label_sql('l_quantity * 2')} AS label FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.gem_label(F.col("l_quantity") * 2).alias("label"))


@query("recommendation_reason", """
    WITH s AS (SELECT id, classifier_confidence AS q, coalesce(niche_score, 0.0) AS u, niche_score AS n, CAST(id AS INT) % 2 = 0 AS m FROM products),
         l AS (SELECT id, list_filter([CASE WHEN coalesce(q, 0) >= 0.8 THEN 'strong catalog quality' END, CASE WHEN u >= 0.7 THEN 'distinctive style' END,
               CASE WHEN n >= 0.7 THEN 'independent-label appeal' END, CASE WHEN m THEN 'matches your saved preferences' END], lambda x: x IS NOT NULL) AS parts FROM s)
    SELECT id, CASE WHEN len(parts) > 0 THEN 'Recommended for ' || array_to_string(parts[1:3], ' + ') || '.' ELSE 'Worth exploring based on its catalog relevance.' END AS reason FROM l""")
def _(t):
    return t.products.select("id", S.recommendation_reason(
        F.col("classifier_confidence"), F.coalesce("niche_score", F.lit(0.0)), F.col("niche_score"),
        F.col("id").cast("int") % 2 == 0).alias("reason"))


@query("readiness_status", """
    SELECT o_orderkey, CASE WHEN total < 10 OR img < 50 OR emb < 50 THEN 'NOT_READY'
           WHEN total >= 100 AND img >= 90 AND cat >= 90 AND emb >= 95 THEN 'READY' ELSE 'NEEDS_ATTENTION' END AS status
    FROM (SELECT o_orderkey, o_orderkey AS total, o_custkey % 101 AS img, (o_custkey + 7) % 101 AS cat, 45 + (o_custkey + o_orderkey) % 56 AS emb FROM orders)""")
def _(t):
    c = F.col
    return t.orders.select("o_orderkey", S.readiness_status(
        c("o_orderkey"), c("o_custkey") % 101, (c("o_custkey") + 7) % 101, 45 + (c("o_custkey") + c("o_orderkey")) % 56,
        not_ready_min=10, ready_min=100, ready_image=90, ready_category=90, ready_embedding=95).alias("status"))


@query("niche_score", """
    SELECT doc_id, CASE WHEN brand_name IS NULL THEN 0.5::DOUBLE WHEN followers >= 5000 THEN 1.0 WHEN followers >= 1000 THEN 0.8 ELSE 0.75 END AS niche FROM posts""")
def _(t):
    from vitrine.functions.posts import normalize_brand

    return t.posts.select("doc_id", S.niche_score(F.col("followers"), normalize_brand(F.col("brand_name"))).alias("niche"))


@query("weighted_mean_nonnull", """
    SELECT id, CASE WHEN w = 0 THEN 0.0 ELSE round_even(v / w, 9) END AS mean FROM (
      SELECT id, coalesce(niche_score * 0.5, 0) + coalesce(classifier_confidence * 0.3, 0) + coalesce(price / 1000 * 0.2, 0) AS v,
             CASE WHEN niche_score IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN classifier_confidence IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN price IS NULL THEN 0 ELSE 0.2::DOUBLE END AS w FROM products)""")
def _(t):
    c = F.col
    mean = S.weighted_mean_nonnull([(c("niche_score"), 0.5), (c("classifier_confidence"), 0.3), (c("price") / 1000, 0.2)])
    return t.products.select("id", S.half_even(mean, 9).alias("mean"))


def days_sql(ts: str) -> str:
    return f"greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us({ts})) / 86400000000.0))"


@query("time_decay", f"""
    SELECT id, CASE WHEN scraped_at IS NOT NULL THEN round_even(exp(-{days_sql('scraped_at')} / 30.0), 9) END AS decay_30, round_even(exp(-{days_sql('created_at')} / 120.0), 9) AS decay_120 FROM products""")
def _(t):
    decay = lambda c, tau: S.half_even(S.time_decay(t.now, F.col(c), tau), 9)
    return t.products.select("id", decay("scraped_at", 30).alias("decay_30"),
                             decay("created_at", 120).alias("decay_120"))


@query("looks_like_caption", rf"""
    WITH s AS (SELECT doc_id, trim(split_part(description, '. ', 1)) AS c FROM posts UNION ALL SELECT -1 - conv_id * 1000 - turn, trim(text, E' \t\n\r') FROM conversations),
    w AS (SELECT doc_id, c, lower(c) AS l, list_filter(regexp_split_to_array(trim(c), '\s+'), lambda x: x <> '') AS ws FROM s)
    SELECT doc_id, c <> '' AND (regexp_matches(l, '{X.CAPTION_START.replace("(?![", "($|[^").replace("p{N}_])", "p{N}_])", 1).replace("($|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])")}')
        OR contains(l, 'may be an image of') OR regexp_matches(l, '@[a-z0-9_.]+') OR regexp_matches(l, '^[\d,]+\s+likes?,\s*[\d,]+\s+comments?($|[^\p{{L}}\p{{N}}_])')
        OR ends_with(c, '?') OR regexp_matches(l, '^(what|how|why|which|who|when|where|do you|did you|have you|are you|is your|can you|would you)($|[^\p{{L}}\p{{N}}_])')
        OR len(list_filter(ws, lambda x: regexp_matches(x, '[a-z][A-Z]'))) / greatest(len(ws), 1)::DOUBLE >= 0.5 OR len(ws) > 12) AS caption_like FROM w""")
def _(t):
    first = F.regexp_replace("description", r"(?s)\. .*$", "")
    rows = t.posts.select("doc_id", first.alias("c")).unionByName(
        t.conversations.select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), F.col("text").alias("c")))
    return rows.select("doc_id", X.looks_like_caption(F.col("c")).alias("caption_like"))


TITLE_TEXT = "lower(concat_ws(' ', coalesce(description,''), coalesce(product_name,''), coalesce(item_name,'')))"


@query("constructed_title", f"""
    WITH s AS (SELECT id, brand_name, {TITLE_TEXT} AS txt FROM products), r AS (SELECT *, {RANK} AS k FROM s),
    b AS (SELECT id, k, txt, CASE WHEN coalesce(trim(brand_name), '') = '' THEN NULL ELSE brand_name END AS brand FROM r),
    c AS (SELECT id, brand, {H.first_word('txt', WORDS.colours)} AS colour, {H.type_label(H.type_of('k', HARDWARE), HARDWARE)} AS label FROM b)
    SELECT id, CASE WHEN (brand IS NOT NULL)::INT + (colour IS NOT NULL)::INT + (label IS NOT NULL)::INT >= 2
           THEN concat_ws(' ', brand, upper(colour[1]) || colour[2:], label) END AS title FROM c""")
def _(t):
    return t.products.select("id", X.constructed_title(t.products, HARDWARE, WORDS.colours).alias("title"))


@query("presentable_brand", r"""
    WITH s AS (SELECT doc_id, trim(coalesce(brand_name, '')) AS n FROM posts),
         p AS (SELECT doc_id, n, list_filter(regexp_split_to_array(n, '[._]+'), lambda x: x <> '') AS ps FROM s),
         k AS (SELECT doc_id, n, CASE WHEN len(ps) > 1 AND length(ps[-1]) <= 3 AND regexp_matches(ps[-1], '^\p{L}+$') THEN ps[1:len(ps)-1] ELSE ps END AS ps FROM p)
    SELECT doc_id, CASE WHEN n = '' OR n <> lower(n) THEN n ELSE array_to_string(list_transform(ps, lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS brand FROM k""")
def _(t):
    return t.posts.select("doc_id", X.presentable_brand(F.col("brand_name")).alias("brand"))


@query("squeeze_text", r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.squeeze_text(F.col("text")).alias("text"))


@query("cosine_similarity", """
    SELECT a.vec_id, round_even(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""")
def _(t):
    total = t.embeddings.agg(F.count("*").alias("n"))
    other = t.embeddings.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    rows = t.embeddings.withColumn("next_id", (F.col("vec_id") + 1) % total.select("n").scalar())
    return rows.join(other, "next_id").select(
        "vec_id", S.half_even(S.cosine_similarity(F.col("embedding"), F.col("other")), 9).alias("similarity"))
