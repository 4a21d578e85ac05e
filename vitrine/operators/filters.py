"""Projections, predicates and worklists over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.functions.classify import compact_text
from vitrine.functions.posts import source_post_url
from vitrine.functions.text import any_of, first_filled, or_else
from vitrine.taxonomy import Taxonomy


def is_active(status: Column) -> Column:
    """Search keeps ACTIVE products only; a missing status counts as ACTIVE."""
    return F.coalesce(status, F.lit("ACTIVE")) == "ACTIVE"


def is_not_non_product(status: Column) -> Column:
    """Reports, feeds and exact-type lookups keep everything but NON_PRODUCT."""
    return F.coalesce(status, F.lit("")) != "NON_PRODUCT"


def format_product(p: DataFrame) -> DataFrame:
    """The canonical product projection with its ordered fallbacks."""
    has = lambda c: p[c] if c in p.columns else F.lit(None)
    number = lambda c: p[c].cast("double")
    name = or_else(first_filled(p["product_name"], p["item_name"], has("name")), "Untitled item")
    category = or_else(first_filled(has("category")), "")
    category = F.when(category == "", F.coalesce(
        F.concat(F.lit("Category "), p["category_id"].cast("string")), F.lit(""))).otherwise(category)
    similarity = or_else(F.coalesce(has("similarity"), has("match_score")).cast("double"), 0.0)
    columns = {
        "id": p["id"], "brand_id": p["brand_id"],
        "brand_name": or_else(first_filled(p["brand_name"], p["brand"]), "Unknown brand"),
        "product_name": name, "item_name": name,
        "description": or_else(p["description"], ""),
        "image_url": or_else(first_filled(p["image_url"], has("thumbnail_url"), has("photo_url"), has("cover_url")), ""),
        "product_url": or_else(first_filled(p["product_url"], p["source_url"]), ""),
        "price": number("price"), "source": or_else(p["source"], ""),
        "niche_score": number("niche_score"),
        "likes_count": or_else(p["likes_count"], 0), "comments_count": or_else(p["comments_count"], 0),
        "source_hashtag": or_else(p["source_hashtag"], ""),
        "scraped_at": F.coalesce(p["scraped_at"], p["created_at"]),
        "category_id": p["category_id"], "category": category,
        "category_audience": or_else(has("category_audience"), ""),
        "classifier_confidence": p["classifier_confidence"],
        "audience": or_else(first_filled(p["audience"], has("gender")), ""),
        "subcategory": or_else(first_filled(p["normalized_subcategory"], p["subcategory"]), ""),
        "normalized_main_category": or_else(p["normalized_main_category"], ""),
        "normalized_subcategory": or_else(p["normalized_subcategory"], ""),
        "metadata": p["metadata"], "currency": or_else(first_filled(p["currency"]), "INR"),
        "similarity": similarity,
        "final_score": F.when(or_else(has("final_score").cast("double"), 0.0) == 0, similarity).otherwise(has("final_score")),
    }
    return p.select(*[c.alias(n) for n, c in columns.items()])


def format_brand(b: DataFrame) -> DataFrame:
    has = lambda c: b[c] if c in b.columns else F.lit(None)
    name = or_else(first_filled(b["name"], b["brand_name"], b["instagram_username"]), "Unknown brand")
    link = or_else(first_filled(b["instagram_profile_url"], b["profile_url"]), "")
    image = or_else(first_filled(has("image_url"), b["profile_picture_url"], has("profile_image_url"), has("logo_url")), "")
    return b.select(
        b["id"], name.alias("name"), or_else(b["instagram_username"], "").alias("instagram_username"),
        or_else(first_filled(b["category"]), "Fashion").alias("category"),
        or_else(b["followers"], 0).alias("followers"), or_else(b["niche_score"].cast("double"), 0.0).alias("niche_score"),
        image.alias("image_url"), link.alias("profile_url"), or_else(has("post_url"), "").alias("post_url"),
    )


def filter_condition(
    p, *, min_price=None, max_price=None, min_niche=None, min_followers=None, brand=None, gender=None
) -> Column:
    """Conjunction of the bounds that are given (numbers, strings or Columns); a null value fails its bound.

    Brand and gender are substring tests here, so "men" also passes "women"; the ranking gate is stricter.
    """
    conditions = []

    def bound(value, column, test):
        if value is not None:
            value = value if isinstance(value, Column) else F.lit(value)
            conditions.append(value.isNull() | or_else(test(column, value), False))

    def within(value, column):
        if value is not None:
            value = value if isinstance(value, Column) else F.lit(value)
            needle = F.lower(X.strip(or_else(value, "")))
            conditions.append((needle == "") | F.contains(column, needle))

    bound(min_price, p["price"], lambda c, v: c >= v)
    bound(max_price, p["price"], lambda c, v: c <= v)
    bound(min_niche, p["niche_score"], lambda c, v: c >= v)
    bound(min_followers, p["brand_follower_count"], lambda c, v: c >= v)
    within(brand, F.lower(X.strip(or_else(p["brand_name"], ""))))
    within(gender, F.lower(X.join_words([
        p["audience"], p["category"], p["normalized_main_category"], p["normalized_subcategory"]])))
    result = F.lit(True)
    for c in conditions:
        result = result & c
    return result


def filter_products(products: DataFrame, **bounds) -> DataFrame:
    return products.where(filter_condition(products, **bounds))


def discovery_eligible(p, product_type: Column, storage: str, dim: int) -> Column:
    return (
        S.discovery_stable_image(p["image_url"], p["image_status"], storage)
        & S.has_embedding(p["embedding"], dim)
        & S.is_confident(p["classifier_confidence"])
        & product_type.isNotNull()
        & (or_else(p["brand_id"], "") != "")
        & is_not_non_product(p["catalog_status"])
    )


def browse_catalog(products: DataFrame, taxonomy: Taxonomy, *, category=None, product_type=None, colour=None,
                   limit: int | None = None) -> DataFrame:
    """Plain substring and taxonomy browse, no ranking; ``limit`` is the page size of the browse."""
    text = X.product_search_text(products)
    wanted = is_not_non_product(products["catalog_status"])
    if category:
        wanted &= X.contains_text(F.lower(or_else(products["category"], "")), category.lower())
    if product_type:
        wanted &= X.type_match(text, product_type, taxonomy)
    if colour:
        wanted &= X.contains_text(text, colour.lower())
    found = products.where(wanted)
    return found if limit is None else found.orderBy("id").limit(limit)


GENDER_WORDS = ("men", "women", "unisex")


def rail_condition(p, taxonomy: Taxonomy, *, category: str | None = None, product_type: str | None = None) -> Column:
    """Gate of a rail labelled "[gender-]...-family_or_type", or of an exact product type."""
    text = X.discovery_text(p)
    product = X.identify_product(text, taxonomy)
    wanted = F.lit(True)
    if product_type:
        wanted &= or_else(product["type"] == product_type.lower().replace("_", "-"), False)
    needle = (category or "").lower().replace("_", "-")
    if not needle:
        return wanted
    parts = needle.split("-")
    if parts[0] in GENDER_WORDS:
        wanted &= X.gender_match_score(X.audience_text(p), F.lit(parts[0])) > 0
    known = X.contains_term(F.lower(text), *taxonomy.family_terms(parts[-1]), *taxonomy.type_terms(parts[-1]))
    loose = (
        (or_else(product["family"], "") == needle)
        | (or_else(product["type"], "") == needle)
        | F.replace(F.lower(text), F.lit("-"), F.lit(" ")).contains(needle.replace("-", " "))
    )
    return wanted & (known | loose)


def rail_filter(products: DataFrame, taxonomy: Taxonomy, **kwargs) -> DataFrame:
    return products.where(rail_condition(products, taxonomy, **kwargs))


def reclassify_scope(products: DataFrame, *, brand=None, only_uncategorized=False, only_low_confidence=False,
                     force=False, limit=None) -> DataFrame:
    wanted = F.lit(True)
    if brand:
        wanted &= X.contains_text(F.lower(or_else(products["brand_name"], "")), brand.lower())
    if only_uncategorized:
        wanted &= or_else(products["category_id"], 0) == 0
    if only_low_confidence or not force:
        wanted &= ~S.is_confident(products["classifier_confidence"])
    found = products.where(wanted)
    return found.orderBy("id").limit(limit) if limit else found


def public_projection(df: DataFrame) -> DataFrame:
    return df.drop("score_breakdown", "rerank_detail")


def backfill_columns(products: DataFrame) -> DataFrame:
    item = F.coalesce("item_name", "name") if "name" in products.columns else F.col("item_name")
    return products.withColumns({
        "brand_name": F.coalesce("brand_name", "brand"),
        "item_name": item,
        "description": F.coalesce("description", F.lit("")),
        "product_name": F.coalesce(F.col("product_name"), item),
    })


def backfill_brand_columns(brands: DataFrame) -> DataFrame:
    handle = F.nullif(F.lower(F.regexp_replace("name", "[^a-zA-Z0-9._]", "")), F.lit(""))
    return brands.withColumns({
        "brand_name": F.coalesce("brand_name", "name"),
        "instagram_username": F.coalesce("instagram_username", handle),
    })


def image_sample_audit(products: DataFrame, brands: DataFrame, storage: str) -> DataFrame:
    """Which image field each product and brand uses, its class, and its CDN / storage flags."""
    def audited(df, owner, kind, fields):
        cells = [F.nullif(df[f], F.lit("")) for f in fields if f in df.columns]
        used = [F.when(c.isNotNull(), F.lit(f)) for c, f in zip(cells, [f for f in fields if f in df.columns])]
        url = F.coalesce(*cells)
        cdn = or_else(url.contains("instagram") | url.contains("fbcdn"), False)
        return df.select(
            F.lit(kind).alias("kind"), df["id"].alias("owner_id"), owner.alias("owner"),
            F.coalesce(*used, F.lit(fields[-1])).alias("db_field"), url.alias("db_value"), url.isNull().alias("is_null"),
            S.image_class(url, storage).alias("classification"), cdn.alias("social_cdn"),
            S.in_storage(url, storage).alias("in_storage"))

    rows = audited(products, first_filled(products["product_name"], products["item_name"]), "product", ["image_url"])
    return rows.unionByName(audited(
        brands, first_filled(brands["name"], brands["brand_name"]), "brand",
        ["image_url", "profile_image_url", "logo_url", "profile_picture_url"]))


# The terms whose broken images are recovered first.
PRIORITY_TERMS = ("top", "kurta", "kurti", "ethnic", "earring", "necklace", "ring", "bracelet")


def recovery_worklist(products: DataFrame, storage: str, *, only_broken: bool = True) -> DataFrame:
    """Products whose image needs recovery, priority terms first, with RECOVERABLE / UNRECOVERABLE."""
    flagged = products["image_status"].isin(*S.FLAGGED_IMAGE)
    wrong_seed = (products["source"] == "instagram") & products["image_url"].contains(S.STOCK_PHOTO_HOST)
    broken = S.image_status(products["image_url"]) != "UNKNOWN"
    wanted = ~S.in_storage(products["image_url"], storage)
    if only_broken:
        wanted &= or_else(flagged, False) | or_else(wrong_seed, False) | broken
    post = source_post_url(products["product_url"], products["source_url"])
    priority = X.contains_text(compact_text(products), *PRIORITY_TERMS)
    return products.where(wanted).select(
        "id", "image_url", "image_status", priority.alias("priority"), post.alias("source_post_url"),
        F.when(post.isNotNull(), "RECOVERABLE").otherwise("UNRECOVERABLE").alias("recovery"),
    ).orderBy(F.desc("priority"), "id")


def embed_worklist(products: DataFrame, batch_size: int | None = None) -> DataFrame:
    """Rows still to embed, newest first."""
    todo = products.where(
        "embedding IS NULL AND brand_name IS NOT NULL AND item_name IS NOT NULL AND category_id IS NOT NULL")
    ordered = todo.select("id", "brand_name", "item_name", "description", "image_url", "created_at").orderBy(
        F.desc("created_at"), "id")
    return ordered.limit(batch_size) if batch_size else ordered


# The legal states of the checked columns.
STATUS_RULES = {
    "image_status": ("VALID", "MISSING", "BROKEN", "EXPIRED_OR_FORBIDDEN", "TIMEOUT", "INVALID_URL",
                     "RECOVERY_REQUIRED", "UNRECOVERABLE", "UNKNOWN"),
    "classification_source": ("deterministic", "metadata", "ai", "heuristic", "openai", "manual", "legacy"),
    "catalog_status": ("ACTIVE", "NON_PRODUCT", "MANUAL_REVIEW"),
}


def schema_checks(products: DataFrame) -> DataFrame:
    """Violations per rule, counted in one pass."""
    rules = {f"{c}_domain": products[c].isNotNull() & ~products[c].isin(*allowed) for c, allowed in STATUS_RULES.items()}
    rules |= {
        "image_status_present": products["image_status"].isNull(),
        "catalog_status_present": products["catalog_status"].isNull(),
        "confidence_range": ~products["classifier_confidence"].between(0, 1),
        "likes_not_negative": products["likes_count"] < 0,
        "comments_not_negative": products["comments_count"] < 0,
        "niche_range": ~products["niche_score"].between(0, 1),
    }
    return _violations(products, rules)


def preference_checks(preferences: DataFrame) -> DataFrame:
    return _violations(preferences, {"price_range": preferences["min_price"] > preferences["max_price"]})


def mapping_checks(mappings: DataFrame) -> DataFrame:
    return _violations(mappings, {
        "mapping_source_domain": ~mappings["source"].isin("product_derived", "manual", "ai_classified"),
        "mapping_confidence_range": ~mappings["confidence"].between(0, 1),
    })


def _violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    counted = df.agg(*[F.count_if(or_else(c, False)).alias(n) for n, c in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")
