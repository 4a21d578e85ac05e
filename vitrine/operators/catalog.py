"""Joins that enrich the catalog, category trees, and brand linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.posts import bare_url, normalize_username
from vitrine.functions.scores import embedding_status
from vitrine.functions.text import first_filled, or_else
from vitrine.operators.sizes import small_side


def attach_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Add the name and audience of each product's category as ``category`` and ``category_audience``."""
    side = categories.select(
        F.col("id").alias("category_id"), F.col("name").alias("category"),
        F.col("audience").alias("category_audience"))
    return products.join(small_side(side), "category_id", "left")


def attach_category_audience(products: DataFrame, categories: DataFrame) -> DataFrame:
    side = categories.select(F.col("id").alias("category_id"), F.col("audience").alias("category_audience"))
    return products.join(small_side(side), "category_id", "left")


def attach_category_slug(products: DataFrame, categories: DataFrame, name: str = "category_slug") -> DataFrame:
    side = categories.select(F.col("id").alias("category_id"), F.col("slug").alias(name))
    return products.join(small_side(side), "category_id", "left")


def enrich_products(products: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with brand followers, niche score and profile links, and category name and audience."""
    brand_side = brands.select(
        F.col("id").alias("brand_id"),
        F.col("followers").alias("brand_follower_count"),
        F.col("niche_score").alias("brand_niche_score"),
        F.col("profile_picture_url").alias("brand_profile_picture_url"),
        F.coalesce("instagram_profile_url", "profile_url").alias("brand_instagram_profile_url"),
    )
    return attach_category(products, categories).join(brand_side, "brand_id", "left")


ENRICHED_COLUMNS = [
    "id", "brand_id", "brand_name", "category", "category_audience", "item_name", "description", "image_url",
    "product_url", "price", "source", "niche_score", "likes_count", "comments_count", "source_hashtag",
    "scraped_at", "brand_follower_count", "brand_niche_score", "brand_profile_picture_url",
    "brand_instagram_profile_url", "category_id",
]


def category_closure(categories: DataFrame) -> DataFrame:
    """(root_id, id) for every category and each of its descendants, itself included. Cycle-safe.

    Each round follows one level of children for all roots at once. The pairs already reached are
    removed, so a cycle ends the rounds instead of repeating them.
    """
    spark = categories.sparkSession
    edges = categories.select("id", "parent_id")
    return spark.sql(
        """
        WITH RECURSIVE closure (root_id, id, path) AS (
            SELECT id, id, array(id) FROM {edges}
            UNION ALL
            SELECT closure.root_id, child.id, array_append(closure.path, child.id)
            FROM closure JOIN {edges} child ON child.parent_id = closure.id
            WHERE NOT array_contains(closure.path, child.id)
        )
        SELECT root_id, id FROM closure
        """,
        edges=edges,
    )


def filter_category_scope(products: DataFrame, categories: DataFrame, root_id: int) -> DataFrame:
    scope = category_closure(categories).where(F.col("root_id") == root_id).select(F.col("id").alias("category_id"))
    return products.join(small_side(scope), "category_id", "left_semi")


def category_main_slug(categories: DataFrame) -> DataFrame:
    """(slug, main_slug): the slug of each category's root."""
    roots = categories.where(F.col("parent_id").isNull()).select(F.col("id").alias("root_id"), F.col("slug").alias("main_slug"))
    names = categories.select("id", "slug")
    return category_closure(categories).join(roots, "root_id").join(names, "id").select("slug", "main_slug")


def category_leaves(categories: DataFrame) -> DataFrame:
    """Categories with ``is_leaf``, roots first, then by parent and name."""
    parents = categories.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct()
    flagged = categories.join(parents.withColumn("has_child", F.lit(True)), "id", "left")
    return flagged.select(
        "id", "parent_id", "name", "slug", F.col("has_child").isNull().alias("is_leaf")
    ).orderBy(F.asc_nulls_first("parent_id"), "name")


# ---------------------------------------------------------------- brand linking


def _brand_keys(brands: DataFrame) -> DataFrame:
    """One row per key a brand can be found under: name, display name, user name."""
    keys = F.array_distinct(F.array_compact(F.array(
        F.lower("name"), F.lower("brand_name"), F.lower("instagram_username"))))
    return brands.select(F.col("id").alias("found_id"), F.explode(keys).alias("key"))


def _product_keys(products: DataFrame) -> DataFrame:
    lowered = F.lower("brand_name")
    handle = F.lower(F.regexp_replace("brand_name", "[^a-zA-Z0-9._]", ""))
    return products.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(lowered, handle)))))


def link_brands(products: DataFrame, brands: DataFrame) -> DataFrame:
    """Fill a missing brand_id from the brand whose name, display name or user name matches.

    The distinct names without a brand are matched by key (one equi-join, no OR join), then the small
    result comes back to the products by name. Ties take the smallest brand id.
    """
    names = products.where("brand_id IS NULL AND brand_name IS NOT NULL").select("brand_name").distinct()
    found = (
        _product_keys(names).join(_brand_keys(brands), "key")
        .groupBy("brand_name").agg(F.min("found_id").alias("linked_id"))
    )
    return (
        products.join(found, "brand_name", "left")
        .withColumn("brand_id", F.coalesce("brand_id", "linked_id")).drop("linked_id")
    )


def missing_brands(products: DataFrame, brands: DataFrame) -> DataFrame:
    """New brand rows for product brand names that no brand matches; one row per user name."""
    names = (
        products.where("brand_id IS NULL AND brand_name IS NOT NULL")
        .groupBy("brand_name").agg(F.min(F.coalesce("niche_score", F.lit(0.0))).alias("niche_score"))
    )
    matched = _product_keys(names).join(_brand_keys(brands), "key", "left_semi").select("brand_name").distinct()
    rows = names.join(matched, "brand_name", "left_anti").select(
        F.col("brand_name").alias("name"),
        "brand_name",
        F.nullif(F.lower(F.regexp_replace("brand_name", "[^a-zA-Z0-9._]", "")), F.lit("")).alias("instagram_username"),
        F.lit("Fashion").alias("category"),
        F.lit(0).alias("followers"),
        "niche_score",
    )
    keyed = rows.where("instagram_username IS NOT NULL")
    first = keyed.groupBy("instagram_username").agg(F.min_by(F.struct(*rows.columns), "name").alias("row")).select("row.*")
    return first.unionByName(rows.where("instagram_username IS NULL"))


def hydrate_candidates(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Fill scraped_at from created_at and product_url from source_url; nothing else is fetched."""
    side = products.select(
        "id", F.col("created_at").alias("_created_at"), F.col("source_url").alias("_source_url"))
    return (
        candidates.join(side, "id", "left")
        .withColumn("scraped_at", F.coalesce("scraped_at", "_created_at"))
        .withColumn("product_url", first_filled(F.col("product_url"), F.col("_source_url")))
        .drop("_created_at", "_source_url")
    )


def brand_validated_category(brands: DataFrame, mappings: DataFrame, categories: DataFrame) -> DataFrame:
    """Replace a brand's category by the name of its primary mapped category when there is one."""
    primary = (
        mappings.where("is_primary")
        .join(small_side(categories.select(F.col("id").alias("category_id"), F.col("name").alias("validated"))), "category_id")
        .groupBy("brand_id").agg(F.max_by("validated", "category_id").alias("validated"))
    )
    return (
        brands.join(primary, brands["id"] == primary["brand_id"], "left").drop("brand_id")
        .withColumn("category", F.coalesce("validated", F.coalesce(F.nullif("category", F.lit("")), F.lit("Fashion"))))
        .drop("validated")
    )


def reuse_embeddings(incoming: DataFrame, stored: DataFrame, dim: int) -> DataFrame:
    """Keep a stored valid embedding for a product with the same URL (query and trailing slash ignored)."""
    side = (
        stored.where("product_url IS NOT NULL").select(bare_url(F.col("product_url")).alias("_url"), "embedding", "id")
        .where(F.col("_url") != "")
        .groupBy("_url").agg(F.max_by("embedding", F.struct(F.length("id"), "id")).alias("stored_embedding"))
    )
    valid = embedding_status(F.col("stored_embedding"), dim)["valid"]
    return (
        incoming.withColumn("_url", bare_url(F.col("product_url"))).join(side, "_url", "left")
        .withColumn("reused", F.coalesce(valid, F.lit(False)))
        .withColumn("stored_embedding", F.when(F.col("reused"), F.col("stored_embedding"))).drop("_url")
    )


def related_by_category_or_brand(sources: DataFrame, products: DataFrame, limit: int = 6) -> DataFrame:
    """(source_id, related_id, position): other products sharing category or brand, first ``limit`` by order.

    Only the first ``limit + 1`` products of a category or of a brand can appear, so each side is cut to
    those before joining: a category holding a third of the catalog adds seven rows, not a third of it.
    """
    from pyspark.sql import Window

    def shortlist(key: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy("order_key", "id"))
        ordered = products.select("id", key, order_key(F.col("id")).alias("order_key")).where(F.col(key).isNotNull())
        short = ordered.withColumn("_r", rank).where(F.col("_r") <= limit + 1)
        return short.select(F.col("id").alias("related_id"), key, "order_key")

    base = sources.select(F.col("id").alias("source_id"), "category_id", "brand_id")
    by_category = base.join(shortlist("category_id"), "category_id").select("source_id", "related_id", "order_key")
    by_brand = base.join(shortlist("brand_id"), "brand_id").select("source_id", "related_id", "order_key")
    pairs = by_category.union(by_brand).where("source_id <> related_id").distinct()
    position = F.row_number().over(Window.partitionBy("source_id").orderBy("order_key", "related_id"))
    return pairs.withColumn("position", position).where(F.col("position") <= limit).drop("order_key")


def order_key(id_column: Column) -> Column:
    """Catalog order of ids: numeric ids by value, others by text."""
    return F.coalesce(id_column.try_cast("long"), F.lit(9_223_372_036_854_775_807))


def personalized_products(products: DataFrame, preferences: DataFrame, pairs: DataFrame) -> DataFrame:
    """Join (user_id, product id) pairs with their product and the user's preference row."""
    return pairs.join(products, "id").join(preferences, "user_id", "left")


def normalized_brand_batch(brands: DataFrame) -> DataFrame:
    """Brands ready for scraping: normalised user name, profile link, niche score; sorted by user name."""
    from vitrine.functions.posts import normalize_brand, profile_url
    from vitrine.functions.scores import niche_score

    name = normalize_brand(first_filled(F.col("name"), F.col("brand_name"), F.col("instagram_username")))
    username = normalize_username(F.coalesce(F.nullif("instagram_username", F.lit("")), name))
    followers = F.greatest(or_else(F.col("followers"), 0), F.lit(0))
    score = F.when(or_else(F.col("niche_score"), 0.0) == 0, niche_score(followers, name)).otherwise(F.col("niche_score"))
    return brands.select(
        name.alias("brand_name"), username.alias("instagram_username"),
        F.coalesce(first_filled(F.col("instagram_profile_url"), F.col("profile_url")), profile_url(username)).alias("instagram_profile_url"),
        or_else(F.col("profile_picture_url"), "").alias("profile_picture_url"),
        followers.alias("followers"), score.alias("niche_score"),
    ).where(F.col("instagram_username") != "unknown_brand").orderBy("instagram_username")
