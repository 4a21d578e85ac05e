"""Catalog quality: duplicates, warnings, coverage, brand health, image and category audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import classify as C
from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.functions.posts import source_post_url
from vitrine.functions.text import or_else
from vitrine.operators.catalog import attach_category_slug, category_closure
from vitrine.operators.filters import is_not_non_product
from vitrine.operators.sizes import skew_safe_join, small_side
from vitrine.taxonomy import Taxonomy

# Readiness thresholds, inventory targets and confidence buckets.
READINESS = {"not_ready_min": 10, "ready_min": 100, "ready_image": 90.0, "ready_category": 90.0, "ready_embedding": 95.0}
CONFIDENCE_BUCKETS = ((0.0, 0.5, "0.0-0.5"), (0.5, 0.6, "0.5-0.6"), (0.6, 0.7, "0.6-0.7"), (0.7, 0.8, "0.7-0.8"),
                      (0.8, 0.9, "0.8-0.9"), (0.9, 1.01, "0.9-1.0"))
DUPLICATE_REASONS = ("same_instagram_post", "same_source_url", "same_product_url", "same_brand_normalized_name", "same_image_url")
CATEGORY_ALIASES = {"accessories-jewellery": ("accessories-jewellery", "women-jewelry"), "accessories-bags": ("accessories-bags", "women-bags")}
CATEGORY_FAMILIES = {
    "women-tops": ("tops", "shirts"), "men-shirts": ("shirts",), "men-t-shirts": ("tops",),
    "accessories-jewellery": ("jewellery",), "accessories-bags": ("bags",), "women-kurtis": ("ethnic-upperwear",),
    "women-ethnic-wear": ("ethnic-upperwear", "sets"), "women-jeans": ("bottoms",), "men-jeans": ("bottoms",),
}


def _filled(column: Column) -> Column:
    return or_else(X.strip(column.cast("string")) != "", False)


# ---------------------------------------------------------------- duplicates


def duplicate_keys(products: DataFrame) -> DataFrame:
    """(id, brand_id, brand_name, reason, match_value): the identity keys of every product."""
    name = S.product_name(products)
    by_name = F.when(_filled(F.col("brand_id")) & (name != ""), F.concat_ws(":", F.col("brand_id"), X.normalize_name(name)))
    signals = (F.col("instagram_post_id"), F.col("source_url"), F.col("product_url"), by_name, F.col("image_url"))
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.lower(X.strip(c)).alias("match_value")) for r, c in zip(DUPLICATE_REASONS, signals)])
    rows = products.select("id", "brand_id", "brand_name", F.explode(pairs).alias("k"))
    return rows.select("id", "brand_id", "brand_name", "k.*").where("match_value IS NOT NULL AND match_value <> ''")


def duplicate_groups(products: DataFrame) -> DataFrame:
    """One row per group of two or more products that share a key, with its size and first member.

    Members are counted before the shuffle, so a key shared by a third of the catalog stays one small row;
    ``duplicate_members`` lists them.
    """
    return duplicate_keys(products).groupBy("reason", "match_value").agg(
        F.count("*").alias("product_count"), F.min("id").alias("first_id"),
        F.min_by("brand_id", "id").alias("brand_id"), F.min_by("brand_name", "id").alias("brand_name"),
    ).where(F.col("product_count") >= 2)


def duplicate_members(products: DataFrame) -> DataFrame:
    """(reason, match_value, id, product_count) for every member of every duplicate group."""
    groups = duplicate_groups(products).select("reason", "match_value", "product_count")
    return skew_safe_join(duplicate_keys(products).select("reason", "match_value", "id"), groups, ["reason", "match_value"], "product_count")


def duplicate_ids(products: DataFrame) -> DataFrame:
    """Training duplicates: all but the first product of each (brand, post or URL identity, else image)."""
    identity = F.lower(X.strip(or_else(X.first_filled(F.col("instagram_post_id"), F.col("product_url")), "")))
    image = F.lower(X.strip(F.regexp_replace(or_else(F.col("image_url"), ""), r"(?s)\?.*$", "")))
    key = F.coalesce(F.nullif(identity, F.lit("")), F.nullif(image, F.lit("")))
    keyed = products.select("id", or_else(F.col("brand_id"), "").alias("brand"), key.alias("key")).where("key IS NOT NULL")
    first = keyed.groupBy("brand", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return skew_safe_join(keyed, first, ["brand", "key"], "n").where("id <> first_id").select("id")


# ---------------------------------------------------------------- warnings and reports


def product_warnings(p, duplicate: Column, dim: int) -> Column:
    price = S.price_status(p["price"])
    return F.array_compact(F.array(
        F.when(S.product_name(p) == "", "MISSING_NAME"),
        F.when(~S.valid_http_url(p["image_url"]), "MISSING_IMAGE"),
        F.when(~_filled(p["category_id"]), "MISSING_CATEGORY"),
        F.when(~S.has_embedding(p["embedding"], dim), "MISSING_EMBEDDING"),
        F.when(price == "INVALID", "INVALID_PRICE").when(price == "SUSPICIOUS", "SUSPICIOUS_PRICE"),
        F.when(~_filled(p["brand_id"]), "MISSING_BRAND"),
        F.when(~S.valid_http_url(S.source_url(p)), "INVALID_SOURCE_URL"),
        F.when(duplicate, "DUPLICATE_CANDIDATE"),
    ))


def with_warnings(products: DataFrame, dim: int) -> DataFrame:
    """(id, brand_id, warnings, catalog_quality_score) of every product."""
    duplicated = duplicate_members(products).select("id").distinct().withColumn("_dup", F.lit(True))
    facts = products.select(
        "id", "brand_id", product_warnings(products, F.lit(False), dim).alias("w"), S.catalog_quality_score(products, dim).alias("catalog_quality_score"))
    marked = facts.join(duplicated, "id", "left")
    warnings = F.when(F.col("_dup"), F.array_append("w", "DUPLICATE_CANDIDATE")).otherwise(F.col("w"))
    return marked.select("id", "brand_id", warnings.alias("warnings"), "catalog_quality_score")


def catalog_issues(products: DataFrame, dim: int, *, issue: str | None = None, brand_id: str | None = None) -> DataFrame:
    rows = with_warnings(products, dim).where(F.size("warnings") > 0)
    if issue:
        rows = rows.where(F.array_contains("warnings", issue.upper()))
    return rows.where(F.col("brand_id") == brand_id) if brand_id else rows


def _percent(part: Column, total: Column, digits: int = 1) -> Column:
    return F.when(total > 0, S.half_even(part / total * 100, digits)).otherwise(0.0)


def catalog_summary(brands: DataFrame, products: DataFrame, dim: int) -> DataFrame:
    """One row: totals, coverage, duplicates, issues and readiness."""
    price = S.price_status(F.col("price"))
    n = lambda condition, name: F.count_if(condition).alias(name)
    main = products.agg(
        F.count("*").alias("total_products"), n(S.valid_http_url(F.col("image_url")), "products_with_images"),
        n(price.isin("VALID", "SUSPICIOUS"), "products_with_price"), n(_filled(F.col("category_id")), "products_with_category"),
        n(S.has_embedding(F.col("embedding"), dim), "products_with_embedding"), n(price == "SUSPICIOUS", "suspicious_price_count"))
    sold = products.select(F.col("brand_id").alias("id")).where("id IS NOT NULL AND id <> ''").distinct().withColumn("_sold", F.lit(True))
    brand_side = brands.join(sold, "id", "left").agg(F.count("*").alias("total_brands"), F.count("_sold").alias("brands_with_products"))
    groups = duplicate_groups(products).agg(F.count("*").alias("possible_duplicates"))
    issues = catalog_issues(products, dim).agg(F.count("*").alias("products_with_issues"))
    row = _one_row(main, brand_side, groups, issues)
    c = F.col
    row = row.withColumns({
        "brands_without_products": c("total_brands") - c("brands_with_products"),
        **{f"products_without_{x}": c("total_products") - c(f"products_with_{x}") for x in ("images", "price", "category", "embedding")},
        **{f"{x}_coverage_percent": _percent(c(f"products_with_{y}"), c("total_products"))
           for x, y in (("image", "images"), ("price", "price"), ("category", "category"), ("embedding", "embedding"))},
    })
    return row.withColumn("catalog_status", S.readiness_status(
        c("total_products"), c("image_coverage_percent"), c("category_coverage_percent"), c("embedding_coverage_percent"), **READINESS))


def _one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side."""
    row = first.withColumn("_one", F.lit(1))
    for other in others:
        row = row.join(other.withColumn("_one", F.lit(1)), "_one")
    return row.drop("_one")


def brand_health(brands: DataFrame, products: DataFrame, failures: DataFrame, dim: int) -> DataFrame:
    n = lambda condition: F.count_if(condition)
    stats = products.where("brand_id IS NOT NULL").groupBy("brand_id").agg(
        F.count("*").alias("product_count"), n(S.valid_http_url(F.col("image_url"))).alias("products_with_images"),
        n(S.has_embedding(F.col("embedding"), dim)).alias("products_with_embeddings"), n(_filled(F.col("category_id"))).alias("products_with_categories"),
        F.sum(S.catalog_quality_score(products, dim)).alias("_quality"), F.max(F.coalesce("scraped_at", "created_at")).alias("last_product_ingested_at"))
    failed = failures.where("brand_id IS NOT NULL").select("brand_id").distinct().withColumn("_failed", F.lit(True))
    rows = brands.select(F.col("id").alias("brand_id"), X.first_filled(F.col("name"), F.col("brand_name")).alias("brand_name"))
    rows = rows.join(stats, "brand_id", "left").join(failed, "brand_id", "left")
    counts = ("product_count", "products_with_images", "products_with_embeddings", "products_with_categories")
    rows = rows.fillna(0, list(counts))
    total = F.col("product_count")
    average = F.when(total > 0, S.half_even(F.col("_quality") / total, 1)).otherwise(0.0)
    coverage = F.when(total > 0, F.least(*[F.col(c) for c in counts[1:]]) / total * 100).otherwise(0.0)
    health = (
        F.when(F.col("_failed") & (total == 0), "FAILED").when(total == 0, "EMPTY")
        .when((total >= 3) & (coverage >= 90) & (average >= 85), "HEALTHY").otherwise("PARTIAL"))
    return rows.select("brand_id", "brand_name", *counts, average.alias("average_catalog_quality_score"), "last_product_ingested_at", health.alias("ingestion_health"))


# ---------------------------------------------------------------- inventory


def inventory_report(products: DataFrame, taxonomy: Taxonomy, *, minimum=(20, 3), healthy=(40, 5)) -> DataFrame:
    """Products and brands per taxonomy type, empty types included, with status and where to look for more."""
    found = X.identify_product(X.inventory_text(products), taxonomy)
    counted = products.where(is_not_non_product(F.col("catalog_status"))).select(found["type"].alias("type"), F.nullif("brand_id", F.lit("")).alias("brand_id")).where("type IS NOT NULL")
    stats = counted.groupBy("type").agg(F.count("*").alias("products"), F.count_distinct("brand_id").alias("brands"))
    spark = products.sparkSession
    types = spark.createDataFrame(
        [(i, taxonomy.family_label(f), k) for i, (f, k) in enumerate(taxonomy.types)], "position int, family string, type string")
    rows = types.join(stats, "type", "left").fillna(0, ["products", "brands"])
    enough = lambda bar: (F.col("products") >= bar[0]) & (F.col("brands") >= bar[1])
    status = F.when(enough(healthy), "HEALTHY").when(enough(minimum), "ADEQUATE").otherwise("NEED_MORE")
    rows = rows.withColumn("status", status)
    return rows.withColumn("acquisition_category", F.when(F.col("status") == "NEED_MORE", F.lower("family")))


def compare_inventory(before: DataFrame, after: DataFrame) -> DataFrame:
    old = before.select("type", F.col("products").alias("before_products"), F.col("brands").alias("before_brands"))
    rows = after.join(old, "type", "left").fillna(0, ["before_products", "before_brands"])
    return rows.withColumns({
        "product_change": F.col("products") - F.col("before_products"), "brand_change": F.col("brands") - F.col("before_brands")})


def confidence_distribution(products: DataFrame) -> DataFrame:
    """Count per half-open bucket, empty ones kept, null counted apart."""
    value = F.col("classifier_confidence")
    tests = [(label, (value >= low) & (value < high)) for low, high, label in CONFIDENCE_BUCKETS]
    tests.append(("missing", value.isNull()))
    counted = products.agg(F.array(*[
        F.struct(F.lit(label).alias("bucket"), F.count_if(test).alias("products")) for label, test in tests]).alias("b"))
    return counted.select(F.inline("b"))


def category_audience_breakdown(products: DataFrame, categories: DataFrame) -> DataFrame:
    names = small_side(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")))
    audience = F.lower(or_else(X.first_filled(F.col("audience")), "unspecified"))
    rows = products.select("category_id", audience.alias("audience")).join(names, "category_id", "left")
    return rows.groupBy(or_else(F.col("category"), "Uncategorized").alias("category"), "audience").count().orderBy(F.desc("count"), "category", "audience")


def brand_category_breakdown(brands: DataFrame) -> DataFrame:
    return brands.groupBy(or_else(X.first_filled(F.col("category")), "Uncategorized").alias("category")).count().orderBy(F.desc("count"), "category")


def caption_like_names(products: DataFrame, limit: int = 25) -> DataFrame:
    """Count of names that are a bare type word, with the first examples."""
    flagged = products.where(C.is_generic_name(F.col("product_name"))).select("id", "product_name", "brand_id")
    total = flagged.agg(F.count("*").alias("flagged"))
    return flagged.orderBy("id").limit(limit).withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")


def catalog_scale_report(brands: DataFrame, products: DataFrame, taxonomy: Taxonomy, storage: str, dim: int) -> DataFrame:
    """(section, key, value): coverage, price brackets, follower sizes, families, categories, milestones, readiness."""
    active = products.where(is_not_non_product(F.col("catalog_status")))
    found = X.identify_product(X.product_search_text(active), taxonomy)
    vector = S.embedding_status(F.col("embedding"), dim)
    price = or_else(F.col("price"), 0.0)
    bracket = (F.when(price <= 0, "missing").when(price < 1000, "under_1000").when(price <= 2500, "1000_2500")
               .when(price <= 5000, "2500_5000").otherwise("over_5000"))
    stable = S.usable_image(F.col("image_url"), F.col("image_status")) & F.col("image_url").contains(S.PUBLIC_STORAGE_PATH)
    facts = active.select(
        found.alias("product"), (vector["finite"] & (vector["dimensions"] == dim) & (vector["l2_norm"] > 0)).alias("embedded"),
        or_else(stable, False).alias("stable"), bracket.alias("bracket"), or_else(X.first_filled(F.col("category")), "uncategorized").alias("category"),
        S.is_confident(F.col("classifier_confidence")).alias("confident"))
    # Each product adds its cells, equal cells are summed before the shuffle.
    cell = lambda section, key, condition=None: F.struct(F.lit(section).alias("section"), (key if isinstance(key, Column) else F.lit(key)).alias("key"), (
        F.lit(1) if condition is None else condition.cast("int")).alias("n"))
    kind = F.col("product.type")
    cells = F.array(
        cell("coverage", "products"), cell("coverage", "stable_images", F.col("stable")), cell("coverage", "valid_embeddings", F.col("embedded")),
        cell("coverage", "classified_type", kind.isNotNull()), cell("coverage", "categorized", F.col("category") != "uncategorized"),
        cell("price_brackets", F.col("bracket")), cell("categories", F.col("category")), cell("families", F.col("product.family")),
        cell("trusted_types", F.when(F.col("stable") & F.col("confident"), kind)))
    summed = facts.select(F.explode(cells).alias("c")).select("c.*").where("key IS NOT NULL").groupBy("section", "key").agg(F.sum("n").alias("value"))
    followers = or_else(F.col("followers"), 0)
    size = (F.when(followers <= 0, "unknown").when(followers < 10_000, "micro").when(followers < 50_000, "small")
            .when(followers < 250_000, "medium").otherwise("larger_independent"))
    sizes = brands.groupBy(size.alias("key")).agg(F.count("*").alias("value")).select(F.lit("brand_sizes").alias("section"), "key", "value")
    totals = brands.agg(F.count("*").alias("value")).select(F.lit("coverage").alias("section"), F.lit("brands").alias("key"), "value")
    rows = summed.unionByName(sizes).unionByName(totals)
    remaining = lambda key, targets: rows.where((F.col("section") == "coverage") & (F.col("key") == key)).select(
        F.lit(f"{key}_milestones").alias("section"), F.explode(F.array(*[F.struct(F.lit(str(t)).alias("key"), F.greatest(F.lit(0), F.lit(t) - F.col("value")).alias("value")) for t in targets])).alias("m")
    ).select("section", "m.*")
    weak = rows.where((F.col("section") == "families") & (F.col("value") < 20)).withColumn("section", F.lit("weak_families"))
    report = rows.unionByName(remaining("brands", (150, 200, 250))).unionByName(remaining("products", (2000, 3000, 5000))).unionByName(weak)
    status = F.when(F.col("section") == "trusted_types", F.when(F.col("value") >= 100, "SUFFICIENT").when(F.col("value") >= 50, "DEVELOPING").otherwise("WEAK"))
    return report.withColumn("status", status)


# ---------------------------------------------------------------- categories


def category_support(products: DataFrame, categories: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(id, brand_id, category_id, slug, confidence): every category a product strictly supports.

    Evidence is a confident stored label, a confident re-classification, the audience gate of a gendered
    category, the family rule of the category, and the decision being the category itself, an alias or a
    descendant of it. Categories are few, so each product is joined with the ancestors of its own decision.
    """
    staged = C.with_classification(products)
    found = X.identify_product(F.col("cls_text"), taxonomy)
    audience = X.audience_text(staged)
    good = (
        is_not_non_product(F.col("catalog_status")) & S.is_confident(F.col("classifier_confidence"))
        & (F.col("direct.confidence") >= S.CONFIDENCE_FLOOR) & F.col("direct.category_slug").isNotNull())
    evidence = staged.where(good).select(
        "id", "brand_id", "category_id", "classifier_confidence", F.col("direct.category_slug").alias("decided"), found.alias("product"),
        *[X.gender_match_score(audience, F.lit(g)).alias(f"g_{g}") for g in ("women", "men", "unisex")])
    slugs = categories.select("id", "slug")
    lines = category_closure(categories).join(slugs.select(F.col("id").alias("root_id"), F.col("slug").alias("requested")), "root_id").join(
        slugs.select("id", F.col("slug").alias("decided")), "id").select("requested", "decided")
    own = slugs.select(F.col("slug").alias("requested"), F.col("slug").alias("decided"))
    alias_rows = [(r, a) for r, accepted in CATEGORY_ALIASES.items() for a in accepted]
    spark = products.sparkSession
    alias = spark.createDataFrame(alias_rows, "requested string, accepted string")
    through_alias = alias.join(lines.select(F.col("requested").alias("accepted"), "decided"), "accepted").select("requested", "decided")
    direct_alias = alias.select("requested", F.col("accepted").alias("decided"))
    accepted = lines.union(own).union(through_alias).union(direct_alias).distinct()
    pairs = evidence.join(small_side(accepted), "decided")
    gate = F.lit(True)
    for g in ("women", "men", "unisex"):
        gate = gate & (~F.col("requested").startswith(f"{g}-") | (F.col(f"g_{g}") > 0))
    family = F.lit(True)
    for slug, families in CATEGORY_FAMILIES.items():
        family = family & ((F.col("requested") != slug) | or_else(F.col("product.family").isin(*families), False))
    jeans = ~F.col("requested").endswith("jeans") | or_else(F.col("product.type").isin("jeans", "wide-leg-jeans"), False)
    return pairs.where(gate & family & jeans).select("id", "brand_id", "category_id", F.col("requested").alias("slug"), "classifier_confidence")


def category_brands(support: DataFrame, brands: DataFrame, products: DataFrame, slug: str) -> DataFrame:
    """Brands with products supporting a category: count, mean confidence and the five newest products."""
    backed = support.where((F.col("slug") == slug) & F.col("brand_id").isNotNull())
    dated = backed.join(products.select("id", F.coalesce("scraped_at", "created_at").alias("scraped_at")), "id")
    spot = Window.partitionBy("brand_id").orderBy(F.desc_nulls_last("scraped_at"), "id")
    newest = dated.withColumn("_n", F.row_number().over(spot)).where("_n <= 5").groupBy("brand_id").agg(
        F.sort_array(F.collect_list(F.struct("_n", "id"))).alias("_top"))
    stats = dated.groupBy("brand_id").agg(F.count("*").alias("supporting_product_count"), F.bround(F.avg("classifier_confidence"), 4).alias("average_confidence"))
    names = brands.select(F.col("id").alias("brand_id"), X.first_filled(F.col("name"), F.col("brand_name")).alias("name"))
    return names.join(stats, "brand_id").join(newest, "brand_id").select(
        "brand_id", "name", "supporting_product_count", F.transform("_top", lambda x: x["id"]).alias("supporting_products"), "average_confidence")


def supported_mappings(support: DataFrame, categories: DataFrame) -> DataFrame:
    """(brand_id, category_id, n, confidence) where the product's stored category is itself supported."""
    own = categories.select(F.col("id").alias("category_id"), "slug")
    return support.where("brand_id IS NOT NULL").join(small_side(own), ["category_id", "slug"]).groupBy("brand_id", "category_id").agg(
        F.count("*").alias("n"), F.max("classifier_confidence").alias("confidence"))


def primary_category(counts: DataFrame) -> DataFrame:
    """The most supported category of each brand; ties take the smaller category id."""
    spot = Window.partitionBy("brand_id").orderBy(F.desc("n"), "category_id")
    return counts.withColumn("is_primary", F.row_number().over(spot) == 1)


def rebuild_brand_categories(support: DataFrame, categories: DataFrame, mappings: DataFrame) -> DataFrame:
    """Curated mappings kept as they are, derived ones rebuilt from supporting products; derived wins a clash."""
    derived = primary_category(supported_mappings(support, categories)).select(
        "brand_id", "category_id", "is_primary", F.lit("product_derived").alias("source"), "confidence")
    kept = mappings.where("source <> 'product_derived'").select(*derived.columns)
    return derived.unionByName(kept.join(derived, ["brand_id", "category_id"], "left_anti"))


def invalid_mappings(mappings: DataFrame, support: DataFrame, categories: DataFrame) -> DataFrame:
    """Mappings of a known category that no product of the brand supports."""
    named = mappings.join(small_side(categories.select(F.col("id").alias("category_id"), "slug")), "category_id")
    return named.join(support.select("brand_id", "slug").distinct(), ["brand_id", "slug"], "left_anti").select("brand_id", "category_id", "slug")


def category_overlaps(support: DataFrame, slugs: tuple[str, ...]) -> DataFrame:
    """(brand_id, left_slug, right_slug): brands backed in two of the named categories."""
    held = support.where(F.col("slug").isin(*slugs) & F.col("brand_id").isNotNull()).groupBy("brand_id").agg(
        F.sort_array(F.collect_set("slug")).alias("s"))
    order = {s: i for i, s in enumerate(slugs)}
    pairs = [F.when(F.array_contains("s", a) & F.array_contains("s", b), F.struct(F.lit(a).alias("left_slug"), F.lit(b).alias("right_slug")))
             for a in slugs for b in slugs if order[a] < order[b]]
    return held.select("brand_id", F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("brand_id", "p.*")


def category_health(products: DataFrame, brands: DataFrame, categories: DataFrame, mappings: DataFrame, storage: str) -> DataFrame:
    """(section, key, value): category distribution, sources, images, confidence, suspicious shares."""
    rows = attach_category_slug(products, categories)
    confident = S.is_confident(F.col("classifier_confidence"))
    stored = F.coalesce(X.first_filled(F.col("normalized_subcategory")), "category_slug", F.lit("UNCATEGORIZED"))
    source = F.lower(or_else(X.first_filled(F.col("classification_source")), "legacy"))
    source = F.when(source == "heuristic", "deterministic").when(source == "openai", "ai").otherwise(source)
    url, status = F.col("image_url"), F.col("image_status")
    stable, missing = S.in_storage(url, storage), or_else(url, "") == ""
    broken = or_else(status.isin(*S.FLAGGED_IMAGE), False) | or_else((F.col("source") == "instagram") & url.contains(S.STOCK_PHOTO_HOST), False)
    cell = lambda section, key, n: F.struct(F.lit(section).alias("section"), (key if isinstance(key, Column) else F.lit(key)).alias("key"), n.cast("int").alias("n"))
    one = F.lit(1)
    cells = F.array(
        cell("categories", F.when(confident, stored).otherwise("UNCATEGORIZED"), one),
        cell("sources", F.when(confident, source).otherwise("unresolved"), one),
        cell("products", "total", one), cell("products", "confident", confident),
        cell("images", "stable", stable), cell("images", "missing", missing), cell("images", "broken", broken))
    summed = rows.select(F.explode(cells).alias("c")).select("c.*").groupBy("section", "key").agg(F.sum("n").alias("value"))
    total = summed.where("section = 'products' AND key = 'total'").select(F.col("value").alias("_total"))
    suspicious = summed.where("section = 'categories'").withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").where(
        F.col("value") > F.greatest(F.lit(100.0), F.col("_total") * 0.35)).select(F.lit("suspicious_category").alias("section"), "key", "value")
    trusted = mappings.where(S.is_confident(F.col("confidence")))
    crowded = trusted.groupBy("brand_id").agg(F.count("*").alias("value")).where("value > 6").select(F.lit("suspicious_brand").alias("section"), F.col("brand_id").alias("key"), "value")
    sold = products.select(F.col("brand_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("_sold", F.lit(True))
    brand_rows = brands.join(sold, "id", "left").agg(F.count("_sold").alias("with_products"), F.count("*").alias("total")).unpivot(
        [], ["with_products", "total"], "key", "value").select(F.lit("brands").alias("section"), "key", "value")
    mapped = trusted.agg(F.count_distinct("brand_id").alias("value")).select(F.lit("brands").alias("section"), F.lit("with_mappings").alias("key"), "value")
    result = summed
    for part in (suspicious, crowded, brand_rows, mapped):
        result = result.unionByName(part)
    return result


def image_health(products: DataFrame, brands: DataFrame, storage: str) -> DataFrame:
    """(owner, class, images, percent): counts of each image class, with its share."""
    count = lambda df, owner, column: df.groupBy(S.image_class(F.col(column), storage).alias("class")).agg(F.count("*").alias("images")).withColumn("owner", F.lit(owner))
    rows = count(products, "product", "image_url").unionByName(count(brands, "brand", "profile_picture_url"))
    share = F.bround(F.col("images") * 100 / F.sum("images").over(Window.partitionBy("owner")), 2)
    recoverable = F.col("class").isin("EXTERNAL_WORKING", "STOCK_PHOTO")
    return rows.select("owner", "class", "images", share.alias("percent"), recoverable.alias("recoverable"))


def ambiguity_audit(products: DataFrame, examples: int = 3) -> DataFrame:
    """Per ambiguity reason: products, how the pipeline would settle them, and a few examples."""
    rows = C.with_classification(products.where(~S.is_confident(F.col("classifier_confidence"))))
    outcome = F.when(F.col("non_product"), "non_product").when(
        F.col("decision.category_slug").isNotNull() & (F.col("decision.confidence") >= S.CONFIDENCE_FLOOR), "resolved_without_ai").otherwise("would_require_ai")
    facts = rows.select("id", F.col("ambiguity").alias("reason"), outcome.alias("outcome"))
    counted = facts.groupBy("reason").agg(F.count("*").alias("products"), *[
        F.count_if(F.col("outcome") == o).alias(o) for o in ("non_product", "resolved_without_ai", "would_require_ai")])
    spot = Window.partitionBy("reason").orderBy("id")
    shown = facts.withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= examples).groupBy("reason").agg(
        F.sort_array(F.collect_list("id")).alias("examples"))
    return counted.join(shown, "reason")


def manual_review(products: DataFrame, categories: DataFrame, *, brand: str | None = None, category: str | None = None, reason: str | None = None) -> DataFrame:
    rows = C.with_classification(attach_category_slug(products.where(~S.is_confident(F.col("classifier_confidence"))), categories))
    wanted = F.lit(True)
    for column, needle in (("brand_name", brand), ("category_slug", category), ("ambiguity", reason)):
        if needle:
            wanted &= X.contains_text(F.lower(or_else(F.col(column), "")), needle.lower())
    return rows.where(wanted).select(
        "id", "product_name", "brand_name", source_post_url(F.col("product_url"), F.col("source_url")).alias("source_post_url"),
        F.coalesce("metadata.caption", "description").alias("caption"), F.col("category_slug").alias("current_category"),
        F.col("decision.category_slug").alias("proposed_category"), F.col("decision.confidence").alias("confidence"), F.col("ambiguity").alias("reason"))


def classification_errors(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Confident stored categories against the evidence: (id, stored, evidence_based, obvious_mismatch)."""
    rows = C.with_classification(attach_category_slug(products.where(S.is_confident(F.col("classifier_confidence"))), categories))
    return rows.where("category_slug IS NOT NULL AND direct.category_slug IS NOT NULL").select(
        "id", F.col("category_slug").alias("stored"), F.col("direct.category_slug").alias("evidence_based"),
        (F.col("category_slug") != F.col("direct.category_slug")).alias("obvious_mismatch"))


def type_tiles(products: DataFrame, taxonomy: Taxonomy, storage: str, families: tuple[str, ...] | None = None) -> DataFrame:
    """Per type: product count and the image of its best product with a stable image."""
    found = X.identify_product(X.product_search_text(products), taxonomy)
    stable = S.tile_stable_image(F.col("image_url"), F.col("image_status"), storage)
    order = F.struct(or_else(F.col("classifier_confidence"), 0.0), or_else(F.col("niche_score"), 0.0),
                     S.engagement_score(F.col("likes_count"), F.col("comments_count")), or_else(F.col("scraped_at").cast("string"), ""), F.col("id"))
    rows = products.select(found.alias("product"), F.when(stable, F.struct(order.alias("o"), F.col("image_url").alias("u"))).alias("pick")).where("product.type IS NOT NULL")
    if families:
        rows = rows.where(F.col("product.family").isin(*families))
    tiles = rows.groupBy(F.col("product.type").alias("slug")).agg(F.count("*").alias("product_count"), F.max("pick").alias("pick"))
    label = F.element_at(X.literal_map(taxonomy.type_labels), F.col("slug"))
    return tiles.select(label.alias("name"), "slug", F.col("pick.u").alias("image_url"), "product_count").orderBy(F.desc("product_count"), "name")


def pilot_report(products: DataFrame, brands: DataFrame, handles: list[str], storage: str, dim: int) -> DataFrame:
    """(section, key, value) over the products of the chosen brands."""
    chosen = brands.where(F.lower("instagram_username").isin(*handles)).select(F.col("id").alias("brand_id"))
    rows = products.join(small_side(chosen), "brand_id", "left_semi")
    image = F.when(S.in_storage(F.col("image_url"), storage), "stable").when(or_else(F.col("image_url"), "") == "", "missing").otherwise("external")
    valid = S.embedding_status(F.col("embedding"), dim)["valid"]
    cell = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    cells = F.array(cell("images", image), cell("embeddings", F.when(valid, "valid").otherwise("invalid")),
                    cell("categories", or_else(X.first_filled(F.col("normalized_subcategory")), "unresolved")),
                    cell("confidence", F.when(or_else(F.col("classifier_confidence"), 0.0) < 0.8, "low").otherwise("ok")))
    return rows.select(F.explode(cells).alias("c")).select("c.*").groupBy("section", "key").agg(F.count("*").alias("value"))


def feed_isolation(feed: DataFrame, taxonomy: Taxonomy, families: tuple[str, ...]) -> DataFrame:
    """One row: feed size, rows inside the families, precision."""
    family = X.identify_product(X.inventory_text(feed), taxonomy)["family"]
    valid = F.count_if(or_else(family.isin(*families), False))
    total = F.count("*")
    return feed.agg(total.alias("total"), valid.alias("valid"), F.when(total > 0, F.bround(valid / total, 4)).otherwise(1.0).alias("precision"))
