"""From posts to catalog rows: dedupe, candidate products, one decision per post, and the reclassification job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import classify as C
from vitrine.functions import posts as P
from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.functions.text import or_else
from vitrine.operators.catalog import attach_category_slug, category_main_slug
from vitrine.operators.filters import reclassify_scope
from vitrine.operators.sizes import small_side
from vitrine.session import cut_lineage
from vitrine.taxonomy import QueryVocabulary, Taxonomy

# ---------------------------------------------------------------- dedupe


def post_keys(posts: DataFrame) -> DataFrame:
    """Add the identity keys of a post: k_id, k_url, k_image (brand and image); null when absent."""
    url = F.lower(P.bare_url(F.col("product_url")))
    post = F.coalesce(F.nullif("instagram_post_id", F.lit("")), F.nullif(P.post_id(url), F.lit("")))
    image = F.lower(F.regexp_replace(or_else(F.col("image_url"), ""), r"(?s)\?.*$", ""))
    return posts.withColumns({
        "k_id": post, "k_url": F.nullif(url, F.lit("")),
        "k_image": F.when(image != "", F.concat_ws("|", P.normalize_username(F.col("brand_name")), image))})


KEYS = ("k_id", "k_url", "k_image")


def dedupe_posts(posts: DataFrame, order_col: str) -> DataFrame:
    """Drop a post when its id, URL or brand and image occur on an earlier post.

    The first post of each key is found with a minimum per key, which is combined before the shuffle, so a
    key copied a billion times costs one row per task. It differs from ``dedupe_posts_exact`` only where the
    earlier twin was itself a duplicate.
    """
    keyed = post_keys(posts)
    for key in KEYS:
        first = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order_col).alias(f"_{key}"))
        keyed = keyed.join(first, key, "left")
    late = [F.col(key).isNotNull() & (F.col(f"_{key}") < F.col(order_col)) for key in KEYS]
    kept = keyed.where(~(late[0] | late[1] | late[2]))
    return kept.drop(*KEYS, *[f"_{k}" for k in KEYS])


def dedupe_posts_exact(posts: DataFrame, order_col: str) -> DataFrame:
    """The sequential rule: a dropped post claims no keys, so a later post may be kept again.

    Each round settles, for every key, its earliest undecided post: a post that is first for all its keys is
    kept, and every later post sharing a key with a kept post is dropped. Rounds follow the longest chain of
    alternating copies; their tables are checkpointed.
    """
    keyed = post_keys(posts).select(order_col, F.array_compact(F.array(*[
        F.when(F.col(k).isNotNull(), F.concat_ws("=", F.lit(k), F.col(k))) for k in KEYS])).alias("keys"))
    open_keys = cut_lineage(keyed.select(F.col(order_col).alias("pos"), F.explode_outer("keys").alias("key")))
    kept = None
    while True:
        firsts = open_keys.groupBy("key").agg(F.min("pos").alias("first"))
        settled = open_keys.join(firsts, "key", "left").groupBy("pos").agg(
            F.min((F.col("key").isNull() | (F.col("pos") == F.col("first"))).cast("int")).alias("ok")).where("ok = 1").select("pos")
        settled = cut_lineage(settled)
        kept = settled if kept is None else kept.unionByName(settled)
        claimed = open_keys.join(settled, "pos", "left_semi").select("key").where("key IS NOT NULL").distinct()
        gone = open_keys.join(claimed, "key", "left_semi").select("pos").distinct().unionByName(settled).distinct()
        open_keys = cut_lineage(open_keys.join(gone, "pos", "left_anti"))
        if open_keys.isEmpty():
            return posts.join(kept.withColumnRenamed("pos", order_col), order_col, "left_semi")


# ---------------------------------------------------------------- candidates


def candidate_products(posts: DataFrame, categories: DataFrame, taxonomy: Taxonomy, words: QueryVocabulary) -> DataFrame:
    """Each post with its category, name, price, ids, audience and metadata; unknown slugs fall back to the ladder."""
    named = small_side(categories.select(F.col("slug").alias("normalized_subcategory"), F.col("id").alias("category_id"), F.col("name").alias("category")))
    found = P.fallback_category(F.col("description"))
    rows = posts.withColumn("_c", found).withColumns({
        "normalized_subcategory": F.col("_c.category_slug"), "classifier_confidence": F.col("_c.confidence_score")}).drop("_c")
    rows = rows.join(named, "normalized_subcategory", "left")
    slug, brand = F.col("normalized_subcategory"), P.normalize_brand(F.col("brand_name"))
    username = F.coalesce(F.nullif("instagram_username", F.lit("")), P.normalize_username(F.col("brand_name")))
    rows = rows.withColumns({
        "product_name": F.coalesce(P.clean_product_name(F.col("description"), taxonomy, words), "category", F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))),
        "price": P.extract_price(F.col("description")), "brand_name": brand, "instagram_username": username,
        "instagram_post_id": F.coalesce(F.nullif("instagram_post_id", F.lit("")), P.post_id(F.col("product_url"))),
        "normalized_main_category": P.main_of_slug(slug), "audience": P.audience_of_slug(slug),
        "niche_score": F.when(brand != "unknown_brand", 0.75).otherwise(0.5), "metadata": P.fashion_metadata(F.col("description"), taxonomy, words)})
    return rows


def product_payload(candidates: DataFrame) -> DataFrame:
    """The stored row of a candidate: legacy twin columns, price 0.0 when unknown, blanks as null."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    c = F.col
    return candidates.select(
        c("product_name").alias("name"), c("brand_name").alias("brand"), "brand_name", "product_name", c("product_name").alias("item_name"), "description",
        "image_url", "category_id", F.lit("instagram").alias("source"), c("product_url").alias("source_url"), "product_url",
        or_else(c("price"), 0.0).alias("price"), F.lit("INR").alias("currency"), c("category").alias("subcategory"), blank("instagram_post_id").alias("instagram_post_id"),
        F.lit("VALID").alias("image_status"), blank("normalized_main_category").alias("normalized_main_category"), blank("normalized_subcategory").alias("normalized_subcategory"),
        blank("audience").alias("audience"), F.lit("heuristic").alias("classification_source"), "likes_count", "comments_count", blank("source_hashtag").alias("source_hashtag"),
        "scraped_at", "niche_score", "classifier_confidence", "metadata")


def ingest_decisions(posts: DataFrame, stored: DataFrame, categories: DataFrame, taxonomy: Taxonomy, words: QueryVocabulary) -> DataFrame:
    """Candidates with ``decision`` (INSERT / UPDATE / HOLD / SKIP / REJECT) and ``reasons``.

    A post fails alone: its reasons are a column, never an exception of the batch.
    """
    rows = candidate_products(posts, categories, taxonomy, words)
    known = stored.select("product_url").where("product_url IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "product_url", "left")
    rows = rows.withColumns({
        "_errors": P.post_errors(rows), "_likely": P.is_likely_product_post(F.col("description"), F.col("image_url")), "_held": P.quality_gate(rows)})
    decision = (F.when(F.size("_errors") > 0, "REJECT").when(~F.col("_likely"), "SKIP").when(F.size("_held") > 0, "HOLD")
                .when(F.col("_known"), "UPDATE").otherwise("INSERT"))
    reasons = (F.when(F.size("_errors") > 0, F.col("_errors")).when(~F.col("_likely"), F.array(F.lit("no reliable fashion product signal"))).otherwise(F.col("_held")))
    return rows.withColumns({"decision": decision, "reasons": reasons}).drop("_errors", "_likely", "_held", "_known")


def ingestion_summary(raw: DataFrame, decided: DataFrame, brands: DataFrame) -> DataFrame:
    """One row of counters for an ingest run."""
    n = lambda d: F.count_if(F.col("decision").isin(*d))
    accepted = F.col("decision").isin("INSERT", "UPDATE")
    known = brands.select("instagram_username").distinct().withColumn("_old", F.lit(True))
    rows = decided.join(known, "instagram_username", "left")
    counted = rows.agg(
        F.count("*").alias("unique_posts"), n(("HOLD", "INSERT", "UPDATE")).alias("product_posts_detected"), n(("INSERT",)).alias("products_inserted"),
        n(("UPDATE",)).alias("products_updated"), n(("HOLD",)).alias("quality_rejections"), n(("REJECT", "SKIP", "HOLD")).alias("skipped"),
        F.count_distinct("instagram_username").alias("brands_attempted"), F.count_distinct(F.when(accepted, F.col("instagram_username"))).alias("brands_successful"),
        F.count_distinct(F.when(accepted & F.col("_old"), F.col("instagram_username"))).alias("brands_updated"), n(("REJECT",)).alias("errors"))
    total = raw.agg(F.count("*").alias("posts_scanned")).select("posts_scanned").scalar()
    return counted.withColumn("posts_scanned", total).withColumns({
        "duplicates_skipped": F.col("posts_scanned") - F.col("unique_posts"), "brands_failed": F.col("brands_attempted") - F.col("brands_successful"),
        "brands_inserted": F.col("brands_successful") - F.col("brands_updated")}).drop("unique_posts")


# ---------------------------------------------------------------- proposals of an external model


def check_proposals(proposals: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """Validate proposed categories: slug exists, parent and audience agree, confidence grounded in the text.

    ``proposals`` holds id, category_slug, main_category_slug, audience, confidence, evidence, reason.
    """
    tree = small_side(category_main_slug(categories).join(categories.select("slug", F.lower("audience").alias("row_audience")), "slug"))
    facts = products.select("id", C.compact_text(products).alias("_text"), "normalized_subcategory", *[
        c.cast("int").alias(n) for n, c in (
            ("_s1", or_else(F.col("product_name"), "") != ""), ("_s2", or_else(F.col("description"), "") != ""),
            ("_s3", or_else(F.size("metadata.hashtags"), 0) > 0))])
    rows = proposals.join(facts, "id").join(tree, proposals["category_slug"] == tree["slug"], "left")
    claimed = or_else(F.col("confidence"), 0.0)
    model = F.greatest(F.lit(0.0), F.least(F.lit(1.0), claimed))
    clean = F.transform(F.slice("evidence", 1, 5), lambda e: F.regexp_replace(F.lower(e), "^[ \"'#]+|[ \"'#]+$", ""))
    explicit = F.size(F.filter(clean, lambda e: (e != "") & F.col("_text").contains(e)))
    grounded = F.least(model, 0.70 + F.least(explicit, F.lit(2)) * 0.08 + F.greatest(F.lit(0), F.col("_s1") + F.col("_s2") + F.col("_s3") - 1) * 0.02)
    mismatch = or_else(C.obvious_mismatch(F.col("category_slug"), F.col("normalized_subcategory")), False)
    final = S.half_even(F.bround(F.when(mismatch, F.least(grounded, F.lit(0.55))).otherwise(grounded), 9), 2)
    low = lambda value, reason: F.struct(F.lit(None).cast("string").alias("main_slug"), F.lit(None).cast("string").alias("slug"), value.alias("confidence"), F.lit(reason).alias("reason"))
    audience = F.nullif(F.lower(or_else(F.col("audience"), "")), F.lit(""))
    verdict = (
        F.when(F.col("category_slug").isNull(), low(F.least(F.when(claimed == 0, 0.35).otherwise(claimed), F.lit(0.79)), "insufficient information"))
        .when(F.col("slug").isNull() | (F.col("category_slug") == "uncategorized"), low(F.lit(0.25), "category does not exist in taxonomy"))
        .when(or_else(F.col("main_category_slug"), "").isin("") == False, F.when(  # noqa: E712
            F.col("main_category_slug") != or_else(F.col("main_slug"), ""), low(F.lit(0.25), "subcategory does not belong to claimed main category"))))
    agreed = F.struct(F.col("main_slug"), F.col("category_slug").alias("slug"), final.alias("confidence"), F.when(
        mismatch, "proposal contradicted strong stored evidence").otherwise(or_else(X.first_filled(F.col("reason")), "metadata classification")).alias("reason"))
    contradicts = or_else(audience != F.col("row_audience"), False)
    outcome = F.coalesce(verdict, F.when(contradicts, low(F.lit(0.35), "audience contradicts taxonomy")).otherwise(agreed))
    return rows.select("id", outcome.alias("o")).select("id", "o.*")


def parent_fallback(proposals: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, category_id, confidence): an unknown id goes to the first root, a weak proposal to its parent."""
    known = small_side(categories.select(F.col("id").alias("category_id"), "parent_id", F.lit(True).alias("_known")))
    first_root = categories.where("parent_id IS NULL").agg(F.min("id").alias("r")).select("r").scalar()
    rows = proposals.join(known, "category_id", "left").withColumn("_root", first_root)
    known_id = F.col("_known").isNotNull()
    confidence = F.when(known_id, F.col("confidence")).otherwise(F.least(F.col("confidence"), F.lit(0.69)))
    target = F.when(~known_id, F.col("_root")).when(confidence < 0.7, F.coalesce("parent_id", "category_id")).otherwise(F.col("category_id"))
    return rows.select("id", target.alias("category_id"), F.bround(F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0))), 4).alias("confidence"))


def context_fingerprint(products: DataFrame, taxonomy_version: str) -> DataFrame:
    """(id, fingerprint): sha256 over what a model would be shown and the taxonomy version.

    The parts are set apart by a unit separator; a missing part is a null sign, so it differs from an empty one.
    """
    m = F.col("metadata")
    parts = [
        X.first_filled(F.col("product_name"), F.col("item_name")), F.col("brand_name"), X.first_filled(m["caption"], m["post_text"], F.col("description")),
        F.col("source_hashtag"), m["alt_text"], F.col("price").cast("decimal(18,4)"), F.col("category_id"), F.lit(taxonomy_version)]
    context = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1a")) for p in parts])
    return products.select("id", F.sha2(context, 256).alias("fingerprint"))


def reuse_proposals(fingerprints: DataFrame, cached: DataFrame) -> DataFrame:
    """Mark products whose context is unchanged since a stored proposal."""
    return fingerprints.join(cached.select("id", F.col("fingerprint").alias("_f")), "id", "left").select(
        "id", "fingerprint", F.col("fingerprint").eqNullSafe(F.col("_f")).alias("cache_hit"))


# ---------------------------------------------------------------- reclassification


def reclassify_catalog(products: DataFrame, categories: DataFrame, **scope) -> DataFrame:
    """One row per product in scope with ``action`` and the values an update would write."""
    rows = attach_category_slug(reclassify_scope(products, **scope), categories, "old_slug")
    rows = C.with_classification(rows)
    rows = rows.withColumn("suggested", C.suggested_name(C.display_name(rows), F.col("cls_text")))
    target = small_side(categories.select(F.col("slug").alias("new_slug"), F.col("id").alias("new_category_id")))
    rows = rows.withColumn("new_slug", F.col("decision.category_slug")).join(target, "new_slug", "left")
    sure = F.col("new_slug").isNotNull() & (F.col("decision.confidence") >= S.CONFIDENCE_FLOOR)
    settled = (F.col("old_slug") == F.col("new_slug")) & S.is_confident(F.col("classifier_confidence")) & F.lit(not scope.get("force", False))
    action = (F.when(F.col("non_product"), "MARK_NON_PRODUCT").when(~sure, "LEAVE").when(F.col("new_category_id").isNull(), "MIGRATION_REQUIRED")
              .when(or_else(settled, False), "ALREADY_CORRECT").otherwise("UPDATE"))
    main = F.col("decision.main_slug")
    return rows.select(
        "id", action.alias("action"), "new_category_id", main.alias("new_main"), "new_slug", F.when(main.isin(*C.AUDIENCES), F.upper(main)).alias("new_audience"),
        F.col("decision.confidence").alias("new_confidence"), F.col("decision.source").alias("new_source"),
        F.when(F.col("suggested.confidence") >= 0.80, F.col("suggested.name")).alias("new_name"))


def apply_reclassification(products: DataFrame, actions: DataFrame) -> DataFrame:
    """The catalog after the actions; products out of scope are untouched."""
    side = actions.where(F.col("action").isin("UPDATE", "MARK_NON_PRODUCT"))
    rows = products.join(side, "id", "left")
    update, retire = or_else(F.col("action") == "UPDATE", False), or_else(F.col("action") == "MARK_NON_PRODUCT", False)
    put = lambda old, new: F.when(update, F.col(new)).otherwise(F.col(old))
    rows = rows.withColumns({
        "category_id": put("category_id", "new_category_id"), "normalized_main_category": put("normalized_main_category", "new_main"),
        "normalized_subcategory": put("normalized_subcategory", "new_slug"), "audience": put("audience", "new_audience"),
        "classifier_confidence": put("classifier_confidence", "new_confidence"),
        "classification_source": F.when(retire, "metadata").otherwise(put("classification_source", "new_source")),
        "catalog_status": F.when(retire, "NON_PRODUCT").otherwise(F.col("catalog_status")),
        "product_name": F.when(update, F.coalesce("new_name", "product_name")).otherwise(F.col("product_name"))})
    return rows.select(*products.columns)
