"""Search logs, ingestion runs, user activity, brand lists and category pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.functions.text import any_of, or_else
from vitrine.operators.discovery import nearest_ranks
from vitrine.operators.filters import is_not_non_product
from vitrine.operators.topk import BestPerQuery
from vitrine.session import cut_lineage

#: Brands of a block when brands are compared, and numbers of a dense part at most.
TARGET_BLOCK, BRAND_BLOCK, DENSE_CELLS = 4_096, 20_000, 4_000_000

# The outcome classes, review thresholds and candidate words.
SUCCESS_OUTCOMES, FAILURE_OUTCOMES = ("INSERTED", "UPDATED"), ("FAILED_IMAGE",)
APPROVE_SCORE, REVIEW_SCORE = 80, 60
REJECT_TERMS = ("meme", "influencer", "fanpage", "quotes", "aggregator", "giveaway only")
COMMERCE_TERMS = ("shop", "store", "shipping", "order", "collection", "label", "brand", "handmade")
CATEGORY_SEEDS = {
    "kurtas": ("KurtaBrandIndia", "ContemporaryEthnicWear", "TrendyKurtiBrand"),
    "ethnic": ("IndianFashionBrand", "ContemporaryEthnicWear", "IndependentClothingIndia"),
    "tops": ("CropTopBrandIndia", "GoingOutTops", "IndieFashionIndia"),
    "streetwear": ("WomenStreetwearIndia", "IndependentClothingIndia"),
    "jewellery": ("MinimalJewelleryIndia", "StatementJewelleryIndia"),
    "bags": ("IndependentBagBrandIndia", "IndianFashionBrand"),
}


def search_analytics(log: DataFrame, top_n: int = 20) -> DataFrame:
    """(section, key, value): totals, cache-hit rate, top and zero-result queries, exact p50 and p95 latency."""
    totals = log.agg(F.count("*").cast("double").alias("total_queries"), F.bround(F.avg(F.col("cache_hit").cast("double")), 9).alias("cache_hit_rate"))
    rows = totals.unpivot([], totals.columns, "key", "value").select(F.lit("summary").alias("section"), "key", "value")
    ranks = nearest_ranks(log, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}).select(F.lit("summary").alias("section"), F.col("name").alias("key"), "value")
    counts = log.groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("result_count") == 0).alias("z"))
    top = lambda column, section: counts.where(F.col(column) > 0).orderBy(F.desc(column), "query").limit(top_n).select(
        F.lit(section).alias("section"), F.col("query").alias("key"), F.col(column).cast("double").alias("value"))
    return rows.unionByName(ranks).unionByName(top("n", "top_queries")).unionByName(top("z", "zero_result_queries"))


def ingestion_runs(audit: DataFrame) -> DataFrame:
    """Per batch: first and last time, products added, failures, outcome counts. A batch without times is left out."""
    outcome = or_else(X.first_filled(F.col("outcome")), "UNKNOWN")
    cells = audit.groupBy("batch", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return cells.groupBy(F.col("batch").alias("batch_id")).agg(
        F.min("lo").alias("started_at"), F.max("hi").alias("finished_at"),
        or_else(F.sum(F.when(F.col("outcome").isin(*SUCCESS_OUTCOMES), F.col("n"))), 0).alias("products_added"),
        or_else(F.sum(F.when(F.col("outcome").isin(*FAILURE_OUTCOMES), F.col("n"))), 0).alias("failures"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"),
    ).where("started_at IS NOT NULL").orderBy(F.desc("finished_at"), "batch_id")


def stale_brands(brands: DataFrame, products: DataFrame, now: Column, stale_days: int) -> DataFrame:
    """Brands not refreshed for ``stale_days`` whole days or never; never first, then the oldest."""
    last = products.where("brand_id IS NOT NULL").groupBy("brand_id").agg(F.max(F.coalesce("scraped_at", "created_at")).alias("last_refresh"))
    rows = brands.select(F.col("id").alias("brand_id"), X.first_filled(F.col("name"), F.col("brand_name")).alias("brand"), "instagram_username").join(last, "brand_id", "left")
    rows = rows.withColumn("age_days", F.when(F.col("last_refresh").isNotNull(), S.floor_days(now, F.col("last_refresh"))))
    status = F.when(F.col("age_days").isNull(), "NEVER_REFRESHED").otherwise("STALE")
    return rows.where(F.col("age_days").isNull() | (F.col("age_days") >= stale_days)).withColumn("status", status).orderBy(
        F.desc(F.col("age_days").isNull()), F.desc("age_days"), "brand_id")


def batch_quality(posts: DataFrame, existing: DataFrame) -> DataFrame:
    """Per brand handle: ingestion score 0-100 and APPROVE / REVIEW / SKIP. ``posts`` carry handle and product_post."""
    known = existing.select("handle").distinct().withColumn("_known", F.lit(True))
    stats = posts.groupBy("handle").agg(
        F.count("*").alias("posts"), F.count_if("product_post").alias("product_posts"),
        F.count_if(F.col("product_post") & (or_else(F.col("image_url"), "") != "")).alias("with_image"),
        F.max((or_else(F.col("source_hashtag"), "") != "").cast("int")).alias("categorised"), F.max("niche_score").alias("niche"))
    rows = stats.join(known, "handle", "left")
    c, one = F.col, lambda condition: F.when(condition, 1).otherwise(0)
    ratio = c("product_posts") / F.greatest(F.lit(1), c("posts"))
    usable = c("with_image") / F.greatest(F.lit(1), c("product_posts"))
    score = (15 * one(c("posts") > 0) + 15 * one(c("product_posts") > 0) + 15 * ratio + 10 * one(c("posts") > 0) + 15 * usable + 10 * c("categorised")
             + 10 * F.least(F.lit(1.0), c("product_posts") / 10) + 5 * F.when(c("_known"), 0).otherwise(1) + 5 * S.clamp01(c("niche")))
    rows = rows.withColumn("score", S.half_even(F.bround(score, 9)).cast("int"))
    verdict = F.when(c("score") >= APPROVE_SCORE, "APPROVE").when(c("score") >= REVIEW_SCORE, "REVIEW").otherwise("SKIP")
    return rows.select("handle", "posts", "product_posts", "score", verdict.alias("recommendation"))


def brand_candidate_score(candidates: DataFrame, category: str) -> DataFrame:
    """Score brand candidates by commerce, category, activity and handle signals; reject words give zero."""
    text = F.lower(X.join_words([F.col(c) for c in ("name", "handle", "bio", "recent_posts")]))
    letters = F.regexp_replace(text, "[^a-z]", "")
    relevant = X.contains_text(text, category.lower().replace("-", " ")) | X.contains_text(letters, *[s.lower() for s in CATEGORY_SEEDS.get(category, ())])
    handle_ok = F.regexp_replace(F.regexp_replace(or_else(F.col("handle"), ""), "^@+", ""), "[._]", "").rlike(r"^[\p{L}\p{N}]+$")
    points = lambda condition, w: F.when(condition, w).otherwise(0.0)
    raw = points(X.contains_text(text, *COMMERCE_TERMS), 0.35) + points(relevant, 0.25) + points(or_else(F.col("recent_activity"), False), 0.2) + points(handle_ok, 0.2)
    rejected = X.contains_text(text, *REJECT_TERMS)
    score = S.half_even(F.when(rejected, 0.0).otherwise(raw), 2)
    return candidates.withColumns({"confidence": score, "relevant": relevant}).withColumn("accepted", F.col("confidence") >= 0.6)


def dedupe_candidates(candidates: DataFrame, order_col: str) -> DataFrame:
    key = F.regexp_replace(F.lower(X.strip(or_else(X.first_filled(F.col("handle"), F.col("name")), ""))), "^@+", "")
    keyed = candidates.withColumn("_key", key).where("_key <> ''")
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(order_col))).where("_n = 1").drop("_key", "_n")


def similar_brands(targets: DataFrame, brands: DataFrame, products: DataFrame, limit: int = 8, block: int = TARGET_BLOCK) -> DataFrame:
    """(target_id, brand_id, similarity_score, position) for a batch of target brands.

    .65 x products in the target's categories per target category + .35 x closeness of the mean niche score. Targets and
    brands are dealt into blocks, and every block of targets meets every block of brands in one task, which multiplies
    sparse category counts and keeps ``limit`` per target: brand pairs are never rows, and only two counts reach the driver.
    """
    cells = products.where("brand_id IS NOT NULL").groupBy("brand_id", "category_id").agg(F.count("*").alias("n"), F.sum(or_else(F.col("niche_score"), 0.0)).alias("s"))
    stats = cut_lineage(cells.groupBy("brand_id").agg(
        F.collect_list(F.when(F.col("category_id").isNotNull(), F.struct(F.col("category_id").cast("bigint").alias("category_id"), "n"))).alias("cats"),
        F.bround(F.sum("s") / F.sum("n"), 12).alias("niche")))
    asked = cut_lineage(stats.join(targets.select(F.col("id").alias("brand_id")).distinct(), "brand_id", "left_semi"))
    blocks = lambda df, rows: max(1, -(-df.count() // rows))
    target_blocks, brand_blocks = blocks(asked, block), blocks(stats, BRAND_BLOCK)
    spread = lambda n: F.pmod(F.xxhash64("brand_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(spread(target_blocks).alias("tb"), every(brand_blocks).alias("bb"), "brand_id", "cats", "niche")
    right = stats.select(spread(brand_blocks).alias("bb"), every(target_blocks).alias("tb"), "brand_id", "cats", "niche")
    met = left.groupBy("tb", "bb").cogroup(right.select("tb", "bb", "brand_id", "cats", "niche").groupBy("tb", "bb"))
    spot = Window.partitionBy("target_id").orderBy(F.desc("similarity_score"), "brand_id")
    found = met.applyInArrow(lambda asked, known: _similar_in_blocks(asked, known, limit), "target_id string, brand_id string, similarity_score double")
    return found.withColumn("position", F.row_number().over(spot)).where(F.col("position") <= limit)


def _flat_cats(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, category and count of every (brand, category) of a block."""
    lists = table.column("cats").combine_chunks()
    rows = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int))
    flat = lists.flatten()
    return rows, flat.field("category_id").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)


def _similar_in_blocks(asked: pa.Table, known: pa.Table, limit: int) -> pa.Table:
    """Each target's best brands of one block. Dense parts hold at most DENSE_CELLS numbers, whatever the number of categories."""
    targets, names = (np.asarray(t.column("brand_id").to_pylist(), dtype="U") for t in (asked, known))
    best = BestPerQuery(len(targets), limit, -1.0)
    if len(targets) and len(names):
        niches, niche = (t.column("niche").to_numpy().astype(float) for t in (asked, known))
        t_row, t_cat, _ = _flat_cats(asked)
        b_row, b_cat, b_n = _flat_cats(known)
        categories = np.unique(t_cat)
        shared = np.isin(b_cat, categories)
        b_row, b_col, b_n = b_row[shared], np.searchsorted(categories, b_cat[shared]), b_n[shared]
        t_col, per_target = np.searchsorted(categories, t_cat), np.bincount(t_row, minlength=len(targets))
        step = max(1, DENSE_CELLS // max(len(categories), len(targets), 1))
        for low in range(0, len(names), step):
            high = min(low + step, len(names))
            mine = (b_row >= low) & (b_row < high)
            counts = np.zeros((high - low, max(1, len(categories))))
            counts[b_row[mine] - low, b_col[mine]] = b_n[mine]
            for first in range(0, len(targets), step):
                last = min(first + step, len(targets))
                own = (t_row >= first) & (t_row < last)
                weights = np.zeros((last - first, counts.shape[1]))
                weights[t_row[own] - first, t_col[own]] = 1.0 / per_target[t_row[own]]
                near = 1 - np.minimum(1.0, np.abs(niche[low:high, None] - niches[None, first:last]))
                scores = np.round(0.65 * (counts @ weights.T) + 0.35 * near, 9)
                scores[names[low:high, None] == targets[None, first:last]] = -np.inf
                best.offer(scores, first, names[low:high])
    found = best.batch(targets)
    return pa.Table.from_arrays(found.columns, names=["target_id", "brand_id", "similarity_score"])


# ---------------------------------------------------------------- user activity


def last_n_interactions(interactions: DataFrame, n: int = 200) -> DataFrame:
    spot = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return interactions.withColumn("recency", F.row_number().over(spot)).where(F.col("recency") <= n)


def interaction_category_counts(interactions: DataFrame, products: DataFrame) -> DataFrame:
    named = products.select(F.col("id").alias("product_id"), "category").where("category IS NOT NULL")
    return interactions.join(named, "product_id").groupBy("user_id", "category").agg(F.count("*").alias("interactions"))


def for_you_rail(interactions: DataFrame, products: DataFrame, fallback: DataFrame, limit: int = 8) -> DataFrame:
    """(user_id, label, id, position): products of the user's last category, else the fallback rail.

    The first ``limit`` products of every category are found once and joined to the users.
    """
    named = products.select(F.col("id").alias("product_id"), "category").where("category IS NOT NULL")
    last = interactions.join(named, "product_id").groupBy("user_id").agg(F.max_by("category", F.struct("ts", "event_id")).alias("label"))
    users = interactions.select("user_id").distinct().join(last, "user_id", "left")
    spot = Window.partitionBy("category").orderBy(F.col("id").try_cast("long"), "id")
    heads = products.where("category IS NOT NULL").select(F.col("category").alias("label"), "id", F.row_number().over(spot).alias("position")).where(F.col("position") <= limit)
    own = users.where("label IS NOT NULL").join(heads, "label").select("user_id", "label", "id", "position")
    short = fallback.where(F.col("position") <= limit).agg(F.sort_array(F.collect_list(F.struct("position", "id"))).alias("f")).select("f").scalar()
    rest = users.where("label IS NULL").select("user_id", "label", F.explode(short).alias("f"))
    return own.unionByName(rest.select("user_id", "label", "f.id", "f.position"))


# ---------------------------------------------------------------- lists and pages


def list_brands(brands: DataFrame, *, query: str | None = None, limit: int = 48, offset: int = 0) -> DataFrame:
    """A page of brands by niche score and followers, with the total number of matches."""
    rows = brands
    if query and query.strip():
        rows = rows.where(X.contains_text(F.lower(F.concat_ws(" ", "name", "instagram_username", "category")), query.strip().lower()))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc(or_else(F.col("niche_score"), 0.0)), F.desc(or_else(F.col("followers"), 0)), "id").offset(max(0, offset)).limit(max(1, min(limit, 100)))
    return page.withColumn("total", total.select("total").scalar())


def list_products(products: DataFrame, *, limit: int = 64, offset: int = 0, brand_id: str | None = None) -> DataFrame:
    """A page of products, NON_PRODUCT rows left out, newest first, with has_more."""
    size = max(1, min(limit, 100))
    rows = products.where(F.col("brand_id") == brand_id) if brand_id else products
    page = rows.orderBy(F.col("id").try_cast("long"), "id").offset(max(0, offset)).limit(size)
    full = page.agg((F.count("*") == size).alias("m")).select("m").scalar()
    return page.where(is_not_non_product(F.col("catalog_status"))).withColumn("has_more", full).orderBy(F.desc_nulls_last("scraped_at"), "id")


def category_page(products: DataFrame, terms: list[str], sort: str = "newest") -> DataFrame:
    """Products of a category page holding one of the type terms, newest / most liked / best gem score first."""
    text = F.lower(X.join_words([F.col("product_name"), F.col("description"), F.col("subcategory")]))
    order = {"newest": F.desc_nulls_last("scraped_at"), "popularity": F.desc("likes_count"), "gem": F.desc("gem_score")}[sort]
    return (products.where(any_of([text.contains(t) for t in terms])) if terms else products).orderBy(order, "id")
