"""Scoring expressions: prices, images, embeddings, quality, engagement and weighted means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import or_else, strip

# The thresholds and status lists the reports are defined on.
CONFIDENCE_FLOOR = 0.80
MIN_REASONABLE_PRICE = 100.0
MAX_REASONABLE_PRICE = 500_000.0
UNUSABLE_IMAGE = ("BROKEN", "EXPIRED_OR_FORBIDDEN", "INVALID_URL", "RECOVERY_REQUIRED", "UNRECOVERABLE", "MISSING")
UNSTABLE_IMAGE = ("BROKEN", "MISSING", "RECOVERY_REQUIRED", "UNRECOVERABLE")
FLAGGED_IMAGE = ("BROKEN", "EXPIRED_OR_FORBIDDEN", "INVALID_URL", "RECOVERY_REQUIRED", "UNRECOVERABLE")
STOCK_PHOTO_HOST = "unsplash.com"
PUBLIC_STORAGE_PATH = "/storage/v1/object/public/"
PRODUCT_BUCKET = "product-images/"
HTTP_URL = r"^https?://[^/?#]+"
MICROS_PER_DAY = 86_400_000_000


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, the rounding every reported figure uses."""
    return F.bround(value, digits)


def clamp01(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double"))))


# ---------------------------------------------------------------- price and confidence


def price_status(price: Column) -> Column:
    """MISSING / INVALID / SUSPICIOUS / VALID; accepts numbers or text."""
    raw = price.cast("string")
    number = raw.try_cast("double")
    return (
        F.when(raw.isNull() | (raw == ""), "MISSING")
        .when(number.isNull() | (number <= 0), "INVALID")
        .when((number < MIN_REASONABLE_PRICE) | (number > MAX_REASONABLE_PRICE), "SUSPICIOUS")
        .otherwise("VALID")
    )


def price_signal(price: Column, low: Column, high: Column) -> Column:
    """+1 in range, -1 outside, 0 without a range or without a positive price."""
    outside = F.coalesce(price < low, F.lit(False)) | F.coalesce(price > high, F.lit(False))
    return (
        F.when(low.isNull() & high.isNull(), 0.0)
        .when(price.isNull() | (price <= 0), 0.0)
        .when(outside, -1.0)
        .otherwise(1.0)
    )


def confidence_signal(confidence: Column) -> Column:
    return or_else(clamp01(confidence), 0.0)


def is_confident(confidence: Column, floor: float = CONFIDENCE_FLOOR) -> Column:
    return or_else(confidence, 0.0) >= floor


def engagement_score(likes: Column, comments: Column) -> Column:
    return F.least(F.lit(1.0), (or_else(likes, 0) + or_else(comments, 0) * 3) / 10_000)


# ---------------------------------------------------------------- URLs and images


def valid_http_url(url: Column) -> Column:
    return or_else(strip(url).rlike(HTTP_URL), False)


def usable_image(url: Column, status: Column) -> Column:
    return (
        or_else(url.rlike("^https?://"), False)
        & ~or_else(url.contains(STOCK_PHOTO_HOST), False)
        & ~F.upper(or_else(status, "")).isin(*UNUSABLE_IMAGE)
    )


def in_storage(url: Column, base_url: str) -> Column:
    return or_else(url.startswith(base_url.rstrip("/") + PUBLIC_STORAGE_PATH), False)


def in_product_bucket(url: Column, base_url: str) -> Column:
    return or_else(url.startswith(base_url.rstrip("/") + PUBLIC_STORAGE_PATH + PRODUCT_BUCKET), False)


def discovery_stable_image(url: Column, status: Column, base_url: str) -> Column:
    return (
        in_product_bucket(url, base_url)
        & ~url.contains(STOCK_PHOTO_HOST)
        & ~F.upper(or_else(status, "")).isin(*UNSTABLE_IMAGE)
    )


def tile_stable_image(url: Column, status: Column, base_url: str) -> Column:
    return usable_image(url, status) & in_product_bucket(url, base_url)


def training_stable_image(url: Column, status: Column, base_url: str) -> Column:
    return (
        in_storage(url, base_url)
        & url.contains(PUBLIC_STORAGE_PATH + PRODUCT_BUCKET)
        & ~or_else(status, "").isin(*UNUSABLE_IMAGE)
        & ~url.contains(STOCK_PHOTO_HOST)
    )


def image_class(url: Column, base_url: str) -> Column:
    """Offline class of an image URL. Network outcomes are inputs, not something a query fetches."""
    value = strip(or_else(url, ""))
    return (
        F.when(value == "", "MISSING")
        .when(F.lower(value).contains(STOCK_PHOTO_HOST), "STOCK_PHOTO")
        .when(~value.rlike(HTTP_URL), "MALFORMED")
        .when(in_storage(value, base_url), "STABLE_STORAGE")
        .otherwise("EXTERNAL_WORKING")
    )


def image_status(url: Column) -> Column:
    """MISSING / BROKEN / UNKNOWN without touching the network."""
    return (
        F.when(strip(or_else(url, "")) == "", "MISSING")
        .when(~valid_http_url(url), "BROKEN")
        .otherwise("UNKNOWN")
    )


# ---------------------------------------------------------------- embeddings


def parse_embedding(text: Column) -> Column:
    """A "[..]" string as an array of doubles; anything unreadable is an empty array."""
    body = F.regexp_replace(strip(text), r"^\[+|\]+$", "")
    values = F.transform(
        F.filter(F.split(body, ","), lambda v: strip(v) != ""), lambda v: strip(v).try_cast("double"))
    return F.when(F.exists(values, lambda v: v.isNull()), F.array().cast("array<double>")).otherwise(values)


def has_embedding(vector: Column, dim: int) -> Column:
    return or_else(F.size(vector) == dim, False)


def has_embedding_text(text: Column, dim: int) -> Column:
    body = F.regexp_replace(text, r"^[ \[\]]+|[ \[\]]+$", "")
    return or_else((body != "") & (F.size(F.split(body, ",")) == dim), False)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def all_finite(vector: Column) -> Column:
    infinite = float("inf")
    return F.forall(vector, lambda v: ~F.isnan(v) & (v != infinite) & (v != -infinite))


def embedding_status(vector: Column, dim: int, tolerance: float = 0.02) -> Column:
    """struct(exists, dimensions, finite, l2_norm, valid)."""
    n = F.greatest(F.coalesce(F.size(vector), F.lit(0)), F.lit(0))
    finite = (n > 0) & or_else(all_finite(vector), False)
    norm = F.when(finite, l2_norm(vector)).otherwise(0.0)
    return F.struct(
        (n > 0).alias("exists"),
        n.alias("dimensions"),
        finite.alias("finite"),
        half_even(norm, 6).alias("l2_norm"),
        (finite & (n == dim) & (F.abs(norm - 1) <= tolerance)).alias("valid"),
    )


# ---------------------------------------------------------------- means, decay, labels


def weighted_mean_nonnull(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are present; the weights of absent parts drop out."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, w in parts:
        total = total + F.coalesce(value * F.lit(w), F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(weight == 0, 0.0).otherwise(total / weight)


def floor_days(now: Column, then: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(MICROS_PER_DAY))


def time_decay(now: Column, then: Column, tau: float) -> Column:
    age = F.greatest(F.lit(0), floor_days(now, then))
    return F.when(then.isNotNull(), F.exp(-age / F.lit(float(tau))))


def gem_label(score: Column) -> Column:
    return (
        F.when(score >= 90, "Exceptional Gem")
        .when(score >= 80, "Hidden Gem")
        .when(score >= 70, "Worth Discovering")
        .when(score >= 60, "Promising")
    )


def niche_score(followers: Column, normalized_brand: Column) -> Column:
    return (
        F.when(normalized_brand == "unknown_brand", 0.5)
        .when(followers >= 5_000, 1.0)
        .when(followers >= 1_000, 0.8)
        .otherwise(0.75)
    )


def recommendation_reason(quality: Column, uniqueness: Column, niche: Column, personalized: Column) -> Column:
    parts = F.array_compact(F.array(
        F.when(or_else(quality, 0.0) >= 0.8, "strong catalog quality"),
        F.when(or_else(uniqueness, 0.0) >= 0.7, "distinctive style"),
        F.when(niche >= 0.7, "independent-label appeal"),
        F.when(personalized, "matches your saved preferences"),
    ))
    sentence = F.concat(F.lit("Recommended for "), F.array_join(F.slice(parts, 1, 3), " + "), F.lit("."))
    return F.when(F.size(parts) > 0, sentence).otherwise("Worth exploring based on its catalog relevance.")


def catalog_quality_score(p, dim: int) -> Column:
    """0-100 points: name 20, image 20, category 15, brand 15, embedding 20, source URL 5, price 5."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    filled = lambda c: or_else(strip(c.cast("string")) != "", False)
    name = product_name(p)
    return (
        points(name != "", 20)
        + points(valid_http_url(p["image_url"]), 20)
        + points(filled(p["category_id"]), 15)
        + points(filled(p["brand_id"]), 15)
        + points(has_embedding(p["embedding"], dim), 20)
        + points(valid_http_url(source_url(p)), 5)
        + points(price_status(p["price"]).isin("MISSING", "VALID"), 5)
    )


def product_name(p) -> Column:
    """First filled of product_name and item_name, trimmed; '' when neither is."""
    from vitrine.functions.text import first_filled

    return strip(or_else(first_filled(p["product_name"], p["item_name"]), ""))


def source_url(p) -> Column:
    from vitrine.functions.text import first_filled

    return first_filled(p["product_url"], p["source_url"])


def readiness_status(total: Column, image_pct: Column, category_pct: Column, embedding_pct: Column,
                     *, not_ready_min: int, ready_min: int, ready_image: float, ready_category: float,
                     ready_embedding: float) -> Column:
    return (
        F.when((total < not_ready_min) | (image_pct < 50) | (embedding_pct < 50), "NOT_READY")
        .when((total >= ready_min) & (image_pct >= ready_image) & (category_pct >= ready_category)
              & (embedding_pct >= ready_embedding), "READY")
        .otherwise("NEEDS_ATTENTION")
    )


def rank_bucket(score: Column, epsilon: float = 1e-5) -> Column:
    """Scores closer than epsilon share a bucket; sort by bucket descending, then by id."""
    return half_even(or_else(score, 0.0) / F.lit(epsilon)).cast("long")
