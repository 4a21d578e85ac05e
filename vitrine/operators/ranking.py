"""Ranking of candidates: the weighted ranker for text and image search, and the structured reranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.functions.personal import blend_personal
from vitrine.functions.text import or_else
from vitrine.operators.fusion import minmax
from vitrine.taxonomy import Taxonomy

# The signal weights.
TEXT_WEIGHTS = {
    "semantic_similarity": 0.22, "text_match": 0.08, "category_match": 0.12, "product_family_match": 0.22,
    "product_type_match": 0.20, "colour_match": 0.06, "style_match": 0.04, "fit_match": 0.02,
    "gender_match": 0.02, "niche_score": 0.02,
}
IMAGE_WEIGHTS = {
    "visual_similarity": 0.72, "category_match": 0.09, "product_type_match": 0.06, "colour_match": 0.03,
    "style_match": 0.03, "gender_match": 0.02, "niche_score": 0.05,
}
RERANK_WEIGHTS = {
    "fused": 0.35, "type": 0.25, "audience": 0.20, "audience_mismatch": 0.60, "colour": 0.08, "style": 0.05,
    "price": 0.05, "confidence": 0.02,
}
RERANK_SIGNALS = ("fused", "type", "audience", "colour", "style", "price", "confidence")
TEXT_COLUMNS = (
    "product_name", "item_name", "description", "category", "subcategory", "normalized_main_category",
    "normalized_subcategory", "audience", "category_audience",
)
METADATA_FIELDS = ("colour", "color", "style", "fit", "primary_colour", "secondary_colours", "product_type")
#: What the rankers read out of a product's text; it depends on the product alone.
FEATURES = ("_hay", "_aud", "_genders", "_categories", "_types", "_families", "_full", "_full_types", "_full_families")


def completed(df: DataFrame) -> DataFrame:
    """Add the columns a retriever did not return as nulls."""
    add = {c: F.lit(None).cast("string") for c in TEXT_COLUMNS if c not in df.columns}
    if "metadata" not in df.columns:
        lists = ("style", "secondary_colours")
        add["metadata"] = F.struct(*[
            F.lit(None).cast("array<string>" if f in lists else "string").alias(f) for f in METADATA_FIELDS])
    if "classifier_confidence" not in df.columns:
        add["classifier_confidence"] = F.lit(None).cast("double")
    return df.withColumns(add) if add else df


def with_text_features(df: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Read each row's text once: ``FEATURES``. Candidates that carry them already keep them."""
    df = completed(df)
    if all(c in df.columns for c in FEATURES):
        return df
    df = df.withColumns({
        "_hay": X.product_search_text(df), "_full": X.rerank_haystack(df),
        "_aud": X.audience_text(df),
    })
    words = F.lower(X.join_words([F.col(c) for c in ("category", "subcategory", "normalized_main_category", "normalized_subcategory")]))
    return df.withColumns({
        "_genders": X.named_genders(F.col("_aud")), "_categories": X.category_families(words, taxonomy),
        "_types": X.matched_types(F.col("_hay"), taxonomy), "_families": X.matched_families(F.col("_hay"), taxonomy),
        "_full_types": X.matched_types(F.col("_full"), taxonomy), "_full_families": X.matched_families(F.col("_full"), taxonomy),
    })


def described_hits(hits: DataFrame, products: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Hits with the columns and text features of their products.

    A product is a candidate of many queries, so its text is read before the join, and only if it was hit. ``hits`` is
    read twice: it should be stored (``cut_lineage``).
    """
    found = products.join(hits.select("id").distinct(), "id", "left_semi")
    return hits.join(with_text_features(found, taxonomy).select(*products.columns, *FEATURES), "id")


def _flag(unset: Column, matched: Column) -> Column:
    return F.when(unset, 0.5).when(or_else(matched, False), 1.0).otherwise(0.0)


def ranking_signals(df: DataFrame, taxonomy: Taxonomy, category_id: Column, image: bool) -> DataFrame:
    """Add ``score_breakdown``, one field per signal."""
    a, hay = df["attributes"], F.col("_hay")
    similarity = or_else(df["similarity"], 0.0)
    signals = {
        "category_match": X.category_match_score(df["category_id"], F.col("_categories"), a["product_family"], category_id),
        "product_family_match": _flag(a["product_family"].isNull(), F.array_contains("_families", a["product_family"])),
        "product_type_match": _flag(a["product_type"].isNull(), F.array_contains("_types", a["product_type"])),
        "colour_match": X.phrase_match_score(hay, a["colours"]),
        "style_match": X.phrase_match_score(hay, F.concat(a["styles"], a["aesthetic_terms"])),
        "fit_match": X.phrase_match_score(hay, a["fits"]),
        "gender_match": X.gender_match_score(F.col("_aud"), a["gender"], F.col("_genders")),
        "niche_score": or_else(S.clamp01(df["niche_score"]), 0.0),
    }
    if image:
        signals["visual_similarity"] = similarity
    else:
        signals["semantic_similarity"] = similarity
        signals["text_match"] = X.lexical_token_score(hay, a["query_tokens"])
    return df.withColumn("score_breakdown", F.struct(*[c.alias(n) for n, c in signals.items()]))


def weighted_score(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(f"score_breakdown.{name}")
    return S.half_even(total, 12)


def _survivors(df: DataFrame, requested: Column, signal: str) -> DataFrame:
    """Keep matching rows of the queries that ask for the attribute, unless none of their rows match."""
    hit = F.col(f"score_breakdown.{signal}") > 0
    any_hit = F.max(hit.cast("int")).over(Window.partitionBy("qid")) == 1
    return df.withColumn("_any", any_hit).where(requested.isNull() | hit | ~F.col("_any")).drop("_any")


def score_text(candidates: DataFrame, taxonomy: Taxonomy, *, personal_match: Column | None = None, keep_features: bool = False) -> DataFrame:
    """Score text-search candidates and apply the family, type and gender gates, in that order.

    ``candidates`` holds product columns, qid, similarity, ``attributes`` and ``requested_category_id``.
    The family gate always applies; type and gender narrow only a query that keeps some row.
    """
    rows = ranking_signals(with_text_features(candidates, taxonomy), taxonomy, F.col("requested_category_id"), image=False)
    score = weighted_score(TEXT_WEIGHTS)
    if personal_match is not None:
        score = blend_personal(score, personal_match)
    rows = rows.withColumn("final_score", score)
    family = F.col("attributes.product_family")
    rows = rows.where(family.isNull() | (F.col("score_breakdown.product_family_match") > 0))
    rows = _survivors(rows, F.col("attributes.product_type"), "product_type_match")
    rows = _survivors(rows, F.col("attributes.gender"), "gender_match")
    return rows if keep_features else rows.drop(*[c for c in FEATURES if c not in ("_hay", "_types")])


def dominant_category(candidates: DataFrame, leading: int = 10, floor: int = 3) -> DataFrame:
    """(qid, dominant_category): the most frequent category of the leading rows when it is frequent enough."""
    lead = candidates.where(F.col("rank") <= leading)
    size = lead.groupBy("qid").agg(F.count("*").alias("n_lead"))
    counts = lead.where("category_id IS NOT NULL").groupBy("qid", "category_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    spot = Window.partitionBy("qid").orderBy(F.desc("n"), "first_rank")
    top = counts.withColumn("_spot", F.row_number().over(spot)).where("_spot = 1")
    return top.join(size, "qid").where(F.col("n") >= F.greatest(F.lit(floor), F.floor(F.col("n_lead") / 2))).select(
        "qid", F.col("category_id").alias("dominant_category"))


def score_image(candidates: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Score image-search candidates: no gates; without a requested category the dominant one is used."""
    rows = candidates.join(dominant_category(candidates), "qid", "left")
    category = F.coalesce("requested_category_id", "dominant_category")
    rows = ranking_signals(with_text_features(rows, taxonomy), taxonomy, category, image=True)
    return rows.withColumn("final_score", weighted_score(IMAGE_WEIGHTS)).drop(*[c for c in FEATURES if c not in ("_hay", "_types")])


def structured_rerank(candidates: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Seven transparent signals; an unset attribute adds nothing, the wrong audience subtracts."""
    df = with_text_features(candidates, taxonomy)
    a = df["attributes"]
    df = df.withColumn("_fused", minmax(or_else(df["similarity"], 0.0)))
    audience = X.audience_signal(F.col("_aud"), a["gender"])
    signals = {
        "fused": F.col("_fused"),
        "type": X.type_signal(F.col("_full_types"), F.col("_full_families"), a["product_type"], a["product_family"]),
        "audience": audience,
        "colour": X.phrase_match_score(F.col("_full"), a["colours"], 0.0),
        "style": X.phrase_match_score(F.col("_full"), F.concat(a["styles"], a["fits"], a["aesthetic_terms"]), 0.0),
        "price": S.price_signal(df["price"], a["min_price"], a["max_price"]),
        "confidence": S.confidence_signal(df["classifier_confidence"]),
    }
    df = df.withColumn("rerank_detail", F.struct(*[c.alias(n) for n, c in signals.items()]))
    w = RERANK_WEIGHTS

    def contribution(name: str) -> Column:
        value = F.col(f"rerank_detail.{name}")
        if name == "audience":
            return F.when(value >= 0, F.lit(w["audience"]) * value).otherwise(-w["audience_mismatch"])
        return F.lit(w[name]) * value

    df = df.withColumn("score_breakdown", F.struct(*[contribution(n).alias(n) for n in RERANK_SIGNALS]))
    total = F.lit(0.0)
    for n in RERANK_SIGNALS:
        total = total + F.col(f"score_breakdown.{n}")
    return df.withColumn("final_score", S.half_even(total, 12)).drop(*FEATURES, "_fused")


def gated_rerank(candidates: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """The weighted ranker decides who survives; the structured reranker decides their order."""
    survivors = score_text(candidates, taxonomy, keep_features=True).drop("score_breakdown", "final_score")
    return structured_rerank(survivors, taxonomy)


SORT_MODES = ("score", "newest", "popular", "price_asc", "price_desc", "niche_score")


def sort_columns(mode: str | None = "score", order_col: str = "id") -> list[Column]:
    """Order-by columns of a sort mode; near-equal scores and equal values fall back to ``order_col``."""
    c = F.col
    leading = {
        "score": [F.desc(S.rank_bucket(c("final_score")))],
        "newest": [F.desc_nulls_last("scraped_at")],
        "popular": [F.desc(S.engagement_score(c("likes_count"), c("comments_count")))],
        "price_asc": [F.asc_nulls_last("price")],
        "price_desc": [F.desc(F.when(or_else(c("price"), 0.0) == 0, -1.0).otherwise(c("price")))],
        "niche_score": [F.desc(or_else(c("niche_score"), 0.0))],
    }
    return [*leading[mode or "score"], F.asc(order_col)]


def rank_results(scored: DataFrame, mode: str | None = "score", limit: int | None = None) -> DataFrame:
    """Add the 1-based ``position`` within each query and keep the first ``limit`` rows."""
    position = F.row_number().over(Window.partitionBy("qid").orderBy(*sort_columns(mode)))
    ranked = scored.withColumn("position", position)
    return ranked if limit is None else ranked.where(F.col("position") <= limit)


def split_groups(results: DataFrame, taxonomy: Taxonomy, exact_limit: int = 8) -> DataFrame:
    """Add ``group`` (best / more) and ``group_position``: exact-type rows first, then the alternatives."""
    rows = results if "_types" in results.columns else with_text_features(results, taxonomy)
    kind = F.col("attributes.product_type")
    exact = kind.isNull() | or_else(F.array_contains("_types", kind), False)
    rows = rows.withColumn("_exact", exact)
    nth = F.row_number().over(Window.partitionBy("qid", "_exact").orderBy("position"))
    rows = rows.withColumn("_nth", nth)
    group = F.when(F.col("_exact") & (F.col("_nth") <= exact_limit), "best").otherwise("more")
    rows = rows.withColumn("group", group)
    spot = Window.partitionBy("qid", "group").orderBy(F.desc("_exact"), "position")
    return rows.withColumn("group_position", F.row_number().over(spot)).drop("_exact", "_nth")


def similar_brands_from_results(results: DataFrame, limit: int = 6) -> DataFrame:
    """Per query, the brands behind its results: fields of the best row, match count, best first."""
    name = X.strip(or_else(F.col("brand_name"), ""))
    rows = results.withColumn("_brand", name).where((F.col("_brand") != "") & (F.lower("_brand") != "unknown brand"))
    similarity = or_else(F.col("similarity"), 0.0)
    best = F.struct(
        F.col("brand_id").alias("brand_id"), F.col("brand_follower_count").alias("followers"), F.col("niche_score").alias("niche_score"),
        F.when(or_else(F.col("brand_niche_score"), 0.0) == 0, F.col("niche_score")).otherwise(F.col("brand_niche_score")).alias("brand_niche_score"),
        F.col("id").alias("representative_id"), similarity.alias("similarity"))
    brands = rows.groupBy("qid", F.col("_brand").alias("brand_name")).agg(
        F.max_by(best, F.struct(similarity, -F.col("position"))).alias("b"),
        F.count("*").alias("matched_product_count"), F.min("position").alias("_first"))
    flat = brands.select("qid", "brand_name", "b.*", "matched_product_count", "_first")
    spot = Window.partitionBy("qid").orderBy(F.desc("similarity"), F.desc(or_else(F.col("niche_score"), 0.0)), F.desc("matched_product_count"), "_first")
    return flat.withColumn("brand_position", F.row_number().over(spot)).where(F.col("brand_position") <= limit).drop("_first")
