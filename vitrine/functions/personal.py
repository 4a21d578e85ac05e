"""How well a product matches a user's stored preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import join_words, or_else

PERSONALIZATION_WEIGHT = 0.10


def personalization_match(p, prefs) -> Column:
    """Mean of the preference signals that apply: saved brand, categories, styles, colours, gender, price."""
    hay = F.lower(join_words([p["category"], p["subcategory"], p["normalized_main_category"], p["normalized_subcategory"],
                              p["description"], p["product_name"], p["audience"]]))

    def any_in(values: Column) -> Column:
        hit = F.exists(values, lambda v: hay.contains(F.lower(v)))
        return F.when(or_else(F.size(values), 0) > 0, hit.cast("double"))

    gender = F.nullif(prefs["gender_preference"], F.lit(""))
    bounded = p["price"].isNotNull() & (prefs["min_price"].isNotNull() | prefs["max_price"].isNotNull())
    in_range = or_else(p["price"] >= prefs["min_price"], True) & or_else(p["price"] <= prefs["max_price"], True)
    signals = F.array_compact(F.array(
        F.when(or_else(F.array_contains(prefs["saved_brand_ids"], p["brand_id"]), False), 1.0),
        any_in(prefs["favourite_categories"]),
        any_in(prefs["preferred_styles"]),
        any_in(prefs["preferred_colours"]),
        F.when(gender.isNotNull(), (hay.contains(F.lower(gender)) | hay.contains("unisex")).cast("double")),
        F.when(bounded, in_range.cast("double")),
    ))
    total = F.aggregate(signals, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(signals) > 0, total / F.size(signals)).otherwise(0.0)


def blend_personal(score: Column, match: Column, weight: float = PERSONALIZATION_WEIGHT) -> Column:
    return F.lit(1.0 - weight) * score + F.lit(weight) * match


def personalized_discovery(gem: Column, text: Column, prefs, brand_id: Column) -> Column:
    """struct(score, matched): gem score plus up to 12 points, three per match; a saved brand counts twice."""
    terms = F.concat(*[or_else_array(prefs[c]) for c in ("preferred_styles", "favourite_categories", "preferred_colours")])
    named = F.size(F.filter(terms, lambda v: (v != "") & F.lower(text).contains(F.lower(v))))
    saved = F.when(or_else(F.array_contains(prefs["saved_brand_ids"], brand_id), False), 2).otherwise(0)
    matches = named + saved
    score = F.bround(F.least(F.lit(100.0), gem + F.least(F.lit(12), matches * 3)).cast("double"), 2)
    return F.struct(score.alias("score"), (matches > 0).alias("matched"))


def or_else_array(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))
