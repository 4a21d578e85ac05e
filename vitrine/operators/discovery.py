"""Discovery feeds: gem scores, decayed engagement, diversified rails, brand rails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.functions.personal import personalized_discovery
from vitrine.functions.text import or_else
from vitrine.operators.catalog import order_key
from vitrine.operators.filters import discovery_eligible
from vitrine.operators.sizes import small_side
from vitrine.operators.topk import best_per_query, block_topk
from vitrine.taxonomy import Taxonomy


def nearest_neighbor_similarity(items: DataFrame, group: str) -> DataFrame:
    """(id, nearest_neighbor_similarity): the largest cosine to another product of the same group.

    Blocks of a group meet pairwise, so a group holding a third of the catalog is spread over many tasks.
    """
    rows = items.where("embedding IS NOT NULL").select(
        F.col("id").cast("string"), "embedding", F.col(group).alias("grp"), F.lit(None).cast("bigint").alias("category_id"))
    queries = rows.select(F.col("id").alias("qid"), "embedding", "grp", F.lit(None).cast("array<bigint>").alias("scope"))
    best = best_per_query(block_topk(queries, rows, 1, exclude_self=True), 1)
    return best.select(F.col("qid").alias("id"), F.col("similarity").alias("nearest_neighbor_similarity"))


# The rail sizes and the limits per brand and per family.
RAILS = ("hidden_gems", "trending", "fresh_drops", "new_discoveries", "missed")
BRAND_RAIL_SIZE = 8
MAX_PER_BRAND = 2
MAX_PER_FAMILY = 3
FAMILY_RAILS = {"stylish_tops": ("tops",), "modern_ethnic": ("ethnic-upperwear", "sets")}
EVENT_NAMES = {"save": "save_product", "click": "product_click", "view": "discovery_impression"}
EVENTS = ("save_product", "product_click", "discovery_impression")


def catalog_context(products: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(kind, key, n): products per type, per brand, and in total."""
    kind = X.identify_product(X.discovery_text(products), taxonomy)["type"]
    cells = F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("key")) for n, c in (
        ("type", kind), ("brand", F.nullif(F.col("brand_id"), F.lit(""))), ("total", F.lit("all")))])
    return products.select(F.explode(cells).alias("c")).select("c.*").where("key IS NOT NULL").groupBy("kind", "key").agg(F.count("*").alias("n"))


def decayed_engagement(interactions: DataFrame, now: Column, tau: float = 30.0) -> DataFrame:
    """(id, saves, clicks, impressions, engagement, exposure_boost): event weights decayed by age in whole days."""
    name = F.coalesce(*[F.when(F.col("action") == a, F.lit(n)) for a, n in EVENT_NAMES.items()], F.col("action"))
    weight = or_else(S.time_decay(now, F.col("ts"), tau), 1.0)
    total = lambda event: F.bround(F.sum(F.when(name == event, weight).otherwise(0.0)), 9)
    sums = interactions.where("product_id IS NOT NULL AND product_id <> ''").groupBy(F.col("product_id").alias("id")).agg(
        *[total(e).alias(n) for e, n in zip(EVENTS, ("saves", "clicks", "impressions"))])
    points = F.col("saves") * 3 + F.col("clicks") * 1.5 + F.col("impressions") * 0.15
    return sums.withColumns({
        "engagement": F.when(points > 0, F.least(F.lit(1.0), points / 20)),
        "exposure_boost": 1 / (1 + F.col("impressions"))})


def gem_scores(products: DataFrame, interactions: DataFrame, now: Column, taxonomy: Taxonomy, storage: str, dim: int) -> DataFrame:
    """Every product with its gem score, label, components, family, type, exposure and eligibility.

    Type counts are at most one row per taxonomy type, so they are joined as a broadcast.
    """
    found = X.identify_product(X.discovery_text(products), taxonomy)
    rows = products.withColumn("_product", found).withColumns({
        "product_family": F.col("_product.family"), "product_type": F.col("_product.type")}).drop("_product")
    counts = rows.where("product_type IS NOT NULL").groupBy("product_type").agg(F.count("*").alias("_n_type"))
    total = products.agg(F.count("*").alias("_n")).select("_n").scalar()
    rows = rows.join(small_side(counts), "product_type", "left").join(decayed_engagement(interactions, now), "id", "left")
    url, status = F.col("image_url"), F.col("image_status")
    fields = ("product_name", "brand_id", "category_id", "normalized_subcategory")
    filled = [or_else(F.col(c).cast("string"), "") != "" for c in fields]
    completeness = X.count_of(filled) / len(fields)
    image = F.when(S.discovery_stable_image(url, status, storage), 1.0).when(
        (or_else(url, "") != "") & ~or_else(url.contains(S.STOCK_PHOTO_HOST), False), 0.35).otherwise(0.0)
    embedding = F.when(S.has_embedding(F.col("embedding"), dim), 1.0).otherwise(0.0)
    quality = 0.30 * completeness + 0.25 * S.confidence_signal(F.col("classifier_confidence")) + 0.25 * image + 0.20 * embedding
    crowd = F.greatest(F.lit(0), F.col("_n_type") - 1) / F.greatest(F.lit(20.0), total * 0.08)
    scarcity = F.when(F.col("product_type").isNotNull(), 1 - F.least(F.lit(1.0), crowd)).otherwise(0.35)
    neighbour = F.col("nearest_neighbor_similarity") if "nearest_neighbor_similarity" in products.columns else F.lit(None).cast("double")
    uniqueness = S.weighted_mean_nonnull([(scarcity, 0.6), (S.clamp01(1 - neighbour), 0.4)])
    brand_niche = F.col("brand_niche_score") if "brand_niche_score" in products.columns else F.lit(None).cast("double")
    niche = S.clamp01(F.coalesce(F.nullif("niche_score", F.lit(0.0)), brand_niche))
    freshness = S.time_decay(now, F.coalesce("scraped_at", "created_at"), 120.0)
    rows = rows.withColumns({
        "quality": F.bround(quality, 12), "uniqueness": F.bround(uniqueness, 12), "niche_factor": niche, "freshness": F.bround(freshness, 12),
        "exposure_boost": or_else(F.col("exposure_boost"), 1.0)})
    c = F.col
    base = S.weighted_mean_nonnull([(c("quality"), 0.42), (c("uniqueness"), 0.23), (c("niche_factor"), 0.16), (c("freshness"), 0.12), (c("engagement"), 0.07)])
    score = S.half_even(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base * 100)), 9)).cast("int")
    rows = rows.withColumn("gem_score", score)
    return rows.withColumns({
        "gem_label": S.gem_label(c("gem_score")),
        "recommendation_reason": S.recommendation_reason(c("quality"), c("uniqueness"), c("niche_factor"), F.lit(False)),
        "discovery_eligible": discovery_eligible(rows, c("product_type"), storage, dim),
    }).drop("_n_type")


def personalized_scores(scored: DataFrame, pairs: DataFrame, preferences: DataFrame) -> DataFrame:
    """(user_id, id, personalized_discovery_score, personalization_matched) for the given (user_id, id) pairs."""
    rows = pairs.join(scored, "id").join(preferences, "user_id", "left")
    result = personalized_discovery(F.col("gem_score"), X.discovery_text(rows), rows, F.col("brand_id"))
    return rows.select("user_id", "id", result.alias("p")).select(
        "user_id", "id", F.col("p.score").alias("personalized_discovery_score"), F.col("p.matched").alias("personalization_matched"))


def rail_scores(scored: DataFrame) -> DataFrame:
    """(rail, id, brand, product_family, s1, s2): the order of each eligible product in each of the five rails."""
    c = F.col
    niche = F.when(or_else(c("niche_factor"), 0.0) == 0, 0.5).otherwise(c("niche_factor"))
    fresh, engaged, gem = or_else(c("freshness"), 0.0), or_else(c("engagement"), 0.0), c("gem_score")
    epoch = F.unix_timestamp(F.coalesce("scraped_at", "created_at")).cast("double")
    zero = F.lit(0.0)
    keys = {
        "hidden_gems": (gem * 0.75 + niche * 15 + c("exposure_boost") * 10, zero),
        "trending": (engaged * 50 + fresh * 25 + gem * 0.25, zero),
        "fresh_drops": (fresh, gem.cast("double")),
        "new_discoveries": (or_else(epoch, -1e18), gem.cast("double")),
        "missed": (gem * 0.8 + c("exposure_boost") * 20, zero),
    }
    cells = F.array(*[F.struct(F.lit(r).alias("rail"), F.bround(a, 9).alias("s1"), b.alias("s2")) for r, (a, b) in keys.items()])
    brand = or_else(X.first_filled(c("brand_id"), c("brand_name")), "")
    return scored.where("discovery_eligible").select(
        "id", brand.alias("brand"), or_else(c("product_family"), "uncategorized").alias("product_family"), F.explode(cells).alias("k")
    ).select("k.rail", "id", "brand", "product_family", "k.s1", "k.s2")


def diversify(rails: DataFrame, limit: int, *, seed: str = "", max_per_brand: int = MAX_PER_BRAND, max_per_family: int = MAX_PER_FAMILY) -> DataFrame:
    """(rail, id, position): round-robin over families in a seeded order, with caps per brand and per family.

    Only the first ``max_per_brand`` rows of a (family, brand) can ever be taken: a later one follows a taken
    row or a row skipped because its brand was full, and a full brand stays full. Of those, the first
    2 * limit of a family are enough, because at most ``limit`` rows are taken and the skipped ones belong to
    brands that are full. Both cuts are windows; what is left per rail is families x 2 x limit rows.
    """
    by_brand = Window.partitionBy("rail", "product_family", "brand").orderBy(F.desc("s1"), F.desc("s2"), "id")
    by_family = Window.partitionBy("rail", "product_family").orderBy(F.desc("s1"), F.desc("s2"), "id")
    short = rails.withColumn("_b", F.row_number().over(by_brand)).where(F.col("_b") <= max_per_brand)
    short = short.withColumn("_f", F.row_number().over(by_family)).where(F.col("_f") <= 2 * limit)
    short = short.withColumn("_turn", F.md5(F.concat(F.lit(seed), "product_family"))).select("rail", "id", "brand", "product_family", "_f", "_turn")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_turn", "product_family", "_f"])
        queues = {f: list(zip(g["id"], g["brand"])) for f, g in rows.groupby("product_family", sort=False)}
        taken, per_brand, per_family = [], {}, dict.fromkeys(queues, 0)
        for family_cap in (max_per_family, None):
            moved = True
            while moved and len(taken) < limit:
                moved = False
                for family, queue in queues.items():
                    if len(taken) >= limit:
                        break
                    if family_cap is not None and per_family[family] >= family_cap:
                        continue
                    while queue and per_brand.get(queue[0][1], 0) >= max_per_brand:
                        queue.pop(0)
                    if queue:
                        item, brand = queue.pop(0)
                        taken.append(item)
                        per_brand[brand] = per_brand.get(brand, 0) + 1
                        per_family[family] += 1
                        moved = True
        return pd.DataFrame({"rail": rows["rail"].iloc[0], "id": taken, "position": range(1, len(taken) + 1)})

    return short.groupBy("rail").applyInPandas(pick, "rail string, id string, position int")


def dominant_styles(products: DataFrame, top: int = 3) -> DataFrame:
    """(brand_id, styles): the most used styles of brands with at least five products, each used twice or more."""
    sold = products.where("brand_id IS NOT NULL")
    large = sold.groupBy("brand_id").agg(F.count("*").alias("_n")).where("_n >= 5")
    used = sold.select("brand_id", F.explode("metadata.style").alias("style")).groupBy("brand_id", "style").agg(F.count("*").alias("n"))
    spot = Window.partitionBy("brand_id").orderBy(F.desc("n"), "style")
    kept = used.withColumn("_r", F.row_number().over(spot)).where((F.col("_r") <= top) & (F.col("n") >= 2))
    lists = kept.groupBy("brand_id").agg(F.sort_array(F.collect_list(F.struct("_r", "style"))).alias("s"))
    return lists.join(large, "brand_id", "left_semi").select("brand_id", F.transform("s", lambda x: x["style"]).alias("dominant_styles"))


def brand_gem_scores(brands: DataFrame, scored: DataFrame) -> DataFrame:
    c = F.col
    stats = scored.where("brand_id IS NOT NULL").groupBy("brand_id").agg(
        F.avg("quality").alias("catalog_quality"), F.avg("uniqueness").alias("product_uniqueness"), F.count_if("discovery_eligible").alias("eligible_product_count"),
        F.max(or_else(c("freshness"), 0.0)).alias("freshness"), F.avg(or_else(c("engagement"), 0.0)).alias("engagement"))
    rows = brands.select(c("id").alias("brand_id"), "name", c("niche_score").alias("niche_factor")).join(stats, "brand_id", "left").fillna(0, [
        "catalog_quality", "product_uniqueness", "eligible_product_count", "freshness", "engagement"])
    depth = F.least(F.lit(1.0), c("eligible_product_count") / 8)
    rows = rows.withColumn("catalog_depth", depth)
    raw = S.weighted_mean_nonnull([(c("catalog_quality"), 0.35), (c("product_uniqueness"), 0.2), (c("niche_factor"), 0.2), (c("catalog_depth"), 0.15), (c("freshness"), 0.1)])
    rows = rows.withColumn("gem_score", S.half_even(F.bround(raw * 100, 9)).cast("int"))
    reason = F.when((c("catalog_quality") >= 0.7) & (c("product_uniqueness") >= 0.6), "Independent brand with strong catalog quality and distinctive products.").otherwise(
        "A promising independent label worth watching.")
    rounded = {n: F.bround(n, 4) for n in ("catalog_quality", "product_uniqueness", "catalog_depth", "freshness", "engagement")}
    return rows.withColumns({"gem_label": S.gem_label(c("gem_score")), "recommendation_reason": reason, **rounded})


def brand_rails(scored_brands: DataFrame, *, seed: str = "", size: int = BRAND_RAIL_SIZE) -> DataFrame:
    """(rail, brand_id, position): emerging brands by gem score, then trending ones among the rest."""
    c = F.col
    turn = F.md5(F.concat(F.lit(seed), c("brand_id")))
    enough = scored_brands.where("eligible_product_count >= 2")

    def top(df: DataFrame, rail: str, *order: Column) -> DataFrame:
        first = df.orderBy(*order, turn).limit(size).withColumn("rail", F.lit(rail))
        return first.withColumn("position", F.row_number().over(Window.partitionBy("rail").orderBy(*order, turn))).select("rail", "brand_id", "position")

    emerging = top(enough.where("gem_score >= 60"), "emerging", F.desc("gem_score"), F.desc("freshness"))
    niche = F.when(or_else(c("niche_factor"), 0.0) == 0, 0.5).otherwise(c("niche_factor"))
    trend = F.bround(c("freshness") * 0.35 + c("engagement") * 0.25 + c("catalog_depth") * 0.25 + niche * 0.15, 9)
    rest = enough.join(emerging.select("brand_id"), "brand_id", "left_anti")
    return emerging.unionByName(top(rest, "trending", F.desc(trend)))


def family_rails(scored: DataFrame, rails: dict[str, tuple[str, ...]] | None = None, limit: int = 16) -> DataFrame:
    """(rail, id, position): the first eligible products of each family rail in catalog order."""
    rails = rails or FAMILY_RAILS
    rail = F.coalesce(*[F.when(F.col("product_family").isin(*families), F.lit(name)) for name, families in rails.items()])
    rows = scored.where("discovery_eligible").select("id", rail.alias("rail")).where("rail IS NOT NULL")
    spot = Window.partitionBy("rail").orderBy(order_key(F.col("id")), "id")
    return rows.withColumn("position", F.row_number().over(spot)).where(F.col("position") <= limit)


def discovery_quality(rails: DataFrame, scored: DataFrame) -> DataFrame:
    """Per rail: size, distinct brands and categories, eligible share, duplicate rate."""
    rows = rails.select("rail", "id").join(scored.select("id", "brand_id", "category_id", "discovery_eligible"), "id", "left")
    return rows.groupBy("rail").agg(
        F.count("*").alias("selected"), F.count_distinct("brand_id").alias("brand_diversity"), F.count_distinct("category_id").alias("category_diversity"),
        F.bround(F.avg(F.col("discovery_eligible").cast("double")), 3).alias("eligible_share"), F.bround(1 - F.count_distinct("id") / F.count("*"), 3).alias("duplicate_rate"))


def nearest_ranks(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """(name, value): exact order statistics at index round_half_even(share * (n - 1)).

    Equal values are counted before the shuffle; the distinct values are then numbered inside 4,096 equal
    slices of the value range, so neither the rows nor the distinct values pass through one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    lo, hi, n = (ends.select(x).scalar() for x in ("lo", "hi", "n"))
    slice_no = F.when(hi > lo, F.floor((F.col("v") - lo) / (hi - lo) * 4095)).otherwise(0).cast("int")
    sliced = counts.withColumn("s", slice_no)
    before = sliced.groupBy("s").agg(F.sum("c").alias("m"))
    offset = F.sum("m").over(Window.orderBy("s")) - F.col("m")
    starts = F.broadcast(before.select("s", offset.alias("start")))
    upto = F.sum("c").over(Window.partitionBy("s").orderBy("v"))
    placed = sliced.join(starts, "s").withColumn("last", F.col("start") + upto).withColumn("first", F.col("last") - F.col("c"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), F.bround(F.lit(p) * (n - 1), 0).cast("long").alias("i")) for k, p in shares.items()])
    return placed.withColumn("w", F.explode(wanted)).where((F.col("w.i") >= F.col("first")) & (F.col("w.i") < F.col("last"))).select(F.col("w.name").alias("name"), F.col("v").alias("value"))


def score_distribution(scored: DataFrame, value: str = "gem_score") -> DataFrame:
    """(name, value): count, min, mean, max and nearest-rank percentiles of the scores, and the label counts."""
    ranks = nearest_ranks(scored, value, {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    n = F.col(value).cast("double")
    plain = scored.agg(F.count(value).cast("double").alias("count"), F.min(n).alias("minimum"), F.bround(F.avg(n), 2).alias("mean"), F.max(n).alias("maximum"), F.median(n).alias("median"))
    labels = scored.groupBy(F.concat(F.lit("label:"), or_else(S.gem_label(F.col(value)), "Unlabelled")).alias("name")).agg(F.count("*").cast("double").alias("value"))
    return plain.unpivot([], plain.columns, "name", "value").unionByName(ranks).unionByName(labels)
