"""Registered discovery-feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import hardware as H
from registry.core import DIM, NOW, STORAGE, query
from registry.hardware import HARDWARE
from registry.scalar_queries import DISCOVERY_STABLE_SQL, days_sql, enriched, gem_label_sql, joined
from vitrine.operators import discovery as D

RANK = H.term_rank("lower(txt)", HARDWARE)
EN = f"dtx AS (SELECT *, {H.DISCOVERY_TEXT} AS txt FROM ({H.ENRICHED})), dk AS (SELECT *, {RANK} AS k FROM dtx), dp AS (SELECT *, {H.family_of('k', HARDWARE)} AS fam, {H.type_of('k', HARDWARE)} AS kind FROM dk)"


@query("catalog_context", f"WITH {EN} SELECT 'type' AS kind, kind AS key, count(*) AS n FROM dp WHERE kind IS NOT NULL GROUP BY 2 UNION ALL SELECT 'brand', brand_id, count(*) FROM dp WHERE coalesce(brand_id, '') <> '' GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM dp")
def _(t):
    return D.catalog_context(enriched(t), HARDWARE)


ENG_SQL = f"""ev AS (SELECT product_id AS id, action, exp(-{days_sql('ts')} / 30.0) AS w FROM interactions WHERE coalesce(product_id, '') <> ''),
    es AS (SELECT id, round_even(sum(CASE WHEN action = 'save' THEN w ELSE 0 END), 9) AS saves, round_even(sum(CASE WHEN action = 'click' THEN w ELSE 0 END), 9) AS clicks, round_even(sum(CASE WHEN action = 'view' THEN w ELSE 0 END), 9) AS impressions FROM ev GROUP BY 1),
    eg AS (SELECT *, CASE WHEN saves * 3 + clicks * 1.5 + impressions * 0.15 > 0 THEN least(1.0, (saves * 3 + clicks * 1.5 + impressions * 0.15) / 20) END AS engagement, 1 / (1 + impressions) AS exposure_boost FROM es)"""


@query("decayed_engagement", f"WITH {ENG_SQL} SELECT id, saves, clicks, impressions, round_even(engagement, 6) AS engagement, round_even(exposure_boost, 6) AS exposure_boost FROM eg")
def _(t):
    rows = D.decayed_engagement(t.interactions, t.now)
    return rows.select("id", "saves", "clicks", "impressions", F.bround("engagement", 6).alias("engagement"), F.bround("exposure_boost", 6).alias("exposure_boost"))


def wmean(*parts: tuple[str, float]) -> str:
    top = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in parts)
    bottom = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for c, w in parts)
    return f"(({top}) / ({bottom}))"


GEM_SQL = f"""{EN}, {ENG_SQL}, tc AS (SELECT kind, count(*) AS nk FROM dp WHERE kind IS NOT NULL GROUP BY 1), nn AS (SELECT count(*) AS n FROM dp),
    gc AS (SELECT dp.*, nk, n, eg.engagement, coalesce(eg.exposure_boost, 1.0) AS exposure_boost FROM dp LEFT JOIN tc ON tc.kind = dp.kind LEFT JOIN eg ON eg.id = dp.id, nn),
    gq AS (SELECT *, round_even(0.30 * (CAST(coalesce(product_name, '') <> '' AS INT) + CAST(coalesce(brand_id, '') <> '' AS INT) + CAST(category_id IS NOT NULL AS INT) + CAST(coalesce(normalized_subcategory, '') <> '' AS INT)) / 4.0 + 0.25 * coalesce(classifier_confidence, 0)
      + 0.25 * CASE WHEN {DISCOVERY_STABLE_SQL} THEN 1.0 WHEN coalesce(image_url, '') <> '' THEN 0.35 ELSE 0 END + 0.20 * CAST(coalesce(len(embedding), 0) = {DIM} AS INT), 12)::DOUBLE AS quality,
      round_even(CASE WHEN kind IS NULL THEN 0.35 ELSE 1 - least(1.0, greatest(0, nk - 1) / greatest(20.0, n * 0.08)) END, 12)::DOUBLE AS uniqueness, nullif(niche_score, 0) AS niche_factor,
      round_even(exp(-{days_sql('coalesce(scraped_at, created_at)')} / 120.0), 12) AS freshness FROM gc),
    gs AS (SELECT *, CAST(round_even(round_even(greatest(0, least(100, {wmean(('quality', .42), ('uniqueness', .23), ('niche_factor', .16), ('freshness', .12), ('engagement', .07))} * 100)), 9), 0) AS INT) AS gem_score,
      {DISCOVERY_STABLE_SQL} AND coalesce(len(embedding), 0) = {DIM} AND coalesce(classifier_confidence, 0) >= 0.8 AND kind IS NOT NULL AND coalesce(brand_id, '') <> '' AND coalesce(catalog_status, '') <> 'NON_PRODUCT' AS discovery_eligible FROM gq)"""


def scored(t):
    return D.gem_scores(enriched(t), t.interactions, t.now, HARDWARE, STORAGE, DIM)


@query("gem_score", f"""WITH {GEM_SQL} SELECT id, gem_score, {gem_label_sql('gem_score')} AS gem_label, round_even(quality, 4) AS quality, round_even(uniqueness, 4) AS uniqueness, niche_factor, round_even(freshness, 4) AS freshness,
    round_even(engagement, 4) AS engagement, fam AS product_family, kind AS product_type, round_even(exposure_boost, 4) AS exposure_boost, discovery_eligible FROM gs""")
def _(t):
    r4 = lambda c: F.bround(c, 4).alias(c)
    return scored(t).select("id", "gem_score", "gem_label", r4("quality"), r4("uniqueness"), "niche_factor", r4("freshness"), r4("engagement"),
                            "product_family", "product_type", r4("exposure_boost"), "discovery_eligible")


@query("personalized_discovery_score", f"""
    WITH {GEM_SQL}, pr AS (SELECT i.user_id, gs.id, gs.gem_score, lower(gs.txt) AS low, gs.brand_id, f.* EXCLUDE (user_id) FROM (SELECT DISTINCT user_id, product_id FROM interactions) i JOIN gs ON gs.id = i.product_id LEFT JOIN preferences f ON f.user_id = i.user_id),
    m AS (SELECT *, len(list_filter(list_concat(coalesce(preferred_styles, []), list_concat(coalesce(favourite_categories, []), coalesce(preferred_colours, []))), lambda v: contains(low, lower(v)))) + CASE WHEN list_contains(saved_brand_ids, brand_id) THEN 2 ELSE 0 END AS matches FROM pr)
    SELECT user_id, id, least(100, gem_score + least(12, matches * 3))::DOUBLE AS personalized_discovery_score, matches > 0 AS personalization_matched FROM m""")
def _(t):
    pairs = t.interactions.select("user_id", F.col("product_id").alias("id")).distinct()
    return D.personalized_scores(scored(t).drop("embedding"), pairs, t.preferences)


NICHE = "CASE WHEN coalesce(niche_factor, 0) = 0 THEN 0.5 ELSE niche_factor END"
RAIL_SQL = f"""rl AS (SELECT id, coalesce(nullif(brand_id, ''), brand_name, '') AS brand, coalesce(fam, 'uncategorized') AS product_family, rail, round_even(s1, 9)::DOUBLE AS s1, s2::DOUBLE AS s2 FROM (
      SELECT *, 'hidden_gems' AS rail, gem_score * 0.75 + {NICHE} * 15 + exposure_boost * 10 AS s1, 0 AS s2 FROM gs UNION ALL SELECT *, 'trending', coalesce(engagement, 0) * 50 + coalesce(freshness, 0) * 25 + gem_score * 0.25, 0 FROM gs
      UNION ALL SELECT *, 'fresh_drops', coalesce(freshness, 0), gem_score FROM gs UNION ALL SELECT *, 'new_discoveries', epoch(coalesce(scraped_at, created_at)), gem_score FROM gs UNION ALL SELECT *, 'missed', gem_score * 0.8 + exposure_boost * 20, 0 FROM gs) WHERE discovery_eligible)"""


@query("rail_scores", f"WITH {GEM_SQL}, {RAIL_SQL} SELECT * FROM rl")
def _(t):
    return D.rail_scores(scored(t))


def diversify_sql(rails: str, limit: int = 16, seed: str = "guest-1") -> str:
    """SQL tables up to diversified(rail, id, position): one family's turn a step, the state held in lists."""
    pick = (f"list_filter(fs[i].q, lambda x: NOT list_contains(ids, x.id) AND len(list_filter(brands, lambda b: b = x.brand)) < {D.MAX_PER_BRAND})[1]")
    return f"""dv_b AS (SELECT *, row_number() OVER (PARTITION BY rail, product_family, brand ORDER BY s1 DESC, s2 DESC, id) AS b FROM {rails}),
    dv_f AS (SELECT *, row_number() OVER (PARTITION BY rail, product_family ORDER BY s1 DESC, s2 DESC, id) AS f FROM dv_b WHERE b <= {D.MAX_PER_BRAND}),
    dv_q AS (SELECT rail, product_family AS fam, md5('{seed}' || product_family) AS turn, list({{'id': id, 'brand': brand}} ORDER BY f) AS q FROM dv_f WHERE f <= {2 * limit} GROUP BY ALL),
    dv_r AS (SELECT rail, list({{'fam': fam, 'q': q}} ORDER BY turn, fam) AS fs FROM dv_q GROUP BY rail),
    dv_s AS (SELECT rail, fs, 1 AS i, 0 AS phase, FALSE AS moved, []::VARCHAR[] AS ids, []::VARCHAR[] AS brands, []::VARCHAR[] AS fams FROM dv_r
      UNION ALL SELECT rail, fs, CASE WHEN i < len(fs) THEN i + 1 ELSE 1 END, CASE WHEN i < len(fs) OR moved OR pick IS NOT NULL THEN phase ELSE phase + 1 END, i < len(fs) AND (moved OR pick IS NOT NULL),
        CASE WHEN pick IS NULL THEN ids ELSE list_append(ids, pick.id) END, CASE WHEN pick IS NULL THEN brands ELSE list_append(brands, pick.brand) END, CASE WHEN pick IS NULL THEN fams ELSE list_append(fams, fs[i].fam) END
      FROM (SELECT *, CASE WHEN phase = 1 OR len(list_filter(fams, lambda x: x = fs[i].fam)) < {D.MAX_PER_FAMILY} THEN {pick} END AS pick FROM dv_s WHERE phase < 2 AND len(ids) < {limit})),
    diversified AS (SELECT rail, unnest(ids) AS id, CAST(generate_subscripts(ids, 1) AS INT) AS position FROM dv_s WHERE phase = 2 OR len(ids) = {limit})"""


@query("diversify", f"WITH RECURSIVE {GEM_SQL}, {RAIL_SQL}, {diversify_sql('rl')} SELECT rail, id, position FROM diversified")
def _(t):
    return D.diversify(D.rail_scores(scored(t)), 16, seed="guest-1")


BRAND_SQL = f"""bs AS (SELECT brand_id, avg(quality) AS q, avg(uniqueness) AS u, count(*) FILTER (discovery_eligible) AS e, max(coalesce(freshness, 0)) AS fr, avg(coalesce(engagement, 0)) AS en FROM gs WHERE brand_id IS NOT NULL GROUP BY 1),
    bj AS (SELECT b.id AS brand_id, b.name, b.niche_score AS niche_factor, coalesce(q, 0) AS q, coalesce(u, 0) AS u, coalesce(e, 0) AS eligible_product_count, coalesce(fr, 0) AS fr, coalesce(en, 0) AS en, least(1.0, coalesce(e, 0) / 8.0)::DOUBLE AS d FROM brands b LEFT JOIN bs ON bs.brand_id = b.id),
    bg AS (SELECT *, CAST(round_even(round_even({wmean(('q', .35), ('u', .2), ('niche_factor', .2), ('d', .15), ('fr', .1))} * 100, 9), 0) AS INT) AS gem_score FROM bj)"""


@query("brand_gem_score", f"""WITH {GEM_SQL}, {BRAND_SQL} SELECT brand_id, name, gem_score, {gem_label_sql('gem_score')} AS gem_label, eligible_product_count, round_even(q, 4) AS catalog_quality, round_even(u, 4) AS product_uniqueness,
    niche_factor, round_even(d, 4) AS catalog_depth, round_even(fr, 4) AS freshness, round_even(en, 4) AS engagement,
    CASE WHEN q >= 0.7 AND u >= 0.6 THEN 'Independent brand with strong catalog quality and distinctive products.' ELSE 'A promising independent label worth watching.' END AS recommendation_reason FROM bg""")
def _(t):
    return D.brand_gem_scores(t.brands, scored(t))


@query("dominant_styles", """
    WITH u AS (SELECT brand_id, unnest(metadata.style) AS style FROM products WHERE brand_id IS NOT NULL), c AS (SELECT brand_id, style, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY n DESC, style) AS r FROM c)
    SELECT brand_id, string_agg(style, ',' ORDER BY r) AS styles FROM r WHERE r <= 3 AND n >= 2 AND brand_id IN (SELECT brand_id FROM products GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1""")
def _(t):
    return D.dominant_styles(t.products).select("brand_id", joined(F.col("dominant_styles")).alias("styles"))


@query("brand_rails", f"""WITH {GEM_SQL}, {BRAND_SQL},
    en AS (SELECT brand_id, gem_score, niche_factor, round_even(fr, 4) AS fr, round_even(en, 4) AS en, round_even(d, 4) AS d, md5('guest-1' || brand_id) AS turn FROM bg WHERE eligible_product_count >= 2),
    em AS (SELECT brand_id, CAST(row_number() OVER (ORDER BY gem_score DESC, fr DESC, turn) AS INT) AS position FROM en WHERE gem_score >= 60),
    tr AS (SELECT brand_id, CAST(row_number() OVER (ORDER BY round_even(fr * 0.35 + en * 0.25 + d * 0.25 + CASE WHEN coalesce(niche_factor, 0) = 0 THEN 0.5 ELSE niche_factor END * 0.15, 9) DESC, turn) AS INT) AS position
        FROM en WHERE brand_id NOT IN (SELECT brand_id FROM em WHERE position <= {D.BRAND_RAIL_SIZE}))
    SELECT 'emerging' AS rail, * FROM em WHERE position <= {D.BRAND_RAIL_SIZE} UNION ALL SELECT 'trending', * FROM tr WHERE position <= {D.BRAND_RAIL_SIZE}""")
def _(t):
    return D.brand_rails(D.brand_gem_scores(t.brands, scored(t)), seed="guest-1")


@query("family_rails", f"""WITH {GEM_SQL} SELECT rail, id, position FROM (SELECT CASE WHEN fam = 'jewellery' THEN 'rings' ELSE 'hardware' END AS rail, id, CAST(row_number() OVER (PARTITION BY fam = 'jewellery' ORDER BY CAST(id AS BIGINT)) AS INT) AS position
    FROM gs WHERE discovery_eligible AND fam IN ('jewellery', 'fasteners', 'metalware')) WHERE position <= 16""")
def _(t):
    return D.family_rails(scored(t), {"rings": ("jewellery",), "hardware": ("fasteners", "metalware")}).select("rail", "id", "position")


@query("discovery_quality", f"""WITH {GEM_SQL}, {RAIL_SQL} SELECT rl.rail, count(*) AS selected, count(DISTINCT gs.brand_id) AS brand_diversity, count(DISTINCT gs.category_id) AS category_diversity, round_even(avg(CAST(gs.discovery_eligible AS INT)), 3) AS eligible_share,
    round_even(1 - count(DISTINCT rl.id) / count(*)::DOUBLE, 3) AS duplicate_rate FROM rl JOIN gs ON gs.id = rl.id GROUP BY 1""")
def _(t):
    rows = scored(t)
    return D.discovery_quality(D.rail_scores(rows), rows)


def rank_sql(p: float) -> str:
    return f"(SELECT gem_score FROM o WHERE r = (SELECT CAST(round_even({p} * (count(*) - 1), 0) AS BIGINT) FROM o))::DOUBLE"


@query("score_distribution", f"""WITH {GEM_SQL}, o AS (SELECT gem_score, row_number() OVER (ORDER BY gem_score) - 1 AS r FROM gs)
    SELECT 'count' AS name, count(*)::DOUBLE AS value FROM o UNION ALL SELECT 'minimum', min(gem_score)::DOUBLE FROM o UNION ALL SELECT 'mean', round_even(avg(gem_score), 2) FROM o UNION ALL SELECT 'maximum', max(gem_score)::DOUBLE FROM o UNION ALL SELECT 'median', median(gem_score)::DOUBLE FROM o
    {' '.join(f"UNION ALL SELECT '{n}', {rank_sql(p)}" for n, p in (('p10', .1), ('p25', .25), ('p50', .5), ('p75', .75), ('p90', .9)))} UNION ALL SELECT 'label:' || coalesce({gem_label_sql('gem_score')}, 'Unlabelled'), count(*)::DOUBLE FROM gs GROUP BY 1""")
def _(t):
    return D.score_distribution(scored(t))
