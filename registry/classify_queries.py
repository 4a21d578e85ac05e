"""Registered category-rule functions over products with captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import query
from registry.hardware import lit, part, term
from vitrine.functions import classify as C

VISION = lambda e: f"regexp_replace(coalesce({e}, ''), '(?is)may be an image of.*', '')"
COMPACT_SQL = "lower(concat_ws(' ', " + ", ".join(VISION(e) for e in (
    "product_name", "item_name", "description", "subcategory", "source_hashtag", "array_to_string(metadata.hashtags, ' ')",
    "metadata.caption", "metadata.alt_text", "metadata.post_text")) + "))"
NAME_SQL = "trim(coalesce(nullif(product_name, ''), nullif(item_name, ''), ''))"
GENERIC_LIST = ", ".join(lit(x) for x in C.GENERIC_NAMES)
WEAK_SQL = f"(length({NAME_SQL}) >= 90 OR regexp_matches({NAME_SQL}, '{C.CAPTION_NAME}') OR lower({NAME_SQL}) IN ({GENERIC_LIST}))"


def audience_sql(t: str) -> str:
    w, m, u = term(t, *C.WOMEN_TERMS), term(t, *C.MEN_TERMS), term(t, "unisex")
    return f"CASE WHEN {w} AND NOT {m} THEN 'women' WHEN {m} AND NOT {w} THEN 'men' WHEN {u} OR ({w} AND {m}) THEN 'unisex' END"


def decision_sql(t: str, who: str) -> tuple[str, str, str, str]:
    """(main, slug, confidence, reason) as four CASE expressions over the text and its audience."""
    fams: dict[str, list[str]] = {}
    for r in C.RULES:
        fams.setdefault("watches" if r.slug.startswith("watches") else r.slug, []).extend(r.terms)
    n = "(" + " + ".join(f"CAST({term(t, *ts)} AS INT)" for ts in fams.values()) + ")"
    conflict = f"({n} > 1 OR ({n} > 0 AND {term(t, *C.GARMENT_CONFLICT)}))"
    steps = [(conflict, "NULL", "NULL", "0.55", lit("multiple product families appear in the same post"))]
    for r in C.RULES:
        first = "CASE " + " ".join(f"WHEN {term(t, x)} THEN {lit(x)}" for x in r.terms) + " END"
        steps.append((term(t, *r.terms), lit(r.main), lit(r.slug), str(r.confidence), f"'explicit product term: ' || {first}"))
    both = f"coalesce({who} IN ('women', 'men'), FALSE)"
    women, men = f"coalesce({who} = 'women', FALSE)", f"coalesce({who} = 'men', FALSE)"
    none = "NULL"
    steps += [
        (f"{term(t, *C.DRESS)} AND {women}", "'women'", "'women-dresses'", "0.95", lit("dress plus explicit women's audience")),
        (term(t, *C.DRESS), none, none, "0.58", "'dress found but audience is ambiguous'"),
        (f"{term(t, *C.JEANS)} AND {both}", who, f"{who} || '-jeans'", "0.97", "'jeans plus explicit audience'"),
        (term(t, *C.JEANS), none, none, "0.58", "'jeans found but audience is ambiguous'"),
        (f"{term(t, *C.TEES)} AND {both}", who, f"{who} || '-t-shirts'", "0.94", "'t-shirt plus explicit audience'"),
        (term(t, *C.TEES), "'unisex'", "'unisex-streetwear'", "0.76", "'t-shirt found without reliable audience'"),
        (f"{term(t, 'shirt')} AND {men}", "'men'", "'men-shirts'", "0.95", lit("shirt plus explicit men's audience")),
        (term(t, "shirt"), none, none, "0.55", "'shirt found without reliable audience'"),
        (f"{term(t, *C.FORMAL)} AND {both}", who, f"{who} || '-formal-wear'", "0.93", "'formalwear plus explicit audience'"),
        (term(t, *C.FORMAL), none, none, "0.57", "'formalwear found without reliable audience'"),
        (f"{term(t, *C.TOPS)} AND {women}", "'women'", "'women-tops'", "0.93", lit("top plus explicit women's audience")),
        (f"{term(t, *C.SKIRTS)} AND {women}", "'women'", "'women-skirts-shorts'", "0.93", lit("skirt/shorts plus explicit women's audience")),
        (term(t, *C.HOME), "'home-decor'", "'home-decor'", "0.94", "'explicit home-decor term'"),
    ]
    end = (none, none, "0.25", "'no deterministic category evidence'")
    pick = lambda i: "CASE " + " ".join(f"WHEN {s[0]} THEN {s[i + 1]}" for s in steps) + f" ELSE {end[i]} END"
    return tuple(pick(i) for i in range(4))


_D = decision_sql("txt", "who")
_N = decision_sql("ntxt", "nwho")
CLASSIFIED = f"""
    cls1 AS (SELECT *, {COMPACT_SQL} AS txt, {NAME_SQL} AS cname, {WEAK_SQL} AS weak FROM products),
    cls2 AS (SELECT *, {audience_sql('txt')} AS who, lower(CASE WHEN weak THEN '' ELSE {VISION('cname')} END) AS ntxt FROM cls1),
    cls3 AS (SELECT *, {audience_sql('ntxt')} AS nwho,
             {part('txt', *C.NON_PRODUCT_TERMS)} AND NOT {term('txt', *C.NON_PRODUCT_EXCEPTIONS)} AS nonprod FROM cls2),
    cls4 AS (SELECT *, {_D[0]} AS d_main, {_D[1]} AS d_slug, {_D[2]}::DOUBLE AS d_conf, {_D[3]} AS d_reason,
             {_N[0]} AS n_main, {_N[1]} AS n_slug, {_N[2]}::DOUBLE AS n_conf, {_N[3]} AS n_reason FROM cls3),
    cls5 AS (SELECT *, trim(lower(split_part(d_reason, ':', -1))) AS rterm,
             list_distinct(list_filter([lower(trim(cname)), lower(trim(coalesce(description, ''))), lower(trim(coalesce(metadata.caption, ''))),
                lower(trim(coalesce(array_to_string(metadata.hashtags, ' '), ''))), lower(trim(coalesce(metadata.alt_text, '')))], lambda x: x <> '')) AS ev FROM cls4),
    cls6 AS (SELECT *, len(list_filter(ev, lambda x: regexp_matches(x, '(^|[^a-z0-9])' || regexp_escape(rterm) || 's?([^a-z0-9]|$)'))) AS agree,
             coalesce(n_slug IS NOT NULL AND n_conf >= 0.8, FALSE) AS by_name, coalesce(d_slug IS NOT NULL AND d_conf >= 0.8, FALSE) AS by_text FROM cls5),
    cls AS (SELECT *, CASE WHEN by_name THEN n_main ELSE d_main END AS p_main, CASE WHEN by_name THEN n_slug ELSE d_slug END AS p_slug,
            CASE WHEN by_name THEN n_conf WHEN by_text AND weak AND agree < 2 THEN 0.74 ELSE d_conf END AS p_conf,
            CASE WHEN by_name THEN n_reason WHEN by_text AND weak AND agree < 2 THEN 'single weak caption/alt-text signal requires AI or manual confirmation' ELSE d_reason END AS p_reason,
            CASE WHEN by_text AND NOT by_name THEN 'metadata' ELSE 'deterministic' END AS p_source FROM cls6)"""


@query("classify_category", f"""
    WITH {CLASSIFIED} SELECT id, d_main AS main_slug, d_slug AS category_slug, d_conf AS confidence, d_reason AS reason, who AS audience FROM cls""")
def _(t):
    c = C.with_classification(t.products)
    return c.select("id", "direct.main_slug", "direct.category_slug", "direct.confidence", "direct.reason",
                    F.col("cls_audience").alias("audience"))


@query("deterministic_pipeline", f"""
    WITH {CLASSIFIED} SELECT id, p_main AS main_slug, p_slug AS category_slug, p_conf AS confidence, p_reason AS reason, p_source AS source FROM cls""")
def _(t):
    return C.with_classification(t.products).select("id", "decision.*")


@query("is_non_product", f"WITH {CLASSIFIED} SELECT id, nonprod AS non_product FROM cls")
def _(t):
    return C.with_classification(t.products).select("id", "non_product")




def nouns_sql(t: str) -> str:
    cells = []
    for p, canonical in C.NAME_NOUNS:
        rx = "(?i)(^|[^\\p{L}\\p{N}_])(" + p + ")([^\\p{L}\\p{N}_]|$)"
        hit = f"regexp_extract({t}, {lit(rx)}, 2)"
        words = f"list_transform(string_split({hit}, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda v: upper(v[1]) || v[2:]), '-'))"
        cells.append(f"WHEN regexp_matches({t}, {lit(rx)}) THEN " + (lit(canonical) if canonical else f"array_to_string({words}, ' ')"))
    return "CASE " + " ".join(cells) + " END"


CURRENT_SQL = "CASE CAST(id AS INT) % 3 WHEN 0 THEN 'New drop' WHEN 1 THEN '' ELSE " + NAME_SQL + " END"


@query("extract_product_name", f"""
    WITH s AS (SELECT id, {CURRENT_SQL} AS cur, {COMPACT_SQL} AS txt FROM products),
         n AS (SELECT id, CASE WHEN cur = '' OR regexp_matches(cur, '{C.WEAK_NAME}') THEN {nouns_sql('txt')} END AS name FROM s)
    SELECT id, name, CASE WHEN name IS NULL THEN 0.0::DOUBLE ELSE 0.9 END AS confidence FROM n""")
def _(t):
    p = t.products
    current = F.when(F.col("id").cast("int") % 3 == 0, "New drop").when(F.col("id").cast("int") % 3 == 1, "").otherwise(C.display_name(p))
    return p.select("id", C.suggested_name(current, C.compact_text(p)).alias("s")).select("id", "s.*")


@query("is_generic_name", f"SELECT id, lower({NAME_SQL}) IN ({GENERIC_LIST}) AS generic, {WEAK_SQL} AS weak FROM products")
def _(t):
    p = t.products
    return p.select("id", C.is_generic_name(C.display_name(p)).alias("generic"), C.is_weak_name(C.display_name(p)).alias("weak"))


AMBIGUITY_SQL = f"""CASE WHEN nonprod THEN 'likely non-product post'
    WHEN cname = '' OR regexp_matches(cname, '{C.WEAK_NAME}') THEN 'generic or failed product name extraction'
    WHEN length(cname) >= 90 OR regexp_matches(cname, '{C.CAPTION_NAME}') THEN 'scraper extracted caption/alt text as product name'
    WHEN trim(coalesce(description, '')) = '' AND coalesce(metadata.caption, '') = '' THEN 'missing caption and description'
    WHEN ({term('txt', *C.AMBIGUOUS_GARMENTS)} AND who IS NULL) OR (p_slug IS NOT NULL AND p_conf < 0.8) THEN 'ambiguous gender or audience'
    WHEN p_slug IS NULL AND coalesce(len(metadata.hashtags), 0) = 0 AND coalesce(source_hashtag, '') = '' THEN 'missing useful hashtags and explicit product terms'
    WHEN p_slug IS NULL THEN 'no explicit taxonomy product term' ELSE 'taxonomy mismatch or conflicting evidence' END"""


@query("ambiguity_reason", f"WITH {CLASSIFIED} SELECT id, {AMBIGUITY_SQL} AS reason FROM cls")
def _(t):
    return C.with_classification(t.products).select("id", F.col("ambiguity").alias("reason"))
