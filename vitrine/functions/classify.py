"""Rule-based product categories: the text evidence, the decision, and why a product stays ambiguous."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scores import CONFIDENCE_FLOOR
from vitrine.functions.text import (
    WORD_CHAR, any_of, contains_text, first_filled, in_list_order, join_words, or_else, strip, term_pattern, terms_present, text_array, word_pattern,
)


@dataclass(frozen=True)
class Rule:
    main: str
    slug: str
    terms: tuple[str, ...]
    confidence: float


# The category rules, first match wins.
RULES = (
    Rule("accessories", "accessories-jewellery", ("earring", "earrings", "hoops", "necklace", "necklaces", "bracelet", "bangle", "choker", "jewellery", "jewelry", "hoop earrings", "pendant", "ring", "rings"), 0.98),
    Rule("accessories", "accessories-wallets", ("wallet", "card holder", "cardholder"), 0.97),
    Rule("accessories", "accessories-sunglasses-all", ("sunglasses", "shades", "eyewear"), 0.96),
    Rule("watches", "watches-minimal", ("minimal analog watch", "analog watch", "minimal watch"), 0.96),
    Rule("watches", "watches", ("watch", "timepiece", "chronograph", "smartwatch"), 0.93),
    Rule("women", "women-kurtis", ("kurti", "kurtis", "straight kurta", "embroidered kurti"), 0.98),
    Rule("women", "women-coord-sets", ("co-ord", "co ord", "coord", "co-ords", "matching set"), 0.96),
    Rule("women", "women-lingerie", ("lingerie", "bralette", "underwire bra"), 0.98),
    Rule("unisex", "unisex-hoodies", ("hoodie", "hooded sweatshirt"), 0.96),
    Rule("unisex", "unisex-sneakers", ("sneaker", "sneakers", "trainer", "trainers"), 0.95),
    Rule("accessories", "accessories-bags", ("handbag", "tote bag", "sling bag", "clutch", "crossbody bag"), 0.94),
)

# Word lists of the audience, garment and non-product tests.
WOMEN_TERMS = ("women", "woman", "womens", "women's", "female", "ladies", "girl")
MEN_TERMS = ("men", "man", "mens", "men's", "male", "gentlemen", "boy")
GARMENT_CONFLICT = ("dress", "gown", "top", "blouse", "shirt", "jeans", "skirt", "shorts")
DRESS = ("dress", "gown", "sundress")
JEANS = ("jeans", "straight leg jeans", "straight-leg jeans", "wide-leg jeans", "mom jeans", "denim jeans")
TEES = ("t-shirt", "tshirt", "tee", "graphic tee", "tees")
FORMAL = ("blazer", "formal suit", "formal wear")
TOPS = ("top", "blouse", "crop top", "tank top", "camisole")
SKIRTS = ("skirt", "mini skirt", "midi skirt", "shorts")
HOME = ("home decor", "vase", "lamp", "wall decor", "furniture")
AMBIGUOUS_GARMENTS = ("dress", "gown", "top", "blouse", "shirt", "jeans", "skirt", "shorts", "blazer")
NON_PRODUCT_TERMS = ("giveaway winner", "hiring", "job opening", "store closed", "holiday notice",
                     "quote of the day", "event invitation", "behind the scenes", "meme")
GENERIC_GARMENT_NAMES = ("dress", "dresses", "gown", "top", "tops", "blouse", "shirt", "shirts", "jeans", "skirt",
                         "skirts", "shorts", "kurti", "kurtis", "kurta", "kurtas")
WEAK_NAME = (r"(?i)^(?:product|instagram product|new drop|summer collection|look\s*\d*|new arrival|shop now|"
             r"latest product)$")
CAPTION_NAME = r"(?i)^(?:photo|video) (?:by|shared by)"
NAME_NOUNS = (
    (r"(?:oversized\s+)?(?:linen\s+)?shirt", "Oversized Linen Shirt"),
    (r"silver\s+hoops?", "Silver Hoop Earrings"),
    (r"hoop earrings?", "Hoop Earrings"),
    (r"(?:embroidered\s+)?kurt(?:a|i)s?", "Embroidered Kurti"),
    (r"(?:crossbody|sling|tote) bag", None),
    (r"(?:analog|minimal|smart) watch", None),
    (r"(?:graphic|oversized) (?:tee|t-shirt)", None),
)
INCOMPATIBLE = {
    "accessories-jewellery": ("women-jeans", "men-jeans", "women-lingerie", "home-decor"),
    "watches": ("women-lingerie", "women-jeans", "men-shirts"),
    "unisex-sneakers": ("women-lingerie", "accessories-jewellery", "home-decor"),
    "women-kurtis": ("men-shirts", "home-decor", "accessories-jewellery"),
}
AUDIENCES = ("women", "men", "unisex")

ALL_TERMS = tuple(dict.fromkeys(
    [t for r in RULES for t in r.terms]
    + [*WOMEN_TERMS, *MEN_TERMS, "unisex", *GARMENT_CONFLICT, *DRESS, *JEANS, *TEES, *FORMAL, *TOPS, *SKIRTS, *HOME]
))
RULE_TERMS = tuple(dict.fromkeys(t for r in RULES for t in r.terms))
GENERIC_NAMES = tuple(dict.fromkeys([*RULE_TERMS, *GENERIC_GARMENT_NAMES]))


def strip_vision_guess(text: Column) -> Column:
    """Drop an automatic "may be an image of ..." guess and all that follows it in the same field."""
    return F.regexp_replace(or_else(text, ""), r"(?is)may be an image of.*", "")


def compact_text(p) -> Column:
    m = p["metadata"]
    fields = [p["product_name"], p["item_name"], p["description"], p["subcategory"], p["source_hashtag"],
              F.concat_ws(" ", m["hashtags"]), m["caption"], m["alt_text"], m["post_text"]]
    return F.lower(join_words([strip_vision_guess(f.cast("string")) for f in fields]))


def display_name(p) -> Column:
    return strip(or_else(first_filled(p["product_name"], p["item_name"]), ""))


def is_generic_name(name: Column) -> Column:
    return F.lower(strip(or_else(name, ""))).isin(*GENERIC_NAMES)


def is_weak_name(name: Column) -> Column:
    """Long, caption-like or bare type-word names are no evidence of their own."""
    return (F.length(name) >= 90) | name.rlike(CAPTION_NAME) | is_generic_name(name)


def _overlaps(present: Column, terms) -> Column:
    return F.arrays_overlap(present, text_array(terms))


def audience(present: Column) -> Column:
    """struct(audience, confidence) from the terms found in the text."""
    women, men, unisex = (_overlaps(present, t) for t in (WOMEN_TERMS, MEN_TERMS, ("unisex",)))
    name = (F.when(women & ~men, "women").when(men & ~women, "men").when(unisex | (women & men), "unisex"))
    confidence = F.when(name.isNull(), 0.0).when(name == "unisex", 0.92).otherwise(0.98)
    return F.struct(name.alias("audience"), confidence.alias("confidence"))


def _decision(main, slug, confidence, reason) -> Column:
    column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(
        column(main).alias("main_slug"), column(slug).alias("category_slug"),
        (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).alias("confidence"),
        column(reason).alias("reason"))


def classify_terms(present: Column, who: Column) -> Column:
    """struct(main_slug, category_slug, confidence, reason) from the terms in a text and its audience."""
    has = lambda *terms: _overlaps(present, terms)
    family = lambda r: "watches" if r.slug.startswith("watches") else r.slug
    families = list(dict.fromkeys(family(r) for r in RULES))
    n_families = sum(
        (has(*[t for r in RULES if family(r) == f for t in r.terms]).cast("int") for f in families), F.lit(0))
    conflict = (n_families > 1) | ((n_families > 0) & has(*GARMENT_CONFLICT))
    gendered = who.isin("women", "men")
    decision = F.when(conflict, _decision(None, None, 0.55, "multiple product families appear in the same post"))
    for r in RULES:
        first = F.get(in_list_order(present, r.terms), F.lit(0))
        decision = decision.when(
            has(*r.terms),
            _decision(r.main, r.slug, r.confidence, F.concat(F.lit("explicit product term: "), first)))
    ladder = [
        (has(*DRESS) & (who == "women"), _decision("women", "women-dresses", 0.95, "dress plus explicit women's audience")),
        (has(*DRESS), _decision(None, None, 0.58, "dress found but audience is ambiguous")),
        (has(*JEANS) & gendered, _decision(who, F.concat(who, F.lit("-jeans")), 0.97, "jeans plus explicit audience")),
        (has(*JEANS), _decision(None, None, 0.58, "jeans found but audience is ambiguous")),
        (has(*TEES) & gendered, _decision(who, F.concat(who, F.lit("-t-shirts")), 0.94, "t-shirt plus explicit audience")),
        (has(*TEES), _decision("unisex", "unisex-streetwear", 0.76, "t-shirt found without reliable audience")),
        (has("shirt") & (who == "men"), _decision("men", "men-shirts", 0.95, "shirt plus explicit men's audience")),
        (has("shirt"), _decision(None, None, 0.55, "shirt found without reliable audience")),
        (has(*FORMAL) & gendered, _decision(who, F.concat(who, F.lit("-formal-wear")), 0.93, "formalwear plus explicit audience")),
        (has(*FORMAL), _decision(None, None, 0.57, "formalwear found without reliable audience")),
        (has(*TOPS) & (who == "women"), _decision("women", "women-tops", 0.93, "top plus explicit women's audience")),
        (has(*SKIRTS) & (who == "women"), _decision("women", "women-skirts-shorts", 0.93, "skirt/shorts plus explicit women's audience")),
        (has(*HOME), _decision("home-decor", "home-decor", 0.94, "explicit home-decor term")),
    ]
    for condition, value in ladder:
        decision = decision.when(or_else(condition, False), value)
    return decision.otherwise(_decision(None, None, 0.25, "no deterministic category evidence"))


NON_PRODUCT_EXCEPTIONS = (*RULE_TERMS, "dress", "top", "shirt", "jeans", "skirt", "shorts", "blouse")


def is_non_product(text: Column, present: Column | None = None) -> Column:
    """Announcement-like text without any product term. ``present`` is the term scan when there is one."""
    present = terms_present(text, NON_PRODUCT_EXCEPTIONS) if present is None else present
    return contains_text(text, *NON_PRODUCT_TERMS) & ~_overlaps(present, NON_PRODUCT_EXCEPTIONS)


def suggested_name(current: Column, text: Column) -> Column:
    """struct(name, confidence): a canonical noun from the metadata when the stored name is weak."""
    options = []
    for pattern, canonical in NAME_NOUNS:
        hit = F.nullif(F.regexp_extract(text, rf"(?i)(?<!{WORD_CHAR})({pattern})(?!{WORD_CHAR})", 1), F.lit(""))
        options.append(F.when(hit.isNotNull(), F.lit(canonical) if canonical else title_words(hit)))
    weak = (current == "") | current.rlike(WEAK_NAME)
    name = F.when(weak, F.coalesce(*options))
    return F.struct(name.alias("name"), F.when(name.isNotNull(), 0.9).otherwise(0.0).alias("confidence"))


def title_words(text: Column) -> Column:
    """Capital after every non-letter, as in "T-Shirt"."""
    return F.array_join(F.transform(F.split(F.initcap(text), "-"), lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), "-")


def obvious_mismatch(slug: Column, stored_slug: Column) -> Column:
    return any_of([(slug == s) & stored_slug.isin(*bad) for s, bad in INCOMPATIBLE.items()])


def with_classification(products: DataFrame) -> DataFrame:
    """Add the text evidence and the decisions of the deterministic classifier.

    New columns: ``cls_text`` (compact text), ``cls_terms`` (terms in it), ``direct`` (decision from all the
    text), ``decision`` (name first, then all the text; a lone weak signal is capped at .74), ``non_product``,
    ``ambiguity``. The two term scans are materialised first, so each text is read once.
    """
    name = display_name(products)
    m = products["metadata"]
    # Fields of the metadata struct are taken out first; the generator stages read flat columns only.
    staged = products.withColumns({
        "cls_text": compact_text(products),
        "cls_name": name,
        "cls_weak": is_weak_name(name),
        "cls_caption": or_else(m["caption"], ""),
        "cls_tags": F.concat_ws(" ", m["hashtags"]),
        "cls_alt": or_else(m["alt_text"], ""),
    })
    staged = _stage(staged, {
        "cls_terms": terms_present(F.col("cls_text"), ALL_TERMS),
        "cls_name_terms": terms_present(
            F.lower(F.when(F.col("cls_weak"), "").otherwise(strip_vision_guess(F.col("cls_name")))), ALL_TERMS),
    })
    staged = _stage(staged, {
        "non_product": is_non_product(F.col("cls_text"), F.col("cls_terms")),
        "cls_audience": audience(F.col("cls_terms"))["audience"],
        "cls_name_audience": audience(F.col("cls_name_terms"))["audience"],
    })
    staged = _stage(staged, {
        "direct": classify_terms(F.col("cls_terms"), F.col("cls_audience")),
        "cls_by_name": classify_terms(F.col("cls_name_terms"), F.col("cls_name_audience")),
    })
    staged = _stage(staged, {"decision": _two_stage_decision(staged)})
    staged = _stage(staged, {"ambiguity": ambiguity_reason(staged)})
    return staged.drop("cls_name_terms", "cls_by_name", "cls_name_audience", "cls_caption", "cls_tags", "cls_alt")


def _stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    A later filter on a decision would otherwise be pushed down with the whole rule ladder substituted into
    it, once per mention, and every text would be scanned again for each of them.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def _accepted(decision: Column) -> Column:
    return decision["category_slug"].isNotNull() & (decision["confidence"] >= CONFIDENCE_FLOOR)


def _with_source(decision: Column, confidence: Column, reason: Column, source: str) -> Column:
    return F.struct(
        decision["main_slug"].alias("main_slug"), decision["category_slug"].alias("category_slug"),
        confidence.alias("confidence"), reason.alias("reason"), F.lit(source).alias("source"))


def _two_stage_decision(p) -> Column:
    by_name, direct = p["cls_by_name"], p["direct"]
    reason_term = F.lower(strip(F.element_at(F.split(direct["reason"], ":"), -1)))
    brand_context = [p[c] for c in ("brand_category", "brand_bio") if c in p.columns]
    evidence = F.array_distinct(F.filter(F.transform(F.array(
        p["cls_name"], p["description"], p["cls_caption"], p["cls_tags"], p["cls_alt"],
        *brand_context), lambda v: F.lower(strip(or_else(v, "")))), lambda v: v != ""))
    pattern = F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(reason_term, r"([\\.^$|()\[\]{}*+?\-])", r"\\$1"),
                       F.lit("s?(?![a-z0-9])"))
    agreeing = F.size(F.filter(evidence, lambda v: F.rlike(v, pattern)))
    lone_weak = p["cls_weak"] & (agreeing < 2)
    return (
        F.when(_accepted(by_name), _with_source(by_name, by_name["confidence"], by_name["reason"], "deterministic"))
        .when(_accepted(direct) & lone_weak, _with_source(
            direct, F.lit(0.74),
            F.lit("single weak caption/alt-text signal requires AI or manual confirmation"), "metadata"))
        .when(_accepted(direct), _with_source(direct, direct["confidence"], direct["reason"], "metadata"))
        .otherwise(_with_source(direct, direct["confidence"], direct["reason"], "deterministic"))
    )


def ambiguity_reason(p) -> Column:
    """Why a product is not confidently categorised: one of seven reasons, first that applies."""
    name, decision = p["cls_name"], p["decision"]
    caption_like = (F.length(name) >= 90) | name.rlike(CAPTION_NAME)
    no_text = (strip(or_else(p["description"], "")) == "") & (p["cls_caption"] == "")
    garment = _overlaps(p["cls_terms"], AMBIGUOUS_GARMENTS) & p["cls_audience"].isNull()
    no_tags = (p["cls_tags"] == "") & (or_else(p["source_hashtag"], "") == "")
    unsure = decision["category_slug"].isNotNull() & (decision["confidence"] < CONFIDENCE_FLOOR)
    return (
        F.when(p["non_product"], "likely non-product post")
        .when((name == "") | name.rlike(WEAK_NAME), "generic or failed product name extraction")
        .when(caption_like, "scraper extracted caption/alt text as product name")
        .when(no_text, "missing caption and description")
        .when(garment | unsure, "ambiguous gender or audience")
        .when(decision["category_slug"].isNull() & no_tags, "missing useful hashtags and explicit product terms")
        .when(decision["category_slug"].isNull(), "no explicit taxonomy product term")
        .otherwise("taxonomy mismatch or conflicting evidence")
    )
