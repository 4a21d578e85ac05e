"""Expressions that turn a social post into product fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.scores import HTTP_URL
from vitrine.functions.text import (
    WORD_CHAR, alternation, any_of, contains_text, count_of, contains_word, first_word, identify_product,
    looks_like_unparsed_caption, or_else, strip, word_pattern, words_found, literal_map,
)
from vitrine.taxonomy import QueryVocabulary, Taxonomy, escape_regex

# The profile host, and the words the post rules are defined on.
PROFILE_PREFIX = "https://www.instagram.com/"
RESERVED_PROFILE_PATHS = ("p", "reel", "explore", "accounts")
PRODUCT_TERMS = (
    "dress", "gown", "kurta", "kurti", "saree", "shirt", "t-shirt", "tshirt", "tee",
    "top", "blouse", "jeans", "trousers", "pants", "skirt", "jacket", "coat", "blazer",
    "earring", "earrings", "necklace", "ring", "bracelet", "jewellery", "jewelry", "bag",
    "tote", "clutch", "shoes", "sneakers", "heels", "sandals", "watch", "belt", "sunglasses",
    "scrunchie", "co-ord", "coord", "activewear", "hoodie", "sweater", "shorts", "lehenga",
)
SOCIAL_POST_TERMS = (
    "meme", "giveaway winner", "happy birthday", "behind the scenes", "moodboard",
    "hiring", "job opening", "store closed", "holiday notice", "quote of the day",
)
COMMERCE_SIGNALS = ("₹", " rs", "inr", "shop", "order", "launch", "collection", "available", "size")
GENERIC_POST_NAMES = ("product", "instagram product", "new drop", "collection", "look", "new arrival",
                      "latest product", "women tops", "uncategorized")
REJECTED_CANDIDATES = ("latest product", "new product", "instagram product", "product", "new drop", "collection")
MARKETING_WORDS = ("bestselling", "bestseller", "finally back", "shop now", "new drop", "collection", "launching",
                   "introducing")
FALLBACK_COLOURS = ("black", "white", "blue", "green", "red", "pink", "beige", "brown", "silver", "gold",
                    "embroidered")
FALLBACK_MATERIALS = ("linen", "cotton", "silk", "denim", "leather", "velvet")
MULTIPLIERS = {"k": 1_000.0, "m": 1_000_000.0, "b": 1_000_000_000.0}
CALL_TO_ACTION = r"shop now|link in bio|dm (?:us )?to order|available now"
PRICE_TEXT = r"(?i)(?:₹|rs\.?|inr)\s*[0-9][0-9,.]*(?:\s*[kK])?(?:\s*/-)?(?:\s+onwards)?"
PHOTO_CREDIT = r"(?i)^Photo by .+? on Instagram:\s*"
EDGE_MARKS = " \\-—:|"

# The ingest keyword ladder, first match wins: (words, slug, slug when the text says men).
INGEST_LADDER = (
    (("jewelry", "jewellery", "earring", "necklace", "bracelet", "ring"), "women-jewelry", None),
    (("bag", "tote", "purse", "clutch"), "women-bags", None),
    (("shoe", "heel", "sneaker", "sandal", "loafer"), "women-shoes", None),
    (("sunglass", "eyewear"), "accessories-sunglasses", None),
    (("watch",), "accessories-watches", None),
    (("belt",), "accessories-belts", None),
    (("scrunchie", "hair clip", "hairband", "headband"), "accessories-hair", None),
    (("kurta", "kurti", "saree", "lehenga", "ethnic"), "women-ethnic-wear", "men-ethnic-wear"),
    (("co-ord", "coord", "matching set"), "women-co-ords", None),
    (("activewear", "sports bra", "leggings", "gym wear"), "women-activewear", None),
    (("dress", "gown", "frock"), "women-dresses", None),
    (("jacket", "coat", "blazer", "outerwear"), "women-jackets", "men-jackets"),
    (("jeans", "denim jean"), "women-jeans", "men-jeans"),
    (("trouser", "pants", "shorts", "skirt"), "women-bottoms", "men-bottoms"),
    (("tshirt", "t-shirt", "tee"), "women-tops", "men-t-shirts"),
    (("shirt",), "men-shirts", None),
    (("home", "decor", "lamp", "cushion", "ceramic"), "home-decor", None),
)
MEN_MARKS = (" men", "mens", "men's")


def normalize_brand(raw: Column) -> Column:
    cleaned = F.regexp_replace(strip(or_else(raw, "")), "^@+", "")
    return or_else(F.nullif(F.regexp_replace(cleaned, r"\s+", " "), F.lit("")), "unknown_brand")


def normalize_username(raw: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(normalize_brand(raw)), r"[^a-z0-9._]", "")
    return or_else(F.nullif(cleaned, F.lit("")), "unknown_brand")


def profile_url(username: Column) -> Column:
    return F.concat(F.lit(PROFILE_PREFIX), username, F.lit("/"))


def parse_identity(value: Column) -> Column:
    """struct(username, profile_url) for an exact handle or profile URL; nulls mean rejected."""
    raw = strip(or_else(value, ""))
    is_url = raw.rlike("^https?://")
    handle = F.regexp_extract(raw, r"^https?://(?:www\.)?instagram\.com/([A-Za-z0-9._]+)/?(?:\?.*)?$", 1)
    from_url = F.when((handle != "") & ~F.lower(handle).isin(*RESERVED_PROFILE_PATHS), normalize_username(handle))
    bare = F.regexp_replace(raw, "^@+", "")
    name = normalize_username(bare)
    from_handle = F.when((raw != "") & (name != "unknown_brand") & (name == F.lower(bare)), name)
    username = F.when(is_url, from_url).otherwise(from_handle)
    return F.struct(username.alias("username"), profile_url(username).alias("profile_url"))


def parse_count(raw: Column, label: str) -> Column:
    """"12.5k followers" -> 12500; 0 when the label is absent."""
    text = F.regexp_replace(F.lower(strip(or_else(raw, ""))), ",", "")
    pattern = rf"([0-9]+(?:\.[0-9]+)?)\s*([kmb])?\s+{escape_regex(label.lower())}"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.coalesce(*[F.when(unit == k, F.lit(v)) for k, v in MULTIPLIERS.items()], F.lit(1.0))
    return F.floor(F.coalesce(number * factor, F.lit(0.0))).cast("long")


def extract_price(text: Column) -> Column:
    """Amount after a rupee mark, with a k suffix, else a bare "2.5k"; null when there is none."""
    pattern = r"(?i)(?:₹|rs\.?|inr)\s*([0-9][0-9,]*(?:\.\d{1,2})?)\s*([kK])?(?:\s*/-)?(?:\s+onwards)?"
    amount = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    thousands = F.regexp_extract(text, pattern, 2) != ""
    short = F.regexp_extract(
        text, rf"(?<![\p{{L}}\p{{N}}_₹])([0-9]+(?:\.[0-9]+)?)\s*[kK](?!{WORD_CHAR})", 1).try_cast("double")
    return F.coalesce(F.when(thousands, amount * 1000).otherwise(amount), short * 1000)


def post_id(url: Column) -> Column:
    """Post id with or without the user name in the path; '' when there is none."""
    return F.regexp_extract(or_else(url, ""), r"(?i)instagram\.com/(?:[^/?#]+/)?(?:p|reel)/([^/?#]+)", 1)


def bare_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(or_else(url, ""), r"(?s)\?.*$", ""), "/+$", "")


def source_post_url(*urls: Column) -> Column:
    """The first of the URLs that is a valid post URL, without query and trailing slash."""
    pattern = r"(?i)^https://(?:www\.)?instagram\.com/(?:[^/]+/)?(?:p|reel)/[^/]+$"
    return F.coalesce(*[F.when(bare_url(u).rlike(pattern), bare_url(u)) for u in urls])


def infer_brand(description: Column, followers: Column) -> Column:
    """struct(brand_name, username, profile_url, niche_score) from a "Photo by X on ..." alt text."""
    from vitrine.functions.scores import niche_score

    credit = F.regexp_extract(or_else(description, ""), r"(?i)Photo by\s+(.+?)\s+on\s+", 1)
    brand = normalize_brand(credit)
    username = normalize_username(brand)
    count = F.greatest(or_else(followers, 0), F.lit(0))
    return F.struct(
        brand.alias("brand_name"),
        username.alias("username"),
        F.when(username != "unknown_brand", profile_url(username)).otherwise("").alias("profile_url"),
        count.alias("followers"),
        niche_score(count, brand).alias("niche_score"),
    )


def fashion_metadata(description: Column, taxonomy: Taxonomy, words: QueryVocabulary) -> Column:
    text = F.lower(description)
    product = identify_product(text, taxonomy)
    scan = (*words.caption_colours, *words.caption_styles, *words.caption_fits, *words.caption_materials,
            *words.caption_patterns, *words.caption_occasions)
    colours = words_found(text, words.caption_colours, scan)
    return F.struct(
        F.regexp_extract_all(description, F.lit("#([A-Za-z0-9_]+)"), F.lit(1)).alias("hashtags"),
        product["family"].alias("product_family"),
        product["type"].alias("product_type"),
        F.get(colours, F.lit(0)).alias("primary_colour"),
        F.when(F.size(colours) > 1, F.slice(colours, F.lit(2), F.greatest(F.size(colours), F.lit(1))))
        .otherwise(F.array().cast("array<string>")).alias("secondary_colours"),
        words_found(text, words.caption_styles, scan).alias("style"),
        first_word(text, words.caption_fits, scan).alias("fit"),
        first_word(text, words.caption_materials, scan).alias("material"),
        first_word(text, words.caption_patterns, scan).alias("pattern"),
        words_found(text, words.caption_occasions, scan).alias("occasion"),
    )


def fallback_product_name(description: Column) -> Column:
    """Colour, material and garment words of the caption; null when there are none."""
    text = F.lower(F.regexp_replace(or_else(description, ""), PHOTO_CREDIT, ""))
    nouns = sorted(PRODUCT_TERMS, key=len, reverse=True)
    words = F.array_compact(F.concat(
        F.transform(words_found(text, (*FALLBACK_COLOURS, *FALLBACK_MATERIALS)), F.initcap),
        F.array(F.element_at(literal_map({n: n.title() for n in nouns}), first_word(text, nouns, plural=True))),
    ))
    name = F.substring(F.array_join(F.array_distinct(words), " "), 1, 100)
    # Not a ``when`` over the words: its two mentions of them would read the text twice.
    return F.get(F.filter(F.array(name), lambda n: n != ""), F.lit(0))


def _trim_marks(text: Column, extra: str = "") -> Column:
    marks = f"[{EDGE_MARKS}{extra}]+"
    return F.regexp_replace(text, f"^{marks}|{marks}$", "")


def clean_product_name(description: Column, taxonomy: Taxonomy, words: QueryVocabulary) -> Column:
    """A title from a caption: first clause if presentable, else colour + material + type, else keywords."""
    text = strip(F.regexp_replace(or_else(description, ""), r"\s+", " "))
    text = _trim_marks(F.regexp_replace(text, PHOTO_CREDIT, ""))
    text = F.regexp_replace(text, PRICE_TEXT, "")
    text = F.regexp_replace(text, rf"(?i)(?<!{WORD_CHAR})(?:{CALL_TO_ACTION})(?!{WORD_CHAR}).*$", "")
    text = F.regexp_replace(text, "#[A-Za-z0-9_]+", "")
    clause = _trim_marks(F.regexp_replace(text, r"(?s)(?:[.!?]|\s+[|•]\s+).*$", ""), ",.")
    presentable = (
        (F.length(clause) >= 4)
        & (F.length(clause) <= 100)
        & ~clause.rlike("(?i)" + word_pattern(*MARKETING_WORDS))
        & ~looks_like_unparsed_caption(clause)
        & ~F.lower(clause).isin(*REJECTED_CANDIDATES)
    )
    lowered = F.lower(text)
    scan = (*words.caption_colours, *words.caption_materials)
    kind = identify_product(text, taxonomy)["type"]
    concise = F.concat_ws(
        " ",
        F.initcap(first_word(lowered, words.caption_colours, scan)),
        F.initcap(first_word(lowered, words.caption_materials, scan)),
        F.element_at(literal_map(taxonomy.type_labels), kind),
    )
    return (
        F.when(presentable, clause)
        .when(kind.isNotNull(), F.substring(concise, 1, 100))
        .otherwise(fallback_product_name(description))
    )


def is_likely_product_post(description: Column, image_url: Column) -> Column:
    text = F.regexp_replace(F.lower(or_else(description, "")), "[_#]", " ")
    social = contains_text(text, *SOCIAL_POST_TERMS) & ~contains_text(text, *PRODUCT_TERMS)
    named = or_else(text.rlike(word_pattern(*PRODUCT_TERMS, suffix="s?")), False)
    commerce = count_of([contains_text(text, s) for s in COMMERCE_SIGNALS])
    has_image = or_else(image_url.rlike("^https?://"), False)
    return ~social & (named | ((commerce >= 2) & has_image))


def post_errors(p) -> Column:
    """Reasons a post is invalid; an empty array means valid."""
    return F.array_compact(F.array(
        F.when(~or_else(p["product_url"].startswith(PROFILE_PREFIX), False), "invalid_product_url"),
        F.when(~or_else(p["image_url"].rlike("^https?://"), False), "invalid_image_url"),
        F.when(strip(or_else(p["description"], "")) == "", "missing_description"),
    ))


def quality_gate(p) -> Column:
    """Hold reasons for a candidate product; an empty array means accepted."""
    name = F.lower(strip(F.regexp_replace(or_else(p["product_name"], ""), r"\s+", " ")))
    username = normalize_username(F.coalesce(F.nullif(p["instagram_username"], F.lit("")), p["brand_name"]))
    generic = (F.length(name) < 4) | name.isin(*GENERIC_POST_NAMES) | name.rlike(r"^(?:look|product)\s*\d*$")
    return F.array_compact(F.array(
        F.when((or_else(p["brand_name"], "") == "") | (username == "unknown_brand"), "invalid_brand_relation"),
        F.when(generic, "generic_product_name"),
        F.when(~or_else(p["product_url"].startswith(PROFILE_PREFIX), False), "invalid_source_post"),
        F.when(~or_else(p["image_url"].rlike("^https?://"), False), "missing_or_unrecoverable_image"),
        F.when(~is_likely_product_post(p["description"], p["image_url"]), "non_product_post"),
        F.when(p["category_id"].isNull(), "missing_category"),
        F.when((p["classifier_confidence"] < 0.45) & (p["normalized_subcategory"] != "uncategorized"),
               "contradictory_or_weak_category"),
    ))


def fallback_category(description: Column) -> Column:
    """struct(category_slug, confidence_score) from the keyword ladder; substring tests, first rung wins."""
    text = F.lower(or_else(description, ""))
    men = contains_text(text, *MEN_MARKS)
    ladder = [
        F.when(contains_text(text, *words), F.when(men, men_slug).otherwise(slug) if men_slug else F.lit(slug))
        for words, slug, men_slug in INGEST_LADDER
    ]
    slug = F.coalesce(*ladder)
    return F.struct(
        or_else(slug, "uncategorized").alias("category_slug"),
        F.when(slug.isNotNull(), 0.85).otherwise(0.35).alias("confidence_score"),
    )


def validate_category(slug: Column, confidence: Column, known: Column, description: Column) -> Column:
    """Keep a proposed slug only when it is known, clamping its confidence; else use the ladder."""
    fallback = fallback_category(description)
    number = F.coalesce(confidence.cast("string").try_cast("double"), F.lit(0.0))
    return F.when(
        or_else(known, False),
        F.struct(slug.alias("category_slug"),
                 F.greatest(F.lit(0.0), F.least(number, F.lit(1.0))).alias("confidence_score")),
    ).otherwise(fallback)


def audience_of_slug(slug: Column) -> Column:
    return F.when(slug.rlike("^(?:women|men|unisex)-"), F.upper(F.regexp_extract(slug, "^([^-]*)", 1))).otherwise("")


def main_of_slug(slug: Column) -> Column:
    return F.when(slug == "uncategorized", "uncategorized").otherwise(F.regexp_extract(slug, "^([^-]*)", 1))
