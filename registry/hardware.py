"""The small taxonomy and word lists of the part names, used by the registered queries, and SQL snippets for them."""

from __future__ import annotations

from vitrine.taxonomy import FASHION, FASHION_WORDS, QueryVocabulary, Taxonomy

HARDWARE = Taxonomy(
    tree={
        "jewellery": {"ring": ("ring",)},
        "fasteners": {"bolt": ("bolt",), "rod": ("rod",), "red-rod": ("red rod",)},
        "mechanisms": {"gear": ("gear",), "widget": ("widget",), "gizmo": ("gizmo",)},
        "metalware": {"anvil": ("anvil",), "plate": ("plate",)},
    },
    type_label_overrides={"gear": "Gear Sets"},
    category_words={"jewellery": ("jewellery", "accessories"), "metalware": ("plate", "anvil", "decor")},
)
WORDS = QueryVocabulary(
    colours=("red", "blue", "black", "green"),
    styles=("old", "new", "hot", "cold", "minimal"),
    fits=("small", "large"),
    materials=FASHION_WORDS.materials,
    occasions=FASHION_WORDS.occasions,
    aesthetics=("cute", "minimal"),
    caption_colours=FASHION_WORDS.caption_colours,
    caption_styles=FASHION_WORDS.caption_styles,
    caption_fits=FASHION_WORDS.caption_fits,
    caption_materials=FASHION_WORDS.caption_materials,
    caption_patterns=FASHION_WORDS.caption_patterns,
    caption_occasions=FASHION_WORDS.caption_occasions,
    training_styles=FASHION_WORDS.training_styles,
    token_stopwords=FASHION_WORDS.token_stopwords,
)


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(term: str) -> str:
    return "".join("\\" + c if c in r"\.^$|()[]{}*+?-" else c for c in term)


def term(text: str, *terms: str) -> str:
    """SQL: does the text hold one of the terms, optional plural s, on [a-z0-9] boundaries?"""
    if not terms:
        return "FALSE"
    pattern = "(^|[^a-z0-9])(" + "|".join(rx(t) for t in terms) + ")(s)?([^a-z0-9]|$)"
    return f"coalesce(regexp_matches({text}, {lit(pattern)}), FALSE)"


def word(text: str, *words: str, suffix: str = "") -> str:
    pattern = r"(^|[^\p{L}\p{N}_])(" + "|".join(rx(w) for w in words) + ")" + suffix + r"([^\p{L}\p{N}_]|$)"
    return f"coalesce(regexp_matches({text}, {lit(pattern)}), FALSE)"


def part(text: str, *parts: str) -> str:
    return "(" + " OR ".join(f"coalesce(contains({text}, {lit(p)}), FALSE)" for p in parts) + ")"


def term_rank(text: str, taxonomy: Taxonomy) -> str:
    """SQL: position of the best term in (length desc, taxonomy order), tested one after the other."""
    cells = " ".join(f"WHEN {term(text, t.term)} THEN {i}" for i, t in enumerate(taxonomy.ranked_terms))
    return f"CASE {cells} END"


def family_of(rank: str, taxonomy: Taxonomy) -> str:
    return "CASE " + " ".join(
        f"WHEN {rank} = {i} THEN {lit(t.family)}" for i, t in enumerate(taxonomy.ranked_terms)) + " END"


def type_of(rank: str, taxonomy: Taxonomy) -> str:
    return "CASE " + " ".join(
        f"WHEN {rank} = {i} THEN {lit(t.type)}" for i, t in enumerate(taxonomy.ranked_terms)) + " END"


def type_label(kind: str, taxonomy: Taxonomy) -> str:
    return "CASE " + " ".join(
        f"WHEN {kind} = {lit(k)} THEN {lit(v)}" for k, v in taxonomy.type_labels.items()) + " END"


def words_list(text: str, words, separator: str = ",") -> str:
    """SQL: the listed words that occur as whole words, joined."""
    cells = ", ".join(f"CASE WHEN {word(text, w)} THEN {lit(w)} END" for w in words)
    return f"concat_ws('{separator}', {cells})"


def parts_list(text: str, parts, separator: str = ",") -> str:
    cells = ", ".join(f"CASE WHEN {part(text, p)} THEN {lit(p)} END" for p in parts)
    return f"concat_ws('{separator}', {cells})"


def first_word(text: str, words) -> str:
    return "CASE " + " ".join(f"WHEN {word(text, w)} THEN {lit(w)}" for w in words) + " END"


def first_part(text: str, words) -> str:
    return "CASE " + " ".join(f"WHEN {part(text, w)} THEN {lit(w)}" for w in words) + " END"


def matched(text: str, options: dict[str, tuple[str, ...]], separator: str = ",") -> str:
    """SQL: keys whose terms occur in the text, joined."""
    cells = ", ".join(f"CASE WHEN {term(text, *terms)} THEN {lit(k)} END" for k, terms in options.items())
    return f"concat_ws('{separator}', {cells})"


TYPE_TERMS = {k: HARDWARE.type_terms(k) for _, k in HARDWARE.types}
FAMILY_TERMS = {f: HARDWARE.family_terms(f) for f in HARDWARE.families}
FASHION_RANKED = FASHION

# SQL: the search text of a product joined with its category name, and the other product texts.
SEARCH_TEXT = (
    "lower(concat_ws(' ', coalesce(product_name,''), coalesce(item_name,''), coalesce(description,''), "
    "coalesce(category,''), coalesce(subcategory,''), coalesce(normalized_main_category,''), "
    "coalesce(normalized_subcategory,''), coalesce(audience,''), coalesce(metadata.colour,''), "
    "coalesce(metadata.color,''), coalesce(array_to_string(metadata.style, ' '),''), coalesce(metadata.fit,'')))"
)
AUDIENCE_TEXT = (
    "lower(concat_ws(' ', coalesce(category_audience,''), coalesce(audience,''), coalesce(category,''), "
    "coalesce(normalized_main_category,''), coalesce(normalized_subcategory,'')))"
)
DISCOVERY_TEXT = (
    "concat_ws(' ', coalesce(product_name,''), coalesce(item_name,''), coalesce(description,''), coalesce(category,''), "
    "coalesce(subcategory,''), coalesce(normalized_subcategory,''), coalesce(source_hashtag,''), "
    "coalesce(array_to_string(metadata.style, ' '),''), coalesce(metadata.colour,''))"
)
INVENTORY_TEXT = (
    "concat_ws(' ', coalesce(product_name,''), coalesce(description,''), coalesce(normalized_subcategory,''), "
    "coalesce(subcategory,''))"
)
TRAINING_TEXT = (
    "lower(concat_ws(' ', coalesce(product_name,''), coalesce(item_name,''), coalesce(description,''), "
    "coalesce(subcategory,''), coalesce(normalized_subcategory,''), coalesce(metadata.caption,''), "
    "coalesce(metadata.alt_text,'')))"
)
# SQL: products with their category name and audience.
ENRICHED = (
    "SELECT p.*, c.name AS category, c.audience AS category_audience FROM products p "
    "LEFT JOIN categories c ON c.id = p.category_id"
)
