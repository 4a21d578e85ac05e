"""Text and taxonomy expressions. Every function maps Columns to a Column; nothing leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.taxonomy import QueryVocabulary, Taxonomy, escape_regex

WORD_CHAR = r"[\p{L}\p{N}_]"


def or_else(column: Column, value) -> Column:
    return F.coalesce(column, F.lit(value))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty, or null."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def _sql_text(value) -> str:
    if isinstance(value, tuple):
        return f"array({', '.join(_sql_text(v) for v in value)})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def text_array(values: Iterable[str]) -> Column:
    """A constant array, built from one parsed text rather than one call per element."""
    return F.expr(_sql_text(tuple(values)))


def literal_map(entries: dict) -> Column:
    return F.expr(f"map({', '.join(f'{_sql_text(k)}, {_sql_text(v)}' for k, v in entries.items())})")


def strip(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def join_words(columns: Iterable[Column], separator: str = " ") -> Column:
    """Join with one separator per field; a missing field leaves an empty slot."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def count_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions]) if conditions else F.lit(0)


def alternation(terms: Iterable[str]) -> str:
    return "|".join(escape_regex(t) for t in terms)


def longest_first(terms: Iterable[str]) -> str:
    """An alternation that tries the longest of the terms at a place first, with common beginnings factored out.

    Terms that match at one place begin alike, so their order is the one of a list sorted by length; but a place where
    no term begins fails at its first letter and not after each term.
    """
    tree: dict = {}
    for term in terms:
        node = tree
        for letter in term:
            node = node.setdefault(letter, {})
        node[""] = {}

    def text(node: dict) -> str:
        ways = [escape_regex(letter) + text(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        joined = "|".join(ways)
        if "" in node:
            return f"(?:{joined})?"
        return joined if len(ways) == 1 else f"(?:{joined})"

    return text(tree)


# ---------------------------------------------------------------- terms


def term_pattern(*terms: str) -> str:
    """Whole term, optional plural s, not glued to another lower-case letter or digit."""
    return rf"(?<![a-z0-9])(?:{longest_first(terms)})s?(?![a-z0-9])"


def word_pattern(*words: str, suffix: str = "") -> str:
    return rf"(?<!{WORD_CHAR})(?:{longest_first(words)}){suffix}(?!{WORD_CHAR})"


def contains_term(text: Column, *terms: str) -> Column:
    return F.coalesce(text.rlike(term_pattern(*terms)), F.lit(False)) if terms else F.lit(False)


def contains_word(text: Column, *words: str) -> Column:
    return F.coalesce(text.rlike(word_pattern(*words)), F.lit(False))


def contains_text(text: Column, *parts: str) -> Column:
    return any_of([F.coalesce(text.contains(p), F.lit(False)) for p in parts])


def words_present(text: Column, words: Sequence[str], plural: bool = False) -> Column:
    """All listed words found as whole words (optionally with a plural s), in one regex pass."""
    words = list(dict.fromkeys(words))
    tail = "s?" if plural else ""
    implied = {}
    for surface in sorted({*words, *((w + "s" for w in words) if plural else ())}):
        implied[surface] = tuple(w for w in words if re.match(re.escape(w) + tail + r"(?!\w)", surface))
    pattern = rf"(?<!{WORD_CHAR})(?=((?:{longest_first(words)}){tail})(?!{WORD_CHAR}))"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(hits, lambda s: F.element_at(literal_map(implied), s))))


def in_list_order(present: Column, words: Sequence[str]) -> Column:
    return F.array_intersect(text_array(dict.fromkeys(words)), present)


def words_found(text: Column, words: Sequence[str], scan: Sequence[str] = (), plural: bool = False) -> Column:
    """The listed words that occur as whole words, in list order.

    Pass the same ``scan`` list to several calls and they share one pass over the text.
    """
    return in_list_order(words_present(text, [*(scan or words)], plural), words)


def parts_found(text: Column, parts: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(contains_text(text, p), F.lit(p)) for p in parts]))


def first_word(text: Column, words: Sequence[str], scan: Sequence[str] = (), plural: bool = False) -> Column:
    return F.get(words_found(text, words, scan, plural), F.lit(0))


def first_part(text: Column, parts: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(contains_text(text, p), F.lit(p)) for p in parts], F.lit(None).cast("string"))


# ---------------------------------------------------------------- taxonomy


def terms_present(text: Column, terms: Sequence[str]) -> Column:
    """All listed terms found in the text (already lower-cased), in one regex pass.

    The scan yields the longest surface form at each position. Shorter terms that start at the same
    position are implied by that surface, so they are looked up instead of searched for again.
    """
    terms = list(dict.fromkeys(terms))
    implied = {}
    for surface in sorted({*terms, *(t + "s" for t in terms)}):
        implied[surface] = tuple(t for t in terms if re.match(re.escape(t) + r"s?(?![a-z0-9])", surface))
    pattern = rf"(?<![a-z0-9])(?=((?:{longest_first(terms)})s?)(?![a-z0-9]))"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(hits, lambda s: F.element_at(literal_map(implied), s))))


def taxonomy_hits(text: Column, taxonomy: Taxonomy) -> Column:
    """The longest taxonomy surface starting at each position, found in one pass over the text."""
    pattern = rf"(?<![a-z0-9])(?=((?:{longest_first(t.term for t in taxonomy.terms)})s?)(?![a-z0-9]))"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))


def identify_product(text: Column, taxonomy: Taxonomy) -> Column:
    """struct(family, type) of the longest matching term; ties keep taxonomy order; nulls when none."""
    ranked = taxonomy.ranked_terms
    rank_of = {t.term: i for i, t in enumerate(ranked)}
    surface_rank = {}
    for term, rank in rank_of.items():
        surface_rank[term] = rank
    for term, rank in rank_of.items():
        surface_rank.setdefault(term + "s", rank)
    best = F.array_min(
        F.transform(taxonomy_hits(text, taxonomy), lambda s: F.element_at(literal_map(surface_rank), s))
    )
    entries = F.expr("array(" + ", ".join(
        f"named_struct('family', {_sql_text(t.family)}, 'type', {_sql_text(t.type)})" for t in ranked) + ")")
    found = F.get(entries, best)
    return F.struct(found["family"].alias("family"), found["type"].alias("type"))


def matched_types(text: Column, taxonomy: Taxonomy) -> Column:
    """Every type with a term in the text. Testing a per-row type then is array_contains, not a regex."""
    types = {s: kinds for s, (kinds, _) in taxonomy.surfaces.items()}
    return F.array_distinct(
        F.flatten(F.transform(taxonomy_hits(text, taxonomy), lambda s: F.element_at(literal_map(types), s)))
    )


def matched_families(text: Column, taxonomy: Taxonomy) -> Column:
    families = {s: fams for s, (_, fams) in taxonomy.surfaces.items()}
    return F.array_distinct(
        F.flatten(F.transform(taxonomy_hits(text, taxonomy), lambda s: F.element_at(literal_map(families), s)))
    )


def type_match(text: Column, kind: str | None, taxonomy: Taxonomy) -> Column:
    if not kind:
        return F.lit(True)
    return contains_term(F.lower(text), *taxonomy.type_terms(kind))


def family_match(text: Column, family: str | None, taxonomy: Taxonomy) -> Column:
    if not family:
        return F.lit(True)
    return contains_term(F.lower(text), *taxonomy.family_terms(family))


def slugify(value: Column) -> Column:
    dashed = F.regexp_replace(F.lower(or_else(value.cast("string"), "")), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def normalize_name(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", " "))


def squeeze_text(value: Column) -> Column:
    return or_else(strip(F.regexp_replace(value, r"\s+", " ")), "")


# ---------------------------------------------------------------- product texts


def product_search_text(p) -> Column:
    m = p["metadata"]
    style = F.concat_ws(" ", m["style"])
    return F.lower(join_words([
        p["product_name"], p["item_name"], p["description"], p["category"], p["subcategory"],
        p["normalized_main_category"], p["normalized_subcategory"], p["audience"],
        m["colour"], m["color"], style, m["fit"],
    ]))


def rerank_haystack(p) -> Column:
    m = p["metadata"]
    extra = join_words([
        m["primary_colour"], F.concat_ws(" ", m["secondary_colours"]), F.concat_ws(" ", m["style"]),
        m["product_type"],
    ])
    return F.lower(F.concat_ws(" ", product_search_text(p), extra))


def audience_text(p) -> Column:
    return F.lower(join_words([
        p["category_audience"], p["audience"], p["category"], p["normalized_main_category"],
        p["normalized_subcategory"],
    ]))


def discovery_text(p) -> Column:
    m = p["metadata"]
    main = join_words([
        p["product_name"], p["item_name"], p["description"], p["category"], p["subcategory"],
        p["normalized_subcategory"], p["source_hashtag"],
    ])
    return F.concat_ws(" ", main, join_words([F.concat_ws(" ", m["style"]), m["colour"]]))


def inventory_text(p) -> Column:
    return join_words([p["product_name"], p["description"], p["normalized_subcategory"], p["subcategory"]])


def training_text(p) -> Column:
    m = p["metadata"]
    return F.lower(join_words([
        p["product_name"], p["item_name"], p["description"], p["subcategory"], p["normalized_subcategory"],
        m["caption"], m["alt_text"],
    ]))


# ---------------------------------------------------------------- query understanding

# The audience words of the structured reranker.
WOMEN_WORDS = ("women", "womens", "woman", "female", "ladies")
MEN_WORDS = ("men", "mens", "man", "male")


GENDERS = ("women", "men", "unisex")


def named_genders(audience: Column) -> Column:
    """The genders that the audience text names as words."""
    return F.array_compact(F.array(*[F.when(contains_term(audience, g), F.lit(g)) for g in GENDERS]))


def gender_match_score(audience: Column, requested: Column, genders: Column | None = None) -> Column:
    """1 when the audience text names the requested gender as a word, .75 for unisex, else 0; .5 unset.

    ``genders`` are the ``named_genders`` of the audience, where they are known.
    """
    requested = F.nullif(requested, F.lit(""))
    names = lambda g: contains_term(audience, g) if genders is None else F.array_contains(genders, g)
    named = F.coalesce(
        *[F.when(requested == g, names(g)) for g in GENDERS],
        F.rlike(audience, F.concat(
            F.lit(r"(?<![a-z0-9])"), F.regexp_replace(requested, r"([\\.^$|()\[\]{}*+?\-])", r"\\$1"),
            F.lit(r"s?(?![a-z0-9])"))),
    )
    return (
        F.when(requested.isNull(), 0.5)
        .when(named, 1.0)
        .when(names("unisex"), 0.75)
        .otherwise(0.0)
    )


def canonical_gender(value: Column) -> Column:
    token = F.nullif(F.lower(strip(value)), F.lit(""))
    return F.when(token.isin(*WOMEN_WORDS), "women").when(token.isin(*MEN_WORDS), "men").otherwise(token)


def audience_signal(audience: Column, requested: Column) -> Column:
    """+1 for matching or unisex evidence, -1 for evidence of the other gender only, 0 otherwise."""
    tokens = F.regexp_extract_all(audience, F.lit("([a-z]+)"), F.lit(1))
    has = lambda words: F.arrays_overlap(tokens, text_array(words))
    women, men, unisex = has(WOMEN_WORDS), has(MEN_WORDS), has(("unisex",))
    wanted = canonical_gender(requested)
    match = F.when(wanted == "women", women).otherwise(men)
    opposite = F.when(wanted == "women", men).otherwise(women)
    return (
        F.when(wanted.isNull() | ~wanted.isin("women", "men"), 0.0)
        .when(unisex | match, 1.0)
        .when(opposite, -1.0)
        .otherwise(0.0)
    )


def _amount_after(text: Column, leads: str) -> Column:
    raw = F.regexp_extract(text, rf"(?:{leads})\s*(?:₹|rs\.?|inr)?\s*([\d,]+)", 1)
    return F.regexp_replace(raw, ",", "").try_cast("double")


def extract_query_attributes(query: Column, taxonomy: Taxonomy, words: QueryVocabulary) -> Column:
    """Read product type, colours, styles, fits, gender, price bounds and tokens out of a query."""
    text = strip(F.lower(query))
    product = identify_product(text, taxonomy)
    gender = F.coalesce(*[
        F.when(text.rlike(word_pattern(g, suffix="(?:'s)?")), F.lit(g)) for g in ("women", "men", "unisex")
    ])
    tokens = F.filter(
        F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1)),
        lambda t: (F.length(t) > 2) & ~t.isin(*words.token_stopwords),
    )
    scan = (*words.colours, *words.styles, *words.materials)
    return F.struct(
        product["type"].alias("product_type"),
        product["family"].alias("product_family"),
        words_found(text, words.colours, scan).alias("colours"),
        words_found(text, words.styles, scan).alias("styles"),
        parts_found(text, words.fits).alias("fits"),
        gender.alias("gender"),
        _amount_after(text, "under|below|less than|up to").alias("max_price"),
        _amount_after(text, "over|above|more than|from").alias("min_price"),
        first_part(text, words.occasions).alias("occasion"),
        first_word(text, words.materials, scan).alias("material"),
        parts_found(text, words.aesthetics).alias("aesthetic_terms"),
        tokens.alias("query_tokens"),
    )


def phrase_match_score(haystack: Column, phrases: Column, when_empty: float = 0.5) -> Column:
    """Share of the phrases contained in the haystack as plain substrings."""
    n = F.coalesce(F.size(phrases), F.lit(0))
    found = F.size(F.filter(phrases, lambda p: haystack.contains(p)))
    return F.when(n <= 0, F.lit(when_empty)).otherwise(found / n)


def lexical_token_score(haystack: Column, tokens: Column) -> Column:
    return phrase_match_score(haystack, tokens, 0.5)


def category_families(category_words: Column, taxonomy: Taxonomy) -> Column:
    """The families with a category word in the text."""
    return F.array_compact(F.array(*[
        F.when(contains_text(category_words, *taxonomy.words_for_category(f)), F.lit(f)) for f in taxonomy.families]))


def category_match_score(product_category_id: Column, families: Column, family: Column, category_id: Column) -> Column:
    """1/0 by category id when one is requested, else by the query's family among the ``category_families`` of the product."""
    by_family = F.coalesce(F.array_contains(families, family).cast("double"), F.lit(0.0))
    return (
        F.when(category_id.isNotNull(), F.coalesce((product_category_id == category_id).cast("double"), F.lit(0.0)))
        .when(F.nullif(family, F.lit("")).isNull(), 0.5)
        .otherwise(by_family)
    )


def type_signal(types: Column, families: Column, kind: Column, family: Column) -> Column:
    """1 when the requested type matches, .5 for its family only, 0 otherwise or when nothing is requested."""
    return (
        F.when(F.coalesce(F.array_contains(types, kind), F.lit(False)), 1.0)
        .when(F.coalesce(F.array_contains(families, family), F.lit(False)), 0.5)
        .otherwise(0.0)
    )


# ---------------------------------------------------------------- titles


# The patterns that mark a product name as a leaked caption.
CAPTION_START = r"^(?:photo|video|reel)s?\s+(?:by|shared by)(?![\p{L}\p{N}_])"
ENGAGEMENT_ALT = r"^[\d,]+\s+likes?,\s*[\d,]+\s+comments?(?![\p{L}\p{N}_])"
QUESTION_START = (
    r"(?i)^(what|how|why|which|who|when|where|do you|did you|have you|are you|is your|can you|would you)"
    r"(?![\p{L}\p{N}_])"
)
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]+"
MAX_PRESENTABLE_WORDS = 12


def looks_like_unparsed_caption(text: Column) -> Column:
    lowered = F.lower(strip(text))
    return F.coalesce(
        lowered.rlike(CAPTION_START)
        | lowered.contains("may be an image of")
        | lowered.rlike(r"@[a-z0-9_.]+")
        | lowered.rlike(ENGAGEMENT_ALT),
        F.lit(False),
    )


def looks_like_caption(text: Column) -> Column:
    candidate = strip(or_else(text, ""))
    bare = strip(F.regexp_replace(candidate, EMOJI, ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    glued = F.size(F.filter(words, lambda w: w.rlike("[a-z][A-Z]")))
    soup = F.when(bare == "", True).otherwise(glued / F.size(words) >= 0.5)
    n_words = F.size(F.filter(F.split(candidate, r"\s+"), lambda w: w != ""))
    return F.when(candidate == "", False).otherwise(
        looks_like_unparsed_caption(candidate)
        | candidate.endswith("?")
        | candidate.rlike(QUESTION_START)
        | soup
        | (n_words > MAX_PRESENTABLE_WORDS)
    )


def presentable_brand(name: Column) -> Column:
    """Turn a raw handle into a display name; a name that already has capitals is left alone."""
    name = strip(or_else(name, ""))
    pieces = F.filter(F.split(name, r"[._]+"), lambda x: x != "")
    n = F.size(pieces)
    last = F.coalesce(F.element_at(pieces, -1), F.lit(""))
    domain_like = (n > 1) & (F.length(last) <= 3) & last.rlike(r"^\p{L}+$")
    kept = F.when(domain_like, F.slice(pieces, F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(pieces)
    capital = F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))
    # Try-catch free: an empty handle has no pieces, so it stays as it is.
    return (
        F.when((name == "") | (name != F.lower(name)), name)
        .when(n == 0, name)
        .otherwise(F.array_join(capital, " "))
    )


def constructed_title(p, taxonomy: Taxonomy, colours: Sequence[str]) -> Column:
    """Brand + colour + type, when at least two distinct parts are known; null otherwise."""
    text = F.lower(join_words([p["description"], p["product_name"], p["item_name"]]))
    colour = F.initcap(first_word(text, colours))
    kind = identify_product(text, taxonomy)["type"]
    label = F.element_at(literal_map(taxonomy.type_labels), kind)
    parts = F.array_distinct(F.array_compact(F.array(
        F.nullif(presentable_brand(p["brand_name"]), F.lit("")), colour, label)))
    return F.when(F.size(parts) >= 2, F.array_join(parts, " "))
