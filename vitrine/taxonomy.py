"""Product taxonomy: family -> type -> terms, plus the rule tables used to categorise products.

Every operator takes a ``Taxonomy`` as a parameter. A taxonomy is a few hundred terms at most, so its
patterns are compiled into the expressions as literals; ``Taxonomy.from_dataframe`` checks that bound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

MAX_TAXONOMY_TERMS = 5_000


def escape_regex(term: str) -> str:
    """Escape a term for Java regular expressions and RE2 alike."""
    return re.sub(r"([\\.^$|()\[\]{}*+?\-])", r"\\\1", term)


@dataclass(frozen=True)
class Term:
    family: str
    family_pos: int
    type: str
    type_pos: int
    term: str
    term_pos: int


@dataclass(frozen=True)
class Taxonomy:
    tree: dict[str, dict[str, tuple[str, ...]]]
    family_labels: dict[str, str] = field(default_factory=dict)
    type_label_overrides: dict[str, str] = field(default_factory=dict)
    category_words: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __hash__(self) -> int:
        return id(self)

    @cached_property
    def terms(self) -> list[Term]:
        rows = []
        for family_pos, (family, types) in enumerate(self.tree.items()):
            for type_pos, (kind, words) in enumerate(types.items()):
                rows += [Term(family, family_pos, kind, type_pos, word, i) for i, word in enumerate(words)]
        return rows

    @cached_property
    def ranked_terms(self) -> list[Term]:
        """Longest term first; equal lengths keep taxonomy order. A repeated term keeps its first place."""
        ordered = sorted(self.terms, key=lambda t: (-len(t.term), t.family_pos, t.type_pos, t.term_pos))
        first: dict[str, Term] = {}
        for row in ordered:
            first.setdefault(row.term, row)
        return list(first.values())

    @cached_property
    def families(self) -> list[str]:
        return list(self.tree)

    @cached_property
    def types(self) -> list[tuple[str, str]]:
        return [(family, kind) for family, kinds in self.tree.items() for kind in kinds]

    def type_terms(self, kind: str | None) -> tuple[str, ...]:
        for kinds in self.tree.values():
            if kind in kinds:
                return kinds[kind]
        return ()

    def family_terms(self, family: str | None) -> tuple[str, ...]:
        words = [w for kind in self.tree.get(family or "", {}).values() for w in kind]
        return tuple(dict.fromkeys(words))

    def family_label(self, family: str) -> str:
        return self.family_labels.get(family, family.replace("-", " ").title())

    def type_label(self, kind: str) -> str:
        return self.type_label_overrides.get(kind, kind.replace("-", " ").title())

    @cached_property
    def type_labels(self) -> dict[str, str]:
        return {kind: self.type_label(kind) for _, kind in self.types}

    def words_for_category(self, family: str) -> tuple[str, ...]:
        return self.category_words.get(family, self.family_terms(family))

    @cached_property
    def surfaces(self) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
        """Surface form -> every (type, family) whose term starts there and ends on a word boundary.

        A scan of the text yields the longest surface at each position; shorter terms that start at the
        same position ("tank" inside "tank top") are implied by it and looked up here.
        """
        found = {}
        for surface in sorted({t.term for t in self.terms} | {t.term + "s" for t in self.terms}):
            hits = [t for t in self.terms if re.match(re.escape(t.term) + r"s?(?![a-z0-9])", surface)]
            found[surface] = (
                tuple(dict.fromkeys(t.type for t in hits)),
                tuple(dict.fromkeys(t.family for t in hits)),
            )
        return found

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(t.family, t.family_pos, t.type, t.type_pos, t.term, t.term_pos) for t in self.terms]
        return spark.createDataFrame(
            rows, "family string, family_pos int, type string, type_pos int, term string, term_pos int"
        )

    @classmethod
    def from_dataframe(cls, df: DataFrame, **labels) -> "Taxonomy":
        rows = df.limit(MAX_TAXONOMY_TERMS + 1).collect()
        if len(rows) > MAX_TAXONOMY_TERMS:
            raise ValueError(f"a taxonomy may hold at most {MAX_TAXONOMY_TERMS} terms")
        tree: dict[str, dict[str, list[str]]] = {}
        for r in sorted(rows, key=lambda r: (r.family_pos, r.type_pos, r.term_pos)):
            tree.setdefault(r.family, {}).setdefault(r.type, []).append(r.term)
        return cls({f: {k: tuple(v) for k, v in kinds.items()} for f, kinds in tree.items()}, **labels)


# The fashion taxonomy, in matching order.
FASHION = Taxonomy(
    tree={
        "tops": {
            "crop-top": ("crop top", "cropped top"),
            "tank-top": ("tank top", "tank", "camisole", "cami"),
            "corset-top": ("corset top", "corset", "bustier", "fitted top"),
            "party-top": ("party top", "going out top", "going-out top"),
            "casual-top": ("casual top",),
            "blouse": ("blouse",),
            "top": ("top", "tops"),
        },
        "ethnic-upperwear": {
            "kurta": ("kurta", "kurtas"),
            "kurti": ("kurti", "kurtis"),
            "ethnic-top": ("ethnic top", "tunic"),
        },
        "shirts": {
            "oversized-shirt": ("oversized shirt",),
            "linen-shirt": ("linen shirt",),
            "shirt": ("shirt", "shirts", "button-down", "button down"),
        },
        "bottoms": {
            "cargo-pants": ("cargo pants", "cargo pant", "cargo trouser", "utility trouser"),
            "wide-leg-jeans": ("wide leg jeans", "wide-leg jeans"),
            "jeans": ("jeans",),
            "trousers": ("trousers", "trouser", "pants"),
            "shorts": ("shorts",),
            "skirts": ("skirt", "skirts"),
        },
        "dresses": {
            "mini-dress": ("mini dress",),
            "party-dress": ("party dress",),
            "dress": ("dress", "dresses", "gown"),
        },
        "sets": {"co-ord-set": ("co-ord", "co ord", "coord", "matching set")},
        "outerwear": {"jacket": ("jacket", "blazer", "coat", "outerwear")},
        "jewellery": {
            "earrings": ("earring", "earrings", "hoop earrings", "hoops"),
            "necklace": ("necklace", "necklaces"),
            "ring": ("ring", "rings"),
            "bracelet": ("bracelet", "bracelets", "bangle"),
            "anklet": ("anklet", "anklets"),
            "jewellery": ("jewellery", "jewelry"),
        },
        "bags": {
            "tote": ("tote", "tote bag"),
            "shoulder-bag": ("shoulder bag",),
            "sling-bag": ("sling bag", "sling"),
            "clutch": ("clutch",),
            "crossbody": ("crossbody", "crossbody bag"),
            "backpack": ("backpack",),
            "bag": ("bag", "bags", "handbag"),
        },
        "footwear": {
            "sneakers": ("sneaker", "sneakers", "trainer", "trainers"),
            "heels": ("heel", "heels"),
            "sandals": ("sandal", "sandals"),
            "loafers": ("loafer", "loafers"),
            "boots": ("boot", "boots"),
        },
        "watches": {"watch": ("watch", "watches", "timepiece", "chronograph")},
        "lingerie": {"lingerie": ("lingerie",)},
        "underwear": {"underwear": ("underwear", "innerwear")},
        "hoodies": {"hoodie": ("hoodie", "hoodies")},
        "socks": {"socks": ("sock", "socks")},
    },
    family_labels={"ethnic-upperwear": "Ethnic Upperwear"},
    type_label_overrides={"co-ord-set": "Co-ord Sets", "kurta": "Kurtas", "kurti": "Kurtis"},
    category_words={
        "tops": ("top", "blouse"),
        "ethnic-upperwear": ("ethnic", "kurta", "kurti", "tunic"),
        "shirts": ("shirt", "top"),
        "bottoms": ("bottom", "pants", "trouser", "jeans", "skirt", "shorts"),
        "dresses": ("dress", "gown"),
        "sets": ("co-ord", "coord", "set"),
        "outerwear": ("jacket", "outerwear"),
        "jewellery": ("jewellery", "jewelry", "accessories"),
        "bags": ("bag", "accessories"),
        "footwear": ("footwear", "shoe", "sneaker"),
        "watches": ("watch", "accessories"),
    },
)


@dataclass(frozen=True)
class QueryVocabulary:
    """Word lists used to read attributes from a search query and from captions."""

    colours: tuple[str, ...]
    styles: tuple[str, ...]
    fits: tuple[str, ...]
    materials: tuple[str, ...]
    occasions: tuple[str, ...]
    aesthetics: tuple[str, ...]
    caption_colours: tuple[str, ...]
    caption_styles: tuple[str, ...]
    caption_fits: tuple[str, ...]
    caption_materials: tuple[str, ...]
    caption_patterns: tuple[str, ...]
    caption_occasions: tuple[str, ...]
    training_styles: tuple[str, ...]
    token_stopwords: tuple[str, ...]


# The fashion word lists, in matching order.
FASHION_WORDS = QueryVocabulary(
    colours=("black", "white", "silver", "gold", "brown", "beige", "blue", "navy", "red", "green", "pink",
             "purple", "grey", "gray", "orange", "yellow"),
    styles=("minimalist", "minimal", "stylish", "trendy", "contemporary", "streetwear", "vintage", "formal",
            "party", "going out", "quiet luxury", "luxury", "sporty", "classic", "boho", "ethnic", "gym",
            "activewear", "athletic", "workout", "sportswear"),
    fits=("oversized", "slim", "relaxed", "wide leg", "straight leg", "cropped"),
    materials=("linen", "cotton", "silk", "denim", "leather", "satin", "wool"),
    occasions=("college party", "date night", "festive", "wedding", "party", "college", "work"),
    aesthetics=("quiet luxury", "minimal", "minimalist", "trendy", "stylish", "streetwear", "contemporary",
                "cute"),
    caption_colours=("black", "white", "silver", "gold", "brown", "beige", "blue", "navy", "red", "green",
                     "pink", "purple", "grey", "orange", "yellow"),
    caption_styles=("minimal", "streetwear", "party", "formal", "casual", "ethnic", "y2k", "vintage",
                    "quiet luxury", "boho", "sporty", "trendy", "contemporary"),
    caption_fits=("oversized", "fitted", "slim", "relaxed", "wide leg", "straight leg", "cropped"),
    caption_materials=("linen", "cotton", "silk", "denim", "leather", "satin", "wool", "velvet"),
    caption_patterns=("floral", "striped", "checked", "printed", "solid", "embroidered"),
    caption_occasions=("party", "festive", "wedding", "college", "work", "date night", "everyday"),
    training_styles=("minimal", "streetwear", "party", "formal", "casual", "ethnic", "y2k", "vintage",
                     "quiet luxury", "boho", "sporty", "trendy"),
    token_stopwords=("under", "below", "with", "from", "this", "that"),
)
