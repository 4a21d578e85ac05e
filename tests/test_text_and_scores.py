from pyspark.sql import functions as F

from vitrine.functions import classify as C
from vitrine.functions import posts as P
from vitrine.functions import scores as S
from vitrine.functions import text as X
from vitrine.taxonomy import FASHION, FASHION_WORDS, Taxonomy


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_longest_term_wins_and_material_is_no_type(spark):
    kind = lambda t: tuple(one(spark, t, lambda c: X.identify_product(c, FASHION)))
    assert kind("denim bag") == ("bags", "bag")
    assert kind("a cropped crop top") == ("tops", "crop-top")
    assert kind("Two KURTAS") == ("ethnic-upperwear", "kurta")
    assert kind("stopwatches") == (None, None)
    assert kind("nothing here") == (None, None)


def test_implied_terms_and_plurals(spark):
    found = one(spark, "tank tops and earrings", lambda c: X.matched_types(c, FASHION))
    assert set(found) == {"tank-top", "top", "earrings"}
    assert one(spark, "topper", lambda c: X.matched_types(c, FASHION)) == []


def test_single_pass_equals_term_by_term(spark):
    texts = ["wide leg jeans", "hoop earrings hoops", "co-ord set, matching sets", "tops top topss", "going-out top!", "", "bag-bags handbagx"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    types = [k for _, k in FASHION.types]
    scanned = X.matched_types(F.col("t"), FASHION)
    tested = F.array_compact(F.array(*[F.when(X.type_match(F.col("t"), k, FASHION), F.lit(k)) for k in types]))
    for row in df.select(F.array_sort(scanned).alias("a"), F.array_sort(tested).alias("b")).collect():
        assert row["a"] == row["b"]


def test_men_is_not_part_of_women(spark):
    gate = lambda g: one(spark, "women tops", lambda c: X.gender_match_score(c, F.lit(g)))
    assert gate("women") == 1.0 and gate("men") == 0.0
    assert one(spark, "unisex", lambda c: X.gender_match_score(c, F.lit("men"))) == 0.75


def test_query_attributes(spark):
    a = one(spark, "Red silk party dress for women under rs. 2,500", lambda c: X.extract_query_attributes(c, FASHION, FASHION_WORDS))
    assert (a["product_type"], a["colours"], a["gender"], a["max_price"], a["material"]) == ("party-dress", ["red"], "women", 2500.0, "silk")
    assert a["min_price"] is None and "under" not in a["query_tokens"]


def test_price_states(spark):
    states = [one(spark, t, S.price_status) for t in (None, "-500", "0", "n/a", "50", "99999999", "2499")]
    assert states == ["MISSING", "INVALID", "INVALID", "INVALID", "SUSPICIOUS", "SUSPICIOUS", "VALID"]


def test_captions_and_titles(spark):
    like = lambda t: one(spark, t, X.looks_like_caption)
    assert like("Photo by a on Monday") and like("What is this?") and like("4 likes, 0 comments - x") and like("VelvetBreeze CoastalWear")
    assert not like("Linen shirt") and not like("")
    assert one(spark, "quillhaven.in", X.presentable_brand) == "Quillhaven"
    assert one(spark, "_sunloom_", X.presentable_brand) == "Sunloom"
    assert one(spark, "QZX", X.presentable_brand) == "QZX"


def test_post_fields(spark):
    assert one(spark, "only ₹1,899 now", P.extract_price) == 1899.0
    assert one(spark, "price 2.5k", P.extract_price) == 2500.0
    assert one(spark, "no price", P.extract_price) is None
    assert one(spark, "12.5k followers", lambda c: P.parse_count(c, "followers")) == 12500
    assert one(spark, "https://www.instagram.com/a/p/XY9/?x=1", P.post_id) == "XY9"
    assert one(spark, "https://instagram.com/reel/abc", lambda c: P.parse_identity(c)["username"]) is None
    assert one(spark, "@Some.One", lambda c: P.parse_identity(c)["username"]) == "some.one"


def test_categories(spark):
    def decide(text):
        present = X.terms_present(F.lower(F.col("t")), C.ALL_TERMS)
        df = spark.createDataFrame([(text,)], "t string").select(present.alias("p"))
        return df.select(C.classify_terms(F.col("p"), C.audience(F.col("p"))["audience"]).alias("d")).first()["d"]

    assert decide("silver necklace")["category_slug"] == "accessories-jewellery"
    assert decide("necklace and dress")["category_slug"] is None
    assert decide("dress for ladies")["category_slug"] == "women-dresses"
    assert decide("blue jeans for men")["category_slug"] == "men-jeans"
    assert decide("shirt")["confidence"] == 0.55


def test_weighted_mean_drops_absent_parts(spark):
    df = spark.createDataFrame([(1.0, None), (0.5, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(S.weighted_mean_nonnull([(F.col("a"), 0.6), (F.col("b"), 0.4)])).collect()]
    assert got == [1.0, 0.3]


def test_taxonomy_round_trip(spark):
    again = Taxonomy.from_dataframe(FASHION.to_dataframe(spark))
    assert again.terms == FASHION.terms


def test_factored_alternations_find_what_a_list_finds():
    """Terms that begin alike, contain each other or end in s: the same hits as the list sorted by length."""
    import re

    from vitrine.functions.text import alternation, longest_first
    from vitrine.taxonomy import FASHION

    for terms in (["tee", "teen", "tees", "t-shirt", "t-shirts", "t", "co-ord", "coord", "a.b", "a"], sorted({t.term for t in FASHION.terms})):
        by_length = alternation(sorted(terms, key=lambda t: (-len(t), t)))
        scan = lambda ways: re.compile(rf"(?<![a-z0-9])(?=((?:{ways})s?)(?![a-z0-9]))")
        texts = [f"{a}{glue}{b}s {b}" for a in terms[:40] for b in terms[:40] for glue in (" ", "-", "", "s ", ".")]
        for text in texts:
            assert scan(longest_first(terms)).findall(text) == scan(by_length).findall(text), text


def test_a_scan_does_not_try_every_term_at_every_place():
    from vitrine.functions.text import longest_first
    from vitrine.taxonomy import FASHION

    terms = {t.term for t in FASHION.terms}
    depth, ways = 0, 1
    for c in longest_first(terms)[3:-1]:
        depth += (c == "(") - (c == ")")
        ways += c == "|" and depth == 0
    assert ways == len({t[0] for t in terms}) < len(terms) / 2
