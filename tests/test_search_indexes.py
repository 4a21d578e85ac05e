"""The vector index and the trigram join against brute force, and how much of the data they look at."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import activity as A
from vitrine.operators import ivf as I
from vitrine.operators import lexical as L
from vitrine.operators.topk import exact_topk


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 vectors around 60 centres, and 40 queries near some of them; every seventh item has no vector."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 24))
    rows = [(f"p{i}", None if i % 7 == 0 else (centres[i % 60] + 0.25 * rng.standard_normal(24)).tolist(), i % 5) for i in range(3000)]
    asked = [(f"q{i}", (centres[i] + 0.25 * rng.standard_normal(24)).tolist(), [1, 2] if i % 4 == 0 else None) for i in range(40)]
    items = spark.createDataFrame(rows, "id string, embedding array<float>, category_id long").repartition(6)
    return spark.createDataFrame(asked, "qid string, embedding array<float>, scope array<bigint>"), items


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf"))
    I.write_index(clustered[1], I.fit_centroids(clustered[1], 64, sample=2000), path)
    return I.open_index(spark, path)


def rows(df):
    return sorted((r.qid, r["rank"], r.id, r.similarity) for r in df.collect())


def test_bounds_make_the_index_exact(clustered, index):
    queries, items = clustered
    want = rows(exact_topk(queries, items, 10))
    assert rows(I.ivf_topk(queries, *index, 10, probes=1, exact=True)) == want
    assert rows(I.ivf_topk(queries, *index, 10, probes=64)) == want
    assert rows(I.ivf_topk(queries, *index, 400, probes=1, exact=True)) == rows(exact_topk(queries, items, 400))


def test_recall_of_a_few_cells(clustered, index):
    queries, items = clustered
    found = I.ivf_topk(queries, *index, 10, probes=4)
    got = I.recall_at_k(found, exact_topk(queries, items, 10)).first()
    assert (got.queries, got.wanted) == (40, 400) and got.recall >= 0.9
    assert I.scanned_share(queries, *index, 4).first().share < 0.1


def test_far_cells_stay_closed(clustered, index):
    queries, items = clustered
    store, centroids = index
    rims = store.groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    probed = I.probes_of(queries, centroids, rims)
    floors = exact_topk(queries, items, 10).where("rank = 10").select("qid", F.col("similarity").alias("floor"))
    opened = probed.join(floors, "qid").where("bound >= floor").count()
    assert opened < 0.5 * probed.count()
    truth = exact_topk(queries, items, 10).join(store.select("id", "cell"), "id").join(probed.select("qid", "cell", "bound"), ["qid", "cell"])
    assert truth.where("similarity > bound + 1e-6").count() == 0


def test_index_of_few_rows(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", None)], "id string, embedding array<float>")
    centroids = I.fit_centroids(items, 8)
    store = I.assign_cells(items, centroids)
    queries = spark.createDataFrame([("q", [1.0, 0.1])], "qid string, embedding array<float>")
    assert [r.id for r in I.ivf_topk(queries, store, centroids, 5, probes=1, exact=True).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        I.fit_centroids(items.where("id = 'c'"), 8)


# ---------------------------------------------------------------- trigrams


def grams(text):
    return {f"  {w} "[i:i + 3] for w in text.lower().split() for i in range(len(w) + 1)}


def similarity(needle, name):
    words, want = name.lower().split(), grams(needle)
    runs = [grams(" ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
    return max((len(want & g) / len(want | g) for g in runs), default=0.0) if want else 0.0


def test_trigram_pairs_match_all_pairs(spark):
    rng = random.Random(2)
    syllables = ["ka", "lo", "min", "ter", "sa", "ru", "vel", "do", "xi", "pan"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(300)} | {"", "z"})
    texts = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)} | {"", "z"})
    got = L.trigram_pairs(spark.createDataFrame([(t,) for t in texts], "query string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    want = {(t, n): round(similarity(t, n), 9) for t in texts for n in names if similarity(t, n) > L.TRIGRAM_FLOOR}
    assert {(r["query"], r["name"]): round(r["similarity"], 9) for r in got} == want


# ---------------------------------------------------------------- similar brands


def test_similar_brands_in_any_number_of_blocks(spark, monkeypatch):
    rng = random.Random(4)
    products = [(f"b{rng.randint(0, 29)}", rng.choice([None, *range(12)]), rng.random()) for _ in range(600)]
    table = spark.createDataFrame(products, "brand_id string, category_id long, niche_score double")
    brands = table.select(F.col("brand_id").alias("id")).distinct()
    counts = Counter((b, c) for b, c, _ in products)
    niche = {b: round(sum(n for x, _, n in products if x == b) / sum(1 for x, _, _ in products if x == b), 12) for b, _, _ in products}
    own = {b: {c for x, c in counts if x == b and c is not None} for b in niche}
    want = {}
    for t in niche:
        scored = sorted((-round(0.65 * sum(counts[b, c] for c in own[t]) / max(1, len(own[t])) + 0.35 * (1 - min(1, abs(niche[b] - niche[t]))), 6), b) for b in niche if b != t)
        want[t] = [-s for s, _ in scored[:8]]
    whole = A.similar_brands(brands, brands, table)
    monkeypatch.setattr(A, "BRAND_BLOCK", 7)
    monkeypatch.setattr(A, "DENSE_CELLS", 40)
    for found in (whole, A.similar_brands(brands, brands, table, block=4)):
        got = {}
        for r in found.orderBy("target_id", "position").collect():
            got.setdefault(r.target_id, []).append(round(r.similarity_score, 6))
        assert got == want


def lexical_catalog(spark, n):
    meta = "struct<product_type:string,product_family:string,primary_colour:string,secondary_colours:array<string>,style:array<string>,hashtags:array<string>,caption:string>"
    return spark.range(n).selectExpr(
        "cast(id AS string) AS id", "id % 3 AS category_id", "'ACTIVE' AS catalog_status",
        "element_at(array('red silk ring', 'blue ring ring', 'silk red ring', 'plain bolt'), cast(id % 4 AS int) + 1) AS product_name",
        "cast(NULL AS string) AS normalized_main_category", "cast(NULL AS string) AS normalized_subcategory", "cast(NULL AS string) AS subcategory",
        "concat('item', id) AS description", "concat('Brand', id % 2) AS brand", f"cast(NULL AS {meta}) AS metadata")


def test_lexical_work_follows_kinds_of_products_and_texts_of_queries(spark):
    """2,400 products of 12 kinds and 600 queries of 5 texts: what the alternatives meet does not grow with either."""
    from vitrine.operators import lexical as L

    products = lexical_catalog(spark, 2_400)
    texts = ["ring", '"red silk"', "ring -red OR bolt", "rinng", "silk"]
    queries = spark.createDataFrame([(str(n), texts[n % 5], [0, 2] if n % 2 else None) for n in range(600)], "qid string, query string, scope array<bigint>")
    alternatives = queries.where("qid < '3'").select(F.explode(L.parse_search(F.col("query"))).alias("a")).select("a.*")
    kinds = L.product_kinds(alternatives, L.index_products(products), 7)
    assert kinds.count() == kinds.select("kind").distinct().count() * 7 <= 12 * 7
    got = {}
    for r in L.lexical_search(queries, products, 7).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["source"]))
    names = {r["id"]: (r["product_name"], r["category_id"]) for r in products.collect()}
    weight = {
        "ring": lambda n: n.split().count("ring"), '"red silk"': lambda n: "red silk" in n, "silk": lambda n: "silk" in n,
        "ring -red OR bolt": lambda n: max(n.split().count("ring") * ("red" not in n), "bolt" in n)}
    for q in queries.collect():
        mine = sorted(got.get(q["qid"], []))
        assert len(mine) == 7 and [r for r, _, _ in mine] == list(range(1, 8))
        able = {i: n for i, (n, c) in names.items() if q["scope"] is None or c in q["scope"]}
        if q["query"] == "rinng":
            assert all("ring" in able[i] and source == "trigram" for _, i, source in mine)
            assert [i for _, i, _ in mine] == sorted(i for i, n in able.items() if "ring" in n)[:7]
        else:
            want = sorted((-weight[q["query"]](n), i) for i, n in able.items() if weight[q["query"]](n))[:7]
            assert [(i, source) for _, i, source in mine] == [(i, "text") for _, i in want]


def test_products_with_one_id_and_two_texts_are_searched(spark):
    from vitrine.operators import lexical as L

    products = lexical_catalog(spark, 4).withColumn("id", F.lit("same")).withColumn("category_id", F.lit(1).cast("long"))
    queries = spark.createDataFrame([("q", "silk"), ("p", "bolt")], "qid string, query string")
    assert sorted((r["qid"], r["id"]) for r in L.lexical_search(queries, products.union(products), 7).collect() if r["source"] == "text") == [("p", "same"), ("q", "same")]
