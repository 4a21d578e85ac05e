import json
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from registry import hardware as H
from registry.core import Tables
from vitrine import session
from vitrine.operators import activity as A
from vitrine.operators import discovery as D
from vitrine.operators import evaluation as E
from vitrine.operators import quality as Q
from vitrine.operators import retrieval as V
from vitrine.operators import sizes
from vitrine.operators.sizes import skew_safe_join
from vitrine.operators.topk import nearest_prototype
from vitrine.plans import ingest as I
from vitrine.sources import files as S


def test_metrics_by_hand(spark):
    queries = spark.createDataFrame([("q",), ("none",), ("empty",)], "qid string")
    run = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("none", "a", 1)], "qid string, product_id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("empty", "a", 1)], "qid string, product_id string, grade int")
    judged = spark.createDataFrame([("q", "a"), ("q", "b")], "qid string, product_id string")
    rows = {r["qid"]: r for r in E.eval_metrics(queries, run, qrels, judged).collect()}
    assert rows["q"]["ndcg_at_10"] == pytest.approx((2 / 1.584962500721156) / (2 + 1 / 1.584962500721156), abs=1e-8)
    assert (rows["q"]["recall_at_20"], rows["q"]["precision_at_10"], rows["q"]["reciprocal_rank"], rows["q"]["unjudged_in_top_20"]) == (0.5, 0.1, 0.5, 1)
    assert rows["none"]["ndcg_at_10"] is None and rows["empty"]["ndcg_at_10"] == 0.0
    summary = E.eval_summary(E.eval_metrics(queries, run, qrels, judged)).first()
    assert summary["num_scored"] == 2 and summary["zero_result_rate"] == pytest.approx(1 / 3)


def rail(spark, rows):
    return spark.createDataFrame([("r", i, b, f, s, 0.0) for i, b, f, s in rows], "rail string, id string, brand string, product_family string, s1 double, s2 double")


def test_diversify_caps_a_brand(spark):
    rows = [(str(i), "a" if i < 4 else "b", "tops", 10.0 - i) for i in range(6)]
    got = D.diversify(rail(spark, rows), 4).orderBy("position").collect()
    assert [r["id"] for r in got] == ["0", "1", "4", "5"]


def test_diversify_prunes_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"{i:03d}", rng.choice("abcdefgh"), rng.choice(["x", "y", "z"]), float(rng.randint(0, 40))) for i in range(160)]
    got = [r["id"] for r in D.diversify(rail(spark, rows), 12, seed="s").orderBy("position").collect()]
    turn = {r["f"]: r["t"] for r in spark.createDataFrame([("x",), ("y",), ("z",)], "f string").select("f", F.xxhash64(F.lit("s"), F.col("f")).alias("t")).collect()}
    queues = {f: [r for r in sorted(rows, key=lambda r: (-r[3], r[0])) if r[2] == f] for f in sorted("xyz", key=lambda f: turn[f])}
    taken, brands, fams = [], {}, dict.fromkeys(queues, 0)
    for cap in (3, 10**9):
        moved = True
        while moved and len(taken) < 12:
            moved = False
            for f, queue in queues.items():
                if len(taken) < 12 and fams[f] < cap:
                    while queue and brands.get(queue[0][1], 0) >= 2:
                        queue.pop(0)
                    if queue:
                        row = queue.pop(0)
                        taken.append(row[0])
                        brands[row[1]] = brands.get(row[1], 0) + 1
                        fams[f] += 1
                        moved = True
    assert got == taken


def test_seed_is_stable(spark):
    rows = rail(spark, [(str(i), str(i), f"f{i % 7}", 1.0) for i in range(30)])
    order = lambda seed: [r["id"] for r in D.diversify(rows, 10, seed=seed).orderBy("position").collect()]
    assert order("u1") == order("u1") and any(order("u1") != order(f"v{i}") for i in range(3))


def posts(spark, rows):
    return spark.createDataFrame(rows, "n long, product_url string, image_url string, brand_name string, instagram_post_id string")


def sequential(rows):
    seen, kept = set(), []
    for n, url, image, brand, _ in rows:
        keys = {("u", url.lower()), ("i", brand, image)}
        if not keys & seen:
            seen |= keys
            kept.append(n)
    return kept


def test_exact_dedupe_follows_the_sequential_rule(spark):
    rng = random.Random(11)
    rows = [(i, f"https://x.example/{rng.randint(0, 25)}", f"img{rng.randint(0, 25)}", "b", "") for i in range(80)]
    got = sorted(r["n"] for r in I.dedupe_posts_exact(posts(spark, rows), "n").select("n").collect())
    assert got == sequential(rows)
    chain = [(0, "https://x.example/a", "i1", "b", ""), (1, "https://x.example/a", "i2", "b", ""), (2, "https://x.example/c", "i2", "b", "")]
    assert sorted(r["n"] for r in I.dedupe_posts_exact(posts(spark, chain), "n").collect()) == [0, 2]
    assert [r["n"] for r in I.dedupe_posts(posts(spark, chain), "n").collect()] == [0]


def test_hot_key_join_is_whole(spark, monkeypatch):
    monkeypatch.setattr(sizes, "HOT_ROWS", 50)
    left = spark.range(400).select(F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 20).cast("string"))).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    joined = skew_safe_join(left, right, ["k"], "n")
    assert joined.count() == 400 and joined.where("k = 'hot'").select("n").distinct().first()["n"] == 300


def test_nearest_ranks_are_exact(spark):
    rng = random.Random(5)
    values = [round(rng.expovariate(0.1), 1) for _ in range(997)] + [7.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["name"]: r["value"] for r in D.nearest_ranks(df, "v", {"a": 0.1, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    ordered = sorted(values)
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.95), ("d", 1.0)):
        assert got[name] == ordered[round(p * (len(ordered) - 1))]


def test_brand_batch_files(spark, tmp_path):
    path = tmp_path / "batch_001.csv"
    path.write_text("brand_name,instagram_url,instagram_handle,category_hint,priority,source,status,notes\n"
                    "A,,HandleA,,,user_curated,pending,first\nA2,,handlea/,,,user_curated,approved,second\nB,,,,,user_curated,approved,\nC,,c,,,nowhere,approved,\n")
    kept, rejected = S.read_brand_batch(spark, str(path))
    assert [(r["brand_name"], r["batch_id"]) for r in kept.collect()] == [("A2", "batch_001")]
    assert [r["reason"] for r in rejected.collect()] == ["invalid source"]


def test_query_set_and_run_files(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps([
        {"id": "q1", "query": "ring", "relevant": {"p1": 2}, "judged": ["p1", "p2"]}, {"id": "q1", "query": "", "relevant": {}, "judged": []}]))
    queries, qrels, judged, violations = S.read_queryset(spark, str(tmp_path / "set.json"))
    assert queries.count() == 2 and qrels.count() == 1 and judged.count() == 2
    bad = {r["rule"]: r["violations"] for r in violations.collect()}
    assert bad["duplicate_id"] == 1 and bad["blank_query"] == 1 and bad["nothing_relevant"] == 1 and bad["invalid_grade"] == 0
    runs = tmp_path / "runs"
    os.makedirs(runs)
    for name, n, score in (("20260101T000000Z", 10, 0.5), ("20260102T000000Z", 12, 0.6), ("baseline", 1, 0.1)):
        (runs / f"{name}.json").write_text(json.dumps({"summary": {"generated_at": name, "num_queries": n, "mean_ndcg_at_10": score}}))
    notes = E.run_history_notes(S.read_eval_runs(spark, str(runs))).orderBy("file").collect()
    assert [r["change_note"] for r in notes] == [None, "queryset size 10→12; nDCG@10 +0.100"]


def test_search_log_skips_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": 1.0, "query": "a", "result_count": 0}\n\nnot json\n{"ts": 2.0, "query": "b", "result_count": 3}\n')
    assert [r["query"] for r in S.read_search_log(spark, str(tmp_path)).collect()] == ["b", "a"]


def test_quality_points(spark):
    t = Tables(spark, SMALL)
    rows = Q.with_warnings(t.products, 64)
    assert rows.where("catalog_quality_score < 0 OR catalog_quality_score > 100").isEmpty()
    assert rows.where("catalog_quality_score = 100 AND size(filter(warnings, w -> w <> 'DUPLICATE_CANDIDATE')) > 0").isEmpty()


def test_upsert_overwrites_with_nulls_and_keeps_other_columns(spark):
    stored = spark.createDataFrame([("s", "u1", "old", 1)], "source string, product_url string, name string, likes int")
    incoming = spark.createDataFrame([("s", "u1", None), ("s", "u2", "new")], "source string, product_url string, name string")
    rows = {r["product_url"]: r for r in S.upsert_products(stored, incoming).collect()}
    assert (rows["u1"]["name"], rows["u1"]["likes"], rows["u1"]["_action"]) == (None, 1, "UPDATED")
    assert (rows["u2"]["name"], rows["u2"]["likes"], rows["u2"]["_action"]) == ("new", None, "INSERTED")


def test_cyclic_category_tree_ends(spark):
    from vitrine.operators.catalog import category_closure

    tree = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3)], "id long, parent_id long")
    pairs = {(r["root_id"], r["id"]) for r in category_closure(tree).collect()}
    assert pairs == {(1, 1), (1, 2), (2, 2), (3, 3), (3, 4), (4, 4), (4, 3)}


def test_exact_types_are_not_cut_short_by_many_retrieved_rows(spark):
    """Retrieval returned the first 300 products of the type; the next 100 are still found."""
    rows = [(f"{i:04d}", f"steel ring {i}") for i in range(500)]
    products = spark.createDataFrame(rows, "id string, product_name string").selectExpr(
        "id", "product_name", *[f"CAST(NULL AS STRING) AS {c}" for c in (
            "item_name", "description", "subcategory", "normalized_main_category", "normalized_subcategory", "audience", "catalog_status")],
        "CAST(NULL AS STRUCT<colour: STRING, color: STRING, style: ARRAY<STRING>, fit: STRING>) AS metadata")
    queries = spark.createDataFrame([("q", "ring"), ("other", "ring")], "qid string, product_type string")
    retrieved = spark.createDataFrame([("q", i) for i, _ in rows[:300]], "qid string, id string")
    got = V.exact_type_products(queries, products, retrieved, H.HARDWARE).orderBy("qid", "rank").collect()
    assert [r["id"] for r in got if r["qid"] == "q"] == [i for i, _ in rows[300:400]]
    assert [r["id"] for r in got if r["qid"] == "other"] == [i for i, _ in rows[:100]]


def test_search_log_is_read_whole_by_default(spark, tmp_path):
    spark.range(25_000).selectExpr("CAST(id AS DOUBLE) AS ts", "'x' AS query").write.json(str(tmp_path / "log"))
    assert S.read_search_log(spark, str(tmp_path / "log")).count() == 25_000
    assert [r["ts"] for r in S.read_search_log(spark, str(tmp_path / "log"), keep=2).collect()] == [24_999.0, 24_998.0]


def test_similar_brands_and_prototypes_in_blocks(spark):
    t = Tables(spark, SMALL)
    whole = sorted(map(tuple, A.similar_brands(t.brands, t.brands, t.products).collect()))
    assert sorted(map(tuple, A.similar_brands(t.brands, t.brands, t.products, block=7).collect())) == whole
    rng = random.Random(1)
    vectors = lambda n, kind: [(f"{kind}{i:02d}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    items, protos = spark.createDataFrame(vectors(50, "i"), "id string, embedding array<double>"), spark.createDataFrame(vectors(40, "p"), "label string, embedding array<double>")
    assert sorted(map(tuple, nearest_prototype(items, protos, block=10).collect())) == sorted(map(tuple, nearest_prototype(items, protos).collect()))


def test_no_temporary_folder_off_a_local_master(spark, monkeypatch):
    class Elsewhere:
        master = "spark://cluster:7077"

    class Session:
        sparkContext = Elsewhere()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError):
        session.shared_folder(Session())
