import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.operators import fusion as U
from vitrine.operators import ranking as R
from vitrine.operators import topk as K
from vitrine.taxonomy import FASHION, FASHION_WORDS


def ranked(spark, ids):
    return spark.createDataFrame([("q", i, n) for n, i in enumerate(ids, 1)], "qid string, id string, rank int")


def test_rrf_scores_and_first_seen_ties(spark):
    rows = U.rrf_fuse([ranked(spark, "abc"), ranked(spark, "bad")]).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "b", "c", "d"]
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and rows[3]["score"] == pytest.approx(1 / 63)
    weighted = U.rrf_fuse([ranked(spark, "ab"), ranked(spark, "ba")], weights=[2, 1]).orderBy("rank").collect()
    assert weighted[0]["id"] == "a" and weighted[0]["score"] == pytest.approx(2 / 61 + 1 / 62)
    with pytest.raises(ValueError):
        U.rrf_fuse([])


def candidates(spark, rows, query):
    """rows: (id, name, audience, similarity)"""
    df = spark.createDataFrame(rows, "id string, product_name string, audience string, similarity double").withColumns({
        "qid": F.lit("q"), "price": F.lit(10.0), "niche_score": F.lit(0.5), "category_id": F.lit(None).cast("long"),
        "requested_category_id": F.lit(None).cast("long"), "attributes": X.extract_query_attributes(F.lit(query), FASHION, FASHION_WORDS)})
    return df


def test_wrong_audience_falls_below_right_audience(spark):
    df = candidates(spark, [("m", "shirt", "men", 0.95), ("w", "shirt", "women", 0.40)], "shirt for women")
    assert [r["id"] for r in R.rank_results(R.structured_rerank(df, FASHION)).orderBy("position").collect()] == ["w", "m"]


def test_unset_signals_add_nothing(spark):
    row = R.structured_rerank(candidates(spark, [("a", "shirt", None, 0.5)], "hello"), FASHION).first()
    parts = row["score_breakdown"].asDict()
    assert parts["fused"] == 0.35 and all(v == 0 for k, v in parts.items() if k != "fused")
    assert row["final_score"] == pytest.approx(sum(parts.values()))


def test_gates_narrow_only_when_something_survives(spark):
    df = candidates(spark, [("a", "mini dress", None, 0.2), ("b", "gown", None, 0.9), ("c", "jeans", None, 0.99)], "party dress")
    assert {r["id"] for r in R.score_text(df, FASHION).collect()} == {"a", "b"}
    with_type = candidates(spark, [("a", "party dress", None, 0.2), ("b", "gown", None, 0.9)], "party dress")
    assert [r["id"] for r in R.score_text(with_type, FASHION).collect()] == ["a"]


def test_score_noise_does_not_reorder(spark):
    base = [("b", 0.5), ("a", 0.5 + 1e-7), ("c", 0.5 - 1e-7)]
    df = spark.createDataFrame(base, "id string, final_score double").withColumn("qid", F.lit("q"))
    assert [r["id"] for r in R.rank_results(df).orderBy("position").collect()] == ["a", "b", "c"]


def vectors(n, dim, seed):
    return np.random.default_rng(seed).standard_normal((n, dim)).astype("float32")


def brute(q, x, k, self_join=False):
    qn, xn = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(qn.astype(float) @ xn.astype(float).T, 6)
    out = {}
    for i, row in enumerate(scores):
        if self_join:
            row = row.copy()
            row[i] = -9
        out[f"{i:04d}"] = sorted(((-s, f"{j:04d}") for j, s in enumerate(row)))[:k]
    return out


def frame(spark, m, name):
    return spark.createDataFrame([(f"{i:04d}", [float(v) for v in row]) for i, row in enumerate(m)], f"{name} string, embedding array<float>")


@pytest.mark.parametrize("blocks", [False, True])
def test_topk_equals_brute_force(spark, monkeypatch, blocks):
    q, x = vectors(30, 8, 1), vectors(400, 8, 2)
    x[200:260] = x[0]
    if blocks:
        monkeypatch.setattr(K, "QUERY_BLOCK", 7)
        monkeypatch.setattr(K, "ITEM_BLOCK", 50)
    got = K.exact_topk(frame(spark, q, "qid"), frame(spark, x, "id"), 5).orderBy("qid", "rank").collect()
    want = brute(q, x, 5)
    for qid, best in want.items():
        mine = [(r["id"], round(r["similarity"], 6)) for r in got if r["qid"] == qid]
        assert [s for _, s in mine] == pytest.approx([-s for s, _ in best], abs=2e-6)
        assert len({i for i, _ in mine}) == 5


def test_topk_does_not_depend_on_partitions(spark):
    q, x = frame(spark, vectors(20, 8, 3), "qid"), frame(spark, vectors(300, 8, 4), "id")
    runs = [sorted(map(tuple, K.exact_topk(q, x.repartition(n), 4).collect())) for n in (1, 3, 9)]
    assert runs[0] == runs[1] == runs[2]


def test_approximate_topk_recall(spark):
    m = vectors(500, 16, 5)
    q, x = frame(spark, m[:50], "qid"), frame(spark, m, "id")
    exact = {(r["qid"], r["id"]) for r in K.exact_topk(q, x, 5).collect()}
    near = {(r["qid"], r["id"]) for r in K.approximate_topk(q, x, 5, dim=16, planes=5, probes=2).collect()}
    assert len(exact & near) / len(exact) > 0.7


def test_rough_scores_lose_no_near_tie_and_decide_nothing():
    """Pairs that single precision cannot tell apart, ties, scopes, own ids and bad vectors, against a plain double-precision scan."""
    import pyarrow as pa

    from vitrine.operators import topk as K

    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 32))
    items = np.repeat(base, 60, axis=0) + rng.standard_normal((360, 32)) * 1e-8
    items[::7] = base[0]
    items[11] = np.nan
    ids = [f"i{(n * 37) % 360}" for n in range(360)]
    categories = [None if n % 11 == 0 else n % 4 for n in range(360)]
    qids = [ids[n] for n in range(0, 120, 3)]
    queries = np.array([items[n] for n in range(0, 120, 3)])
    queries[np.isnan(queries)] = 1.0
    scopes = [None if n % 3 == 0 else [] if n % 3 == 1 else [1, 2] for n in range(len(qids))]
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    scores = np.round(np.einsum("qd,id->qi", unit(queries), unit(items)), 9)
    for exclude in (False, True):
        want = []
        for n, qid in enumerate(qids):
            able = [(-scores[n, i], ids[i]) for i in range(360) if np.isfinite(scores[n, i]) and scores[n, i] >= 0.1
                    and (scopes[n] is None or categories[i] in scopes[n]) and not (exclude and ids[i] == qid)]
            want += [(qid, i, -s) for s, i in sorted(able)[:9]]
        best = K.BestPerQuery(len(qids), 9, 0.1)
        block = K.QueryBlock(qids, K.unit_rows(pa.array(queries.tolist(), pa.list_(pa.float64()))), scopes)
        for part in (slice(0, 200), slice(200, 360)):
            block.score(pa.table({"id": ids[part], "embedding": pa.array(items[part].tolist(), pa.list_(pa.float64())), "category_id": pa.array(categories[part], pa.int64())}), best, exclude)
        rows = best.batch(block.qids).to_pylist()
        assert sorted((r["qid"], r["id"], r["similarity"]) for r in rows) == sorted(want)


def test_few_pairs_are_scored_twice(monkeypatch):
    import pyarrow as pa

    from vitrine.operators import topk as K

    rng = np.random.default_rng(6)
    scored, exact = [], K.QueryBlock._exact
    monkeypatch.setattr(K.QueryBlock, "_exact", lambda self, rows, vectors, cols: scored.append(len(rows)) or exact(self, rows, vectors, cols))
    vectors = pa.array(rng.standard_normal((3_000, 64)).tolist(), pa.list_(pa.float64()))
    names = [str(n) for n in range(3_000)]
    block = K.QueryBlock(names, K.unit_rows(vectors))
    block.score(pa.table({"id": names, "embedding": vectors}), K.BestPerQuery(3_000, 10, -2.0), False)
    assert 30_000 <= sum(scored) <= 33_000


def test_a_block_of_items_is_held_in_single_precision_alone():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = pa.ListArray.from_arrays(np.arange(0, 65_536 * 64 + 1, 64, dtype=np.int32), pa.array(rng.standard_normal(65_536 * 64, dtype=np.float32)))
    names = np.arange(65_536).astype(str).tolist()
    items = pa.table({"id": names, "embedding": vectors, "category_id": pa.nulls(65_536, pa.int64())})
    block = K.QueryBlock(names[:64], K.unit_rows(vectors[:64]))
    best = K.BestPerQuery(64, 1, -2.0)
    tracemalloc.start()
    block.score(items, best, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    unit = K.unit_rows(vectors)
    scores = np.round(unit[:64] @ unit.T, K.DIGITS)
    np.fill_diagonal(scores, -2)
    assert best.batch(block.qids).column("id").to_pylist() == [names[i] for i in scores.argmax(axis=1)]


def test_the_best_may_lie_together_in_few_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K, "PARTS", 8)
    monkeypatch.setattr(K, "PARTS_OF_K", 1)
    monkeypatch.setattr(K, "RESCORED", 4)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((400, 6))
    vectors[::8] = vectors[0] + rng.normal(0, 0.01, (50, 6))
    names = [f"{i:03d}" for i in range(400)]
    column = pa.array(vectors.tolist(), pa.list_(pa.float64()))
    unit = K.unit_rows(column)
    scores = np.round(unit[:40] @ unit.T, K.DIGITS)
    reached = K.reached_by(scores, 7)
    assert ((scores >= reached[:, None]).sum(axis=1) >= 7).all()
    best = K.BestPerQuery(40, 7, -2.0)
    block = K.QueryBlock(names[:40], unit[:40])
    block.score(pa.record_batch({"id": names, "embedding": column, "category_id": pa.nulls(400, pa.int64())}), best, False)
    got = best.batch(block.qids)
    want = [names[i] for q in range(40) for i in np.lexsort((np.arange(400), -scores[q]))[:7]]
    assert got.column("id").to_pylist() == want


@pytest.mark.parametrize("key", ["search_evaluation_log", "final_ranking_image"])
def test_a_products_text_is_read_once_and_not_for_each_candidate(spark, monkeypatch, key):
    from conftest import SMALL
    from registry import load_all

    read, texts = X.product_search_text, spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        texts.add(1)
        return text

    monkeypatch.setattr(X, "product_search_text", lambda p: counted(read(p)))
    rows = load_all()[0][key](spark, SMALL)
    assert "InArrow" not in rows._jdf.queryExecution().executedPlan().toString()  # the search is stored, not run by each reader
    rows.write.format("noop").mode("overwrite").save()
    products = spark.read.parquet(f"{SMALL}/part.parquet").count()
    assert 0 < texts.value <= 4 * products  # retrieved, and added for their type; the text may be joined for each of two uses
