"""Registered relevance-evaluation, pooling and classification-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import query
from registry.hardware import HARDWARE
from registry.search_queries import ranked_candidates
from vitrine.operators import evaluation as E
from vitrine.operators import ranking as R


def metrics_sql(run: str, name: str) -> str:
    return f"""{name}_h AS (SELECT r.qid, r.rank, r.product_id, q.grade, j.product_id IS NOT NULL AS is_judged FROM runs r LEFT JOIN qrels q ON q.qid = r.qid AND q.product_id = r.product_id
      LEFT JOIN (SELECT DISTINCT qid, product_id FROM judged) j ON j.qid = r.qid AND j.product_id = r.product_id WHERE r.run_id = '{run}'),
    {name}_s AS (SELECT qid, count(*) AS returned, sum(CASE WHEN rank <= 10 THEN coalesce(grade, 0) / log2(rank + 1) END) AS dcg, count(*) FILTER (grade IS NOT NULL AND rank <= 20) AS rec, count(*) FILTER (grade IS NOT NULL AND rank <= 10) AS pre,
      min(rank) FILTER (grade IS NOT NULL) AS fr, count(*) FILTER (NOT is_judged AND rank <= 20) AS unj FROM {name}_h GROUP BY 1),
    {name}_i AS (SELECT qid, sum(grade / log2(n + 1)) AS idcg, any_value(rel) AS rel FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, product_id) AS n, count(*) OVER (PARTITION BY qid) AS rel FROM qrels) WHERE n <= 10 GROUP BY 1),
    {name}_j AS (SELECT qid, count(DISTINCT product_id) AS judged_total FROM judged GROUP BY 1),
    {name} AS (SELECT q.qid, coalesce(returned, 0) AS returned, CASE WHEN rel IS NOT NULL THEN round_even(coalesce(dcg / idcg, 0), 9) END AS ndcg_at_10, CASE WHEN rel IS NOT NULL THEN round_even(coalesce(rec / rel::DOUBLE, 0), 9) END AS recall_at_20,
      CASE WHEN rel IS NOT NULL THEN round_even(coalesce(pre / 10::DOUBLE, 0), 9) END AS precision_at_10, CASE WHEN rel IS NOT NULL THEN round_even(coalesce(1 / fr::DOUBLE, 0), 9) END AS reciprocal_rank,
      CASE WHEN rel IS NOT NULL THEN fr END AS first_relevant_rank, judged_total, CASE WHEN judged_total IS NOT NULL THEN coalesce(unj, 0) END AS unjudged_in_top_20
      FROM search_queries q LEFT JOIN {name}_s s ON s.qid = q.qid LEFT JOIN {name}_i i ON i.qid = q.qid LEFT JOIN {name}_j j ON j.qid = q.qid)"""


def metrics(t, run):
    return E.eval_metrics(t.search_queries, t.runs.where(F.col("run_id") == run).drop("run_id"), t.qrels, t.judged)


@query("eval_metrics", f"WITH {metrics_sql('a', 'm')} SELECT * FROM m")
def _(t):
    return metrics(t, "a")


@query("eval_summary", f"""
    WITH {metrics_sql('a', 'm')} SELECT count(*) AS num_queries, count(ndcg_at_10) AS num_scored, round_even(avg(ndcg_at_10), 9) AS mean_ndcg_at_10, round_even(avg(recall_at_20), 9) AS mean_recall_at_20,
      round_even(avg(precision_at_10), 9) AS mean_precision_at_10, round_even(avg(reciprocal_rank), 9) AS mrr, round_even(count(*) FILTER (returned = 0) / count(*)::DOUBLE, 9) AS zero_result_rate, round_even(avg(unjudged_in_top_20), 9) AS mean_unjudged_in_top_20 FROM m""")
def _(t):
    return E.eval_summary(metrics(t, "a"))


@query("worst_queries", f"WITH {metrics_sql('b', 'm')} SELECT qid, ndcg_at_10 FROM m WHERE ndcg_at_10 IS NOT NULL ORDER BY ndcg_at_10, qid LIMIT 10")
def _(t):
    return E.worst_queries(metrics(t, "b")).select("qid", "ndcg_at_10")


ANN_SQL = """an AS (SELECT query, product_id, CAST(label AS INT) AS label, row_number() OVER (PARTITION BY query ORDER BY rank, product_id) AS pos, row_number() OVER (PARTITION BY query ORDER BY CAST(label AS INT) DESC, product_id) AS best FROM annotations WHERE trim(label) <> ''),
    st AS (SELECT query, count(*) AS n, count(*) FILTER (label >= 2 AND pos <= 5) AS p5, count(*) FILTER (label >= 2 AND pos <= 10) AS p10, min(pos) FILTER (label >= 2) AS fr,
      sum(CASE WHEN pos <= 10 THEN (2.0 ** label - 1) / log2(pos + 1) END) AS dcg, sum(CASE WHEN best <= 10 THEN (2.0 ** label - 1) / log2(best + 1) END) AS idcg FROM an GROUP BY 1),
    rm AS (SELECT query, round_even(p5 / least(5, n)::DOUBLE, 9) AS precision_at_5, round_even(p10 / least(10, n)::DOUBLE, 9) AS precision_at_10, round_even(coalesce(1 / fr::DOUBLE, 0), 9) AS mrr, CASE WHEN idcg > 0 THEN round_even(dcg / idcg, 9) ELSE 0.0 END AS ndcg_at_10 FROM st)"""


@query("relevance_metrics", f"WITH {ANN_SQL} SELECT * FROM rm")
def _(t):
    return E.relevance_metrics(t.annotations)


@query("relevance_averages", f"WITH {ANN_SQL} SELECT count(*) AS labeled_query_count, round_even(avg(precision_at_5), 4) AS precision_at_5, round_even(avg(precision_at_10), 4) AS precision_at_10, round_even(avg(mrr), 4) AS mrr, round_even(avg(ndcg_at_10), 4) AS ndcg_at_10 FROM rm")
def _(t):
    return E.relevance_averages(E.relevance_metrics(t.annotations))


@query("compare_runs", f"""
    WITH {metrics_sql('a', 'ma')}, {metrics_sql('b', 'mb')}, a AS (SELECT qid, ndcg_at_10 AS ndcg_a FROM ma WHERE ndcg_at_10 IS NOT NULL AND qid NOT LIKE '1%'), b AS (SELECT qid, ndcg_at_10 AS ndcg_b FROM mb WHERE ndcg_at_10 IS NOT NULL AND qid NOT LIKE '2%')
    SELECT qid, ndcg_a, ndcg_b, round_even(ndcg_b - ndcg_a, 9) AS delta, CASE WHEN ndcg_b IS NULL THEN 'only_in_a' WHEN ndcg_a IS NULL THEN 'only_in_b' WHEN ndcg_b < ndcg_a THEN 'regressed' ELSE 'kept' END AS status FROM a FULL JOIN b USING (qid)""")
def _(t):
    return E.compare_runs(metrics(t, "a").where("qid NOT LIKE '1%'"), metrics(t, "b").where("qid NOT LIKE '2%'"))


@query("queries_only_in", f"WITH {metrics_sql('a', 'm')} SELECT qid FROM m WHERE ndcg_at_10 IS NOT NULL AND qid NOT IN (SELECT qid FROM m WHERE ndcg_at_10 > 0.2)")
def _(t):
    m = metrics(t, "a")
    return E.queries_only_in(m, m.where("ndcg_at_10 > 0.2"))


@query("validate_qrels", """
    SELECT DISTINCT qid, product_id FROM (SELECT qid, product_id FROM qrels UNION SELECT qid, product_id FROM judged) n WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.id = n.product_id AND p.brand_id IS NOT NULL)""")
def _(t):
    return E.validate_qrels(t.qrels, t.judged, t.products.where("brand_id IS NOT NULL"))


@query("query_family_precision")
def _(t):
    results = R.rank_results(R.score_text(ranked_candidates(t), HARDWARE), "score", 16)
    expected = t.search_queries.select("qid", F.array(F.split("query", " ")[1]).alias("expected_terms"))
    return E.query_family_precision(results, expected)


@query("build_pool", """
    SELECT qid, product_id, string_agg(run_id || '=' || rank, ',' ORDER BY run_id) AS provenance FROM (SELECT qid, product_id, run_id, min(rank) AS rank FROM runs WHERE rank <= 15 GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    pool = E.build_pool(t.runs, seed="s1", depth=15)
    entries = F.transform(F.map_entries("provenance"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return pool.select("qid", "product_id", F.array_join(F.array_sort(entries), ",").alias("provenance"))


@query("merge_pool", """
    WITH old AS (SELECT qid, product_id, min(rank) AS pos FROM runs WHERE run_id = 'a' GROUP BY 1, 2), new AS (SELECT DISTINCT qid, product_id FROM runs WHERE run_id = 'b'), j AS (SELECT DISTINCT qid, product_id FROM judged)
    SELECT qid, product_id, old.pos IS NULL AS added, old.pos IS NOT NULL AND EXISTS (SELECT 1 FROM j WHERE j.qid = f.qid AND j.product_id = f.product_id) AS in_front FROM (SELECT qid, product_id FROM old UNION SELECT qid, product_id FROM new) f LEFT JOIN old USING (qid, product_id)""")
def _(t):
    run = lambda r: t.runs.where(F.col("run_id") == r)
    existing = run("a").groupBy("qid", "product_id").agg(F.min("rank").alias("position"))
    merged = E.merge_pool(existing, t.judged, run("b"), seed="s1")
    flag = t.judged.select("qid", "product_id").distinct().withColumn("j", F.lit(True))
    rows = merged.join(flag, ["qid", "product_id"], "left")
    return rows.select("qid", "product_id", "added", (~F.col("added") & F.col("j").isNotNull()).alias("in_front"))


GRADES_SQL = "gr AS (SELECT j.qid, j.product_id, coalesce(q.grade, 0) AS grade FROM (SELECT DISTINCT qid, product_id FROM judged) j LEFT JOIN qrels q ON q.qid = j.qid AND q.product_id = j.product_id)"


def grades(t):
    return t.judged.distinct().join(t.qrels, ["qid", "product_id"], "left").fillna(0, ["grade"])


STATS_SQL = f"""{GRADES_SQL}, pool AS (SELECT DISTINCT qid, product_id FROM runs WHERE rank <= 20), ps AS (SELECT p.qid, count(*) AS pool_size, count(g.grade) AS judged FROM pool p LEFT JOIN gr g ON g.qid = p.qid AND g.product_id = p.product_id GROUP BY 1),
    stt AS (SELECT ps.*, coalesce((SELECT count(*) FROM gr WHERE gr.qid = ps.qid AND grade >= 1), 0) AS relevant FROM ps)"""


@query("pool_stats", f"WITH {STATS_SQL} SELECT * FROM stt")
def _(t):
    return E.pool_stats(E.build_pool(t.runs, seed="s1"), grades(t))


@query("pool_totals", f"WITH {STATS_SQL} SELECT count(*) AS queries, CAST(sum(pool_size) AS BIGINT) AS pool_items_total, CAST(sum(judged) AS BIGINT) AS judged_total, round_even(avg(pool_size), 6) AS mean_pool_size, max(pool_size) AS max_pool_size FROM stt")
def _(t):
    return E.pool_totals(E.pool_stats(E.build_pool(t.runs, seed="s1"), grades(t)))


@query("export_queryset", f"WITH {GRADES_SQL} SELECT 'relevant' AS list, qid, product_id, grade FROM gr WHERE grade >= 1 UNION ALL SELECT 'judged', qid, product_id, NULL FROM gr")
def _(t):
    relevant, judged = E.export_queryset(grades(t))
    return relevant.select(F.lit("relevant").alias("list"), "qid", "product_id", "grade").unionByName(
        judged.select(F.lit("judged").alias("list"), "qid", "product_id", F.lit(None).cast("int").alias("grade")))


CHANGES_SQL = "ch AS (SELECT qid, product_id, max(rank) % 3 AS grade FROM runs WHERE run_id = 'a' GROUP BY 1, 2)"


@query("merge_qrels", f"""
    WITH {CHANGES_SQL}, m AS (SELECT qid, product_id, coalesce(ch.grade, q.grade) AS grade FROM qrels q FULL JOIN ch USING (qid, product_id))
    SELECT 'label' AS tool, qid, product_id, grade FROM m WHERE grade > 0 UNION ALL SELECT 'pool', qid, product_id, grade FROM m""")
def _(t):
    changes = t.runs.where("run_id = 'a'").groupBy("qid", "product_id").agg((F.max("rank") % 3).alias("grade"))
    label = E.merge_qrels(t.qrels, changes).select(F.lit("label").alias("tool"), "qid", "product_id", "grade")
    return label.unionByName(E.merge_qrels(t.qrels, changes, zero_removes=False).select(F.lit("pool").alias("tool"), "qid", "product_id", "grade"))


@query("read_queryset", """
    WITH e AS (SELECT CAST(vec_id / 2 AS INT) AS id, vec_id, label FROM embeddings)
    SELECT 'blank_id' AS rule, count(*) FILTER (vec_id % 50 = 7) AS violations FROM e UNION ALL SELECT 'blank_query', count(*) FILTER (vec_id % 40 = 3) FROM e UNION ALL SELECT 'blank_judged_id', 0 UNION ALL SELECT 'nothing_relevant', count(*) FILTER (vec_id % 20 = 0) FROM e
    UNION ALL SELECT 'invalid_grade', count(*) FILTER (vec_id % 20 <> 0 AND label % 3 = 0) FROM e UNION ALL SELECT 'relevant_not_judged', count(*) FILTER (vec_id % 20 <> 0 AND vec_id % 6 = 1) FROM e UNION ALL SELECT 'duplicate_id', 0""")
def _(t):
    v = F.col("vec_id")
    key = v.cast("string")
    entries = t.embeddings.select(
        F.when(v % 50 == 7, F.repeat(F.lit(" "), (v + 1).cast("int"))).otherwise(key).alias("id"), F.when(v % 40 == 3, "").otherwise("ring").alias("query"),
        F.when(v % 20 == 0, F.create_map().cast("map<string,int>")).otherwise(F.create_map(key, F.col("label") % 3)).alias("relevant"),
        F.when(v % 20 == 0, F.array().cast("array<string>")).when(v % 6 == 1, F.array(F.lit("x"))).otherwise(F.array(key, F.lit("x"))).alias("judged"))
    return E.queryset_violations(entries)


@query("run_history_notes", """
    WITH h AS (SELECT strftime(date_trunc('day', ts), '%Y%m%d') || 'T000000Z.json' AS file, strftime(date_trunc('day', ts), '%Y-%m-%d') AS generated_at, CAST(count(*) // 10 AS INT) AS num_queries, round_even(avg(value) / 100, 3) AS mean_ndcg_at_10 FROM events GROUP BY 1, 2),
    l AS (SELECT *, lag(num_queries) OVER (ORDER BY generated_at) AS pn, lag(mean_ndcg_at_10) OVER (ORDER BY generated_at) AS pm, row_number() OVER (ORDER BY generated_at) AS r FROM h)
    SELECT file, CASE WHEN r > 1 THEN nullif(concat_ws('; ', CASE WHEN num_queries <> pn THEN 'queryset size ' || pn || '→' || num_queries END,
      CASE WHEN abs(mean_ndcg_at_10 - pm) >= 0.005 THEN 'nDCG@10 ' || CASE WHEN mean_ndcg_at_10 >= pm THEN '+' ELSE '' END || printf('%.3f', mean_ndcg_at_10 - pm) END), '') END AS change_note FROM l""")
def _(t):
    day = F.date_format("ts", "yyyyMMdd")
    history = t.events.groupBy(F.concat(day, F.lit("T000000Z.json")).alias("file"), F.date_format("ts", "yyyy-MM-dd").alias("generated_at")).agg(
        F.floor(F.count("*") / 10).cast("int").alias("num_queries"), F.bround(F.avg("value") / 100, 3).alias("mean_ndcg_at_10"))
    return E.run_history_notes(history).select("file", "change_note")


PAIRS = "pr AS (SELECT CAST(quality AS STRING) AS actual, CAST(toxic AS STRING) AS predicted FROM labels)"
CLASS_SQL = f"""{PAIRS}, ls AS (SELECT actual AS label FROM pr UNION SELECT predicted FROM pr), c AS (SELECT label, (SELECT count(*) FROM pr WHERE actual = label) AS support, (SELECT count(*) FROM pr WHERE predicted = label) AS guessed, (SELECT count(*) FROM pr WHERE actual = label AND predicted = label) AS tp FROM ls),
    d AS (SELECT label, support, CASE WHEN guessed > 0 THEN tp / guessed::DOUBLE ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS r FROM c)"""


def label_pairs(t):
    return t.labels.select(F.col("quality").cast("string").alias("actual"), F.col("toxic").cast("string").alias("predicted"))


@query("classification_metrics", f"WITH {CLASS_SQL} SELECT label, support, round_even(p, 9) AS precision, round_even(r, 9) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM d")
def _(t):
    return E.classification_metrics(label_pairs(t))


@query("classification_summary", f"WITH {CLASS_SQL} SELECT (SELECT round_even(avg(CAST(actual = predicted AS INT)), 9) FROM pr) AS accuracy, round_even(avg(round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9)), 9) AS macro_f1 FROM d")
def _(t):
    return E.classification_summary(label_pairs(t))


@query("confusion_matrix", f"WITH {PAIRS} SELECT actual, predicted, count(*) AS n FROM pr GROUP BY 1, 2")
def _(t):
    return E.confusion(label_pairs(t))
