"""Offline relevance evaluation: metrics per query and run, judgment pools, query sets, run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import or_else

# Cut-offs of the reported metrics and the change worth a note.
NDCG_CUT, RECALL_CUT, PRECISION_CUT = 10, 20, 10
NDCG_NOTE = 0.005
METRICS = ("ndcg_at_10", "recall_at_20", "precision_at_10", "reciprocal_rank")


def _discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def eval_metrics(queries: DataFrame, run: DataFrame, qrels: DataFrame, judged: DataFrame) -> DataFrame:
    """Per query: nDCG@10 (linear gain), recall@20, precision@10, reciprocal rank, unjudged in the top 20.

    Metrics are null for a query with nothing relevant; a query without results scores zero.
    """
    hits = run.join(qrels, ["qid", "product_id"], "left").join(
        judged.select("qid", "product_id").distinct().withColumn("_judged", F.lit(True)), ["qid", "product_id"], "left")
    rank, grade = F.col("rank"), F.col("grade")
    stats = hits.groupBy("qid").agg(
        F.count("*").alias("returned"),
        F.sum(F.when(rank <= NDCG_CUT, or_else(grade, 0) / _discount(rank))).alias("_dcg"),
        F.count_if(grade.isNotNull() & (rank <= RECALL_CUT)).alias("_recalled"),
        F.count_if(grade.isNotNull() & (rank <= PRECISION_CUT)).alias("_precise"),
        F.min(F.when(grade.isNotNull(), rank)).alias("first_relevant_rank"),
        F.count_if(F.col("_judged").isNull() & (rank <= RECALL_CUT)).alias("_unjudged"))
    spot = Window.partitionBy("qid").orderBy(F.desc("grade"), "product_id")
    ideal = qrels.withColumn("_r", F.row_number().over(spot)).where(F.col("_r") <= NDCG_CUT).groupBy("qid").agg(
        F.sum(grade / _discount(F.col("_r"))).alias("_idcg"))
    relevant = qrels.groupBy("qid").agg(F.count("*").alias("relevant"))
    judged_n = judged.groupBy("qid").agg(F.count_distinct("product_id").alias("judged_total"))
    rows = queries.select("qid").join(stats, "qid", "left").join(relevant, "qid", "left").join(ideal, "qid", "left").join(judged_n, "qid", "left")
    scored = F.col("relevant").isNotNull()
    metric = lambda value: F.when(scored, F.bround(or_else(value, 0.0), 9))
    return rows.select(
        "qid", or_else(F.col("returned"), 0).alias("returned"),
        metric(F.col("_dcg") / F.col("_idcg")).alias("ndcg_at_10"),
        metric(F.col("_recalled") / F.col("relevant")).alias("recall_at_20"),
        metric(F.col("_precise") / PRECISION_CUT).alias("precision_at_10"),
        metric(1 / F.col("first_relevant_rank")).alias("reciprocal_rank"),
        F.when(scored, F.col("first_relevant_rank")).alias("first_relevant_rank"), "judged_total",
        F.when(F.col("judged_total").isNotNull(), or_else(F.col("_unjudged"), 0)).alias("unjudged_in_top_20"))


def eval_summary(metrics: DataFrame) -> DataFrame:
    """One row: means over scored queries, zero-result rate over all of them."""
    mean = lambda c, n: F.bround(F.avg(c), 9).alias(n)
    return metrics.agg(
        F.count("*").alias("num_queries"), F.count("ndcg_at_10").alias("num_scored"), mean("ndcg_at_10", "mean_ndcg_at_10"),
        mean("recall_at_20", "mean_recall_at_20"), mean("precision_at_10", "mean_precision_at_10"), mean("reciprocal_rank", "mrr"),
        F.bround(F.count_if(F.col("returned") == 0) / F.count("*"), 9).alias("zero_result_rate"), mean("unjudged_in_top_20", "mean_unjudged_in_top_20"))


def worst_queries(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.where("ndcg_at_10 IS NOT NULL").orderBy("ndcg_at_10", "qid").limit(n)


def relevance_metrics(annotations: DataFrame) -> DataFrame:
    """Per query over its labelled rows: precision@5/@10 over min(k, n), MRR, nDCG@10 with gain 2^label - 1."""
    rows = annotations.where(F.trim(F.col("label").cast("string")) != "").withColumn("label", F.col("label").cast("int"))
    by_rank = Window.partitionBy("query").orderBy(or_else(F.col("rank"), 9999), "product_id")
    by_label = Window.partitionBy("query").orderBy(F.desc("label"), "product_id")
    rows = rows.withColumns({"_pos": F.row_number().over(by_rank), "_best": F.row_number().over(by_label)})
    good = F.col("label") >= 2
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    stats = rows.groupBy("query").agg(
        F.count("*").alias("_n"), *[F.count_if(good & (F.col("_pos") <= k)).alias(f"_p{k}") for k in (5, 10)],
        F.min(F.when(good, F.col("_pos"))).alias("_first"),
        F.sum(F.when(F.col("_pos") <= 10, gain / _discount(F.col("_pos")))).alias("_dcg"),
        F.sum(F.when(F.col("_best") <= 10, gain / _discount(F.col("_best")))).alias("_idcg"))
    return stats.select(
        "query", *[F.bround(F.col(f"_p{k}") / F.least(F.lit(k), F.col("_n")), 9).alias(f"precision_at_{k}") for k in (5, 10)],
        F.bround(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 9).alias("mrr"),
        F.when(F.col("_idcg") > 0, F.bround(F.col("_dcg") / F.col("_idcg"), 9)).otherwise(0.0).alias("ndcg_at_10"))


def relevance_averages(per_query: DataFrame) -> DataFrame:
    names = ("precision_at_5", "precision_at_10", "mrr", "ndcg_at_10")
    return per_query.agg(F.count("*").alias("labeled_query_count"), *[F.bround(F.avg(n), 4).alias(n) for n in names])


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query scored in either run: both nDCGs, the change, and whether it regressed or is in one run only."""
    side = lambda m, n: m.where("ndcg_at_10 IS NOT NULL").select("qid", F.col("ndcg_at_10").alias(n))
    rows = side(a, "ndcg_a").join(side(b, "ndcg_b"), "qid", "full_outer")
    status = (F.when(F.col("ndcg_b").isNull(), "only_in_a").when(F.col("ndcg_a").isNull(), "only_in_b")
              .when(F.col("ndcg_b") < F.col("ndcg_a"), "regressed").otherwise("kept"))
    return rows.withColumns({"delta": F.bround(F.col("ndcg_b") - F.col("ndcg_a"), 9), "status": status}).orderBy(F.asc_nulls_last("delta"), "qid")


def queries_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    scored = lambda m: m.where("ndcg_at_10 IS NOT NULL").select("qid")
    return scored(a).join(scored(b), "qid", "left_anti")


def validate_qrels(qrels: DataFrame, judged: DataFrame, products: DataFrame) -> DataFrame:
    """(qid, product_id): judged or relevant ids that are not in the catalog."""
    named = qrels.select("qid", "product_id").union(judged.select("qid", "product_id")).distinct()
    return named.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti").select("qid", "product_id")


def query_family_precision(results: DataFrame, expected: DataFrame, top: int = 5) -> DataFrame:
    """Per query over its first rows: relevant by expected terms, family / category / attribute precision, price."""
    rows = results.where(F.col("position") <= top).join(expected.select("qid", "expected_terms"), "qid")
    text = F.lower(F.concat_ws(" ", "product_name", "description", "category", "subcategory"))
    b, a = "score_breakdown.", F.col("attributes")
    share = lambda c, n: F.bround(F.avg(c), 3).alias(n)
    compliant = a["max_price"].isNull() | or_else(F.col("price") <= a["max_price"], False)
    return rows.groupBy("qid").agg(
        F.count_if(F.exists("expected_terms", lambda t: text.contains(t))).alias("relevant_in_top_5"),
        share(F.col(b + "product_family_match"), "product_family_precision"), share(F.col(b + "category_match"), "category_precision"),
        share(F.least(b + "colour_match", b + "style_match"), "attribute_precision"), share(compliant.cast("double"), "price_compliance"),
        F.count("*").alias("returned"))


# ---------------------------------------------------------------- pools and query sets


def _blind_order(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col("qid"), F.col("product_id"))


def build_pool(runs: DataFrame, *, seed: str, depth: int = 20) -> DataFrame:
    """(qid, product_id, provenance, position): union of each run's top rows in a blind, seeded order."""
    top = runs.where(F.col("rank") <= depth).groupBy("qid", "product_id", "run_id").agg(F.min("rank").alias("rank"))
    pooled = top.groupBy("qid", "product_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("run_id", "rank")))).alias("provenance"))
    spot = Window.partitionBy("qid").orderBy(_blind_order(seed), "product_id")
    return pooled.withColumn("position", F.row_number().over(spot))


def merge_pool(existing: DataFrame, judged: DataFrame, fresh: DataFrame, *, seed: str) -> DataFrame:
    """Judged items keep their order at the front; unjudged old and new items are shuffled together behind."""
    old = existing.select("qid", "product_id", F.col("position").alias("_old"))
    rows = old.join(fresh.select("qid", "product_id").distinct(), ["qid", "product_id"], "full_outer")
    rows = rows.join(judged.select("qid", "product_id").distinct().withColumn("_j", F.lit(True)), ["qid", "product_id"], "left")
    front = F.col("_j").isNotNull() & F.col("_old").isNotNull()
    order = [F.desc(front), F.when(front, F.col("_old")), _blind_order(f"{seed}:aug"), F.col("product_id")]
    position = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return rows.select("qid", "product_id", F.col("_old").isNull().alias("added"), position.alias("position"))


def pool_stats(pool: DataFrame, grades: DataFrame) -> DataFrame:
    """Per query: pool size, judged, relevant."""
    rows = pool.select("qid", "product_id").join(grades, ["qid", "product_id"], "left")
    sizes = rows.groupBy("qid").agg(F.count("*").alias("pool_size"), F.count("grade").alias("judged"))
    relevant = grades.where("grade >= 1").groupBy("qid").agg(F.count("*").alias("relevant"))
    return sizes.join(relevant, "qid", "left").fillna(0, ["relevant"])


def pool_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("queries"), F.sum("pool_size").alias("pool_items_total"), F.sum("judged").alias("judged_total"),
                     F.bround(F.avg("pool_size"), 6).alias("mean_pool_size"), F.max("pool_size").alias("max_pool_size"))


def export_queryset(grades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qrels, judged): grades of one and more are relevant, every graded product is judged."""
    return grades.where("grade >= 1").select("qid", "product_id", "grade"), grades.select("qid", "product_id").distinct()


def merge_qrels(current: DataFrame, changes: DataFrame, *, zero_removes: bool = True) -> DataFrame:
    """Apply new grades: 1 and 2 replace, 0 removes the entry or is kept as judged zero, others stay."""
    rows = current.join(changes.select("qid", "product_id", F.col("grade").alias("_new")), ["qid", "product_id"], "full_outer")
    rows = rows.select("qid", "product_id", F.coalesce("_new", "grade").alias("grade"))
    return rows.where("grade > 0") if zero_removes else rows


def queryset_violations(entries: DataFrame) -> DataFrame:
    """Violations per rule of (id, query, relevant map, judged array) entries."""
    relevant, judged = F.col("relevant"), F.col("judged")
    blank = lambda c: or_else(F.trim(c), "") == ""
    n_judged, n_relevant = F.greatest(or_else(F.size(judged), 0), F.lit(0)), F.greatest(or_else(F.size(relevant), 0), F.lit(0))
    rules = {
        "blank_id": blank(F.col("id")), "blank_query": blank(F.col("query")),
        "blank_judged_id": F.exists(judged, lambda x: blank(x)), "nothing_relevant": (n_relevant == 0) & (n_judged == 0),
        "invalid_grade": F.exists(F.map_values(relevant), lambda g: ~g.isin(1, 2)),
        "relevant_not_judged": (n_judged > 0) & (F.size(F.array_except(F.map_keys(relevant), judged)) > 0),
    }
    counted = entries.agg(*[F.count_if(or_else(c, False)).alias(r) for r, c in rules.items()]).unpivot([], list(rules), "rule", "violations")
    repeated = entries.groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit("duplicate_id").alias("rule"), "violations")
    return counted.unionByName(repeated)


def run_history_notes(history: DataFrame) -> DataFrame:
    """Runs in time order with a note on what changed since the previous one. One row per evaluation run."""
    spot = Window.orderBy(F.coalesce("generated_at", "file"), "file")
    previous_n, previous_ndcg = F.lag("num_queries").over(spot), F.lag("mean_ndcg_at_10").over(spot)
    first = F.row_number().over(spot) == 1
    delta = or_else(F.col("mean_ndcg_at_10"), 0.0) - or_else(previous_ndcg, 0.0)
    note = F.concat_ws(
        "; ",
        F.when(~F.col("num_queries").eqNullSafe(previous_n), F.format_string("queryset size %s→%s", previous_n.cast("string"), F.col("num_queries").cast("string"))),
        F.when(F.abs(delta) >= NDCG_NOTE, F.format_string("nDCG@10 %+.3f", delta)))
    return history.withColumn("change_note", F.when(~first, F.nullif(note, F.lit(""))))


# ---------------------------------------------------------------- classification


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def classification_metrics(pairs: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, f1. ``pairs`` holds actual and predicted."""
    cells = confusion(pairs)
    by = lambda c, n: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(n))
    hits = cells.where("actual = predicted").select(F.col("actual").alias("label"), F.col("n").alias("tp"))
    rows = by("actual", "support").join(by("predicted", "guessed"), "label", "full_outer").join(hits, "label", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = rows.withColumns({"precision": ratio("tp", "guessed"), "recall": ratio("tp", "support")})
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return rows.select("label", "support", F.bround(p, 9).alias("precision"), F.bround(r, 9).alias("recall"), F.bround(f1, 9).alias("f1"))


def classification_summary(pairs: DataFrame) -> DataFrame:
    accuracy = pairs.agg(F.bround(F.avg((F.col("actual") == F.col("predicted")).cast("double")), 9).alias("accuracy"), F.lit(1).alias("_one"))
    macro = classification_metrics(pairs).agg(F.bround(F.avg("f1"), 9).alias("macro_f1"), F.lit(1).alias("_one"))
    return accuracy.join(macro, "_one").drop("_one")
