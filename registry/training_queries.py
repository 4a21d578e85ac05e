"""Registered training-set and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import hardware as H
from registry.core import DIM, STORAGE, query
from registry.hardware import HARDWARE, WORDS, lit, part
from registry.quality_queries import DUP_IDS_SQL
from registry.scalar_queries import TRAINING_STABLE_SQL, joined
from vitrine.functions import text as X
from vitrine.operators import evaluation as E
from vitrine.operators import training as T
from vitrine.operators.topk import nearest_prototype
from vitrine.session import scratch_folder
from vitrine.sources.files import export_records

RANK = H.term_rank("txt", HARDWARE)
CAP = lambda text, words: "concat_ws(',', " + ", ".join(f"CASE WHEN {part(text, w)} THEN {lit(w.title())} END" for w in words) + ")"
REC_SQL = f"""{DUP_IDS_SQL}, t0 AS (SELECT *, {H.TRAINING_TEXT} AS txt FROM products), t1 AS (SELECT *, {RANK} AS k FROM t0),
    t2 AS (SELECT *, CASE WHEN len(coalesce(metadata.style, [])) > 0 THEN array_to_string(metadata.style, ',') ELSE {CAP('txt', WORDS.training_styles)} END AS style,
      coalesce(metadata.colour, metadata.color, {CAP('txt', WORDS.colours)}) AS colour, {H.type_label(H.type_of('k', HARDWARE), HARDWARE)} AS product_type FROM t1),
    rec AS (SELECT id AS product_id, brand_id, coalesce(nullif(product_name, ''), item_name) AS name, coalesce(nullif(normalized_main_category, ''), audience, '') AS category, coalesce(nullif(normalized_subcategory, ''), subcategory, '') AS subcategory, product_type, colour, style,
      classifier_confidence AS label_confidence, CASE WHEN coalesce(classification_source, 'heuristic') IN ('ai', 'openai', 'manual') THEN 'ai+validated' ELSE coalesce(classification_source, 'heuristic') END AS label_source
      FROM t2 WHERE coalesce(classifier_confidence, 0) >= 0.3 AND product_type IS NOT NULL AND coalesce(catalog_status, '') <> 'NON_PRODUCT' AND id NOT IN (SELECT id FROM tdup) AND coalesce(brand_id, '') <> '' AND coalesce(len(embedding), 0) = {DIM} AND {TRAINING_STABLE_SQL})"""


def records(t):
    return T.trusted_training_records(t.products, HARDWARE, WORDS, STORAGE, DIM, min_confidence=0.3)


@query("trusted_training_record", f"WITH {REC_SQL} SELECT * FROM rec")
def _(t):
    return records(t).select("product_id", "brand_id", "name", "category", "subcategory", "product_type", joined(F.col("colour")).alias("colour"), joined(F.col("style")).alias("style"), "label_confidence", "label_source")


SPLIT = "CAST(('0x' || substr(sha256('split-v1:' || brand_id), 1, 12)) AS BIGINT) / 281474976710656.0"


@query("grouped_split", f"WITH {REC_SQL} SELECT product_id, brand_id, CASE WHEN {SPLIT} < 0.7 THEN 'train' WHEN {SPLIT} < 0.85 THEN 'validation' ELSE 'test' END AS split FROM rec")
def _(t):
    return T.grouped_split(records(t)).select("product_id", "brand_id", "split")


@query("training_readiness", f"""
    WITH {REC_SQL}, c AS (SELECT 'type' AS section, product_type AS key, count(*) AS n FROM rec GROUP BY 2 UNION ALL SELECT 'category', coalesce(nullif(subcategory, ''), nullif(category, ''), 'Unknown'), count(*) FROM rec GROUP BY 2
      UNION ALL SELECT 'style', s, count(*) FROM (SELECT unnest(string_split(style, ',')) AS s FROM rec WHERE style <> '') GROUP BY 2)
    SELECT *, CASE WHEN section = 'type' THEN CASE WHEN n >= 50 THEN 'SUFFICIENT' WHEN n >= 20 THEN 'WEAK' ELSE 'INSUFFICIENT' END WHEN section = 'style' AND n >= 50 THEN 'ELIGIBLE' END AS status FROM c""")
def _(t):
    return T.training_readiness(records(t))


@query("training_decision", f"""
    WITH {REC_SQL}, c AS (SELECT product_type, count(*) AS n FROM rec GROUP BY 1), s AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS usable_examples, count(*) FILTER (n >= 50) AS sufficient_types FROM c)
    SELECT *, CASE WHEN usable_examples < 200 OR sufficient_types < 3 THEN 'TRAINING_NOT_READY' WHEN usable_examples >= 1000 AND sufficient_types >= 8 THEN 'READY_FOR_FINE_TUNING_REVIEW' ELSE 'READY_FOR_LINEAR_PROBE' END AS decision FROM s""")
def _(t):
    return T.training_decision(records(t))


@query("review_set", f"""
    WITH {REC_SQL} SELECT id AS product_id, product_type AS current_product_type, style, colour, coalesce(classifier_confidence, 0) AS confidence FROM t2 WHERE coalesce(classifier_confidence, 0) < 0.8 OR product_type IS NULL""")
def _(t):
    rows = T.review_set(t.products, HARDWARE, WORDS, limit=None)
    return rows.select("product_id", "current_product_type", joined(F.col("style")).alias("style"), joined(F.col("colour")).alias("colour"), "confidence")


HN = lambda text, n: f"(SELECT {n})"
COLOURS = lambda text: "list_filter([" + ", ".join(f"CASE WHEN {part(text, w)} THEN {lit(w)} END" for w in WORDS.colours) + "], lambda v: v IS NOT NULL)"


@query("hard_negative_kind", f"""
    WITH r AS (SELECT qid, product_id, min(rank) AS rank FROM runs WHERE run_id = 'a' GROUP BY 1, 2), j AS (SELECT r.qid, r.product_id, lower(q.query) AS qt, {H.TRAINING_TEXT.replace('product_name', 'p.product_name').replace('item_name', 'p.item_name')} AS txt FROM r JOIN search_queries q ON q.qid = r.qid JOIN products p ON p.id = r.product_id),
    k AS (SELECT *, {H.term_rank('qt', HARDWARE)} AS a, {RANK} AS b, {COLOURS('qt')} AS asked, {COLOURS('txt')} AS seen FROM j), f AS (SELECT *, {H.family_of('a', HARDWARE)} AS fa, {H.family_of('b', HARDWARE)} AS fb, {H.type_of('a', HARDWARE)} AS ta, {H.type_of('b', HARDWARE)} AS tb, len(list_intersect(asked, seen)) > 0 AS shared FROM k)
    SELECT qid, product_id, CASE WHEN fa IS NOT NULL AND fa IS DISTINCT FROM fb AND shared THEN 'same_colour_wrong_family' WHEN fa IS NOT DISTINCT FROM fb AND ta IS DISTINCT FROM tb THEN 'same_family_wrong_type'
      WHEN ta IS NOT DISTINCT FROM tb AND len(asked) > 0 AND NOT shared THEN 'right_type_wrong_colour' END AS kind FROM f""")
def _(t):
    hits = t.runs.where("run_id = 'a'").select("qid", F.col("product_id").alias("id")).distinct()
    rows = hits.join(t.products.drop("embedding"), "id").join(t.search_queries.select("qid", "query"), "qid")
    return rows.select("qid", F.col("id").alias("product_id"), T.hard_negative_kind(F.col("query"), X.training_text(rows), HARDWARE, WORDS).alias("kind"))


@query("export_records")
def _(t):
    path = scratch_folder(t.spark, "records")
    export_records(T.grouped_split(records(t)), path)
    return t.spark.read.schema("product_id string, product_type string, brand_id string, style array<string>, split string").json(path)


@query("embed_backfill")
def _(t):
    vectors = T.embed_backfill(t.products, T.hashed_features(DIM), DIM)
    return vectors.select("id", F.size("embedding").alias("dimensions"))


PROTO = """pr AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, round_even(avg(x), 12) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    zs AS (SELECT e.vec_id::VARCHAR AS id, e.label::VARCHAR AS actual, pr.label::VARCHAR AS predicted, round_even(list_cosine_similarity(e.embedding::DOUBLE[], pr.v), 9) AS similarity FROM embeddings e, pr),
    zb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, predicted) AS n FROM zs) WHERE n = 1)"""


def labelled(t):
    return t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").cast("string").alias("label"))


@query("zero_shot", f"WITH {PROTO} SELECT id, actual, predicted, similarity FROM zb")
def _(t):
    rows = labelled(t)
    found = nearest_prototype(rows, T.class_prototypes(rows))
    return found.select("id", F.col("label").alias("predicted"), "similarity").join(rows.select("id", F.col("label").alias("actual")), "id")


@query("linear_probe")
def _(t):
    rows = T.grouped_split(labelled(t).withColumn("brand_id", F.col("id")), fallback="id")
    pairs = T.linear_probe(rows.where("split = 'train'"), rows.where("split <> 'train'"))
    return E.classification_metrics(pairs)
