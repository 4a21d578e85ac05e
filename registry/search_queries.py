"""Registered retrieval, fusion, ranking and whole-search queries over the search_queries table."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import hardware as H
from registry.catalog_queries import CLOSURE_SQL, ENRICHED_BRANDS
from registry.core import query
from registry.hardware import HARDWARE, WORDS, lit, term
from registry.scalar_queries import CATEGORY_WORDS_SQL, attributes_sql, audience_signal_sql, category_score_sql, gender_score_sql
from vitrine.functions import text as X
from vitrine.functions.personal import personalization_match
from vitrine.operators import catalog as C
from vitrine.operators import fusion as U
from vitrine.operators import ivf as I
from vitrine.operators import lexical as L
from vitrine.operators import ranking as R
from vitrine.operators import retrieval as V
from vitrine.operators.topk import exact_topk
from vitrine.plans import discover as D
from vitrine.session import cut_lineage, scratch_folder

COS = "round_even(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9)"


def knn_sql(k: int, threshold: float, name: str = "knn") -> str:
    """SQL tables closure and knn(qid, id, similarity, rank)."""
    closure = CLOSURE_SQL.replace("WITH RECURSIVE ", "", 1)
    return f"""{closure}, {name}_pairs AS (SELECT q.qid, p.id, {COS} AS similarity FROM search_queries q JOIN products p
        ON coalesce(p.catalog_status, 'ACTIVE') = 'ACTIVE' AND p.embedding IS NOT NULL
        WHERE q.category_id IS NULL OR p.category_id IN (SELECT c.id FROM closure c WHERE c.root_id = q.category_id)),
    {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INT) AS rank FROM {name}_pairs WHERE similarity >= {threshold}) WHERE rank <= {k})"""


@query("knn_join", f"WITH RECURSIVE {knn_sql(10, 0.1)} SELECT qid, id, similarity, rank FROM knn")
def _(t):
    return V.knn_join(t.search_queries, t.products, t.categories, threshold=0.1, k=10)


@query("match_products", f"""
    WITH RECURSIVE {knn_sql(16, 0.0)} SELECT k.qid, k.id, k.similarity, k.rank, e.brand_name, e.category, e.category_audience, e.item_name, e.price, e.brand_follower_count, e.brand_niche_score
    FROM knn k JOIN ({ENRICHED_BRANDS}) e ON e.id = k.id""")
def _(t):
    rows = V.match_products(t.search_queries, t.products, t.brands, t.categories, threshold=0.0, k=16)
    return rows.select("qid", "id", "similarity", "rank", "brand_name", "category", "category_audience", "item_name", "price", "brand_follower_count", "brand_niche_score")


@query("match_brands", f"""
    WITH p AS (SELECT CAST(vec_id AS STRING) AS id, p_brand AS brand_handle, 'https://posts.example.com/' || vec_id AS post_url, embedding FROM embeddings JOIN part ON p_partkey = vec_id)
    SELECT qid, id, brand_handle, post_url, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INT) AS rank FROM
      (SELECT q.qid, p.id, p.brand_handle, p.post_url, {COS} AS similarity FROM search_queries q, p) WHERE similarity >= 0.3) WHERE rank <= 5""")
def _(t):
    images = t.embeddings.join(t.part, t.embeddings["vec_id"] == t.part["p_partkey"]).select(
        F.col("vec_id").cast("string").alias("id"), F.col("p_brand").alias("brand_handle"),
        F.concat(F.lit("https://posts.example.com/"), F.col("vec_id").cast("string")).alias("post_url"), "embedding")
    return V.match_brands(t.search_queries.select("qid", "embedding"), images, threshold=0.3, k=5)


@query("ann_knn")
def _(t):
    from registry.core import DIM
    from vitrine.operators.topk import approximate_topk

    return approximate_topk(t.search_queries.select("qid", "embedding"), t.products.select("id", "embedding"), 10, dim=DIM)


def indexed(t, cells: int = 32):
    """The products' vectors in a stored inverted-file index."""
    path = scratch_folder(t.spark, "vector-index")
    items = t.products.where("coalesce(catalog_status, 'ACTIVE') = 'ACTIVE'").select("id", "embedding", "category_id")
    I.write_index(items, I.fit_centroids(items, cells), path)
    return I.open_index(t.spark, path)


@query("ann_knn_exact", f"WITH RECURSIVE {knn_sql(10, -2.0)} SELECT qid, id, similarity, rank FROM knn")
def _(t):
    index, centroids = indexed(t)
    return I.ivf_topk(V.attach_scope(t.search_queries, t.categories), index, centroids, 10, probes=4, exact=True)


@query("ann_recall", f"WITH RECURSIVE {knn_sql(10, -2.0)} SELECT count(DISTINCT qid) AS queries, count(*) AS wanted, 1.0::DOUBLE AS recall FROM knn")
def _(t):
    index, centroids = indexed(t)
    queries = V.attach_scope(t.search_queries, t.categories)
    found = I.ivf_topk(queries, index, centroids, 10, probes=4, exact=True)
    exact = exact_topk(queries, t.products.where("coalesce(catalog_status, 'ACTIVE') = 'ACTIVE'"), 10)
    return I.recall_at_k(found, exact)


@query("nearest_neighbor_similarity", """
    SELECT a.vec_id::VARCHAR AS id, max(round_even(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)) AS nearest_neighbor_similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label GROUP BY 1""")
def _(t):
    from vitrine.operators.discovery import nearest_neighbor_similarity

    items = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").cast("string").alias("grp"))
    return nearest_neighbor_similarity(items, "grp")


ATTRS = attributes_sql("query", HARDWARE, WORDS, "search_queries", "qid").strip()
QA = f"qa AS ({ATTRS})"


@query("exact_type_products", f"""
    WITH RECURSIVE {knn_sql(80, 0.0)}, {QA}, s AS (SELECT id, {H.SEARCH_TEXT.replace("coalesce(category,'')", "''")} AS txt FROM products WHERE coalesce(catalog_status, '') <> 'NON_PRODUCT'),
    types AS (SELECT * FROM (VALUES {', '.join(f"({lit(k)}, {lit('(^|[^a-z0-9])(' + '|'.join(ts) + ')(s)?([^a-z0-9]|$)')})" for k, ts in H.TYPE_TERMS.items())}) AS v(product_type, rx)),
    hits AS (SELECT s.id, types.product_type FROM s JOIN types ON regexp_matches(s.txt, types.rx)),
    miss AS (SELECT qa.qid, h.id FROM qa JOIN hits h ON h.product_type = qa.product_type WHERE NOT EXISTS (SELECT 1 FROM knn k WHERE k.qid = qa.qid AND k.id = h.id))
    SELECT qid, id, rank FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY id) AS INT) AS rank FROM miss) WHERE rank <= 100""")
def _(t):
    queries = V.with_attributes(t.search_queries, HARDWARE, WORDS)
    retrieved = V.knn_join(t.search_queries, t.products, t.categories, threshold=0.0, k=80)
    return V.exact_type_products(queries.select("qid", F.col("attributes.product_type").alias("product_type")), t.products, retrieved, HARDWARE)


# ---------------------------------------------------------------- lexical

LEX_STOP = "(" + ", ".join(lit(w) for w in L.STOP_WORDS) + ")"


def lex_sql(text: str) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN {LEX_STOP}), "
            "lambda w: regexp_replace(w, '^(.{2,}[^s])s$', '\\1'))")


@query("lexemes", f"SELECT doc_id, array_to_string({lex_sql('text')}, ' ') AS lexemes FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(L.lexemes(F.col("text")), " ").alias("lexemes"))


M = "metadata"
FIELDS_SQL = {
    "a": "concat_ws(' ', product_name)",
    "b": f"concat_ws(' ', normalized_main_category, normalized_subcategory, subcategory, {M}.product_type, {M}.product_family)",
    "c": f"concat_ws(' ', {M}.primary_colour, array_to_string({M}.secondary_colours, ' '), array_to_string({M}.style, ' '), array_to_string({M}.hashtags, ' '))",
    "d": f"concat_ws(' ', description, brand, {M}.caption)",
}
TF = " + ".join(f"{w} * len(list_filter({n}, lambda x: x = term))" for n, w in L.FIELD_WEIGHTS)
LEXICAL_BODY = f"""
    idx AS (SELECT id, category_id, {', '.join(f'{lex_sql(e)} AS {n}' for n, e in FIELDS_SQL.items())} FROM products WHERE coalesce(catalog_status, 'ACTIVE') = 'ACTIVE'),
    qt AS (SELECT qid, category_id, list_distinct({lex_sql('query')}) AS terms FROM search_queries),
    ut AS (SELECT DISTINCT unnest(terms) AS term FROM qt),
    tf AS (SELECT idx.id, idx.category_id, ut.term, {TF} AS w FROM idx JOIN ut ON list_contains(list_concat(a, list_concat(b, list_concat(c, d))), ut.term)),
    qterm AS (SELECT qid, category_id, len(terms) AS n, unnest(terms) AS term FROM qt),
    fts0 AS (SELECT qterm.qid, tf.id, sum(tf.w)::DOUBLE AS similarity FROM qterm JOIN tf ON tf.term = qterm.term
             WHERE qterm.category_id IS NULL OR tf.category_id IN (SELECT c.id FROM closure c WHERE c.root_id = qterm.category_id) GROUP BY qterm.qid, tf.id, qterm.n HAVING count(*) = qterm.n),
    fts AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round_even(similarity, 9) DESC, id) AS INT) AS rank FROM fts0) WHERE rank <= 100)"""
LEXICAL_SQL = CLOSURE_SQL.replace("WITH RECURSIVE ", "", 1) + "," + LEXICAL_BODY


@query("full_text_hits", f"WITH RECURSIVE {LEXICAL_SQL} SELECT qid, id, round_even(similarity, 6) AS similarity, rank FROM fts")
def _(t):
    hits = L.full_text_hits(V.attach_scope(t.search_queries, t.categories), L.index_products(t.products), 100)
    return hits.withColumn("similarity", F.bround("similarity", 6))


@query("weighted_lexical_rank", f"""
    WITH idx AS (SELECT id, {', '.join(f'{lex_sql(e)} AS {n}' for n, e in FIELDS_SQL.items())} FROM products WHERE coalesce(catalog_status, 'ACTIVE') = 'ACTIVE')
    SELECT id, round_even(list_sum(list_transform(['red', 'ring', 'kurti'], lambda term: {TF}))::DOUBLE, 6) AS rank FROM idx""")
def _(t):
    index = L.index_products(t.products)
    return index.select("id", F.bround(L.weighted_lexical_rank(F.array(F.lit("red"), F.lit("ring"), F.lit("kurti"))), 6).alias("rank"))


def trigram_sql(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("trigram_similarity", f"""
    WITH n AS (SELECT DISTINCT product_name AS name FROM products WHERE product_name IS NOT NULL), w AS (SELECT name, list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM n),
    r AS (SELECT name, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), r2 AS (SELECT name, ws, i, unnest(range(i, len(ws) + 1)) AS j FROM r),
    q AS (SELECT DISTINCT query FROM search_queries), g AS (SELECT query, {trigram_sql('query')} AS qg FROM q),
    e AS (SELECT name, {trigram_sql("array_to_string(ws[i:j], ' ')")} AS ng FROM r2),
    s AS (SELECT query, name, len(list_intersect(qg, ng)) AS shared, len(qg) AS a, len(ng) AS b FROM g, e)
    SELECT query, name, round_even(max(shared / (a + b - shared)::DOUBLE), 6) AS similarity FROM s GROUP BY 1, 2 HAVING max(shared / (a + b - shared)::DOUBLE) > 0.35""")
def _(t):
    names = t.products.select(F.col("product_name").alias("name")).distinct().where("name IS NOT NULL")
    texts = t.search_queries.select("query").distinct()
    return L.trigram_pairs(texts, names).withColumn("similarity", F.bround("similarity", 6))


def lexical_sql(queries: str, alternatives: str, k: int) -> str:
    """SQL of a whole lexical search: ``queries`` gives (qid, query, category_id), ``alternatives`` (qid, nth, must, must_not)."""
    closure = CLOSURE_SQL.replace("WITH RECURSIVE ", "", 1)
    inside = "(lq.category_id IS NULL OR {0}.category_id IN (SELECT c.id FROM closure c WHERE c.root_id = lq.category_id))"
    words = "list_concat(a, list_concat(b, list_concat(c, d)))"
    return f"""WITH RECURSIVE {closure}, lq AS ({queries}), alts AS ({alternatives}),
    idx AS (SELECT id, category_id, {', '.join(f'{lex_sql(e)} AS {n}' for n, e in FIELDS_SQL.items())} FROM products WHERE coalesce(catalog_status, 'ACTIVE') = 'ACTIVE'),
    met AS (SELECT lq.qid, idx.id, list_sum(list_transform(must, lambda term: {TF}))::DOUBLE AS w FROM alts JOIN lq USING (qid) JOIN idx
      ON list_has_all({words}, must) AND NOT list_has_any({words}, must_not) AND {inside.format('idx')} WHERE len(must) > 0),
    best AS (SELECT qid, id, max(round_even(w, 9)) AS similarity FROM met GROUP BY 1, 2),
    fts AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INT) AS rank FROM best) WHERE rank <= {k}),
    few AS (SELECT lq.qid, lq.query, lq.category_id, count(fts.id) AS n FROM lq LEFT JOIN fts ON fts.qid = lq.qid GROUP BY ALL HAVING count(fts.id) < {L.FALLBACK_HITS}),
    live AS (SELECT id, product_name, brand, category_id FROM products WHERE coalesce(catalog_status, 'ACTIVE') = 'ACTIVE'),
    nm AS (SELECT name, list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM (SELECT product_name AS name FROM live UNION SELECT brand FROM live) WHERE name IS NOT NULL),
    r1 AS (SELECT name, ws, unnest(range(1, len(ws) + 1)) AS i FROM nm), r2 AS (SELECT name, ws, i, unnest(range(i, len(ws) + 1)) AS j FROM r1),
    g AS (SELECT query, {trigram_sql('query')} AS qg FROM (SELECT DISTINCT query FROM few)), e AS (SELECT name, {trigram_sql("array_to_string(ws[i:j], ' ')")} AS ng FROM r2),
    s AS (SELECT query, name, len(list_intersect(qg, ng)) AS shared, len(qg) AS na, len(ng) AS nb FROM g, e),
    near AS (SELECT query, name, max(shared / (na + nb - shared)::DOUBLE) AS similarity FROM s GROUP BY 1, 2 HAVING max(shared / (na + nb - shared)::DOUBLE) > {L.TRIGRAM_FLOOR}),
    tri AS (SELECT lq.qid, live.id, lq.n, max(similarity) AS similarity FROM few lq JOIN near USING (query) JOIN live ON (live.product_name = near.name OR live.brand = near.name) AND {inside.format('live')}
      WHERE NOT EXISTS (SELECT 1 FROM fts WHERE fts.qid = lq.qid AND fts.id = live.id) GROUP BY ALL),
    filled AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS r FROM tri)
    SELECT qid, id, round_even(similarity, 6) AS similarity, rank, 'text' AS source FROM fts UNION ALL SELECT qid, id, round_even(similarity, 6), CAST(r + n AS INT), 'trigram' FROM filled WHERE r <= {k} - n"""


@query("lexical_search", lexical_sql("SELECT qid, query, category_id FROM search_queries", f"SELECT qid, 0 AS nth, list_distinct({lex_sql('query')}) AS must, []::VARCHAR[] AS must_not FROM search_queries", 100))
def _(t):
    return L.lexical_search(V.attach_scope(t.search_queries, t.categories), t.products, 100).withColumn("similarity", F.bround("similarity", 6))


MIXED = "SELECT qid, category_id, CASE WHEN CAST(qid AS INT) % 2 = 0 THEN query || ' OR gizmos -plate' ELSE translate(query, 'aeiou', 'aeiuo') END AS query, CASE WHEN CAST(qid AS INT) % 2 = 0 THEN query ELSE translate(query, 'aeiou', 'aeiuo') END AS first FROM search_queries"


@query("fts_union_trigram", lexical_sql(f"SELECT qid, query, category_id FROM ({MIXED})", f"""SELECT qid, 0 AS nth, list_distinct({lex_sql('first')}) AS must, []::VARCHAR[] AS must_not FROM ({MIXED})
    UNION ALL SELECT qid, 1, ['gizmo'], ['plate'] FROM search_queries WHERE CAST(qid AS INT) % 2 = 0""", 20))
def _(t):
    queries = t.search_queries.withColumn("query", F.when(F.col("qid").cast("int") % 2 == 0, F.concat("query", F.lit(" OR gizmos -plate"))).otherwise(F.translate("query", "aeiou", "aeiuo")))
    return L.lexical_search(V.attach_scope(queries, t.categories), t.products, 20).withColumn("similarity", F.bround("similarity", 6))


@query("hybrid_candidates")
def _(t):
    return V.hybrid_candidates(D.resolve_queries(t.search_queries, HARDWARE, WORDS), t.products, t.brands, t.categories, bounds={n: n for n in D.FILTERS})


# ---------------------------------------------------------------- fusion


def run(t, run_id):
    return t.runs.where(F.col("run_id") == run_id).select("qid", F.col("product_id").alias("id"), "rank")


@query("rrf_fuse", """
    WITH l AS (SELECT qid, product_id AS id, CASE run_id WHEN 'a' THEN 0 ELSE 1 END AS list, min(rank) AS rank, round_even(sum(CASE run_id WHEN 'a' THEN 2.0 ELSE 1.0 END::DOUBLE / (60 + rank)), 14) AS gain FROM runs GROUP BY 1, 2, 3),
    f AS (SELECT qid, id, round_even(sum(gain), 12) AS score, min((list, rank)) AS first_seen FROM l GROUP BY 1, 2)
    SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_seen) AS INT) AS rank FROM f""")
def _(t):
    return U.rrf_fuse([run(t, "a"), run(t, "b")], 60, [2.0, 1.0])


@query("rank_in_list", """
    SELECT run_id, qid, product_id, CAST(row_number() OVER (PARTITION BY qid, run_id ORDER BY score DESC, product_id) AS INT) AS rank FROM
    (SELECT run_id, qid, product_id, max(CAST((rank * 7) % 5 AS DOUBLE)) AS score FROM runs GROUP BY 1, 2, 3)""")
def _(t):
    rows = t.runs.groupBy("run_id", "qid", "product_id").agg(F.max(((F.col("rank") * 7) % 5).cast("double")).alias("score"))
    return U.rank_in_list(rows, "score", ("qid", "run_id"), "product_id").drop("score")


@query("minmax_per_query", """
    SELECT user_id, event_id, round_even(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1.0 END, 9) AS scaled FROM
    (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)""")
def _(t):
    rows = U.minmax_per_query(t.events, "value", "scaled", "user_id")
    return rows.select("user_id", "event_id", F.bround("scaled", 9).alias("scaled"))


@query("candidate_union", """
    SELECT qid, id, run_id, rank FROM (SELECT qid, product_id AS id, run_id, rank, row_number() OVER (PARTITION BY qid, product_id ORDER BY run_id DESC, rank) AS n FROM runs) WHERE n = 1""")
def _(t):
    part = lambda r: t.runs.where(F.col("run_id") == r).select("qid", F.col("product_id").alias("id"), "run_id", "rank")
    return U.candidate_union([part("b"), part("a")])


# ---------------------------------------------------------------- ranking


def ranked_candidates(t, k=80):
    """Vector candidates with all product columns, the parsed query and the requested category."""
    queries = V.with_attributes(t.search_queries, HARDWARE, WORDS)
    hits = cut_lineage(V.knn_join(t.search_queries, t.products, t.categories, threshold=0.0, k=k))
    products = C.enrich_products(t.products.drop("embedding"), t.brands, t.categories)
    facts = queries.select("qid", "attributes", F.col("category_id").alias("requested_category_id"))
    return R.described_hits(hits, products, HARDWARE).join(facts, "qid")


def shared_sql(hay: str, items: str, empty: str) -> str:
    split = f"string_split({items}, ',')"
    return f"CASE WHEN {items} = '' THEN {empty}::DOUBLE ELSE len(list_filter({split}, lambda x: contains({hay}, x))) / len({split})::DOUBLE END"


def per_type(text: str, column: str, options) -> str:
    return f"coalesce(CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {term(text, *ts)}" for k, ts in options.items()) + " END, FALSE)"


GENDER = gender_score_sql("aud", "gender")
STYLE_LIST = "concat_ws(',', nullif(styles, ''), nullif(aesthetic_terms, ''))"


def features_sql(k: int = 80, threshold: float = 0.0) -> str:
    """SQL: candidates of every query with text columns; ends in table rk."""
    return f"""{knn_sql(k, threshold)}, {QA}, en AS ({ENRICHED_BRANDS}),
    tx AS (SELECT en.*, {H.SEARCH_TEXT} AS hay, {H.AUDIENCE_TEXT} AS aud, {CATEGORY_WORDS_SQL} AS cat FROM en),
    rk AS (SELECT knn.qid, knn.similarity, knn.rank, tx.*, qa.* EXCLUDE (qid), sq.category_id AS req FROM knn JOIN tx ON tx.id = knn.id JOIN qa ON qa.qid = knn.qid JOIN search_queries sq ON sq.qid = knn.qid)"""


SIGNALS_SQL = f"""
    {category_score_sql('product_family', 'req', 'cat')} AS s_cat,
    CASE WHEN product_family IS NULL THEN 0.5::DOUBLE WHEN {per_type('hay', 'product_family', H.FAMILY_TERMS)} THEN 1.0 ELSE 0.0 END AS s_fam,
    CASE WHEN product_type IS NULL THEN 0.5::DOUBLE WHEN {per_type('hay', 'product_type', H.TYPE_TERMS)} THEN 1.0 ELSE 0.0 END AS s_type,
    {shared_sql('hay', 'colours', '0.5')} AS s_col, {shared_sql('hay', STYLE_LIST, '0.5')} AS s_sty, {shared_sql('hay', 'fits', '0.5')} AS s_fit,
    {GENDER} AS s_gen, coalesce(least(1.0, greatest(0.0, niche_score)), 0.0)::DOUBLE AS s_nic, {shared_sql('hay', 'query_tokens', '0.5')} AS s_txt"""
TEXT_SCORE_SQL = "round_even(0.22 * similarity + 0.08 * s_txt + 0.12 * s_cat + 0.22 * s_fam + 0.20 * s_type + 0.06 * s_col + 0.04 * s_sty + 0.02 * s_fit + 0.02 * s_gen + 0.02 * s_nic, 12)"
GATES_SQL = """g1 AS (SELECT * FROM sc WHERE product_family IS NULL OR s_fam > 0),
    g2 AS (SELECT * FROM (SELECT *, max(CAST(s_type > 0 AS INT)) OVER (PARTITION BY qid) AS any_type FROM g1) WHERE product_type IS NULL OR s_type > 0 OR any_type = 0),
    g3 AS (SELECT * FROM (SELECT *, max(CAST(s_gen > 0 AS INT)) OVER (PARTITION BY qid) AS any_gen FROM g2) WHERE gender IS NULL OR s_gen > 0 OR any_gen = 0)"""
BUCKET = "round_even(final_score / 1e-5, 0)"


@query("final_ranking_text", f"""
    WITH RECURSIVE {features_sql()}, sc0 AS (SELECT *, {SIGNALS_SQL} FROM rk), sc AS (SELECT *, {TEXT_SCORE_SQL} AS final_score FROM sc0), {GATES_SQL}
    SELECT qid, id, position, round_even(final_score, 6) AS final_score, s_fam AS family, s_type AS type, s_gen AS gender FROM
    (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {BUCKET} DESC, id) AS INT) AS position FROM g3) WHERE position <= 16""")
def _(t):
    ranked = R.rank_results(R.score_text(ranked_candidates(t), HARDWARE), "score", 16)
    b = "score_breakdown."
    return ranked.select("qid", "id", "position", F.bround("final_score", 6).alias("final_score"), F.col(b + "product_family_match").alias("family"),
                         F.col(b + "product_type_match").alias("type"), F.col(b + "gender_match").alias("gender"))


IMAGE_SCORE_SQL = "round_even(0.72 * similarity + 0.09 * s_cat + 0.06 * s_type + 0.03 * s_col + 0.03 * s_sty + 0.02 * s_gen + 0.05 * s_nic, 12)"
DOMINANT_SQL = """lead AS (SELECT qid, category_id, rank FROM rk WHERE rank <= 10), nl AS (SELECT qid, count(*) AS n_lead FROM lead GROUP BY 1),
    dc AS (SELECT qid, category_id, count(*) AS n, min(rank) AS fr FROM lead WHERE category_id IS NOT NULL GROUP BY 1, 2),
    dom AS (SELECT d.qid, d.category_id AS dominant_category FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, fr) AS r FROM dc) d JOIN nl ON nl.qid = d.qid WHERE r = 1 AND n >= greatest(3, n_lead // 2))"""


@query("dominant_category", f"WITH RECURSIVE {features_sql()}, {DOMINANT_SQL} SELECT qid, dominant_category FROM dom")
def _(t):
    return R.dominant_category(ranked_candidates(t))


@query("final_ranking_image", f"""
    WITH RECURSIVE {features_sql()}, {DOMINANT_SQL}, rk2 AS (SELECT rk.* EXCLUDE (req), coalesce(rk.req, dom.dominant_category) AS req FROM rk LEFT JOIN dom ON dom.qid = rk.qid),
    sc0 AS (SELECT *, {SIGNALS_SQL} FROM rk2), sc AS (SELECT *, {IMAGE_SCORE_SQL} AS final_score FROM sc0)
    SELECT qid, id, position, round_even(final_score, 6) AS final_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {BUCKET} DESC, id) AS INT) AS position FROM sc) WHERE position <= 16""")
def _(t):
    ranked = R.rank_results(R.score_image(ranked_candidates(t), HARDWARE), "score", 16)
    return ranked.select("qid", "id", "position", F.bround("final_score", 6).alias("final_score"))


FULL_HAY = ("lower(concat_ws(' ', hay, concat_ws(' ', coalesce(metadata.primary_colour, ''), coalesce(array_to_string(metadata.secondary_colours, ' '), ''), "
            "coalesce(array_to_string(metadata.style, ' '), ''), coalesce(metadata.product_type, ''))))")
AUD_SIGNAL = f"CASE WHEN gender = 'women' THEN {audience_signal_sql('aud', 'women')} WHEN gender = 'men' THEN {audience_signal_sql('aud', 'men')} ELSE 0.0::DOUBLE END"
STYLES_FITS = "concat_ws(',', nullif(styles, ''), nullif(fits, ''), nullif(aesthetic_terms, ''))"


def rerank_sql(source: str) -> str:
    """SQL tables over a candidate table, ending in rr with final_score and its parts."""
    return f"""rr0 AS (SELECT *, {FULL_HAY} AS full_hay, min(similarity) OVER (PARTITION BY qid) AS lo, max(similarity) OVER (PARTITION BY qid) AS hi FROM {source}),
    rr1 AS (SELECT *, CASE WHEN hi > lo THEN (similarity - lo) / (hi - lo) ELSE 1.0 END AS fused,
            CASE WHEN {per_type('full_hay', 'product_type', H.TYPE_TERMS)} THEN 1.0::DOUBLE WHEN {per_type('full_hay', 'product_family', H.FAMILY_TERMS)} THEN 0.5 ELSE 0.0 END AS type_s,
            {AUD_SIGNAL} AS aud_s, {shared_sql('full_hay', 'colours', '0.0')} AS col_s, {shared_sql('full_hay', STYLES_FITS, '0.0')} AS sty_s,
            CASE WHEN min_price IS NULL AND max_price IS NULL THEN 0.0::DOUBLE WHEN price IS NULL OR price <= 0 THEN 0.0 WHEN price < min_price OR price > max_price THEN -1.0 ELSE 1.0 END AS pri_s,
            coalesce(least(1.0, greatest(0.0, classifier_confidence)), 0.0) AS con_s FROM rr0),
    rr AS (SELECT *, CASE WHEN aud_s >= 0 THEN 0.20 * aud_s ELSE -0.60 END AS aud_c,
           round_even(0.35 * fused + 0.25 * type_s + CASE WHEN aud_s >= 0 THEN 0.20 * aud_s ELSE -0.60 END + 0.08 * col_s + 0.05 * sty_s + 0.05 * pri_s + 0.02 * con_s, 12) AS final_score FROM rr1)"""


RERANK_SELECT = f"""SELECT qid, id, position, round_even(final_score, 6) AS final_score, round_even(aud_c, 6)::DOUBLE AS audience, round_even(0.25 * type_s, 6)::DOUBLE AS type
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {BUCKET} DESC, id) AS INT) AS position FROM rr) WHERE position <= 16"""


def rerank_columns(ranked):
    return ranked.select("qid", "id", "position", F.bround("final_score", 6).alias("final_score"),
                         F.bround("score_breakdown.audience", 6).alias("audience"), F.bround("score_breakdown.type", 6).alias("type"))


@query("structured_rerank", f"WITH RECURSIVE {features_sql()}, {rerank_sql('rk')} {RERANK_SELECT}")
def _(t):
    return rerank_columns(R.rank_results(R.structured_rerank(ranked_candidates(t), HARDWARE), "score", 16))


@query("gated_rerank", f"""
    WITH RECURSIVE {features_sql()}, sc AS (SELECT *, {SIGNALS_SQL} FROM rk), {GATES_SQL}, {rerank_sql('g3')} {RERANK_SELECT}""")
def _(t):
    return rerank_columns(R.rank_results(R.gated_rerank(ranked_candidates(t), HARDWARE), "score", 16))


MODES = [m for m in R.SORT_MODES if m != "score"]
SORT_SQL = {
    "newest": "scraped_at DESC NULLS LAST", "popular": "least(1.0, (coalesce(likes_count, 0) + coalesce(comments_count, 0) * 3) / 10000.0) DESC",
    "price_asc": "price ASC NULLS LAST", "price_desc": "CASE WHEN coalesce(price, 0) = 0 THEN -1.0 ELSE price END DESC", "niche_score": "coalesce(niche_score, 0.0) DESC",
}


@query("sort_modes", f"WITH RECURSIVE {knn_sql(40, 0.0)}, c AS (SELECT knn.qid, p.* FROM knn JOIN products p ON p.id = knn.id) " + " UNION ALL ".join(
    f"SELECT '{m}' AS mode, qid, id, position FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY {o}, id) AS INT) AS position FROM c) WHERE position <= 5" for m, o in SORT_SQL.items()))
def _(t):
    hits = V.knn_join(t.search_queries, t.products, t.categories, threshold=0.0, k=40)
    rows = hits.join(t.products.drop("embedding", "category_id"), "id")
    parts = [R.rank_results(rows, m, 5).select(F.lit(m).alias("mode"), "qid", "id", "position") for m in MODES]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("rank_key", """
    SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY round_even(l_discount / 0.02, 0) DESC, l_orderkey * 10 + l_linenumber) AS INT) AS position FROM lineitem""")
def _(t):
    from vitrine.functions.scores import rank_bucket

    position = F.row_number().over(R.Window.partitionBy("l_suppkey").orderBy(
        F.desc(rank_bucket(F.col("l_discount"), 0.02)), F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    return t.lineitem.select("l_orderkey", "l_linenumber", position.alias("position"))


RANKED_SQL = f"""{features_sql()}, sc0 AS (SELECT *, {SIGNALS_SQL} FROM rk), sc AS (SELECT *, {TEXT_SCORE_SQL} AS final_score FROM sc0), {GATES_SQL},
    pos AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {BUCKET} DESC, id) AS INT) AS position FROM g3) WHERE position <= 16)"""


@query("split_groups", f"""
    WITH RECURSIVE {RANKED_SQL}, e AS (SELECT qid, id, position, product_type IS NULL OR s_type > 0 AS exact FROM pos),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid, exact ORDER BY position) AS nth FROM e),
    b AS (SELECT *, CASE WHEN exact AND nth <= 8 THEN 'best' ELSE 'more' END AS "group" FROM n)
    SELECT qid, id, "group", CAST(row_number() OVER (PARTITION BY qid, "group" ORDER BY exact DESC, position) AS INT) AS group_position FROM b""")
def _(t):
    ranked = R.rank_results(R.score_text(ranked_candidates(t), HARDWARE), "score", 16)
    return R.split_groups(ranked, HARDWARE).select("qid", "id", "group", "group_position")


@query("similar_brands_from_results", f"""
    WITH RECURSIVE {RANKED_SQL}, r AS (SELECT *, trim(coalesce(brand_name, '')) AS bn FROM pos),
    g AS (SELECT qid, bn, count(*) AS matched, min(position) AS fp, max((similarity, -position)) AS key FROM r WHERE bn <> '' AND lower(bn) <> 'unknown brand' GROUP BY 1, 2),
    j AS (SELECT g.qid, g.bn AS brand_name, r.brand_id, r.brand_follower_count AS followers, r.niche_score, r.id AS representative_id, r.similarity, g.matched, g.fp FROM g JOIN r ON r.qid = g.qid AND r.bn = g.bn AND (r.similarity, -r.position) = g.key)
    SELECT qid, brand_name, brand_id, followers, niche_score, representative_id, similarity, matched AS matched_product_count, brand_position FROM
    (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, coalesce(niche_score, 0) DESC, matched DESC, fp) AS INT) AS brand_position FROM j) WHERE brand_position <= 6""")
def _(t):
    ranked = R.rank_results(R.score_text(ranked_candidates(t), HARDWARE), "score", 16)
    return R.similar_brands_from_results(ranked).drop("brand_niche_score")


PREF_HAY = "lower(concat_ws(' ', coalesce(category,''), coalesce(subcategory,''), coalesce(normalized_main_category,''), coalesce(normalized_subcategory,''), coalesce(description,''), coalesce(product_name,''), coalesce(audience,'')))"


def pref_any(column: str) -> str:
    return f"CASE WHEN coalesce(len({column}), 0) > 0 THEN CAST(len(list_filter({column}, lambda v: contains(phay, lower(v)))) > 0 AS INT)::DOUBLE END"


MATCH_SQL = f"""pm0 AS (SELECT e.*, i.user_id, f.* EXCLUDE (user_id), {PREF_HAY} AS phay FROM (SELECT DISTINCT user_id, product_id FROM interactions) i JOIN ({H.ENRICHED}) e ON e.id = i.product_id LEFT JOIN preferences f ON f.user_id = i.user_id),
    pm1 AS (SELECT user_id, id, list_filter([CASE WHEN list_contains(saved_brand_ids, brand_id) THEN 1.0::DOUBLE END, {pref_any('favourite_categories')}, {pref_any('preferred_styles')}, {pref_any('preferred_colours')},
        CASE WHEN gender_preference IS NOT NULL THEN CAST(contains(phay, lower(gender_preference)) OR contains(phay, 'unisex') AS INT)::DOUBLE END,
        CASE WHEN price IS NOT NULL AND (min_price IS NOT NULL OR max_price IS NOT NULL) THEN CAST(coalesce(price >= min_price, TRUE) AND coalesce(price <= max_price, TRUE) AS INT)::DOUBLE END], lambda v: v IS NOT NULL) AS sig FROM pm0),
    pm AS (SELECT user_id, id, CASE WHEN len(sig) > 0 THEN round_even(list_sum(sig) / len(sig), 9) ELSE 0.0 END AS match FROM pm1)"""


@query("personalization_match", f"WITH {MATCH_SQL} SELECT user_id, id, match FROM pm")
def _(t):
    products = C.attach_category(t.products.drop("embedding"), t.categories)
    pairs = t.interactions.select("user_id", F.col("product_id").alias("id")).distinct()
    rows = C.personalized_products(products, t.preferences, pairs)
    return rows.select("user_id", "id", F.bround(personalization_match(rows, rows), 9).alias("match"))


@query("personalized_ranking", f"""
    WITH {MATCH_SQL} SELECT user_id, pm.id, round_even(0.9 * coalesce(p.niche_score, 0) + 0.1 * match, 6) AS score FROM pm JOIN products p ON p.id = pm.id""")
def _(t):
    from vitrine.functions.personal import blend_personal

    products = C.attach_category(t.products.drop("embedding"), t.categories)
    pairs = t.interactions.select("user_id", F.col("product_id").alias("id")).distinct()
    rows = C.personalized_products(products, t.preferences, pairs)
    return rows.select("user_id", "id", F.bround(blend_personal(F.coalesce("niche_score", F.lit(0.0)), personalization_match(rows, rows)), 6).alias("score"))


# ---------------------------------------------------------------- whole searches


def discover(t, queries=None, **kw):
    return D.batch_discover(t.search_queries if queries is None else queries, t.products, t.brands, t.categories, HARDWARE, WORDS, **kw)


def shape(df):
    return df.select("qid", "position", "id", F.bround("final_score", 6).alias("final_score"), "group", "group_position", "inventory_gap")


@query("batch_discover")
def _(t):
    return shape(discover(t))


@query("batch_discover_hybrid")
def _(t):
    return shape(discover(t, mode="hybrid", rerank="gated"))


@query("batch_recommend")
def _(t):
    results, brands = D.batch_recommend(t.search_queries, t.products, t.brands, t.categories, HARDWARE, WORDS)
    found = results.select("qid", F.lit("product").alias("kind"), "position", F.col("id").alias("name"))
    return found.unionByName(brands.select("qid", F.lit("brand").alias("kind"), F.col("brand_position").alias("position"), F.col("brand_name").alias("name")))


@query("related_products")
def _(t):
    rows = D.related_products(t.products, t.products, t.brands, t.categories, HARDWARE, WORDS)
    return rows.select("qid", "position", "id", F.bround("final_score", 6).alias("final_score"))
