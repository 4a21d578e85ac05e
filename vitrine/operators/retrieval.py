"""Candidate retrieval for a table of queries: vector, exact type, brand, hybrid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import (
    extract_query_attributes, matched_types, product_search_text,
)
from vitrine.operators.catalog import ENRICHED_COLUMNS, category_closure, enrich_products
from vitrine.operators.filters import filter_condition, is_active, is_not_non_product
from vitrine.operators.fusion import minmax, rrf_fuse
from vitrine.operators.lexical import lexical_search
from vitrine.operators.sizes import small_side
from vitrine.operators.topk import exact_topk
from vitrine.taxonomy import QueryVocabulary, Taxonomy

DISCOVER_CANDIDATES = 80
DISCOVER_RESULTS = 16
RETRIEVER_CANDIDATES = 100
EXACT_TYPE_ROWS = 100


def attach_scope(queries: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``scope``: the ids of the requested category and its descendants; null when none is requested."""
    scopes = category_closure(categories).groupBy(F.col("root_id").alias("category_id")).agg(
        F.sort_array(F.collect_set("id")).alias("_scope"))
    nothing = F.array().cast("array<bigint>")
    return (
        queries.join(small_side(scopes), "category_id", "left")
        .withColumn("scope", F.when(F.col("category_id").isNotNull(), F.coalesce("_scope", nothing))).drop("_scope"))


def with_attributes(queries: DataFrame, taxonomy: Taxonomy, words: QueryVocabulary) -> DataFrame:
    return queries.withColumn("attributes", extract_query_attributes(F.col("query"), taxonomy, words))


def knn_join(queries: DataFrame, products: DataFrame, categories: DataFrame, *, threshold: float, k: int) -> DataFrame:
    """(qid, id, similarity, rank) over active products with an embedding, within each query's scope."""
    items = products.where(is_active(F.col("catalog_status"))).select("id", "embedding", "category_id")
    return exact_topk(attach_scope(queries, categories), items, k, threshold=threshold)


def match_products(queries: DataFrame, products: DataFrame, brands: DataFrame, categories: DataFrame, *,
                   threshold: float = 0.35, k: int = 16) -> DataFrame:
    """The k nearest active products of each query, with the enriched product columns."""
    hits = knn_join(queries, products, categories, threshold=threshold, k=k)
    return hits.join(enrich_products(products, brands, categories).select(*ENRICHED_COLUMNS), "id")


def match_brands(queries: DataFrame, brand_images: DataFrame, *, threshold: float = 0.7, k: int = 5) -> DataFrame:
    """(qid, id, brand_handle, post_url, similarity, rank) over brand image embeddings."""
    hits = exact_topk(queries, brand_images.select("id", "embedding"), k, threshold=threshold)
    return hits.join(brand_images.select("id", "brand_handle", "post_url"), "id")


def exact_type_products(queries: DataFrame, products: DataFrame, retrieved: DataFrame, taxonomy: Taxonomy, *,
                        limit: int = EXACT_TYPE_ROWS) -> DataFrame:
    """(qid, id, rank): up to ``limit`` products of the requested type that retrieval did not return.

    ``queries`` carry product_type. A query leaves out at most as many products as retrieval returned to it, so only the
    first limit + (most rows retrieved for a query of the type) products of a type can be needed. The others are cut
    once per type instead of once per query, before the join.
    """
    requested = queries.where("product_type IS NOT NULL").select("qid", "product_type")
    kept = products.where(is_not_non_product(F.col("catalog_status")))
    if "category" not in kept.columns:
        kept = kept.withColumn("category", F.lit(""))
    typed = kept.select("id", F.explode(matched_types(product_search_text(kept), taxonomy)).alias("product_type"))
    counts = retrieved.groupBy("qid").agg(F.count("*").alias("_r"))
    most = requested.join(counts, "qid", "left").groupBy("product_type").agg((F.coalesce(F.max("_r"), F.lit(0)) + limit).alias("_most"))
    spot = Window.partitionBy("product_type").orderBy("id")
    ranked = typed.join(F.broadcast(most), "product_type").withColumn("_n", F.row_number().over(spot))  # one row per taxonomy type
    shortlist = ranked.where(F.col("_n") <= F.col("_most")).drop("_n", "_most")
    pairs = requested.join(shortlist, "product_type").join(retrieved.select("qid", "id"), ["qid", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("id"))
    return pairs.select("qid", "id").withColumn("rank", rank).where(F.col("rank") <= limit)


def hybrid_candidates(queries: DataFrame, products: DataFrame, brands: DataFrame, categories: DataFrame, *,
                      k: int = RETRIEVER_CANDIDATES, rrf_k: int = 60, weights=None, bounds: dict[str, str] | None = None) -> DataFrame:
    """Vector and lexical top-k, each filtered before fusion; the fused score is scaled to [0, 1] per query.

    ``bounds`` maps filter names (min_price, max_price, min_niche, min_followers, brand, gender) to columns
    of ``queries``.
    """
    catalog = enrich_products(products, brands, categories)
    facts = catalog.select(*ENRICHED_COLUMNS, "normalized_main_category", "normalized_subcategory", "audience")
    bounds = bounds or {}
    limits = queries.select("qid", *[F.col(c).alias(f"_{n}") for n, c in bounds.items()])

    def filtered(hits: DataFrame) -> DataFrame:
        rows = hits.select("qid", "id", "rank").join(facts, "id").join(limits, "qid")
        kept = rows.where(filter_condition(rows, **{n: F.col(f"_{n}") for n in bounds}))
        spot = Window.partitionBy("qid").orderBy("rank")
        return kept.select("qid", "id", F.row_number().over(spot).alias("rank"))

    scoped = attach_scope(queries, categories)
    items = products.where(is_active(F.col("catalog_status"))).select("id", "embedding", "category_id")
    vector = filtered(exact_topk(scoped, items, k, threshold=0.0))
    lexical = filtered(lexical_search(scoped, products, k))
    fused = rrf_fuse([vector, lexical], rrf_k, weights)
    return fused.withColumn("similarity", minmax(F.col("score"))).join(facts, "id")
