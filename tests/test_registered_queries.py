"""Every registered query runs at the smallest scale; those with SQL agree with DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from registry.views import BASE_TABLES
from tools.check_queries import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "identify_product", "extract_query_attributes", "clean_product_name", "deterministic_pipeline", "match_products",
    "final_ranking_text", "structured_rerank", "duplicate_members", "catalog_summary", "eval_metrics", "gem_score",
    "similar_brands", "search_analytics", "upsert_products", "stream_engagement", "related_by_category_or_brand",
]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("key", SAMPLE)
def test_agrees_with_sql(spark, duck, key):
    df = QUERIES[key](spark, SMALL)
    cursor = duck.execute(ORACLES[key])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
