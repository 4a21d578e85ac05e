"""What registered queries send through the driver."""

import re

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def narrow_tables(spark, tmp_path_factory):
    """Parts and vectors of a few kilobytes, which Spark would broadcast, and the categories of the views."""
    folder = str(tmp_path_factory.mktemp("narrow"))
    tables = {
        "part": spark.range(60).selectExpr(
            "id AS p_partkey", "concat('red ', element_at(array('ring', 'bolt', 'gear'), cast(id % 3 AS int) + 1)) AS p_name", "concat('Brand#', id % 4) AS p_brand",
            "'SMALL' AS p_type", "cast(id AS int) AS p_size", "cast(900 + id AS double) AS p_retailprice"),
        "embeddings": spark.range(40).selectExpr(
            "id AS vec_id", "transform(sequence(1, 64), i -> cast(cos(i * (id + 1)) AS float)) AS embedding", "cast(id % 3 AS int) AS label"),
        "region": spark.range(5).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name"),
        "nation": spark.range(25).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id % 5 AS n_regionkey"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("key", ["ann_recall", "exact_type_products", "hybrid_candidates", "final_ranking_text"])
def test_parts_and_vectors_meet_by_shuffle(spark, narrow_tables, key):
    """However few bytes Spark takes the table of parts to have, its keys do not go through the driver."""
    result = entry.queries()[key](spark, narrow_tables)
    joins = re.findall(r"(\w+Join) \[(?:vec_id|p_partkey)#\d+L\], \[(?:vec_id|p_partkey)#", result._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
    assert result.count() > 0
