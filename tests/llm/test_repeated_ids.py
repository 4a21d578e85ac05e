"""Rows that share an id, or have none, keep their own content."""

from llm_helpers import docs_of  # noqa: F401
from test_free_operators import edited, prose

from vitrine.llm.common import row_key
from vitrine.llm.near_dedup import drop_near_copies


def test_different_texts_under_one_id_both_stay(docs_of):  # noqa: F811
    rows = [(7, prose(1)), (7, prose(2)), (9, prose(3))]
    assert sorted(r.text for r in drop_near_copies(docs_of(rows)).collect()) == sorted(t for _, t in rows)
    copies = [(8, edited(prose(2, 400), 1, 1)), (8, prose(2, 400)), (7, prose(2, 400)), (7, prose(1)), (7, prose(1)), (12, edited(prose(1, 400), 5, 1)), (11, prose(1, 400))]
    kept = drop_near_copies(docs_of(rows[2:] + copies)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[2], (7, prose(2, 400)), (7, prose(1)), (11, prose(1, 400))])


def test_rows_that_differ_in_nulls_or_maps_keep_their_content(spark):
    schema = "doc_id long, text string, lang string, source string, tags map<string,int>, notes array<string>"
    same = prose(4)
    rows = [(None, same, None, "x", {}, []), (None, same, "x", None, {}, []), (None, same, "x", "x", {"a": 1, "b": 2}, []), (None, same, "x", "x", {"a": 2, "b": 1}, []),
            (None, same, "x", "x", None, ["p", None]), (None, same, "x", "x", None, [None, "p"])]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(map(str, drop_near_copies(docs).collect())) == sorted(map(str, docs.collect()))
    flipped = docs.limit(3).selectExpr("map('b', 2, 'a', 1) AS tags").union(docs.limit(3).selectExpr("map('a', 1, 'b', 2) AS tags"))
    assert flipped.select(*row_key(flipped)).distinct().count() == 1
    nested = spark.sql("SELECT parse_json('{\"a\": 1}') AS v, named_struct('p', named_struct('q.r', 1), 'm', array(map(1, 'x'))) AS s UNION ALL SELECT parse_json('{\"a\": 2}'), named_struct('p', named_struct('q.r', 1), 'm', array(map(1, 'x')))")
    assert nested.select(*row_key(nested)).distinct().count() == 2
