"""The merge-on-read store, and streams over several micro-batches: post dedupe, windowed totals, ingest."""

import datetime as dt
import glob
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from registry.core import Tables
from registry.streaming_queries import as_stream
from conftest import SMALL
from vitrine.plans.ingest import dedupe_posts
from vitrine.session import SHUFFLE_CLEANUP, cut_lineage
from vitrine.sources.files import append_audit, read_ingestion_audit, upsert
from vitrine.sources.store import KeyedStore
from vitrine.streaming import jobs as J
from vitrine.taxonomy import FASHION, FASHION_WORDS

ROW = "source string, url string, name string, price double"


def table(spark, rows, schema=ROW):
    return spark.createDataFrame(rows, schema)


def store_at(spark, root, **more):
    return KeyedStore(spark, str(root), table(spark, []).schema, ("source", "url"), ("url",), **{"buckets": 4, **more})


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files_under(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_store_equals_whole_upserts(spark, tmp_path):
    """Batches, a replay and compactions against an upsert of the whole table, nulls overwriting."""
    store = store_at(spark, tmp_path / "s", most_deltas=2)
    assert found(store.read()) == []
    whole = table(spark, [])
    for batch in range(7):
        rows = table(spark, [("web", f"u{(batch * 3 + i) % 11}", f"n{batch}", None if i == 1 else float(i)) for i in range(5)])
        whole = spark.createDataFrame(upsert(whole, rows, ["source", "url"]).drop("_action").collect(), rows.schema)
        assert store.commit(rows, batch)
        assert found(store.read()) == found(whole)
        assert not store.commit(table(spark, [("web", "u0", "replayed", 0.0)]), batch)
        assert len(store.state().deltas) <= 2
        assert found(store.read()) == found(whole)
    store.compact()
    assert store.state().deltas == () and found(store.read()) == found(whole)
    gone = store.vacuum()
    assert gone and found(store.read()) == found(whole)
    assert {p.name for p in (tmp_path / "s" / "data").iterdir() if p.is_dir()} == store.state().folders()


def test_store_touches_its_buckets_only(spark, tmp_path):
    store = store_at(spark, tmp_path / "s", buckets=16)
    store.commit(table(spark, [("web", f"u{i}", "old", 1.0) for i in range(200)]), 0)
    store.compact()
    before = files_under(tmp_path / "s" / "data")
    one = table(spark, [("web", "u7", "new", 2.0)])
    store.commit(one, 1)
    buckets = store.touched(one)
    assert len(buckets) == 1 and store.state().deltas[-1][1] == tuple(buckets)
    assert len(files_under(tmp_path / "s" / "data")) == len(before) + 1
    store.compact()
    after = files_under(tmp_path / "s" / "data")
    assert all(after[p] == t for p, t in before.items()), "no file is rewritten in place"
    assert sum(name.startswith("base-") and name != store.state().base[buckets[0]] for name in store.state().base.values()) == len(store.state().base) - 1
    assert store.read().where("name = 'new'").count() == 1 and store.read().count() == 200
    looked_up = store.read(buckets)
    assert {r["url"] for r in looked_up.collect()} >= {"u7"} and looked_up.count() < 200


def test_store_of_partial_rows_nulls_and_a_failed_batch(spark, tmp_path):
    store = store_at(spark, tmp_path / "s")
    store.commit(table(spark, [("web", "u1", "one", 1.0), (None, None, "none", 3.0)]), 0)
    store.commit(table(spark, [("web", "u1", "uno"), ("web", "u2", "dos"), (None, None, "nada")], "source string, url string, name string"), 1)
    expected = found(table(spark, [("web", "u1", "uno", 1.0), ("web", "u2", "dos", None), (None, None, "nada", 3.0)]))
    assert found(store.read()) == expected
    # A batch that died after writing its rows and before its version: nothing of it is seen, and its replay counts.
    store._write(table(spark, [("web", "u9", "half", 0.0)]), "delta-000000000002")
    assert found(store.read()) == expected
    store.commit(table(spark, [("web", "u9", "whole", 0.0)]), 2)
    assert [r["name"] for r in store.read().where("url = 'u9'").collect()] == ["whole"]
    assert store.commit(table(spark, []), 3) and store.read().count() == 4


def test_a_small_delta_does_not_shuffle_the_base(spark, tmp_path):
    store = store_at(spark, tmp_path / "s")
    store.commit(table(spark, [("web", f"u{i}", "old", 1.0) for i in range(50)]), 0)
    store.compact()
    store.commit(table(spark, [("web", "u3", "new", 1.0)]), 1)
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


# ---------------------------------------------------------------- streams


POST = "doc_id long, instagram_post_id string, product_url string, image_url string, brand_name string, scraped_at timestamp"
DAY = dt.datetime(2024, 1, 1)


def replay(spark, df_batches, folder, start):
    """Feed one file per micro-batch."""
    folder.mkdir()
    for i, rows in enumerate(df_batches):
        rows.coalesce(1).write.parquet(str(folder / f"b{i:02d}"))
    schema = df_batches[0].schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "b*"))
    run = start(stream).trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def test_stream_dedupe_by_three_identities_over_batches(spark, tmp_path):
    b = "shop"
    first = [
        (1, "a", "https://x/1", "i1", b, DAY), (2, "a", "https://x/2", "i2", b, DAY),  # 2 repeats the id of 1 ...
        (3, "c", "https://x/2", "i3", b, DAY),  # ... and its URL still counts: 3 goes
        (4, "d", "https://x/4", "i1", b, DAY), (5, "e", "https://x/5", "i1", "other", DAY),  # same image: of the brand, and of another
        (6, None, None, None, None, DAY), (7, None, None, None, None, DAY)]
    second = [
        (8, "z", "https://x/5", "i8", b, DAY), (9, "a", "https://x/9", "i9", b, DAY), (10, "y", "https://x/10", "i3", b, DAY),
        (11, "w", "https://x/11", "i11", b, DAY), (12, None, None, None, None, DAY)]
    batches = [table(spark, rows, POST) for rows in (first, second)]
    out, seen, state = (str(tmp_path / n) for n in ("out", "seen", "state"))
    run = replay(spark, batches, tmp_path / "in", lambda posts: J.dedupe_stream(posts, out, seen, state, buckets=4))
    assert sum(1 for p in run.recentProgress if p["numInputRows"]) == 2
    kept = sorted(r[0] for r in spark.read.parquet(out).collect())
    assert kept == sorted(r[0] for r in dedupe_posts(table(spark, first + second, POST), "doc_id").select("doc_id").collect())
    assert kept == [1, 5, 6, 7, 11, 12]


def test_totals_are_upserted_and_late_rows_dropped(spark, tmp_path):
    schema = "ts timestamp, product_id long, action string"
    at = lambda day, hour=1: DAY + dt.timedelta(days=day, hours=hour)
    batches = [
        table(spark, [(at(0), 1, "save"), (at(0), 1, "save"), (at(0), None, "view")], schema),
        table(spark, [(at(0, 3), 1, "save"), (at(0, 3), None, "view"), (at(5), 2, "view")], schema),  # moves the watermark past day 0
        table(spark, [(at(5, 2), 2, "view")], schema),
        table(spark, [(at(0), 1, "save"), (at(5, 3), 2, "view")], schema)]  # its first row is too late
    keys, path = ("day", "product_id", "event"), str(tmp_path / "totals")
    seen = {}

    def start(events):
        totals = J.engagement_stream(events)
        seen["schema"] = totals.schema
        return J.upsert_stream(totals, path, str(tmp_path / "state"), keys, buckets=4)

    run = replay(spark, batches, tmp_path / "in", start)
    rows = J.totals_store(spark, path, seen["schema"], keys, buckets=4).read()
    assert sorted(((r["day"].day, r["product_id"], r["n"]) for r in rows.collect()), key=repr) == [(1, 1, 3), (1, None, 2), (6, 2, 3)]
    held = [op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]]
    assert held[-1] == 1, "the windows of day 0 are freed"
    assert sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"]) == 1


def test_ingest_over_two_batches_equals_one_and_replays(spark, tmp_path):
    t = Tables(spark, SMALL)
    posts = t.posts.persist()
    t.brands.write.parquet(str(tmp_path / "brands"))
    halves = [posts.where("doc_id % 2 = 0"), posts.where("doc_id % 2 = 1"), posts.where("doc_id % 2 = 0")]

    def ingest(name, batches):
        paths = {n: str(tmp_path / name / n) for n in ("products", "audit", "failures")} | {"brands": str(tmp_path / "brands")}
        replay(spark, batches, tmp_path / f"{name}-in", lambda s: J.ingest_stream(
            s, paths, str(tmp_path / f"{name}-state"), t.categories, FASHION, FASHION_WORDS, t.now, "doc_id", buckets=4))
        store = J.product_store(spark, paths["products"], J.product_schema(posts, t.categories, FASHION, FASHION_WORDS), buckets=4)
        return store, paths

    store, paths = ingest("three", halves)
    rows = store.read().select("source", "product_url")
    assert rows.count() == rows.distinct().count() > 0 and store.state().batch == 2
    audit = spark.read.json(paths["audit"])
    counts = {(r["batch"], r["outcome"]): r["count"] for r in audit.groupBy("batch", "outcome").count().collect()}
    assert counts[(2, "UPDATED")] == counts[(0, "INSERTED")] and (2, "INSERTED") not in counts and (0, "UPDATED") not in counts
    single, _ = ingest("one", [posts])
    assert {r[0] for r in single.read().select("product_url").collect()} <= {r[0] for r in rows.select("product_url").collect()}


@pytest.mark.parametrize("columns", [(), ("url",)])
def test_store_of_an_empty_batch(spark, tmp_path, columns):
    store = KeyedStore(spark, str(tmp_path / "s"), table(spark, []).schema, ("source", "url"), columns, 2)
    assert store.commit(table(spark, []), 0) and store.read().count() == 0
    store.compact()
    assert store.vacuum() == ["delta-000000000000"]


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path, files):
    """A larger table is a folder of part files under the table's name; a small one is a file."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    if files == 1:
        (tmp_path / "documents.parquet").write_bytes(Path(f"{SMALL}/documents.parquet").read_bytes())
    else:
        rows.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    stream = as_stream(Tables(spark, str(tmp_path)), "documents")
    run = stream.writeStream.format("memory").queryName(f"streamed_{files}").trigger(availableNow=True).start()
    run.awaitTermination()
    assert found(spark.table(f"streamed_{files}").select("doc_id")) == found(rows.select("doc_id"))


def test_stream_dedupe_query_reads_a_folder_of_part_files(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    run = entry.queries()["stream_dedupe_posts"]
    assert found(run(spark, str(tmp_path))) == found(run(spark, SMALL)) != []


def test_audit_files_do_not_grow_with_the_batches(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.range(3_000).selectExpr("concat('b ', id % 1000, '/x') AS batch", "'INSERTED' AS outcome", "cast(id AS string) AS post").coalesce(2)
    append_audit(rows, path)
    append_audit(table(spark, [(None, "FAILED", "none")], "batch string, outcome string, post string").coalesce(1), path)
    assert len(list(Path(path).rglob("*.json"))) <= 4
    (Path(path) / "batch=old").mkdir()
    (Path(path) / "batch=old" / "part.json").write_text('{"post": "folder", "batch": "ignored"}\n')
    (Path(path) / "manual_7.jsonl").write_text('{"post": "stem", "batch": "ignored"}\n')
    got = {r["post"]: r["batch"] for r in read_ingestion_audit(spark, path).collect()}
    want = {str(i): f"b {i % 1000}/x" for i in range(3_000)}
    assert got == want | {"none": "__HIVE_DEFAULT_PARTITION__", "folder": "old", "stem": "manual_7"}


def test_a_checkpoint_leaves_no_shuffle_behind(spark):
    def shuffles():
        folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
        return set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data"))

    before = shuffles()
    rows = spark.range(10_000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    cut = cut_lineage(rows)
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"
    assert sorted(cut.collect()) == sorted(rows.collect()) == [(k, 1_000) for k in range(10)]
