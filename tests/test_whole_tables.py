"""Registered queries read their whole tables: each against a plain count over all products."""

from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from registry.core import NOW, Tables
from registry.scalar_queries import enriched

QUERIES = entry.queries()


def products_by_brand(spark, *columns):
    groups = defaultdict(list)
    for r in Tables(spark, SMALL).products.select("brand_id", *columns).where("brand_id IS NOT NULL").collect():
        groups[r["brand_id"]].append(r)
    return groups


def test_stale_brands_reads_every_product(spark):
    last = {b: max(r["scraped_at"] or r["created_at"] for r in rows) for b, rows in products_by_brand(spark, "scraped_at", "created_at").items()}
    ages = {r["id"]: (datetime.fromisoformat(NOW) - last[r["id"]]).days if r["id"] in last else None for r in Tables(spark, SMALL).brands.collect()}
    want = {b: (age, "NEVER_REFRESHED" if age is None else "STALE") for b, age in ages.items() if age is None or age >= 70}
    assert "Brand#5" in last and want
    assert {r["brand_id"]: (r["age_days"], r["status"]) for r in QUERIES["stale_brands"](spark, SMALL).collect()} == want


def test_brand_health_counts_every_product(spark):
    groups = products_by_brand(spark, "category_id", "scraped_at", "created_at")
    want = {r["id"]: (len(rows := groups[r["id"]]), sum(p["category_id"] is not None for p in rows),
                      f"{max(p['scraped_at'] or p['created_at'] for p in rows):%Y-%m-%d %H:%M:%S}" if rows else None) for r in Tables(spark, SMALL).brands.collect()}
    assert any(int(i) % 4 != 1 for i in [r["id"] for r in Tables(spark, SMALL).products.where("brand_id = 'Brand#7'").collect()])
    got = QUERIES["brand_health"](spark, SMALL).collect()
    assert {r["brand_id"]: (r["product_count"], r["products_with_categories"], r["last_product_ingested_at"]) for r in got} == want


def test_for_you_rail_uses_every_event_and_falls_back_to_hidden_gems(spark, monkeypatch):
    quiet, build = Tables(spark, SMALL).interactions.where("user_id % 5 <> 0").agg(F.min("user_id")).first()[0], Tables._build

    def with_quiet_user(self, name):
        table = build(self, name)
        return table.withColumn("product_id", F.when(F.col("user_id") != quiet, F.col("product_id"))) if name == "interactions" else table

    monkeypatch.setattr(Tables, "_build", with_quiet_user)
    t = Tables(spark, SMALL)
    category = {r["id"]: r["category"] for r in enriched(t).select("id", "category").collect()}
    last = {}
    for r in sorted(t.interactions.collect(), key=lambda r: (r["ts"], r["event_id"])):
        last[r["user_id"]] = category.get(r["product_id"]) or last.get(r["user_id"])
    rows = QUERIES["for_you_rail"](spark, SMALL).collect()
    assert any(label and int(user) % 5 == 0 for user, label in last.items())
    assert {r["user_id"]: r["label"] for r in rows} == last
    gems = {r["position"]: r["id"] for r in QUERIES["diversify"](spark, SMALL).where("rail = 'hidden_gems' AND position <= 8").collect()}
    without = {u for u, label in last.items() if label is None}
    got = {(r["user_id"], r["position"], r["id"]) for r in rows if r["label"] is None}
    assert quiet in without and gems
    assert got == {(u, p, i) for u in without for p, i in gems.items()}
