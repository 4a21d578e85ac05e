"""The register of queries, and the table views both sides of a check read."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import views
from vitrine.session import pin_utc
from vitrine.sources.tables import spread

NOW = "2024-02-01 00:00:00"
STORAGE = "https://storage.example.com"
DIM = 64
TEXT_TABLES = ("part", "embeddings", "documents", "pages", "conversations")
#: Views that join parts to vectors. Spark takes the size of a Parquet table from its compressed files, and would broadcast the
#: keys of millions of parts through the driver; the two meet by shuffle.
SHUFFLED_VIEWS = ("products", "search_queries")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The domain tables, built lazily from the driver's parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = pin_utc(spark), sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            text = views.spark_sql(name)
            inputs = {d: getattr(self, d) for d in views.view_dependencies(name)}
            if name in SHUFFLED_VIEWS:
                inputs["part"] = inputs["part"].hint("merge")
            return self.spark.sql(text, **inputs)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table

    @cached_property
    def now(self):
        return F.to_timestamp(F.lit(NOW))


def query(key: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``key``; ``sql`` is the statement it must agree with."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix the statement with the views it reads, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views.dependencies(text):
            if name in views.VIEWS and name not in needed:
                visit(views.duckdb_sql(name))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    prelude = ",\n".join(f"{n} AS ({views.duckdb_sql(n)})" for n in needed)
    body = sql.strip()
    if not prelude:
        return body
    if re.match(r"(?is)with\s+recursive\s", body):
        return f"WITH RECURSIVE {prelude},\n" + re.sub(r"(?is)^with\s+recursive\s+", "", body)
    if re.match(r"(?is)with\s", body):
        return f"WITH {prelude},\n" + re.sub(r"(?is)^with\s+", "", body)
    return f"WITH {prelude}\n{body}"
