"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the parquet tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
KEYS = (
    "identify_product", "deterministic_pipeline", "final_ranking_text", "structured_rerank", "full_text_hits",
    "duplicate_groups", "duplicate_members", "catalog_summary", "brand_health", "inventory_report", "eval_metrics",
    "gem_score", "rail_scores", "search_analytics", "similar_brands", "related_by_category_or_brand", "ingest_decisions",
    "batch_discover",
)


def timed(run) -> float:
    started = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    from registry import load_all
    from registry.core import Tables
    from vitrine.operators import retrieval as V
    from vitrine.session import local_session

    spark = local_session("bench", cores=CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = load_all()
    t = Tables(spark, SF_DIR)
    times: dict[str, float] = {}
    timed(lambda: t.products.groupBy("brand_id").count())  # start the JVM and Python workers
    asked = t.search_queries.orderBy(t.search_queries["qid"].cast("int"))
    for size in (1, 100, 1000):  # the first run of each plan compiles it and is left out
        batch = asked.limit(size)
        runs = [timed(lambda: V.match_products(batch, t.products, t.brands, t.categories, threshold=0.0, k=16)) for _ in range(4)]
        times[f"match_products_{size}_queries"] = median(runs[1:])
    for key in KEYS:
        times[key] = timed(lambda: queries[key](spark, SF_DIR))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "queries_per_second": {f"match_products_{n}": round(n / times[f"match_products_{n}_queries"], 2) for n in (1, 100, 1000)},
        "sf": Path(SF_DIR).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
