"""Run the headline queries once each over $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

The tables are first copied, untimed, into as many files as there are cores: each comes as one file with one row group,
which a scan cannot split, while a table at scale has many.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from unitlens.plans.checks import QUERIES  # noqa: E402

TABLES = ("customer", "documents", "events", "lineitem", "orders", "pages", "part", "supplier", "region", "nation")
HEADLINE = (
    "geo_distance_band", "resolve_units", "first_wins_merge", "resolve_priority", "lease_terms", "keyword_scan",
    "keyword_scan_documents", "category_matches", "verdicts", "top_matches", "register_validate", "valuation_verdict",
    "price_history", "running_life", "sighting_state", "snapshot_merge", "cooldown_as_of", "also_listed_on", "store_stats",
    "source_coverage", "map_payloads", "embedded_state", "feed_titles",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("unitlens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="unitlens-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    split = tempfile.mkdtemp(prefix="unitlens-bench-data-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(int(cpus)).write.parquet(f"{split}/{name}.parquet")
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, split).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
