"""Headline timings: one JSON line.

The tables a catalog keeps (files, sources, postings, verdicts, ledger) are built
and timed first; searches and reports then start from them. Every result is
computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalogspark.plans import QUERIES  # noqa: E402
from catalogspark.session import configure  # noqa: E402

HEADLINE = [
    # Kept tables, in order of dependence.
    "b1_files", "b2_sources", "c3_postings", "e4_screen_files", "f1_ledger", "g2_alias_records",
    # Work over offers and events.
    "b1_merge_files", "e4_screen_offers", "f2_publisher_bans", "f2_ban_marks", "f3_refused_logins",
    "f7_session_strikes", "f5_block_counters", "c3_document_postings",
    # Searches and lookups.
    "c16_search", "c17_scan_search", "c19_batch_search", "c20_result_projection", "d1_sources", "d2_batch_sources",
    # Network and traffic.
    "i2_merge_overlapping", "i4_hit_counts", "i5_country", "i8_connection_gate",
    "k3_flood_verdict", "k5_timed_bans", "k7_suppress_repeats", "j6_sessions", "j7_fresh_value",
    # Reports.
    "h2_blocks_by_file", "h3_by_cause", "h4_publisher_graph", "g5_alias_ranking", "g6_size_campaigns", "h12_catalog_shape",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
