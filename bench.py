"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from newsloom.plans.catalog import QUERIES
from newsloom.session import build_session

HEADLINE = [
    "simhash64", "near_dup_pairs", "build_clusters", "tag_entities", "pick_regions", "group_by_entity", "group_by_region",
    "explain_keywords", "insert_if_absent", "char_batches", "budget_select", "linked_digest", "change_pct", "downsample",
    "failure_streak", "fold_runs", "source_alerts", "rate_slots", "merge_albums", "rss_items", "html_to_text", "discover_links",
    "extract_articles", "parse_sections", "merge_sections", "missing_facts", "enrich_items", "stream_ingest", "stream_health",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="newsloom-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and the Python workers' machinery before timing
    QUERIES["head_chars"](spark, root).limit(1).collect()
    spark.range(8).mapInPandas(lambda it: it, "id long").count()
    times = {}
    for name in only:
        started = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
