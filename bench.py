"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is run once to warm up and then timed, plan building included, with all result columns
produced and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lineward.plans import QUERIES
from lineward.session import build_session

HEADLINE = [
    "kw_line_findings", "kw_line_findings_sparse", "kw_surface_counts", "kw_scan", "kw_scan_two_stage",
    "kw_matched_containers", "src_table_inventory", "tbl_candidates", "tbl_findings",
    "tbl_findings_composite_key", "tbl_stats", "tbl_scan_database", "tbl_scan_all", "web_text", "web_findings",
    "web_links", "web_classify", "web_incremental_scan", "web_state_upsert", "web_bfs", "file_magic",
    "file_status", "file_findings", "file_summary", "file_extract", "file_expand_archives",
    "web_incremental_scan_late", "sink_findings", "sink_markdown", "st_scan", "st_change_detect", "enc_apply_attempt", "img_findings", "img_cache_split",
    "llm_batches", "llm_findings", "llm_table_findings", "rep_number", "rep_summary", "st_dedupe",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        times[name] = round(run(spark, name, sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, warm run", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
