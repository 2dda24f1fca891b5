"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weblode.plans import registry  # noqa: E402
from weblode.session import build_session  # noqa: E402

HEADLINE = [
    "link_profile", "page_url_normalized", "page_scan", "internal_external_links", "file_size_display",
    "summary_status_counts", "scans_overview", "scan_size_stats", "search_ranked", "search_by_index", "export_rows",
    "version_chain", "upsert_merge", "dedup_by_filename", "size_progress", "history_top_n", "settings_effective",
    "sheet_profiles", "csv_profiles", "extraction_status", "ai_response_parse", "status_transitions", "bfs_min_depth",
    "crawl_documents", "error_theta_anti",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "weblode-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
