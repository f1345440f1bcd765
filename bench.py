"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Each query runs once to warm up and then three times in full into a sink that discards the rows;
the median counts.  ``python bench.py all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks.queries import QUERIES
from sigweave.session import build_session

HEADLINE = [
    "extract_mentions", "extract_words", "mention_rollup", "tech_profile", "score_signals",
    "merge_profiles", "search_stack", "search_uses_all", "company_detail", "company_list",
    "run_report", "export_json", "change_events", "refresh", "upsert_profile", "ingest_board_a",
    "ingest_board_b", "html_job_links", "strip_html_full", "header_profile", "worklist",
    "monthly_usage", "quota_breach", "rate_windows", "plan_state", "webhook_outbox",
    "delivery_health",
]
RUNS = 3


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(
            statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(RUNS)), 3
        )
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
