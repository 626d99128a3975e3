"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dwellmatch.plans import catalog  # noqa: E402
from dwellmatch.session import build_session  # noqa: E402

HEADLINE = [
    "d1_gate_issues",
    "e3_versions",
    "e8_snapshot",
    "e11_history",
    "e13_soft_groups",
    "f4_matches_per_profile",
    "f4_inverse_match",
    "f6_radius_join",
    "f10_failure_counts",
    "f2_explain_pairs",
    "g6_latest_states",
    "g7_rate_limit",
    "h1_search",
    "h4_profile_matches",
    "h8_source_dashboard",
    "i2_error_alerts",
    "i6_tick_outcomes",
    "a1_marketplace_feed",
    "a7_parsed_pages",
    "b4_structured_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    runs, times = catalog.queries(), {}
    for name in names:
        start = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
