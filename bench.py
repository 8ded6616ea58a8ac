"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from topshare.plans import registry
from topshare.session import build_session

HEADLINE = [
    "concentration_total",
    "concentration_by_quarter",
    "concentration_by_quarter_ranges",
    "concentration_by_month",
    "concentration_by_year",
    "concentration_negative_values",
    "head_sample",
    "report_long",
    "report_summary_wide",
    "insight_rules",
    "normalize_cascade",
    "normalize_table",
    "normalized_metrics",
    "profile_columns",
    "outlier_counts",
    "time_candidates",
    "sample_random",
    "sample_stratified",
    "inject_nulls",
    "redact_pii",
    "screen_messages",
    "row_fingerprint",
    "lineage_latest",
    "artifact_usage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    spark = build_session(
        f"local[{cpus}]", int(cpus), spark__driver__memory="12g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for class loading; it is not one of those timed.
    registry.QUERIES["concentration_none_grain"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
