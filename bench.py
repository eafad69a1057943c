"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyglass import catalog  # noqa: E402
from tallyglass.session import build_session  # noqa: E402

HEADLINE = [
    "r01_analytics_summary",
    "r06_patterns_404",
    "r09_top_ips_404",
    "r12_search_gaps",
    "r15_outbound_clicks__by_source",
    "r16_retention__cohorts",
    "r16_retention__cross_site",
    "r17_route_transitions",
    "r17_route_transitions__sequences",
    "r18_conversion_map",
    "r19_conversion_outcomes",
    "r20_activation_funnel",
    "r21_experiment_summary",
    "r22_holdout_experiment",
    "r26_demand_drill__decliners",
    "r28_content_revenue__by_format",
    "r29_revenue_timeseries",
    "r30_revenue_pages",
    "r31_revenue_diagnostics",
    "r33_error_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    catalog.load()
    spark = build_session("bench", cores=cores)
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executor threads
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
