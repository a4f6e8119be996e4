"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the sample folder, BENCH_CPUS the local cores, BENCH_RUNS the timed
runs per query after one warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from trailmark.plans.catalog import QUERIES
from trailmark.session import local_session

HEADLINE = (
    "daily_stats", "page_stats", "referrer_stats", "device_stats", "country_stats", "revenue_daily",
    "product_stats", "custom_event_stats", "ecommerce_funnel", "sites_overview", "site_stats",
    "recent_events", "hourly_breakdown", "event_detail", "param_coverage", "monthly_usage",
    "client_profiles", "client_journey", "validate_good", "validate_bad", "ingest_events",
    "geo_range_join", "sessionize", "session_table", "session_attribution", "bounce_rate", "top_pages",
    "traffic_sources", "web_vitals", "funnel", "retention", "anomalies", "page_movers",
    "campaign_performance", "stream_daily_stats",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
