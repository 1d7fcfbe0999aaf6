"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads, BENCH_QUERIES
(optional, comma separated) replaces the list of queries; ``all`` runs every one.
"""

from __future__ import annotations

import json
import os
import time

from newsgraph.plans.queries import QUERIES
from newsgraph.session import get_session

HEADLINE = [
    "theme_filter", "clean_events", "clean_drop_report", "country_month_panel", "theme_frequency",
    "dominant_theme_country", "tone_summary", "extraction_manifest", "fetch_outcome", "robots_allowed",
    "word_count", "tokens", "vocabulary", "doc_term_matrix", "coherence_cv", "event_points",
    "eps_neighbours", "dbscan", "kde_grid", "morans_i", "poisson_fit", "negbin_fit", "stream_daily_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = get_session("newsgraph-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                        spark__ui__enabled="false", spark__driver__memory="6g",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rows_per_day"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
