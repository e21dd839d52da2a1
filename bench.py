"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_RUNS (default 1).
Each query runs once to warm up, then the median of the timed runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from demandpanel.catalog import QUERIES
from demandpanel.session import local_session

HEADLINE = (
    "panel_by_node", "features_all", "lost_visitors", "ols_coefficients", "node_models", "hold_out_scores",
    "ccf_every_node_best_lag", "corr_all_pairs", "spearman_raw_rows", "ks_two_sample_raw", "quantiles_raw_column",
    "box_numbers_raw", "audit_column_profile_raw", "audit_drift", "upsert_latest_wins", "date_gaps",
    "text_redaction", "text_tokens", "text_sentiment", "bigram_counts", "tfidf_keywords", "complaint_mining",
    "comfort_panel", "pivot_date_prefecture",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, partitions=max(cpus, 4))
    chosen = [a for a in sys.argv[1:] if a in QUERIES] or HEADLINE
    times: dict[str, float] = {}
    for name in chosen:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
