"""Bench: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit", "queries", "sf"}.
Each query is fully executed (written to a no-op sink) after one warm-up run of a small
query, so JVM start-up is not charged to the first entry.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans.registry import queries  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = [
    ("n3_signatures", "n3_create_signature"),
    ("j1_id_match", "j1_match_by_source_id"),
    ("j2_best_recent", "j2_best_similar_recent"),
    ("j4_best_match", "j4_find_best_match"),
    ("c_cycle_run_summary", "a1_run_summary"),  # full classify cycle + lifecycle + per-company summary
    ("j10_snapshot_diff", "j10_snapshot_diff"),
    ("o1_sort_last_seen", "o1_sort_last_seen"),
    ("p1_job_detail", "p1_job_detail"),
    ("j8_application_cards", "j8_application_cards"),
    ("s5_union_sources", "s5_union_sources"),
    ("r4_presence_sessions", "r4_presence_sessions"),
    ("n1_document_text", "n1_normalize_document_text"),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="tidewatch-bench")
    qs = queries()
    qs["n1_normalize_title"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for key, name in HEADLINE:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
