"""Times the headline queries and prints one JSON line.

Each query runs once to warm up (compilation, file cache) and is then timed to the
materialised result, which Spark computes in full and discards.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palimpsest.plans.catalog import QUERIES  # noqa: E402
from palimpsest.session import local_session  # noqa: E402

HEADLINE = [
    "kw_documents", "kw_messages", "kw_indexed", "kw_phrase", "kw_thoughts", "postings",
    "sem_scores", "sem_topk", "sem_batch", "file_lines", "unified_summary",
    "recent_transcript", "activity", "context_window",
    "dup_exact", "dup_cross_exact", "dup_summary", "dup_delete_ids", "junk_counts",
    "noise_reasons", "emb_orphans_summary", "dry_run_summary", "delete_effects",
    "redact", "html_text", "ingest_messages", "mail_capture", "drive_capture",
    "capture_upsert", "thought_dedup_24h",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    times = {}
    for name in HEADLINE:
        run(spark, name, folder)
        times[name] = round(run(spark, name, folder), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
