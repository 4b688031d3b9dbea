"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES (comma list or "all").
Every result is consumed in full through the no-op sink; the time is the better of two runs
after which the first has warmed the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from paperloom.queries import catalog
from paperloom.session import local_session

HEADLINE = (
    "chunk_documents",
    "number_chunks",
    "chunk_shared_ids",
    "chunk_fixed",
    "document_dimension",
    "denormalise_chunks",
    "document_detail",
    "export_chunks",
    "upsert_orders",
    "upsert_composite_key",
    "delete_stale_chunks",
    "not_in_customers",
    "time_window",
    "assign_window",
    "extract_events",
    "events_with_sync",
    "ical_text",
    "infer_classify",
    "infer_embed",
    "keyword_search",
    "keyword_search_many",
    "title_search_many",
    "semantic_search",
    "fuse_sources",
    "recent_context",
    "vector_topk",
    "ivf_topk",
    "latest_media",
    "ingest_plan",
    "dq_checks",
    "compare_length",
    "compare_events",
    "rate_alert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = local_session("bench", cpus)
    queries = catalog.queries()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
