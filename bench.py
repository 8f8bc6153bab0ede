"""Headline queries, timed on one machine; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores, ``BENCH_RUNS``
the runs of which the median counts. Every query is run in full: its rows are
written to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pictorium.plans import QUERIES
from pictorium.session import local_session

HEADLINE = (
    "hybrid_search", "hybrid_search_batch", "keyword_search", "keyword_search_indexed", "token_index", "term_match",
    "cosine_topk", "multi_phrase_score", "nearest_reference", "embedding_drift", "lexical_factor",
    "noun_phrase_split", "assign_unique_names", "parse_descriptions", "collection_stats", "problematic_queries",
    "repair_json", "best_candidate", "ingest_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' code paths once; not counted.
    QUERIES["hybrid_search"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
