"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Every result is written in
full to the no-op sink, so no column is pruned away. The first query also pays for the start of the JVM code paths;
it is run once before timing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.registry import all_queries  # noqa: E402
from quire.session import local_session  # noqa: E402

HEADLINE = (
    "hybrid_retrieve", "dense_topk", "bm25_topk", "rrf_fusion", "rerank_context", "auto_merge_boost", "boost_grid",
    "recursive_split", "parent_child_chunks", "doc_quality", "clean_text", "html_extract", "ngram_fidelity",
    "guard_shingles", "corpus_signature", "ir_metrics", "grouped_eval", "run_significance", "stage_percentiles",
    "nearest_rank_percentiles", "error_rollup", "cost_summary", "failure_attribution", "needle_test", "manifest_diff",
    "merge_pages", "threshold_scan", "events_window", "event_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times: dict[str, float] = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("stage_percentiles")
    for name in HEADLINE:
        times[name] = round(run(name), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
