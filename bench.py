"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores. Every
query runs to completion through the no-op sink.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from spanloom.session import local_session
from spanloom.workloads import all_workloads

HEADLINE = (
    "tokenize_terms", "term_idf", "bm25_topk", "bm25_batch_topk", "ranked_search_debug", "evidence_packing",
    "prompt_fingerprint", "corpus_grouping_sets", "size_distribution", "duplicate_ids", "nested_semi",
    "policy_c_anti", "interval_union", "overlap_metrics", "direct_parent", "points_inside", "section_spans",
    "section_pieces", "line_windows_50", "statement_segments", "policy_counts", "interactions_from_turns",
    "feedback_latest_wins", "review_report", "session_report", "redact_text", "stream_append_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    workloads = all_workloads()
    times: dict[str, float] = {}
    # The index is built by the first query that asks for it; timed on its own.
    from spanloom.workloads.retrieval import index_of

    began = time.perf_counter()
    index_of(spark, sf_dir)
    times["index_build"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        if name not in workloads:
            continue
        began = time.perf_counter()
        workloads[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
