"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline queries)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 2)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shortlist.session import local_session  # noqa: E402
from workload import load  # noqa: E402

HEADLINE = [
    "prefilter", "prefilter_funnel", "top_k", "score_summary", "strategy_stats", "top_n_per_strategy",
    "merged_top_k", "dedup_url", "dedup_title_company_url", "union_sources", "html_to_text", "page_text",
    "best_text", "search_postings", "enrich_descriptions", "extraction_batches", "parse_extraction",
    "rule_extract", "embed_texts", "embed_incremental", "cosine_to_profile", "match_profiles", "profile_text",
    "collect_postings", "score_postings", "top_jobs", "compare_scored", "compare_searches", "score_pages", "rank_file",
    "stream_score", "stream_dedup_url",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    all_queries, _ = load()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(all_queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, partitions=int(cpus), spark__checkpoint__dir=tempfile.mkdtemp(prefix="shortlist-bench-"))
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name:28s}{times[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
