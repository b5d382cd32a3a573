"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2, best counts), BENCH_ONLY (comma-separated names).
"""

from __future__ import annotations

import json
import os
import time

from planmatch.plans.queries import QUERIES
from planmatch.session import local_session

HEADLINE = (
    "relax_single",
    "relax_batch",
    "relax_batch_wide",
    "relax_level",
    "cosine_topk",
    "ann_topk",
    "score_relevance",
    "chunk_static",
    "chunk_sentences",
    "chunk_semantic",
    "chunk_guarded_doc",
    "chunk_guarded_batch",
    "session_fold",
    "fuzzy_category",
    "predicate_ops",
    "q_rank_price",
    "q_budget_near",
    "q_argmax_excluding",
    "q_at_least",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    spark = local_session(cpus, "bench")
    times = {n: round(min(run(spark, n, sf_dir) for _ in range(runs)), 3) for n in names}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
