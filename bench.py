"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tableworks import plans  # noqa: E402
from tableworks.session import scratch_path  # noqa: E402
from tableworks.session import build_session  # noqa: E402

QUERIES = [
    "profile_missing",
    "profile_numeric_target",
    "value_distribution",
    "regression_metrics",
    "classification_metrics",
    "split_stratified",
    "standardize",
    "chunk_fixed",
    "chunk_recursive",
    "embed_batches",
    "knn_topk",
    "knn_lsh",
    "rerank",
    "retrieve_rerank_context",
    "page_markdown",
    "parse_blocks_json",
    "latex_table_html",
    "thread_history",
    "reasoning_mode",
    "truncate_reasoning",
    "validate_tool_calls",
    "guard_flow",
    "export_pages",
    "stream_experiment_log",
    "train_ridge_line",
]


def laid_out(spark, sf_dir: str, parts: int) -> str:
    """The same tables in as many files as there are cores, as a cluster would hold them; not timed."""
    target = scratch_path(spark, "bench")
    for name in sorted(os.listdir(sf_dir)):
        spark.read.parquet(f"{sf_dir}/{name}").repartition(parts).write.parquet(f"{target}/{name}")
    return target


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    data = laid_out(spark, sf_dir, int(cpus))
    times = {}
    for name in QUERIES:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            plans.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total seconds over the headline queries, better of two runs each",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
