"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to a sink that drops its rows, after one warm-up of the
session, so the numbers include planning and reading.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartlight.plans import catalogue  # noqa: E402
from cartlight.session import local_session  # noqa: E402

HEADLINE = [
    "basket_totals", "payable_total", "basket_budget_report", "rule_score", "eval_voucher", "set_overlap",
    "filter_longtail", "build_search_document", "bm25_topk", "search_page", "semantic_match",
    "parse_message", "workflow_valid", "product_evidence", "trajectory_state", "fold_state",
    "group_state", "run_summary", "bootstrap_ci", "grpo_advantage", "best_worst_at_n",
    "best_of_n", "stratified_split", "candidate_audit", "contamination_scan", "balance_by_length",
    "query_insight", "stream_group_completion",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="16g")
    catalogue.load()
    spark.read.parquet(f"{path}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        start = time.time()
        catalogue.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(path).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
