"""Times the headline queries and prints one JSON line.

Each query is run once to warm up and then measured by writing its whole
result to the ``noop`` sink, so nothing is cached and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factlake.plans import catalog  # noqa: E402, F401
from factlake.plans.registry import QUERIES, Tables  # noqa: E402
from factlake.session import build_session  # noqa: E402

HEADLINE = [
    "clean_chain", "bundle_threads", "parse_replies", "critic_verdicts", "batch_requests", "doc_assembly",
    "route_live", "queue_cap", "new_entities", "resolve_edges", "ingest_batch",
    "topk_acl", "topk_many", "topk_many_acl", "contradiction_notes",
    "edges", "match_edges", "node_upsert", "context_snapshot", "answer_context",
    "token_usage", "usage_summary", "overdue", "eval_pass_rate", "supersede", "crm_import",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        best = None
        for attempt in range(3):
            began = time.perf_counter()
            QUERIES[name].run(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if attempt:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
