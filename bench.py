"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (names separated by commas; default: the list below; ``all`` for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time

# slices as in production hold as many rows as a task takes well; here a few tasks' worth
os.environ.setdefault("ROWS_PER_SLICE", "25000")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "traffic_kpis spend_per_backend latency_per_backend spend_by_period requests_by_status "
    "latency_histogram request_cost preflight_cost redact_pii pii_vault_mask guardrail_scan "
    "complexity_class prompt_cache_key merge_adjacent_turns parse_sse_chunks failover_summary "
    "latency_ema breaker_trace latest_ema_asof rate_limit_decisions rate_utilisation "
    "budget_decisions prompt_reuse reuse_distance rank_backends_complexity round_robin_assign "
    "recent_requests admission_funnel"
).split()


def main() -> None:
    from checks.compare import session
    from checks.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("traffic_kpis", "rate_limit_decisions"):  # start the JVM's and Python's workers
        run(name)
    seconds = {name: round(min(run(name), run(name)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, best of two runs each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
