"""Headline timings: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Each query runs once unmeasured on the same data and is then
timed from building its plan to fetching its result; staged tables shared
between queries are forgotten before each run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "s3_pairs", "s5_hourly_bars", "w1_zscore", "w7_robust_zscore", "t1_asof_join", "h1_rolling_ols", "h3_spread", "c1_unit_root_test",
    "r7_combined_gate", "g3_position_states", "g12_signal_plan", "b7_metrics", "x3_x4_parameter_sweep", "k9_k12_execution_costs_limit",
]


def main() -> None:
    from spreadlake.plans import catalog
    from spreadlake.plans.registry import forget_shared
    from spreadlake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # bars per pair are few and expensive per bar: keep one task per shuffle partition
    spark = build_session(cpus, partitions=int(cpus), extra={"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    names = sys.argv[1:] or HEADLINES
    timings: dict[str, float] = {}
    for name in names:
        for measured in (False, True):
            forget_shared(spark)
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).toArrow()
            if measured:
                timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
