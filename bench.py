"""Headline queries: warm session, median of three runs, one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Results go to the noop sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from asofkit.registry import load_all
from asofkit.session import local_session

HEADLINE = [
    "asof_decayed_rate", "assembled_features", "decayed_panels_by_half_life", "contact_quality_panel", "sufficient_statistics", "running_counts",
    "rest_and_load", "last_ten_form", "rolling_prior_factors", "contingency_hazard", "removal_risk_table", "nearest_event_match", "entity_resolution",
    "unavailable_on_date", "capture_compaction", "market_gate", "settle_ledger", "skill_ledger", "auc_by_family", "paired_ab_report", "goal_board",
    "crossfit_calibration", "movement_patterns", "play_by_play_movements", "stint_pairing",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), memory="16g")
    reg = load_all()
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        got = []
        for _ in range(runs):
            t = time.perf_counter()
            reg[name].fn(spark, sf).write.format("noop").mode("overwrite").save()
            got.append(time.perf_counter() - t)
        times[name] = round(statistics.median(got), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
