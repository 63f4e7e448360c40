"""Time the headline queries and print one JSON line.

BENCH_SF_DIR selects the tables (default sf0.1) and BENCH_CPUS the local threads (default 8).
Each query runs whole into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from tidemark import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = (
    "src1_tape_scan", "flagship_flow_and_variance", "agg1_activity", "agg4_flow_record_short", "agg4_flow_record_long", "agg12_latency_summary",
    "agg20_feature_distributions", "jn6_last_quote_asof", "jn7_contract_snapshot", "jn9_window_assign", "jn14_live_reconciliation", "win5_dense_grid",
    "win6_target_panel", "win11_previous_trade_deltas", "win13_ewma_variance", "win19_counting_windows", "sca2_black_scholes_greeks", "sca16_surface_record",
    "inf1_session_contrast", "mod3_log_ols", "mod19_double_ml", "eco1_performance",
)


def main() -> None:
    from tidemark.plans import catalog

    spark = build_session(f"local[{CPUS}]", CPUS, "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{SF_DIR}/events.parquet").write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
