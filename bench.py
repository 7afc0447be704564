"""Headline timings: prints one JSON line. Env: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS.

Tables that several queries share are built first and timed as ``prepare``, so no query pays for another's cache. A query
that takes under LONG seconds gives the median of BENCH_RUNS warm runs, a longer one its first run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans.registry import CATALOG  # noqa: E402
from ledgerloom.plans.cash_plans import results_of  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402
from ledgerloom.sources.adapters import FACTS, Domain  # noqa: E402

LONG = 30.0

HEADLINE = (
    "W01_daily_running_balance", "A03_currency_position", "D01_reconcile", "A05_cash_forecast", "D03_all_anomalies",
    "D04_supplier_issues", "A06_remittance_rollup", "J14_purchase_orders", "D09_invoice_fields", "D12_people_fields",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    start, shared = time.time(), Domain.shared(spark, sf_dir)
    for name in FACTS:
        shared[name].count()
    results_of(shared).count()
    prepare = round(time.time() - start, 3)
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in CATALOG.queries:
            continue
        seen: list[float] = []
        while len(seen) <= runs and (not seen or seen[0] < LONG):  # the first run is the warm-up unless it is the only one
            start = time.time()
            CATALOG.queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen.append(time.time() - start)
        times[name] = round(statistics.median(seen[1:] or seen), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "prepare": prepare, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
