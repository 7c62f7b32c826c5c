"""Benchmark: headline queries on the driver's tables, one JSON line out.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (every row is
produced, nothing is collected), once to warm up and then
``BENCH_REPEAT`` times; the median is reported.  ``value`` is the sum of
the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aeromart.plans.registry import QUERIES, Prepared  # noqa: E402
from aeromart.session import build_session  # noqa: E402

HEADLINE = [
    "route_dimension",
    "tickets_enriched",
    "flights_enriched",
    "ticket_summary",
    "ticket_summary_enriched",
    "revenue_by_month",
    "cabin_mix",
    "revenue_by_route",
    "route_efficiency",
    "fleet_utilization",
    "fleet_by_model",
    "passenger_segments",
    "tax_by_route",
    "segment_rollup",
    "revenue_by_route_cells",
    "cabin_mix_cells",
    "fleet_utilization_cells",
    "top_routes",
    "filter_tickets",
    "overview_metrics",
    "key_findings",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    Prepared._instances.clear()  # every run builds its plan
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def run_job(spark, sf_dir: str) -> float:
    """The whole preparation (summary grain, as the job's default): build,
    write and re-read the nine datasets under the checkpoint folder."""
    from aeromart.operators.summaries import summarize_tickets
    from aeromart.plans.prepare import prepare_to_storage
    from aeromart.session import ensure_checkpoint_dir
    from aeromart.sources.fixtures import airline_tables

    # one folder per scale, overwritten by every run
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/aeromart-bench-job-{os.path.basename(sf_dir.rstrip('/'))}"
    started = time.perf_counter()
    raw = summarize_tickets(airline_tables(spark, sf_dir))
    prepare_to_storage(raw, folder, as_of_year=2026)
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(
        master=f"local[{cpus}]",
        app_name="aeromart-bench",
        shuffle_partitions=cpus,  # one wave of tasks; AQE coalesces further
        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    timings: dict[str, float] = {}
    for name in names:
        run_once(spark, name, sf_dir)
        timings[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(repeat)), 3)
    if os.environ.get("BENCH_JOB", "1") == "1":
        run_job(spark, sf_dir)
        timings["prepare_job"] = round(statistics.median(run_job(spark, sf_dir) for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf,
                "cpus": cpus,
                "repeat": repeat,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
