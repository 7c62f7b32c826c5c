"""Write PLANS.md: the final (adaptive) physical plans of key queries.

    python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aeromart.functions.expressions import WHITESPACE_CHARS  # noqa: E402
from aeromart.operators import marts  # noqa: E402
from aeromart.operators.summaries import summarize_tickets  # noqa: E402
from aeromart.plans.prepare import prepare_to_storage  # noqa: E402
from aeromart.plans.registry import QUERIES  # noqa: E402
from aeromart.session import build_session, shared_scratch_path  # noqa: E402
from aeromart.sources.fixtures import airline_tables  # noqa: E402

def readable(plan: str) -> list[str]:
    plan = re.sub(r"#\d+L?", "", plan.replace(WHITESPACE_CHARS, "<white space>"))
    return [line[:180] for line in plan.splitlines() if line.strip()]


KEY_QUERIES = ["ticket_summary", "revenue_by_route", "cabin_mix", "flights_enriched", "overview_metrics", "filter_tickets"]


def final_plan(df) -> list[str]:
    """The adaptive plan after a run; no more than a count leaves the tasks."""
    df._jdf.queryExecution().toRdd().count()
    return readable(df._jdf.queryExecution().executedPlan().toString())


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16, extra={"spark.ui.showConsoleProgress": "false"})
    out = ["# Physical plans", "", f"Final adaptive plans at `{sf_dir}` (`local[8]`), ids stripped, lines cut at 180 characters.", ""]
    for name in KEY_QUERIES:
        df = QUERIES[name](spark, sf_dir)
        out += [f"## {name}", "", "```", *final_plan(df), "```", ""]
    written = prepare_to_storage(summarize_tickets(airline_tables(spark, sf_dir)), shared_scratch_path(spark, "plans"), 2026)
    for name in ["revenue_by_route", "fleet_utilization"]:
        df = marts.revenue_by_route(written["tickets_enriched"]) if name == "revenue_by_route" else marts.fleet_utilization(written["flights_enriched"])
        out += [f"## {name} in the job, from the written cell-grain facts", "", "```", *final_plan(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
