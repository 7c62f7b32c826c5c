"""DS5: the prepared datasets, lazily or written and re-read.

``build_prepared_datasets`` returns nine lazy DataFrames, picking the
cell grain when a ``ticket_summary`` table is given.  Each enriched fact
feeds several marts, so ``prepare_to_storage`` writes the dimension and
the two facts first, folds each fact once to its base of partial sums, and
rolls the marts up from these.  The lineage is cut at the written files (a
lost executor recomputes from files, not from the sources), and no mart
reads a fact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from aeromart.operators import marts
from aeromart.operators.base import MONTHS, ROUTES, SEGMENTS, of_set, stored_bases
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import (
    build_flights_enriched,
    build_ticket_summary_enriched,
    build_tickets_enriched,
    tickets_to_lay_out,
)
from aeromart.session import shared_scratch_path
from aeromart.sources.parquet import read_dataset, write_dataset, write_fact

FACT_NAMES = ["route_dimension", "tickets_enriched", "flights_enriched"]
MART_NAMES = [
    "revenue_by_month",
    "revenue_by_route",
    "route_efficiency",
    "fleet_utilization",
    "passenger_segments",
    "tax_by_route",
]


def build_tickets_fact(raw_tables: Mapping[str, DataFrame], route_dim: DataFrame) -> DataFrame:
    """Cells when a ticket summary is given, else one row per ticket."""
    if "ticket_summary" in raw_tables:
        return build_ticket_summary_enriched(raw_tables["ticket_summary"], route_dim)
    return build_tickets_enriched(raw_tables["tickets"], route_dim, raw_tables.get("passengers"))


def build_facts(raw_tables: Mapping[str, DataFrame], as_of_year: int | None = None) -> dict[str, DataFrame]:
    route_dim = build_route_dimension(raw_tables["routes"], raw_tables["airports"])
    tickets = build_tickets_fact(raw_tables, route_dim)
    flight_source = raw_tables["ticket_by_flight"] if "ticket_summary" in raw_tables else tickets
    flights = build_flights_enriched(
        raw_tables["flights"], route_dim, raw_tables["airplanes"], flight_source, as_of_year
    )
    return {"route_dimension": route_dim, "tickets_enriched": tickets, "flights_enriched": flights}


def build_marts(tickets: DataFrame, flights: DataFrame) -> dict[str, DataFrame]:
    return {
        "revenue_by_month": marts.revenue_by_month(tickets),
        "revenue_by_route": marts.revenue_by_route(tickets),
        "route_efficiency": marts.route_efficiency(tickets),
        "fleet_utilization": marts.fleet_utilization(flights),
        "passenger_segments": marts.passenger_segments(tickets),
        "tax_by_route": marts.tax_by_route(tickets),
    }


def marts_from_bases(tickets: DataFrame, fleet: DataFrame) -> dict[str, DataFrame]:
    """The six marts, rolled up from a ticket base and a fleet base."""
    routes = of_set(tickets, ROUTES)
    return {
        "revenue_by_month": marts.revenue_by_month(of_set(tickets, MONTHS)),
        "revenue_by_route": marts.revenue_by_route(routes),
        "route_efficiency": marts.route_efficiency(routes),
        "fleet_utilization": marts.fleet_utilization(fleet),
        "passenger_segments": marts.passenger_segments(of_set(tickets, SEGMENTS)),
        "tax_by_route": marts.tax_by_route(routes),
    }


def build_prepared_datasets(
    raw_tables: Mapping[str, DataFrame], as_of_year: int | None = None
) -> dict[str, DataFrame]:
    """The nine prepared datasets as lazy DataFrames."""
    facts = build_facts(raw_tables, as_of_year)
    return {**facts, **build_marts(facts["tickets_enriched"], facts["flights_enriched"])}


def _run_all(tasks: Mapping[str, Callable[[], DataFrame]], workers: int) -> dict[str, DataFrame]:
    """Run independent writes as concurrent Spark jobs (one driver thread
    each); their stages share the cluster instead of queueing."""
    if workers <= 1 or len(tasks) <= 1:
        return {name: task() for name, task in tasks.items()}
    with ThreadPoolExecutor(max_workers=min(workers, len(tasks))) as pool:
        futures = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: future.result() for name, future in futures.items()}


def prepare_to_storage(
    raw_tables: Mapping[str, DataFrame],
    folder: str,
    as_of_year: int | None = None,
    concurrent_writes: int = 6,
    base_folder: str | None = None,
) -> dict[str, DataFrame]:
    """Write the nine datasets under ``folder`` and return them re-read.

    The bases go to ``base_folder`` (default: a new folder of the session's
    shared scratch space), where later runs can merge them with their own.

    Order follows the dependencies: the route dimension first; then the
    tickets fact, and at cell grain the flights fact alongside it (it
    only needs the per-flight summary); at ticket grain the flights fact
    after the tickets (tickets per flight come from the written file);
    finally the two bases from the written facts, and the six marts
    together from the bases.
    """
    spark = next(iter(raw_tables.values())).sparkSession
    base = folder.rstrip("/")
    cell_grain = "ticket_summary" in raw_tables

    def persist(name: str, df: DataFrame) -> DataFrame:
        write_dataset(df, f"{base}/{name}.parquet")
        return read_dataset(spark, f"{base}/{name}.parquet")

    def persist_tickets(route_dim: DataFrame) -> DataFrame:
        if cell_grain:
            rows, widen = build_tickets_fact(raw_tables, route_dim), None
        else:
            sources = [raw_tables.get(t) for t in ("routes", "airports", "passengers")]
            rows, widen = tickets_to_lay_out(raw_tables["tickets"], route_dim, *sources)
        write_fact(rows, f"{base}/tickets_enriched.parquet", widen)
        return read_dataset(spark, f"{base}/tickets_enriched.parquet")

    def flights_from(route_dim: DataFrame, flight_source: DataFrame) -> DataFrame:
        return persist(
            "flights_enriched",
            build_flights_enriched(raw_tables["flights"], route_dim, raw_tables["airplanes"], flight_source, as_of_year),
        )

    route_dim = persist("route_dimension", build_route_dimension(raw_tables["routes"], raw_tables["airports"]))
    if cell_grain:
        written = _run_all(
            {
                "tickets_enriched": lambda: persist_tickets(route_dim),
                "flights_enriched": lambda: flights_from(route_dim, raw_tables["ticket_by_flight"]),
            },
            concurrent_writes,
        )
    else:
        tickets = persist_tickets(route_dim)
        written = {"tickets_enriched": tickets, "flights_enriched": flights_from(route_dim, tickets)}
    written["route_dimension"] = route_dim
    bases = stored_bases(written["tickets_enriched"], written["flights_enriched"], base_folder or shared_scratch_path(spark, "bases"))
    mart_plans = marts_from_bases(*bases)
    written.update(
        _run_all({name: (lambda n=name, df=df: persist(n, df)) for name, df in mart_plans.items()}, concurrent_writes)
    )
    return {name: written[name] for name in FACT_NAMES + MART_NAMES}
