"""aeromart: airline network analytics as lazy Spark DataFrame transformations.

Reads ticket, route, airport, flight, aircraft and passenger tables,
cleans them, builds a route dimension and enriched ticket and flight
facts, and computes revenue, cabin, route-efficiency, fleet,
passenger-segment and tax marts at ticket grain or from pre-aggregated
monthly cells, with slices, top-n lists and headline findings.
"""

from aeromart.operators.cleaning import clean_table
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import (
    build_flights_enriched,
    build_ticket_summary_enriched,
    build_tickets_enriched,
)
from aeromart.operators.filters import filter_flights, filter_tickets
from aeromart.operators.findings import summarize_key_findings
from aeromart.operators.marts import (
    cabin_mix,
    fleet_by_model,
    fleet_utilization,
    passenger_segments,
    revenue_by_month,
    revenue_by_route,
    route_efficiency,
    segment_rollup,
    tax_by_route,
)
from aeromart.operators.overview import overview_metrics
from aeromart.plans.prepare import build_prepared_datasets, prepare_to_storage
from aeromart.sources.parquet import load_prepared_data, write_prepared_datasets

__all__ = [
    "build_flights_enriched",
    "build_prepared_datasets",
    "build_route_dimension",
    "build_ticket_summary_enriched",
    "build_tickets_enriched",
    "cabin_mix",
    "clean_table",
    "filter_flights",
    "filter_tickets",
    "fleet_by_model",
    "fleet_utilization",
    "load_prepared_data",
    "overview_metrics",
    "passenger_segments",
    "prepare_to_storage",
    "revenue_by_month",
    "revenue_by_route",
    "route_efficiency",
    "segment_rollup",
    "summarize_key_findings",
    "tax_by_route",
    "write_prepared_datasets",
]
