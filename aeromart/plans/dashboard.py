"""DS8: every table the reference's dashboard shows, for one filter state.

One call applies the ticket and flight slices, folds each to its base of
partial sums, and returns lazy DataFrames over the bases; drawing is left to the caller (``toPandas()`` on these small
results).  Fixed list lengths are the dashboard's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromart.operators import filters, marts
from aeromart.operators.base import MONTHS, ROUTES, SEGMENTS, of_set, stored_bases
from aeromart.operators.findings import summarize_key_findings
from aeromart.operators.ordering import asc_first
from aeromart.operators.overview import overview_metrics
from aeromart.session import shared_scratch_path

# List lengths shown by the dashboard.
TOP_ROUTES = 12
TOP_YIELD = 15
TOP_AIRCRAFT = 15
TOP_TAX_ROUTES = 15
TOP_SEGMENTS = 20
TABLE_ROWS = 50
ROUTE_TABLE_ROWS = 100
TICKET_OPTIONS = ["cabin_class", "origin_continent", "destination_continent", "route_code"]
EFFICIENCY_TABLE_COLUMNS = [
    "route_code",
    "route_label",
    "tickets",
    "revenue",
    "avg_ticket_value",
    "distance",
    "flight_minutes",
    "revenue_per_distance",
    "avg_ticket_value_per_minute",
]


@dataclass
class Slice:
    """A filter state; empty lists and None mean "everything"."""

    start_date: object = None
    end_date: object = None
    cabin_classes: list[str] = field(default_factory=list)
    origin_continents: list[str] = field(default_factory=list)
    destination_continents: list[str] = field(default_factory=list)
    routes: list[str] = field(default_factory=list)
    min_distance: float | None = 0.0
    models: list[str] = field(default_factory=list)

    def tickets(self, tickets: DataFrame) -> DataFrame:
        return filters.filter_tickets(
            tickets,
            self.start_date,
            self.end_date,
            self.cabin_classes,
            self.origin_continents,
            self.destination_continents,
            self.routes,
            self.min_distance,
        )

    def flights(self, flights: DataFrame) -> DataFrame:
        return filters.filter_flights(flights, self.origin_continents, self.destination_continents, self.models)


def efficiency_table(efficiency: DataFrame) -> DataFrame:
    """PRJ11: nine columns, first rows of the sorted efficiency mart."""
    return efficiency.select(*EFFICIENCY_TABLE_COLUMNS).limit(TABLE_ROWS)


def ascending_bars(top: DataFrame, column: str) -> DataFrame:
    """SRT4: an already limited top list re-sorted ascending for bars; ties by
    the other columns in order."""
    return top.orderBy(asc_first(column), *[asc_first(c) for c in top.columns if c != column])


def filter_options(tickets: DataFrame, flights: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """FLT4-FLT6: option lists and bounds of the filter widgets.

    Tickets are read once for their four lists and once for the bounds; both
    are written under ``folder`` (default: scratch), so asking for each list
    reads no fact again.
    """
    spark = tickets.sparkSession
    base = (folder or shared_scratch_path(spark, "options")).rstrip("/")
    models = filters.option_lists(flights, ["model"])
    filters.option_lists(tickets, TICKET_OPTIONS).unionByName(models).write.mode("overwrite").parquet(f"{base}/lists")
    filters.bounds(tickets).write.mode("overwrite").parquet(f"{base}/bounds")
    lists, bounds = spark.read.parquet(f"{base}/lists"), spark.read.parquet(f"{base}/bounds")
    kinds = {c: df.schema[c].dataType for df, names in ((tickets, TICKET_OPTIONS), (flights, ["model"])) for c in names if c in df.columns}
    return {
        **{c: filters.one_list(lists, c).orderBy(F.col("value").try_cast(kinds.get(c, "string"))) for c in [*TICKET_OPTIONS, "model"]},
        "date_bounds": bounds.select("min_date", "max_date"),
        "max_distance": bounds.select("max_distance"),
    }


def dashboard_views(
    tickets: DataFrame, flights: DataFrame, selection: Slice | None = None, base_folder: str | None = None
) -> dict[str, DataFrame]:
    """All views for one filter state.

    The slices are folded to their bases at once, one scan of each fact;
    the views are lazy roll-ups of these.  The bases go to ``base_folder``
    (default: a new folder of the session's shared scratch space).
    """
    selection = selection or Slice()
    folder = base_folder or shared_scratch_path(tickets.sparkSession, "dashboard")
    base, fleet_base = stored_bases(selection.tickets(tickets), selection.flights(flights), folder)
    routes, months = of_set(base, ROUTES), of_set(base, MONTHS)
    efficiency = marts.route_efficiency(routes)
    fleet = marts.fleet_utilization(fleet_base)
    segments = marts.passenger_segments(of_set(base, SEGMENTS))
    by_route, taxes = marts.revenue_by_route(routes), marts.tax_by_route(routes)
    views = {
        "overview": overview_metrics(routes, fleet_base),
        "findings": summarize_key_findings(base, fleet_base),
        "monthly": marts.revenue_by_month(months),
        "cabin": marts.cabin_mix(months),
        "top_routes": ascending_bars(by_route.limit(TOP_ROUTES), "revenue"),
        "scatter_source": filters.scatter_source(efficiency),
        "top_yield": ascending_bars(efficiency.limit(TOP_YIELD), "revenue_per_distance"),
        "efficiency_table": efficiency_table(efficiency),
        "top_aircraft": ascending_bars(fleet.limit(TOP_AIRCRAFT), "scheduled_flights"),
        "model_summary": marts.fleet_by_model(fleet_base),
        "fleet_table": fleet.limit(TABLE_ROWS),
        "top_taxes": ascending_bars(taxes.limit(TOP_TAX_ROUTES), "avg_tax_share"),
        "tax_table": taxes.limit(TABLE_ROWS),
        "route_summary": by_route,
        "route_table": by_route.limit(ROUTE_TABLE_ROWS),
    }
    if segments.columns:
        views["segments"] = marts.segment_rollup(segments).limit(TOP_SEGMENTS)
    return views


def kpi_labels(overview: DataFrame) -> DataFrame:
    """The headline numbers as display text: money and counts with
    thousands separators, the tax share as a percent (EXP19)."""
    from aeromart.functions.expressions import percent_text, thousands_text

    is_share = F.col("metric") == "avg_tax_share"
    return overview.withColumn(
        "label", F.when(is_share, percent_text("value")).otherwise(thousands_text("value", 0))
    )


def has_tickets(tickets: DataFrame, selection: Slice | None = None) -> bool:
    """FLT7: the dashboard stops when the slice holds no ticket."""
    return not filters.is_empty((selection or Slice()).tickets(tickets).select(F.lit(1)))
