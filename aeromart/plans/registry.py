"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables in ``sf_dir`` through the
test-data views and runs the library over the whole tables.  Their SQL
twins are in ``aeromart.plans.oracle``.

Presentation rules shared with the SQL twins, fixed up front:
* top-n lists carry ``rank`` (row_number in the list's order), because
  results are compared without order;
* sums and means of doubles depend on the order of rows in the last
  digits, so they are rounded here (never in the library): sums to 4
  decimals, means and ratios to 6, tax-share sums to 9;
* DATE columns are rendered as ISO text (yyyy-MM-dd), so that the
  comparison does not depend on how each engine hands dates to Python.
"""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeromart.operators import filters, marts
from aeromart.operators.base import ROUTES, merged, of_set, ticket_base
from aeromart.operators.cleaning import cast_numbers, clean_strings, parse_temporal
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import (
    build_flights_enriched,
    build_ticket_summary_enriched,
    build_tickets_enriched,
    tickets_enriched_dealt,
    tickets_to_lay_out,
)
from aeromart.operators.findings import summarize_key_findings
from aeromart.operators.joins import known_unique
from aeromart.operators.ordering import asc_first, desc_first, desc_last, with_rank
from aeromart.operators.overview import overview_metrics
from aeromart.operators.summaries import ticket_by_flight, ticket_summary
from aeromart.plans.colocated import prepare_colocated
from aeromart.plans.dashboard import TICKET_OPTIONS, Slice, dashboard_views, efficiency_table
from aeromart.plans.prepare import prepare_to_storage
from aeromart.session import shared_scratch_path
from aeromart.sources import catalog
from aeromart.sources import csv as csv_sink
from aeromart.sources import parquet as pq
from aeromart.sources.fixtures import airline_tables, read_tables
from aeromart.sources.naming import normalize_column_names

AS_OF_YEAR = 2026
TICKET_SLICE = Slice(
    start_date=dt.date(1996, 1, 1),
    end_date=dt.date(1998, 12, 31),
    cabin_classes=["ECONOMY", "BUSINESS"],
    origin_continents=["ASIA", "EUROPE"],
    min_distance=905.0,
)
FLIGHT_SLICE = Slice(
    origin_continents=["ASIA", "EUROPE", "AMERICA"],
    destination_continents=["AFRICA", "EUROPE"],
    models=[f"M{i}" for i in range(0, 25, 2)],
)
DASHBOARD_SLICE = Slice(
    start_date=dt.date(1996, 1, 1),
    end_date=dt.date(1998, 12, 31),
    cabin_classes=["ECONOMY", "BUSINESS"],
    origin_continents=["ASIA", "EUROPE"],
    min_distance=905.0,
    models=[f"M{i}" for i in range(0, 25, 2)],
)
RATIO_DIGITS, MONEY_MEAN_DIGITS, SHARE_SUM_DIGITS = 6, 4, 9


class Prepared:
    """Lazy enriched tables of one test-data folder.

    DataFrames are immutable plans, so one instance per session and folder
    is shared by all queries (``Prepared.of``): the source views, the
    passenger check, and the written bases and tables of the dashboard and of
    the co-located facts are made once, not per query.
    """

    _instances: dict[tuple[str, int, str], "Prepared"] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Prepared":
        key = (spark.sparkContext.applicationId, id(spark), sf_dir)
        if key not in cls._instances:
            cls._instances[key] = cls(spark, sf_dir)
        return cls._instances[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.src = airline_tables(spark, sf_dir)

    @cached_property
    def route_dim(self) -> DataFrame:
        return known_unique(build_route_dimension(self.src["routes"], self.src["airports"]), "route_code")

    @cached_property
    def tickets(self) -> DataFrame:
        return build_tickets_enriched(self.src["tickets"], self.route_dim, self.src["passengers"])

    @cached_property
    def tickets_to_fold(self) -> DataFrame:
        """The same rows, planned for folds."""
        return build_tickets_enriched(self.src["tickets"], self.route_dim, self.src["passengers"], for_folds=True)

    @cached_property
    def tickets_dealt(self) -> DataFrame:
        """The same rows, planned for a reader of all columns."""
        return tickets_enriched_dealt(self.src["tickets"], self.route_dim, self.src["routes"], self.src["airports"], self.src["passengers"])

    @cached_property
    def tickets_to_write(self) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
        """The same rows in two parts, planned for a layout."""
        return tickets_to_lay_out(self.src["tickets"], self.route_dim, self.src["routes"], self.src["airports"], self.src["passengers"])

    @cached_property
    def flights(self) -> DataFrame:
        return build_flights_enriched(
            self.src["flights"], self.route_dim, self.src["airplanes"], self.tickets, AS_OF_YEAR
        )

    @cached_property
    def cells(self) -> DataFrame:
        return ticket_summary(self.src["tickets"])

    @cached_property
    def by_flight(self) -> DataFrame:
        return ticket_by_flight(self.src["tickets"])

    @cached_property
    def cells_enriched(self) -> DataFrame:
        return build_ticket_summary_enriched(self.cells, self.route_dim)

    @cached_property
    def flights_cells(self) -> DataFrame:
        return build_flights_enriched(
            self.src["flights"], self.route_dim, self.src["airplanes"], self.by_flight, AS_OF_YEAR
        )


    @cached_property
    def colocated(self) -> dict[str, DataFrame]:
        """Facts from bucketed tables in a schema of their own."""
        schema = f"aeromart_{uuid.uuid4().hex[:8]}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return prepare_colocated(self.spark, self.src, schema, buckets, AS_OF_YEAR, shared_scratch_path(self.spark, "schema"))

    @cached_property
    def views(self) -> dict[str, DataFrame]:
        """The dashboard of one slice: its bases are written once, for all views."""
        return dashboard_views(self.tickets_to_fold, self.flights, DASHBOARD_SLICE)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})


FLEET_ROUNDING = {"avg_load_factor": RATIO_DIGITS}


# ---------------------------------------------------------------- cleaning
def q_clean_strings(spark: SparkSession, d: str) -> DataFrame:
    o = read_tables(spark, d, ["orders"])["orders"]
    k = F.col("o_orderkey") % 4
    padded = (
        F.when(k == 0, F.concat(F.lit("  "), "o_orderpriority"))
        .when(k == 1, F.concat("o_orderpriority", F.lit("\t\n")))
        .when(k == 2, F.concat(F.lit("\r "), "o_orderpriority", F.lit(" \x0c")))
        .otherwise(F.col("o_orderpriority"))
    )
    dirty = o.select(
        "o_orderkey",
        padded.alias("priority"),
        F.concat(F.lit(" "), "o_orderstatus", F.lit("\t")).alias("status"),
    )
    return clean_strings(dirty)


def q_clean_numbers(spark: SparkSession, d: str) -> DataFrame:
    li = read_tables(spark, d, ["lineitem"])["lineitem"]
    part, supp, line = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    v = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    text = (
        F.when(v == 0, F.concat(part, F.lit("."), line))
        .when(v == 1, F.concat(F.lit(" "), supp, F.lit("e2 ")))
        .when(v == 2, F.concat(F.lit("-"), part))
        .when(v == 3, F.concat(F.lit("x"), part))
        .when(v == 4, F.concat(part, F.lit("_000")))
        .when(v == 5, F.concat(F.lit("."), line))
        .when(v == 6, F.concat(part, F.lit(" "), supp))
        .otherwise(F.concat(F.lit("0x1p"), line))
    )
    dirty = li.select("l_orderkey", "l_linenumber", text.alias("raw_text"), text.alias("price"))
    return cast_numbers(clean_strings(dirty), ["price"])


def q_clean_timestamps(spark: SparkSession, d: str) -> DataFrame:
    li = read_tables(spark, d, ["lineitem"])["lineitem"]
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    n = F.col("l_linenumber")
    text = (
        F.when(n == 1, day)
        .when(n == 2, F.concat(day, F.lit(" 10:30:00")))
        .when(n == 3, F.concat(day, F.lit("T23:59:59")))
        .when(n == 4, F.concat(day, F.lit(" 01:02:03.123456")))
        .when(n == 5, F.concat(day, F.lit("T04:05:06.5")))
        .when(n == 6, F.concat(day, F.lit(" 25:00:00")))
        .otherwise(F.substring(day, 1, 7))
    )
    dirty = li.select("l_orderkey", "l_linenumber", text.alias("raw_text"), text.alias("departure"))
    return parse_temporal(dirty, ["departure"])


# ---------------------------------------------------------------- datasets
def q_route_dimension(spark, d):
    return Prepared.of(spark, d).route_dim


def q_tickets_enriched(spark, d):
    return Prepared.of(spark, d).tickets_dealt


def q_flights_enriched(spark, d):
    return Prepared.of(spark, d).flights


def q_ticket_summary(spark, d):
    return rounded(Prepared.of(spark, d).cells, {"tax_share_sum": SHARE_SUM_DIGITS})


def q_ticket_by_flight(spark, d):
    return Prepared.of(spark, d).by_flight


def q_ticket_summary_enriched(spark, d):
    return rounded(
        Prepared.of(spark, d).cells_enriched, {"tax_share_sum": SHARE_SUM_DIGITS, "tax_share": SHARE_SUM_DIGITS}
    )


def q_flights_enriched_cells(spark, d):
    return Prepared.of(spark, d).flights_cells


# ---------------------------------------------------------------- marts
def q_revenue_by_month(spark, d):
    return marts.revenue_by_month(Prepared.of(spark, d).tickets)


def q_cabin_mix(spark, d):
    return marts.cabin_mix(Prepared.of(spark, d).tickets)


def q_revenue_by_route(spark, d):
    return marts.revenue_by_route(Prepared.of(spark, d).tickets)


def q_route_efficiency(spark, d):
    return marts.route_efficiency(Prepared.of(spark, d).tickets)


def q_fleet_utilization(spark, d):
    return rounded(marts.fleet_utilization(Prepared.of(spark, d).flights), FLEET_ROUNDING)


def q_fleet_by_model(spark, d):
    return rounded(marts.fleet_by_model(Prepared.of(spark, d).flights), FLEET_ROUNDING)


def q_passenger_segments(spark, d):
    return marts.passenger_segments(Prepared.of(spark, d).tickets)


def q_tax_by_route(spark, d):
    return rounded(marts.tax_by_route(Prepared.of(spark, d).tickets), {"avg_tax_share": RATIO_DIGITS})


def q_segment_rollup(spark, d):
    segments = marts.passenger_segments(Prepared.of(spark, d).tickets)
    return rounded(marts.segment_rollup(segments), {"avg_ticket_value": MONEY_MEAN_DIGITS})


# ---------------------------------------------------------------- cell grain
def q_revenue_by_month_cells(spark, d):
    return marts.revenue_by_month(Prepared.of(spark, d).cells_enriched)


def q_cabin_mix_cells(spark, d):
    return marts.cabin_mix(Prepared.of(spark, d).cells_enriched)


def q_revenue_by_route_cells(spark, d):
    return marts.revenue_by_route(Prepared.of(spark, d).cells_enriched)


def q_route_efficiency_cells(spark, d):
    return marts.route_efficiency(Prepared.of(spark, d).cells_enriched)


def q_tax_by_route_cells(spark, d):
    return rounded(marts.tax_by_route(Prepared.of(spark, d).cells_enriched), {"avg_tax_share": RATIO_DIGITS})


def q_segments_cells(spark, d):
    return marts.passenger_segments(Prepared.of(spark, d).cells_enriched)


def q_fleet_utilization_cells(spark, d):
    return rounded(marts.fleet_utilization(Prepared.of(spark, d).flights_cells), FLEET_ROUNDING)


# ---------------------------------------------------------------- top-n lists
def route_order():
    return [desc_first("revenue")] + [asc_first(k) for k in marts.ROUTE_KEYS]


def yield_order():
    return [desc_last("revenue_per_distance")] + [asc_first(k) for k in marts.EFFICIENCY_KEYS]


def tax_order():
    return [desc_last("avg_tax_share")] + [asc_first(k) for k in marts.TAX_KEYS]


def fleet_order():
    return [desc_first("scheduled_flights"), asc_first("airplane"), asc_first("model")]


def q_top_routes(spark, d):
    return with_rank(marts.revenue_by_route(Prepared.of(spark, d).tickets, top=12), route_order())


def q_top_yield(spark, d):
    return with_rank(marts.route_efficiency(Prepared.of(spark, d).tickets, top=15), yield_order())


def q_top_aircraft(spark, d):
    top = marts.fleet_utilization(Prepared.of(spark, d).flights, top=15)
    return rounded(with_rank(top, fleet_order()), FLEET_ROUNDING)


def q_top_tax_routes(spark, d):
    top = marts.tax_by_route(Prepared.of(spark, d).tickets, top=15)
    return rounded(with_rank(top, tax_order()), {"avg_tax_share": RATIO_DIGITS})


def q_efficiency_table(spark, d):
    table = efficiency_table(marts.route_efficiency(Prepared.of(spark, d).tickets))
    order = [desc_last("revenue_per_distance")] + [
        asc_first(k) for k in ["route_code", "route_label", "distance", "flight_minutes"]
    ]
    return with_rank(table, order)


def q_fleet_table(spark, d):
    top = marts.fleet_utilization(Prepared.of(spark, d).flights, top=50)
    return rounded(with_rank(top, fleet_order()), FLEET_ROUNDING)


def q_route_table(spark, d):
    return with_rank(marts.revenue_by_route(Prepared.of(spark, d).tickets, top=100), route_order())


def q_segment_top(spark, d):
    segments = marts.group_segments(Prepared.of(spark, d).tickets)
    top = marts.segment_rollup(segments).limit(20)
    order = [desc_first("revenue")] + [asc_first(k) for k in marts.ROLLUP_KEYS]
    return rounded(with_rank(top, order), {"avg_ticket_value": MONEY_MEAN_DIGITS})


# ---------------------------------------------------------------- slices
def q_filter_tickets(spark, d):
    return TICKET_SLICE.tickets(Prepared.of(spark, d).tickets)


def q_filter_tickets_cells(spark, d):
    cells = TICKET_SLICE.tickets(Prepared.of(spark, d).cells_enriched)
    return rounded(cells, {"tax_share_sum": SHARE_SUM_DIGITS, "tax_share": SHARE_SUM_DIGITS})


def q_filter_flights(spark, d):
    return FLIGHT_SLICE.flights(Prepared.of(spark, d).flights)


def q_scatter_source(spark, d):
    return filters.scatter_source(marts.route_efficiency(Prepared.of(spark, d).tickets))


def q_filter_options(spark, d):
    p = Prepared.of(spark, d)
    tickets = filters.option_lists(p.tickets, TICKET_OPTIONS)
    models = filters.option_lists(p.flights, ["model"])
    return tickets.unionByName(models)


def q_date_bounds(spark, d):
    return filters.date_bounds(Prepared.of(spark, d).tickets)


def q_max_distance(spark, d):
    return filters.max_distance(Prepared.of(spark, d).tickets)


def _round_metrics(df: DataFrame) -> DataFrame:
    ratio = F.col("metric").isin("avg_tax_share", "avg_load_factor")
    return df.withColumn("value", F.when(ratio, F.round("value", RATIO_DIGITS)).otherwise(F.col("value")))


def q_overview_metrics(spark, d):
    p = Prepared.of(spark, d)
    return _round_metrics(overview_metrics(p.tickets_to_fold, p.flights))


def q_overview_metrics_cells(spark, d):
    p = Prepared.of(spark, d)
    return _round_metrics(overview_metrics(p.cells_enriched, p.flights_cells))


def q_slice_overview(spark, d):
    p = Prepared.of(spark, d)
    return _round_metrics(overview_metrics(TICKET_SLICE.tickets(p.tickets), FLIGHT_SLICE.flights(p.flights)))


def q_slice_revenue_by_route(spark, d):
    return marts.revenue_by_route(TICKET_SLICE.tickets(Prepared.of(spark, d).tickets))


def q_key_findings(spark, d):
    p = Prepared.of(spark, d)
    return summarize_key_findings(p.tickets, p.flights)


# ---------------------------------------------------------------- sources / sinks
def q_parquet_roundtrip(spark, d):
    folder = shared_scratch_path(spark, "prepared")
    written = pq.write_prepared_datasets({"revenue_by_route": q_revenue_by_route(spark, d)}, folder)
    return spark.read.parquet(written["revenue_by_route"])


def q_csv_roundtrip(spark, d):
    monthly = q_revenue_by_month(spark, d)
    path = csv_sink.write_csv(monthly, shared_scratch_path(spark, "route-csv"))
    return csv_sink.read_csv(spark, path, monthly.schema)


def q_read_project_tables(spark, d):
    """Two given tables by a column map: other letter case, an absent column."""
    wanted = {"NATION": ["N_NationKey", "ABSENT", "N_NAME"], "CUSTOMER": ["C_CUSTKEY", "C_NAME"]}
    tables = pq.read_project_tables(spark, d, wanted)
    nation = tables["nation"].select(F.lit("nation").alias("source"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    customer = tables["customer"].select(F.lit("customer").alias("source"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"))
    return nation.unionByName(customer)


def _written_sources(spark: SparkSession, d: str) -> str:
    """The airline tables as a folder of Parquet tables, as a project has them."""
    folder = shared_scratch_path(spark, "sources")
    for name, df in Prepared.of(spark, d).src.items():
        pq.write_dataset(df, f"{folder}/{name}.parquet")
    return folder


def q_summary_readers(spark, d):
    """Cells from the summary reader over a folder of source tables."""
    tables = pq.read_project_summary_tables(spark, _written_sources(spark, d))
    return rounded(tables["ticket_summary"], {"tax_share_sum": SHARE_SUM_DIGITS})


#: Columns whose numbers are added up, and whose characters are counted, in each written dataset.
PREPARED_NUMBERS = {
    "route_dimension": ["distance", "flight_minutes", "flight_hours", "origin_airport_tax_ref"],
    "tickets_enriched": ["price", "total_amount", "tax_amount", "distance", "passenger_age", "departure_year"],
    "flights_enriched": ["seat_capacity", "tickets_sold", "ticket_revenue", "estimated_fuel_gallons", "aircraft_age_years"],
    "revenue_by_month": ["revenue", "tickets"],
    "revenue_by_route": ["tickets", "revenue", "avg_ticket_value", "tax_amount"],
    "route_efficiency": ["tickets", "revenue", "distance", "avg_ticket_value"],
    "fleet_utilization": ["scheduled_flights", "assigned_distance", "ticket_revenue", "tickets_sold", "seat_capacity", "estimated_fuel_gallons"],
    "passenger_segments": ["tickets", "revenue", "avg_ticket_value"],
    "tax_by_route": ["tickets", "revenue", "tax_amount"],
}
PREPARED_TEXTS = {
    "route_dimension": ["route_code", "origin_city", "destination_country", "route_label"],
    "tickets_enriched": ["ticket_id", "passenger_id", "route_code", "departure_month", "cabin_class", "route_label", "vip_segment", "age_band"],
    "flights_enriched": ["flight_id", "route_code", "airplane", "model", "route_label"],
    "revenue_by_month": ["departure_month", "cabin_class"],
    "revenue_by_route": ["route_code", "route_label", "origin_country", "destination_continent"],
    "route_efficiency": ["route_code", "route_label", "origin"],
    "fleet_utilization": ["airplane", "model"],
    "passenger_segments": ["passenger_country", "vip_segment", "age_band", "cabin_class"],
    "tax_by_route": ["route_code", "route_label", "destination"],
}


def q_prepared_set(spark, d):
    """The whole prepared set, written and loaded again: of each dataset the
    rows, the sum of its numbers, the characters and the nulls of its texts."""
    folder = shared_scratch_path(spark, "prepared-set")
    prepare_to_storage(Prepared.of(spark, d).src, folder, AS_OF_YEAR)

    def content(name: str, df: DataFrame) -> DataFrame:
        numbers, texts = PREPARED_NUMBERS[name], PREPARED_TEXTS[name]
        total = sum((F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) for c in numbers), F.lit(0.0))
        return df.agg(
            F.lit(name).alias("dataset"),
            F.count(F.lit(1)).alias("row_count"),
            F.round(total + 1e-4, 0).alias("number_sum"),
            sum((F.coalesce(F.sum(F.length(c).cast("long")), F.lit(0)) for c in texts), F.lit(0).cast("long")).alias("text_chars"),
            sum((F.count(F.lit(1)) - F.count(c) for c in texts + numbers), F.lit(0).cast("long")).alias("nulls"),
        )

    return functools.reduce(DataFrame.unionByName, [content(n, df) for n, df in pq.load_prepared_data(spark, folder).items()])


def in_order(df: DataFrame) -> DataFrame:
    """Number the rows of a short sorted result in the order it comes in."""
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("position", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


def q_month_order(spark, d):
    return in_order(marts.revenue_by_month(Prepared.of(spark, d).tickets))


def q_tax_table(spark, d):
    p = Prepared.of(spark, d)
    top = dashboard_views(p.tickets_to_fold, p.flights)["tax_table"]
    return rounded(with_rank(top, tax_order()), {"avg_tax_share": RATIO_DIGITS})


def q_route_bars(spark, d):
    p = Prepared.of(spark, d)
    return in_order(dashboard_views(p.tickets_to_fold, p.flights)["top_routes"])


def q_colocated_tickets(spark, d):
    return Prepared.of(spark, d).colocated["tickets_enriched"]


def q_colocated_flights(spark, d):
    return Prepared.of(spark, d).colocated["flights_enriched"]


def q_catalog_tables(spark, d):
    """Given tables as tables of a catalog schema: rows by its statistics and
    as read, and the columns that a column map picks."""
    schema, location = f"aeromart_{uuid.uuid4().hex[:8]}", shared_scratch_path(spark, "catalog")
    catalog.create_schema(spark, schema, location)
    wanted = {"CUSTOMER": ["C_Name", "ABSENT", "C_CustKey"], "NATION": ["N_NAME"], "ORDERS": ["O_ORDERKEY", "O_CUSTKEY"]}
    for name, df in read_tables(spark, d, [t.lower() for t in wanted]).items():
        catalog.write_table(df, schema, name, location=f"{location}/{name}")
        catalog.analyse_table(spark, schema, name)
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(catalog.estimate_table_rows(spark, schema, name)).cast("long").alias("row_estimate"),
            F.lit(",".join(df.columns)).alias("picked"),
        )
        for name, df in catalog.read_project_tables(spark, schema, wanted).items()
    ]
    return functools.reduce(DataFrame.unionByName, rows)


def q_month_slice(spark, d):
    """A slice of the fact as it is written: by month, clustered by route."""
    path = shared_scratch_path(spark, "by-month")
    rows, widen = Prepared.of(spark, d).tickets_to_write
    pq.write_fact(rows, path, widen)
    return TICKET_SLICE.tickets(pq.read_dataset(spark, path))


# ---------------------------------------------------------------- dashboard of a slice
#: How the rows of each view are numbered (None: by no order), and which means are rounded here.
VIEWS: dict[str, tuple[Callable[[], list] | None, dict[str, int]]] = {
    "overview": (None, {}),
    "findings": (None, {}),
    "monthly": (None, {}),
    "cabin": (None, {}),
    "scatter_source": (None, {}),
    "efficiency_table": (None, {}),
    "top_yield": (yield_order, {}),
    "top_aircraft": (fleet_order, FLEET_ROUNDING),
    "fleet_table": (fleet_order, FLEET_ROUNDING),
    "model_summary": (None, FLEET_ROUNDING),
    "top_taxes": (tax_order, {"avg_tax_share": RATIO_DIGITS}),
    "route_summary": (None, {}),
    "route_table": (route_order, {}),
    "segments": (None, {"avg_ticket_value": MONEY_MEAN_DIGITS}),
}


def view_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    order, digits = VIEWS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        view = Prepared.of(spark, d).views[name]
        if order:
            view = with_rank(view, order())
        return _round_metrics(view) if name == "overview" else rounded(view, digits)

    run.__name__ = f"q_view_{name}"
    run.__doc__ = f"The dashboard's {name} for one filter state, rolled up from the slice's bases."
    return run


def q_merged_base(spark, d):
    """Routes rolled up from two bases merged: tickets of early and of later years."""
    tickets = Prepared.of(spark, d).tickets
    early = F.coalesce(F.col("departure_year") < 1996, F.lit(True))
    parts = [ticket_base(tickets.where(w)) for w in (early, ~early)]
    return marts.revenue_by_route(of_set(merged(*parts), ROUTES))


def q_slice_routes(spark, d):
    """A slice by a route list and destination continents."""
    routes = [f"R{i}" for i in range(1, 200, 3)]
    return filters.filter_tickets(
        Prepared.of(spark, d).tickets, routes=routes, destination_continents=["ASIA", "AFRICA"]
    )


def q_normalized_columns(spark, d):
    nation = read_tables(spark, d, ["nation"])["nation"]
    messy = nation.select(
        F.col("n_nationkey").alias("  N NationKey "),
        F.col("n_name").alias("N-Name"),
        F.col("n_regionkey").alias("n__RegionKey!!"),
    )
    return normalize_column_names(messy)


def q_table_row_counts(spark, d):
    return pq.table_row_counts(spark, d)


SUM_COLUMNS = (
    "revenue",
    "tax_amount",
    "ticket_revenue",
    "assigned_distance",
    "estimated_fuel_gallons",
    "value",
)
RATIO_COLUMNS = (
    "avg_ticket_value",
    "revenue_share",
    "revenue_per_distance",
    "avg_ticket_value_per_distance",
    "avg_ticket_value_per_minute",
)


def sums_rounded(df: DataFrame) -> DataFrame:
    """Round sums and ratios.  A mean of a few four-decimal amounts can lie
    exactly between two rounded values, where the last digit of the sum
    would decide; a small shift moves such ties off the border."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    digits = dict.fromkeys(SUM_COLUMNS, MONEY_MEAN_DIGITS) | dict.fromkeys(RATIO_COLUMNS, RATIO_DIGITS)
    return df.withColumns({c: F.round(F.col(c) + 1e-8, n) for c, n in digits.items() if c in doubles})


def dates_as_text(df: DataFrame) -> DataFrame:
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


def _registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sums_rounded(dates_as_text(fn(spark, sf_dir)))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_project_tables": q_read_project_tables,
    "summary_readers": q_summary_readers,
    "prepared_set": q_prepared_set,
    "month_order": q_month_order,
    "tax_table": q_tax_table,
    "route_bars": q_route_bars,
    "slice_routes": q_slice_routes,
    "clean_strings": q_clean_strings,
    "clean_numbers": q_clean_numbers,
    "clean_timestamps": q_clean_timestamps,
    "route_dimension": q_route_dimension,
    "tickets_enriched": q_tickets_enriched,
    "flights_enriched": q_flights_enriched,
    "ticket_summary": q_ticket_summary,
    "ticket_by_flight": q_ticket_by_flight,
    "ticket_summary_enriched": q_ticket_summary_enriched,
    "flights_enriched_cells": q_flights_enriched_cells,
    "revenue_by_month": q_revenue_by_month,
    "cabin_mix": q_cabin_mix,
    "revenue_by_route": q_revenue_by_route,
    "route_efficiency": q_route_efficiency,
    "fleet_utilization": q_fleet_utilization,
    "fleet_by_model": q_fleet_by_model,
    "passenger_segments": q_passenger_segments,
    "tax_by_route": q_tax_by_route,
    "segment_rollup": q_segment_rollup,
    "revenue_by_month_cells": q_revenue_by_month_cells,
    "cabin_mix_cells": q_cabin_mix_cells,
    "revenue_by_route_cells": q_revenue_by_route_cells,
    "route_efficiency_cells": q_route_efficiency_cells,
    "tax_by_route_cells": q_tax_by_route_cells,
    "segments_cells": q_segments_cells,
    "fleet_utilization_cells": q_fleet_utilization_cells,
    "top_routes": q_top_routes,
    "top_yield": q_top_yield,
    "top_aircraft": q_top_aircraft,
    "top_tax_routes": q_top_tax_routes,
    "efficiency_table": q_efficiency_table,
    "fleet_table": q_fleet_table,
    "route_table": q_route_table,
    "segment_top": q_segment_top,
    "filter_tickets": q_filter_tickets,
    "filter_tickets_cells": q_filter_tickets_cells,
    "filter_flights": q_filter_flights,
    "scatter_source": q_scatter_source,
    "filter_options": q_filter_options,
    "date_bounds": q_date_bounds,
    "max_distance": q_max_distance,
    "overview_metrics": q_overview_metrics,
    "overview_metrics_cells": q_overview_metrics_cells,
    "slice_overview": q_slice_overview,
    "slice_revenue_by_route": q_slice_revenue_by_route,
    "key_findings": q_key_findings,
    "parquet_roundtrip": q_parquet_roundtrip,
    "csv_roundtrip": q_csv_roundtrip,
    "normalized_columns": q_normalized_columns,
    "table_row_counts": q_table_row_counts,
}

_QUERIES |= {f"view_{name}": view_query(name) for name in VIEWS} | {
    "merged_base": q_merged_base,
    "colocated_tickets": q_colocated_tickets,
    "colocated_flights": q_colocated_flights,
    "catalog_tables": q_catalog_tables,
    "month_slice": q_month_slice,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _registered(v) for k, v in _QUERIES.items()}
