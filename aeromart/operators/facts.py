"""Enriched fact tables: tickets (DS2), ticket cells (DS3), flights (DS4).

All builders are lazy but for two tests of the passengers (any row, any
repeated id).  Joins
that are likely to shuffle the fact (passengers, per-flight totals) come
first, while the fact is narrow; routes and aircraft follow, and a select
restores the column order.  The per-flight ticket totals are aggregated
*before* the join to flights, so the join sees one row per flight and a hot
flight is combined map-side.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeromart.functions import expressions as X
from aeromart.operators.cleaning import cast_numbers, cast_strings, clean_table, existing, require
from aeromart.operators.dealing import PART, Dealing, join_dealt, join_dealt_group, key_group
from aeromart.operators.dimensions import airport_dimension, own_route_columns, with_airports
from aeromart.operators.joins import join_dimension, known_unique

# Passenger attributes and their names on the ticket.
PASSENGER_NAMES = {
    "id": "passenger_id",
    "gender": "passenger_gender",
    "birth_date": "passenger_birth_date",
    "country": "passenger_country",
    "vipcard": "vip_card",
}
# Route attributes carried onto flights.
FLIGHT_ROUTE_COLUMNS = [
    "route_code",
    "origin",
    "destination",
    "route_label",
    "distance",
    "flight_minutes",
    "flight_hours",
    "origin_continent",
    "destination_continent",
]
TICKET_REQUIRED = [
    "ticket_id",
    "passenger_id",
    "flight_id",
    "route_code",
    "departure",
    "class",
    "airport_tax",
    "local_tax",
]
# Derived from a ticket's passenger and its departure.
PASSENGER_DERIVED = ["passenger_age", "age_band", "vip_segment"]
# Columns of the fact that are derived after its joins.
LATER_COLUMNS = ["total_amount", "cabin_class", "tax_amount", "tax_share", "ticket_departure", "departure_date", "departure_month", "departure_year", *PASSENGER_DERIVED]
# Rows of a dimension that every task may hold, whatever its file's size says.
MAX_ROWS_HELD = 50_000
# Groups of calendar months that a layout deals tickets to: a part has a twelfth of the months.
MONTH_GROUPS = 12
# Groups up to which a row of a dimension is sent to each of them.
MOST_GROUPS = 32
CELL_MEASURES = ["tickets", "revenue", "avg_ticket_value", "tax_amount", "tax_share_sum"]


def tax_total() -> F.Column:
    return X.zero_if_null("airport_tax") + X.zero_if_null("local_tax")


def passenger_dimension(passengers: DataFrame, cleaned: bool = False) -> DataFrame:
    """Cleaned passengers with prefixed names; all five columns must exist."""
    passengers = require(passengers if cleaned else clean_table(passengers), list(PASSENGER_NAMES), "passengers")
    dim = passengers.select(*[F.col(src).alias(dst) for src, dst in PASSENGER_NAMES.items()])
    return cast_strings(dim, ["passenger_id"])


def build_tickets_enriched(
    tickets: DataFrame,
    route_dim: DataFrame,
    passengers: DataFrame | None = None,
    cleaned: bool = False,
    for_folds: bool = False,
) -> DataFrame:
    """DS2: one row per ticket with cabin, taxes, dates, route and passenger data.

    ``cleaned`` tickets and passengers are taken as they are: cleaning their
    keys again would hide from Spark how staged tables are laid out.

    The rows are the same with ``for_folds``; the columns that marts read are
    then derived before the joins.  Folds of these columns shuffle less so,
    as their sources stay behind; the whole fact would shuffle more.
    """
    joined, finished = _joined_tickets(tickets, route_dim, passengers, cleaned, for_folds)
    return finished(joined)


def tickets_to_move(
    tickets: DataFrame,
    route_dim: DataFrame,
    routes: DataFrame,
    airports: DataFrame,
    passengers: DataFrame | None = None,
    cleaned: bool = False,
    group: Column | None = None,
    groups: int = 1,
    parts: int = 1,
    by_passenger: bool = False,
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
    """DS2 in two parts, for a step that moves every row: the tickets with
    their passengers' and routes' own columns, and a function that adds, row by
    row, what follows from these: airport attributes (the airports are
    broadcast) and derived columns.

    Where that is not the same (names that clash) or the airports are too
    many to hold, the first part is the whole fact and there is no second.
    ``routes`` are those that ``route_dim`` was built from.  Their own columns
    fill a small file, so Spark would broadcast millions of them: many routes
    are merged.  With a ``group`` (of tickets' columns) the join onto many
    routes is where the rows are moved: they come dealt by ``groups`` of it and
    ranges of routes (``dealing.PART``), and need not move again.  A group
    ``by_passenger`` lets them meet their passengers there too.
    """

    def few(dim: DataFrame) -> bool:
        return dim.limit(MAX_ROWS_HELD + 1).count() <= MAX_ROWS_HELD

    own = own_route_columns(routes)
    airport_dim = airport_dimension(airports)
    route_names = with_airports(own, airport_dim).columns
    taken = {*tickets.columns, *LATER_COLUMNS, *PASSENGER_NAMES.values()} - {"route_code"}
    whole = route_names != route_dim.columns or len(set(route_names)) < len(route_names) or taken & set(route_names)
    if whole or not few(airport_dim):
        return build_tickets_enriched(tickets, route_dim, passengers, cleaned), None
    dealing = None
    if not few(own):
        own = own.hint("merge")
        if group is not None:
            keyed = cast_strings(tickets if cleaned else clean_table(tickets), ["route_code", "flight_id", "passenger_id"])
            dealing = Dealing.of(keyed.select("route_code", group), "route_code", group, groups, parts)
    joined, finished = _joined_tickets(tickets, own, passengers, cleaned, dealing=dealing, passengers_dealt=by_passenger)
    return joined, lambda rows: finished(with_airports(rows, F.broadcast(airport_dim)))


def tickets_enriched_dealt(
    tickets: DataFrame, route_dim: DataFrame, routes: DataFrame, airports: DataFrame, passengers: DataFrame
) -> DataFrame:
    """``build_tickets_enriched`` for a reader of the whole fact: many passengers
    and many routes are met in one move of the tickets, as long as there are
    no more than ``MOST_GROUPS`` groups of either (a passenger goes to each
    range of routes, a route to each group of passengers)."""
    parts = int(tickets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = math.isqrt(parts)
    if groups <= MOST_GROUPS and passengers.limit(MAX_ROWS_HELD + 1).count() > MAX_ROWS_HELD:
        rows, widen = tickets_to_move(
            tickets, route_dim, routes, airports, passengers, group=key_group("passenger_id"), groups=groups, parts=parts, by_passenger=True
        )
        if PART in rows.columns:
            return widen(rows.drop(PART))
    return build_tickets_enriched(tickets, route_dim, passengers)


def tickets_to_lay_out(
    tickets: DataFrame,
    route_dim: DataFrame,
    routes: DataFrame,
    airports: DataFrame,
    passengers: DataFrame | None = None,
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
    """``tickets_to_move`` for a layout by month and route: dealt by calendar
    months, if they are dealt, and with their month."""
    parts = int(tickets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, widen = tickets_to_move(tickets, route_dim, routes, airports, passengers, group=F.month("departure"), groups=MONTH_GROUPS, parts=parts)
    return rows.withColumn("departure_month", X.year_month("departure")) if widen else rows, widen


def _joined_tickets(
    tickets: DataFrame,
    route_dim: DataFrame,
    passengers: DataFrame | None = None,
    cleaned: bool = False,
    for_folds: bool = False,
    dealing: Dealing | None = None,
    passengers_dealt: bool = False,
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Tickets joined to both dimensions, and what is left to do row by row."""
    tickets = tickets if cleaned else clean_table(tickets)
    if "total_amount" not in tickets.columns:
        require(tickets, ["price"], "tickets")
        # N15: derived only when the column is absent.
        tickets = tickets.withColumn(
            "total_amount",
            X.zero_if_null("price") + X.zero_if_null("airport_tax") + X.zero_if_null("local_tax"),
        )
    require(tickets, TICKET_REQUIRED, "tickets")

    base = cast_strings(tickets, ["route_code", "ticket_id", "passenger_id", "flight_id"])
    # derived after the joins, so that no shuffle carries them
    derived = {"cabin_class": X.cabin_class("class"), "tax_amount": tax_total()}
    dates = {
        "ticket_departure": F.col("departure"),
        "departure_date": F.to_date("departure"),
        "departure_month": X.year_month("departure"),
        "departure_year": F.year("departure"),
    }
    share = {"tax_share": X.safe_divide("tax_amount", "total_amount")}
    given_columns = base.columns
    ticket_columns = [*given_columns, *[c for c in (*derived, *share, *dates) if c not in given_columns]]
    passenger_names = {*PASSENGER_NAMES.values(), *PASSENGER_DERIVED} - {"passenger_id"}
    early = for_folds and not passenger_names & {*given_columns, *route_dim.columns}
    if early:
        base = base.withColumns(derived)

    # Only when passengers are given and not empty: the output schema
    # depends on it, so an action is used here; the other one is known_unique.
    with_passengers = passengers is not None and not passengers.isEmpty()
    if with_passengers:
        taken = {*ticket_columns, *[c for c in route_dim.columns if c != "route_code"]}
        dim = passenger_dimension(passengers, cleaned)
        clash = {c: f"{c}_right" for c in dim.columns if c in taken and c != "passenger_id"}
        if dealing and passengers_dealt:
            base = join_dealt_group(base, dim.withColumnsRenamed(clash).hint("merge"), dealing, "passenger_id")
        else:
            base = join_dimension(base, known_unique(dim, "passenger_id").withColumnsRenamed(clash), "passenger_id")
    passenger_columns = [c for c in base.columns if c not in (*ticket_columns, PART)]
    if early:
        base = base.withColumns(dates)
        base = with_passenger_segments(base) if with_passengers else base
    later = [c for c in route_dim.columns if c in ticket_columns and c not in base.columns]
    route_dim = route_dim.withColumnsRenamed({c: f"{c}_right" for c in later})
    base = join_dealt(base, route_dim, dealing) if dealing else join_dimension(base, route_dim, "route_code")
    own = {*ticket_columns, *passenger_columns, *(PASSENGER_DERIVED if early else [])}
    segments = [c for c in PASSENGER_DERIVED if early and with_passengers]

    def finished(rows: DataFrame) -> DataFrame:
        route_columns = [c for c in rows.columns if c not in own]
        rows = rows.withColumns(share) if early else rows.withColumns(derived).withColumns(share | dates)
        rows = rows.select(*ticket_columns, *route_columns, *passenger_columns, *segments)
        return with_passenger_segments(rows) if with_passengers and not early else rows

    return base, finished


def with_passenger_segments(tickets: DataFrame) -> DataFrame:
    """Age at departure, its band and the VIP segment."""
    aged = tickets.withColumn("passenger_age", F.col("departure_year") - F.year("passenger_birth_date"))
    return aged.withColumns({"age_band": X.age_band("passenger_age"), "vip_segment": X.vip_segment("vip_card")})


def build_ticket_summary_enriched(ticket_summary: DataFrame, route_dim: DataFrame) -> DataFrame:
    """DS3: route x month x cabin cells with ``tax_share`` = shares per ticket."""
    summary = require(
        clean_table(ticket_summary),
        ["route_code", "departure_date", "departure_month", "cabin_class", *CELL_MEASURES],
        "ticket_summary",
    )
    summary = cast_numbers(summary, CELL_MEASURES).withColumns(
        {
            "route_code": F.col("route_code").cast("string"),
            "departure_date": F.to_date("departure_date"),
            "departure_month": F.col("departure_month").cast("string"),
            "cabin_class": F.col("cabin_class").cast("string"),
        }
    )
    summary = summary.withColumn("tax_share", X.safe_divide("tax_share_sum", "tickets"))
    return join_dimension(summary, route_dim, "route_code")


def ticket_totals_by_flight(tickets: DataFrame) -> DataFrame:
    """AGG11: tickets sold and ticket revenue per flight.

    Takes ``tickets_sold`` / ``ticket_revenue`` as given when the input
    already carries them (the per-flight summary of the cell grain).
    """
    if {"tickets_sold", "ticket_revenue"} <= set(tickets.columns):
        given = tickets.select(
            F.col("flight_id").cast("string").alias("flight_id"), "tickets_sold", "ticket_revenue"
        )
        return cast_numbers(given, ["tickets_sold", "ticket_revenue"])
    return tickets.groupBy(F.col("flight_id").cast("string").alias("flight_id")).agg(
        F.count(F.lit(1)).alias("tickets_sold"),
        X.sum0("total_amount").alias("ticket_revenue"),
    )


def airplane_dimension(airplanes: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Cleaned aircraft keyed by ``airplane``, with ``aircraft_age_years``.

    N13: the age is relative to ``as_of_year`` (default: the current year).
    """
    airplanes = require(
        clean_table(airplanes),
        ["aircraft_registration", "seats_business", "seats_premium", "seats_economy", "fuel_gallons_hour"],
        "airplanes",
    )
    dim = cast_strings(airplanes.withColumnRenamed("aircraft_registration", "airplane"), ["airplane"])
    if "build_date" in dim.columns:
        year = F.lit(as_of_year) if as_of_year is not None else F.year(F.current_date())
        dim = dim.withColumn("aircraft_age_years", year.cast("int") - F.year("build_date"))
    return dim


def build_flights_enriched(
    flights: DataFrame,
    route_dim: DataFrame,
    airplanes: DataFrame,
    ticket_source: DataFrame,
    as_of_year: int | None = None,
    cleaned: bool = False,
) -> DataFrame:
    """DS4: flights with route and aircraft data, ticket totals, seat
    capacity, estimated load factor and estimated fuel.  ``cleaned`` flights
    are taken as they are."""
    flights = require(
        flights if cleaned else clean_table(flights), ["flight_id", "route_code", "airplane", "departure", "arrival"], "flights"
    )
    per_flight = ticket_totals_by_flight(ticket_source)
    base = cast_strings(flights, ["flight_id", "route_code", "airplane"]).withColumns(
        {"flight_departure": F.col("departure"), "flight_arrival": F.col("arrival")}
    )
    routes = route_dim.select(*existing(route_dim, FLIGHT_ROUTE_COLUMNS))
    flight_columns = base.columns
    base = join_dimension(base, per_flight, "flight_id")
    totals = [c for c in base.columns if c not in flight_columns]
    base = join_dimension(base, routes, "route_code")
    base = join_dimension(base, airplane_dimension(airplanes, as_of_year), "airplane")
    base = base.select(*[c for c in base.columns if c not in totals], *totals)
    base = base.withColumns(
        {
            "seat_capacity": X.zero_if_null("seats_business")
            + X.zero_if_null("seats_premium")
            + X.zero_if_null("seats_economy"),
            "tickets_sold": F.coalesce(F.col("tickets_sold"), F.lit(0)),
            "ticket_revenue": F.coalesce(F.col("ticket_revenue"), F.lit(0.0)),
        }
    )
    return base.withColumns(
        {
            "estimated_load_factor": X.safe_divide("tickets_sold", "seat_capacity"),
            "estimated_fuel_gallons": F.col("fuel_gallons_hour") * F.col("flight_hours"),
        }
    )
