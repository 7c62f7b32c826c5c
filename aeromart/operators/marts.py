"""Aggregate marts AGG1-AGG8 and the segment roll-up AGG14.

Each mart is one ``groupBy(...).agg(...)``: Catalyst plans a partial
aggregate before the shuffle, so a route, cabin or aircraft holding a
third of all rows is combined map-side and the shuffle carries one
partial row per key and task.  Measures come from
``aeromart.functions.measures`` and adapt to the grain of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeromart.functions import measures as M
from aeromart.functions.expressions import distinct_count_with_null, safe_divide, sum0
from aeromart.operators.cleaning import existing
from aeromart.operators.ordering import asc_first, desc_first, desc_last, sort_with_ties, top_n

# Grouping keys of each mart.
ROUTE_KEYS = [
    "route_code",
    "route_label",
    "origin",
    "destination",
    "origin_country",
    "destination_country",
    "origin_continent",
    "destination_continent",
]
EFFICIENCY_KEYS = [
    "route_code",
    "route_label",
    "origin",
    "destination",
    "distance",
    "flight_minutes",
    "origin_continent",
    "destination_continent",
]
TAX_KEYS = ["route_code", "route_label", "origin", "destination"]
SEGMENT_KEYS = ["passenger_country", "vip_segment", "age_band", "cabin_class"]
ROLLUP_KEYS = ["vip_segment", "age_band", "cabin_class"]
FLEET_OPTIONAL_MAXIMA = [
    "aircraft_age_years",
    "maintenance_takeoffs",
    "maintenance_flight_hours",
    "total_flight_distance",
]


def empty_frame(like: DataFrame) -> DataFrame:
    """A column-less, row-less table (the reference's empty result)."""
    return like.sparkSession.createDataFrame([], T.StructType([]))


def revenue_by_month(tickets: DataFrame) -> DataFrame:
    """AGG1: revenue and tickets per departure month and cabin."""
    keys = ["departure_month", "cabin_class"]
    return (
        tickets.groupBy(*keys)
        .agg(M.revenue(tickets), M.ticket_count(tickets))
        .orderBy(*[asc_first(k) for k in keys])
    )


def cabin_mix(tickets: DataFrame) -> DataFrame:
    """AGG2 + WIN1: per cabin, with the cabin's share of all revenue.

    The grand total is a window over the few grouped rows, so tickets are
    aggregated once.
    """
    grouped = tickets.groupBy("cabin_class").agg(
        M.ticket_count(tickets), M.revenue(tickets), M.avg_ticket_value(tickets)
    )
    total = F.sum("revenue").over(Window.partitionBy())
    result = grouped.withColumn("revenue_share", safe_divide(F.col("revenue"), total))
    return sort_with_ties(result, [desc_first("revenue")], ["cabin_class"])


def revenue_by_route(tickets: DataFrame, top: int | None = None) -> DataFrame:
    """AGG3: tickets, revenue, average value and taxes per route."""
    result = tickets.groupBy(*ROUTE_KEYS).agg(
        M.ticket_count(tickets),
        M.revenue(tickets),
        M.avg_ticket_value(tickets),
        M.tax_amount(tickets),
    )
    return top_n(sort_with_ties(result, [desc_first("revenue")], ROUTE_KEYS), top)


def route_efficiency(tickets: DataFrame, top: int | None = None) -> DataFrame:
    """AGG4: revenue per distance unit and ticket value per distance/minute."""
    grouped = tickets.groupBy(*EFFICIENCY_KEYS).agg(
        M.ticket_count(tickets), M.revenue(tickets), M.avg_ticket_value(tickets)
    )
    result = grouped.withColumns(
        {
            "revenue_per_distance": safe_divide("revenue", "distance"),
            "avg_ticket_value_per_distance": safe_divide("avg_ticket_value", "distance"),
            "avg_ticket_value_per_minute": safe_divide("avg_ticket_value", "flight_minutes"),
        }
    )
    return top_n(sort_with_ties(result, [desc_last("revenue_per_distance")], EFFICIENCY_KEYS), top)


def fleet_keys(flights: DataFrame) -> list[str]:
    return ["airplane", "model"] if "model" in flights.columns else ["airplane"]


def partial_mean(column: str) -> Column:
    """Mean from the sum and the count that a fleet base keeps."""
    return safe_divide(sum0(f"sum_{column}"), F.sum(f"n_{column}"))


def fleet_utilization(flights: DataFrame, top: int | None = None) -> DataFrame:
    """AGG5: scheduled use, revenue, capacity, load and fuel per aircraft.

    Takes enriched flights or their fleet base."""
    keys = fleet_keys(flights)
    if "n_flights" in flights.columns:
        maxima = existing(flights, [f"max_{c}" for c in FLEET_OPTIONAL_MAXIMA])
        aggregations = [
            F.sum("n_flights").alias("scheduled_flights"),
            sum0("sum_distance").alias("assigned_distance"),
            sum0("sum_ticket_revenue").alias("ticket_revenue"),
            F.coalesce(F.sum("sum_tickets_sold"), F.lit(0)).alias("tickets_sold"),
            F.max("max_seat_capacity").alias("seat_capacity"),
            partial_mean("estimated_load_factor").alias("avg_load_factor"),
            sum0("sum_estimated_fuel_gallons").alias("estimated_fuel_gallons"),
            *[F.max(c).alias(c.removeprefix("max_")) for c in maxima],
        ]
        result = flights.groupBy(*keys).agg(*aggregations)
        return top_n(sort_with_ties(result, [desc_first("scheduled_flights")], keys), top)
    aggregations = [
        F.count(F.lit(1)).alias("scheduled_flights"),
        sum0("distance").alias("assigned_distance"),
        sum0("ticket_revenue").alias("ticket_revenue"),
        F.coalesce(F.sum("tickets_sold"), F.lit(0)).alias("tickets_sold"),
        F.max("seat_capacity").alias("seat_capacity"),
        F.avg("estimated_load_factor").alias("avg_load_factor"),
        sum0("estimated_fuel_gallons").alias("estimated_fuel_gallons"),
    ]
    aggregations += [F.max(c).alias(c) for c in existing(flights, FLEET_OPTIONAL_MAXIMA)]
    result = flights.groupBy(*keys).agg(*aggregations)
    return top_n(sort_with_ties(result, [desc_first("scheduled_flights")], keys), top)


def fleet_by_model(flights: DataFrame) -> DataFrame:
    """AGG6: aircraft count, flights, capacity, load and fuel per model.

    Takes enriched flights or their fleet base (aircraft by model)."""
    if "model" not in flights.columns:
        return empty_frame(flights)
    if "n_flights" in flights.columns:
        result = flights.groupBy("model").agg(
            F.count(F.lit(1)).alias("aircraft"),  # a base has one row for each aircraft of a model, null too
            F.sum("n_flights").alias("scheduled_flights"),
            partial_mean("seat_capacity").alias("avg_seat_capacity"),
            partial_mean("estimated_load_factor").alias("avg_load_factor"),
            sum0("sum_estimated_fuel_gallons").alias("estimated_fuel_gallons"),
        )
        return sort_with_ties(result, [desc_first("scheduled_flights")], ["model"])
    result = flights.groupBy("model").agg(
        distinct_count_with_null("airplane").alias("aircraft"),
        F.count(F.lit(1)).alias("scheduled_flights"),
        F.avg("seat_capacity").alias("avg_seat_capacity"),
        F.avg("estimated_load_factor").alias("avg_load_factor"),
        sum0("estimated_fuel_gallons").alias("estimated_fuel_gallons"),
    )
    return sort_with_ties(result, [desc_first("scheduled_flights")], ["model"])


def group_segments(tickets: DataFrame) -> DataFrame:
    """AGG7 without its order, for further grouping."""
    keys = existing(tickets, SEGMENT_KEYS)
    if not keys:
        return empty_frame(tickets)
    return tickets.groupBy(*keys).agg(
        M.ticket_count(tickets), M.revenue(tickets), M.avg_ticket_value(tickets)
    )


def passenger_segments(tickets: DataFrame) -> DataFrame:
    """AGG7: per existing segment key (country, VIP, age band, cabin)."""
    result = group_segments(tickets)
    keys = existing(tickets, SEGMENT_KEYS)
    return sort_with_ties(result, [desc_first("revenue")], keys) if keys else result


def tax_by_route(tickets: DataFrame, top: int | None = None) -> DataFrame:
    """AGG8: taxes and mean tax share per route."""
    result = tickets.groupBy(*TAX_KEYS).agg(
        M.ticket_count(tickets),
        M.revenue(tickets),
        M.tax_amount(tickets),
        M.avg_tax_share(tickets),
    )
    return top_n(sort_with_ties(result, [desc_last("avg_tax_share")], TAX_KEYS), top)


def segment_rollup(segments: DataFrame) -> DataFrame:
    """AGG14: segments re-aggregated without country.

    Tickets and revenue are re-summed; ``avg_ticket_value`` is the plain
    (unweighted) mean of the segment averages, as in the reference.
    """
    keys = existing(segments, ROLLUP_KEYS)
    if not keys:
        return empty_frame(segments)
    result = segments.groupBy(*keys).agg(
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("tickets"),
        sum0("revenue").alias("revenue"),
        F.avg("avg_ticket_value").alias("avg_ticket_value"),
    )
    return sort_with_ties(result, [desc_first("revenue")], keys)
