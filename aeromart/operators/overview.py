"""AGG9-AGG10: headline metrics as a small ``(metric, value)`` table.

The ticket part and the flight part are separate one-row aggregates,
each unpivoted to long form and appended: no cross join.  Nulls become
0 and every value is a double, as in the reference.  The flight part is
left out when there are no flights, by a filter rather than an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromart.functions import measures as M
from aeromart.functions.expressions import distinct_count_with_null
from aeromart.operators.base import folded_flights, is_fleet_base
from aeromart.operators.marts import partial_mean

TICKET_METRICS = ["revenue", "tickets", "avg_ticket_value", "routes", "avg_tax_share"]
FLIGHT_METRICS = ["scheduled_flights", "aircraft", "avg_load_factor"]


def _long(one_row: DataFrame, names: list[str]) -> DataFrame:
    as_double = one_row.select(
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    )
    return as_double.unpivot([], names, "metric", "value")


def ticket_metrics(tickets: DataFrame) -> DataFrame:
    """From a tickets fact or its base (the routes).

    A fact is folded by route first, so that distinct routes are counted over
    one row a route, not over tickets.
    """
    if not M.is_partial_grain(tickets):
        tickets = tickets.groupBy("route_code").agg(*M.partial_sums(tickets))
    row = tickets.agg(
        M.revenue(tickets),
        M.ticket_count(tickets),
        M.avg_ticket_value(tickets),
        distinct_count_with_null("route_code").alias("routes"),
        M.avg_tax_share(tickets),
    )
    return _long(row, TICKET_METRICS)


def flight_metrics(flights: DataFrame) -> DataFrame:
    """From enriched flights or their base, folded by aircraft."""
    if not is_fleet_base(flights):
        flights = folded_flights(flights, ["airplane"])
    row = flights.agg(
        F.sum("n_flights").alias("scheduled_flights"),
        distinct_count_with_null("airplane").alias("aircraft"),
        partial_mean("estimated_load_factor").alias("avg_load_factor"),
    ).where(F.col("scheduled_flights") > 0)
    return _long(row, FLIGHT_METRICS)


def overview_metrics(tickets: DataFrame, flights: DataFrame | None = None) -> DataFrame:
    """AGG9 (+ AGG10 when flights are given and not empty), from facts or bases."""
    result = ticket_metrics(tickets)
    if flights is not None:
        result = result.unionByName(flight_metrics(flights))
    return result


def as_dict(metrics: DataFrame) -> dict[str, float]:
    """Collect the few metric rows into ``{metric: value}``."""
    return {row["metric"]: row["value"] for row in metrics.collect()}
