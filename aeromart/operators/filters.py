"""Slices (FLT1, FLT2) and the filter helpers of the dashboard (FLT3-FLT7).

Filters are plain ``where`` clauses: Catalyst pushes them through the
projections and, for continent filters over the left join to routes,
turns the outer join into an inner one and pushes the predicate to the
route side.  An empty or ``None`` list means "no filter" (N4); a null
value in a filtered column drops the row (N5).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DateLike = dt.date | dt.datetime | str


def _as_date(value: DateLike) -> F.Column:
    if isinstance(value, dt.datetime):
        return F.lit(value)
    if isinstance(value, dt.date):
        return F.lit(value)
    return F.to_date(F.lit(value))


def _months_of(tickets: DataFrame, start: DateLike | None, end: DateLike | None) -> DataFrame:
    """What a date range says of the month, as a filter of its own: facts laid
    out by month then list only these.  Months are compared as text, which
    holds for years of four digits; others are left to the date filter."""
    month = F.col("departure_month")
    odd = F.length(month) != 7
    if start is not None:
        tickets = tickets.where((month >= F.date_format(_as_date(start), "yyyy-MM")) | odd)
    if end is not None:
        tickets = tickets.where((month <= F.date_format(_as_date(end), "yyyy-MM")) | odd)
    return tickets


def filter_tickets(
    tickets: DataFrame,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
    cabin_classes: Sequence[str] | None = None,
    origin_continents: Sequence[str] | None = None,
    destination_continents: Sequence[str] | None = None,
    routes: Sequence[str] | None = None,
    min_distance: float | None = None,
) -> DataFrame:
    """FLT1: inclusive date range, list filters and a minimum distance.

    At cell grain ``departure_date`` is the first date of the cell, so a
    range keeps or drops whole month cells (N6).  A null distance counts
    as 0 (N25).
    """
    out = tickets
    if start_date is not None:
        out = out.where(F.col("departure_date") >= _as_date(start_date))
    if end_date is not None:
        out = out.where(F.col("departure_date") <= _as_date(end_date))
    if "departure_month" in tickets.columns:
        out = _months_of(out, start_date, end_date)
    if cabin_classes:
        out = out.where(F.col("cabin_class").isin(list(cabin_classes)))
    if origin_continents:
        out = out.where(F.col("origin_continent").isin(list(origin_continents)))
    if destination_continents:
        out = out.where(F.col("destination_continent").isin(list(destination_continents)))
    if routes:
        out = out.where(F.col("route_code").isin(list(routes)))
    if min_distance is not None:
        far_enough = F.col("distance") >= F.lit(float(min_distance))  # a form that scans can use
        out = out.where(far_enough if min_distance > 0 else far_enough | F.col("distance").isNull())
    return out


def filter_flights(
    flights: DataFrame,
    origin_continents: Sequence[str] | None = None,
    destination_continents: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """FLT2: continent lists and aircraft models (models ignored without a
    ``model`` column)."""
    out = flights
    if origin_continents:
        out = out.where(F.col("origin_continent").isin(list(origin_continents)))
    if destination_continents:
        out = out.where(F.col("destination_continent").isin(list(destination_continents)))
    if models and "model" in flights.columns:
        out = out.where(F.col("model").isin(list(models)))
    return out


def scatter_source(efficiency: DataFrame) -> DataFrame:
    """FLT3: efficiency rows usable in a scatter plot."""
    return efficiency.dropna(subset=["distance", "avg_ticket_value", "revenue_per_distance"])


def option_list(df: DataFrame, column: str) -> DataFrame:
    """FLT4: distinct non-null values, sorted by their own type, as text.

    A distributed distinct and range sort; the caller decides whether the
    (possibly long) list is collected.  No column: an empty list.
    """
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "value string")
    values = df.select(F.col(column).alias("value")).dropna().distinct()
    return values.orderBy("value").select(F.col("value").cast("string").alias("value"))


def option_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FLT4 for several columns in one scan: (field, value), the fields one
    after another, each sorted by its column's own type.

    Each row is unpivoted to its (field, value) pairs, which are made
    distinct in the scan's own tasks before one exchange; the sort is by
    range, so a field of very many values is many tasks.  Columns that the
    table does not have give no rows.  Takes a fact or its base.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "field string, value string")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in present])).alias("o"))
    values = pairs.select("o.*").dropna().distinct()
    # one sort key a field: its text back to the type it came from
    order = [F.when(F.col("field") == c, F.col("value").try_cast(df.schema[c].dataType)) for c in present]
    return values.orderBy("field", *order)


def one_list(lists: DataFrame, column: str) -> DataFrame:
    """One field's values of ``option_lists``, in order."""
    return lists.where(F.col("field") == column).select("value")


def bounds(tickets: DataFrame) -> DataFrame:
    """FLT5 and FLT6 in one scan: min_date, max_date, max_distance (one row)."""
    return tickets.agg(
        F.min("departure_date").alias("min_date"),
        F.max("departure_date").alias("max_date"),
        F.coalesce(F.max("distance"), F.lit(0.0)).alias("max_distance"),
    )


def date_bounds(tickets: DataFrame) -> DataFrame:
    """FLT5: earliest and latest departure date (one row)."""
    return tickets.agg(
        F.min("departure_date").alias("min_date"), F.max("departure_date").alias("max_date")
    )


def max_distance(tickets: DataFrame) -> DataFrame:
    """FLT6: the largest route distance, 0 when there is none (one row)."""
    return tickets.agg(F.coalesce(F.max("distance"), F.lit(0.0)).alias("max_distance"))


def is_empty(df: DataFrame) -> bool:
    """FLT7: emptiness test (an action that reads at most one row)."""
    return df.isEmpty()
