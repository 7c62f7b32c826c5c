"""Shared base: mergeable partial sums that every mart is rolled up from.

``ticket_base`` reads a tickets fact once and keeps, for three sets of keys
(route attributes; month and cabin; passenger segment), the partial sums
from which all ticket measures follow: rows, amounts and shares as a sum and
a count each.  The sets are grouping sets of one aggregate: a row of the
fact enters each set's partial aggregate in the scan's own tasks, and one
exchange carries a partial row for each group and task.  Grouping by the
union of all keys instead would keep about one row a ticket.

``fleet_base`` does the same for flights, by aircraft and model.

Both keep their distinct keys as rows: the routes of the first set and the
aircraft of the fleet base are what exact distinct counts are taken from,
so the counts of two bases merge as their sums do (``merged``).

A base has a key column for each key of any set (null in the other sets)
and ``key_set``, which names the set of a row.  ``of_set`` gives the rows of
one set as a table at *partial grain*, which the marts take like tickets or
cells (``aeromart.functions.measures``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromart.functions import measures as M
from aeromart.operators.cleaning import existing
from aeromart.operators.marts import EFFICIENCY_KEYS, FLEET_OPTIONAL_MAXIMA, ROUTE_KEYS, SEGMENT_KEYS, fleet_keys

ROUTES, MONTHS, SEGMENTS = "routes", "months", "segments"
ROUTE_SET_KEYS = list(dict.fromkeys(ROUTE_KEYS + EFFICIENCY_KEYS))
MONTH_SET_KEYS = ["departure_month", "cabin_class"]
TICKET_SETS = (ROUTES, MONTHS, SEGMENTS)


def set_keys(tickets: DataFrame, key_set: str) -> list[str]:
    """Keys of one set; of the segment keys, those that the table has."""
    if key_set == SEGMENTS:
        return existing(tickets, SEGMENT_KEYS)
    return ROUTE_SET_KEYS if key_set == ROUTES else MONTH_SET_KEYS


def ticket_base(tickets: DataFrame, sets: Sequence[str] = TICKET_SETS) -> DataFrame:
    """Partial sums of a tickets fact at ticket or cell grain, by each of ``sets``."""
    keys = {s: set_keys(tickets, s) for s in sets}
    columns = list(dict.fromkeys(k for own in keys.values() for k in own))
    # the id has a bit for each column, set where the column is not of the set
    bits = {s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in own) for s, own in keys.items()}
    name = F.coalesce(*[F.when(F.grouping_id() == bits[s], F.lit(s)) for s in keys])
    grouped = tickets.groupingSets([[F.col(c) for c in own] for own in keys.values()], *columns)
    base = grouped.agg(name.alias("key_set"), *M.partial_sums(tickets))
    return base.select("key_set", *columns, *M.PARTIAL_COLUMNS)


def folded_flights(flights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial sums of enriched flights by ``keys``."""
    summed = ("distance", "ticket_revenue", "estimated_fuel_gallons", "estimated_load_factor", "seat_capacity")
    aggregations = [F.count(F.lit(1)).alias("n_flights"), F.sum("tickets_sold").alias("sum_tickets_sold")]
    aggregations += [F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in summed]
    aggregations += [F.count(c).alias(f"n_{c}") for c in ("estimated_load_factor", "seat_capacity")]  # their means need it
    aggregations += [F.max(c).alias(f"max_{c}") for c in ["seat_capacity", *existing(flights, FLEET_OPTIONAL_MAXIMA)]]
    return flights.groupBy(*keys).agg(*aggregations)


def fleet_base(flights: DataFrame) -> DataFrame:
    """Partial sums of enriched flights by aircraft and model."""
    return folded_flights(flights, fleet_keys(flights))


def of_set(base: DataFrame, key_set: str) -> DataFrame:
    """Rows of one set, without the other sets' keys."""
    keys = [c for c in set_keys(base, key_set) if c in base.columns]
    return base.where(F.col("key_set") == key_set).select(*keys, *M.PARTIAL_COLUMNS)


def merged(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One base from bases of disjoint parts of a fact (say, of its days)."""
    parts = [c for c in first.columns if c in M.PARTIAL_COLUMNS or c.startswith(("n_", "sum_", "max_"))]
    keys = [c for c in first.columns if c not in parts]
    rows = reduce(DataFrame.unionByName, others, first)

    def again(c: str) -> Column:
        return (F.max(c) if c.startswith("max_") else F.sum(c)).alias(c)

    return rows.groupBy(*keys).agg(*[again(c) for c in parts]).select(*first.columns)


def stored_bases(tickets: DataFrame, flights: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both bases, written under ``folder`` and read back: whatever is rolled
    up from them reads neither fact again.  Tickets are laid out by key set,
    so a mart reads only its own."""
    ticket_base(tickets).write.mode("overwrite").partitionBy("key_set").parquet(f"{folder.rstrip('/')}/tickets")
    fleet_base(flights).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/flights")
    return read_bases(tickets.sparkSession, folder)


def read_bases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The ticket base and the fleet base written under ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/tickets"), spark.read.parquet(f"{folder.rstrip('/')}/flights")


def is_fleet_base(flights: DataFrame) -> bool:
    return {"n_flights", "sum_tickets_sold"} <= set(flights.columns)
