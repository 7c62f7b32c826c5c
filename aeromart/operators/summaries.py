"""AGG12-AGG13: the pre-aggregated ticket tables of the summary grain.

``ticket_summary`` folds tickets into route x month x cabin cells and
``ticket_by_flight`` into one row per flight.  Both are plain grouped
aggregates (partial aggregation before the shuffle), so they are also
the cheap way to serve every ticket mart at scale: the cells are orders
of magnitude smaller than the tickets.  Sums follow SQL rules here (null
over no value), as the reference's database queries do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromart.functions import expressions as X
from aeromart.operators.cleaning import cast_strings, clean_table, require

CELL_COLUMNS = [
    "route_code",
    "departure_date",
    "departure_month",
    "cabin_class",
    "tickets",
    "revenue",
    "avg_ticket_value",
    "tax_amount",
    "tax_share_sum",
]


def ticket_summary(tickets: DataFrame) -> DataFrame:
    """AGG12: cells with earliest date, count, revenue, mean, taxes and
    the sum of per-ticket tax shares (tickets with a zero or null amount
    have no share)."""
    t = require(
        clean_table(tickets),
        ["route_code", "departure", "class", "total_amount", "airport_tax", "local_tax"],
        "tickets",
    )
    t = cast_strings(t, ["route_code"])
    taxes = X.zero_if_null("airport_tax") + X.zero_if_null("local_tax")
    amount = F.col("total_amount")
    share = F.when(amount.isNotNull() & (amount != 0), taxes / amount)
    cells = t.groupBy(
        "route_code",
        X.year_month("departure").alias("departure_month"),
        X.cabin_class("class").alias("cabin_class"),
    ).agg(
        F.min(F.to_date("departure")).alias("departure_date"),
        F.count(F.lit(1)).alias("tickets"),
        F.sum(amount).alias("revenue"),
        F.avg(amount).alias("avg_ticket_value"),
        F.sum(taxes).alias("tax_amount"),
        F.sum(share).alias("tax_share_sum"),
    )
    return cells.select(*CELL_COLUMNS)


def ticket_by_flight(tickets: DataFrame) -> DataFrame:
    """AGG13: tickets sold and ticket revenue per flight."""
    t = require(clean_table(tickets), ["flight_id", "total_amount"], "tickets")
    return t.groupBy(F.col("flight_id").cast("string").alias("flight_id")).agg(
        F.count(F.lit(1)).alias("tickets_sold"),
        F.sum("total_amount").alias("ticket_revenue"),
    )


def summarize_tickets(raw_tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Replace ``tickets`` (and ``passengers``) by the two summary tables,
    the Spark counterpart of reading the summaries from the database."""
    out = {k: v for k, v in raw_tables.items() if k not in ("tickets", "passengers")}
    out["ticket_summary"] = ticket_summary(raw_tables["tickets"])
    out["ticket_by_flight"] = ticket_by_flight(raw_tables["tickets"])
    return out
