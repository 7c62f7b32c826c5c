"""Measures that work on every grain of a tickets table.

A tickets table is at *cell grain* when it carries pre-aggregated
``tickets`` and ``revenue`` columns (route x month x cabin cells); every
measure then re-sums partials instead of counting rows.  At *partial grain*
it carries ``partial_sums`` of either grain, with a sum and a count for
each mean, so that means come out as those of the rows summed (N16).  The
decision is made from the schema, never from the data, so it costs no
Spark job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeromart.functions.expressions import safe_divide, sum0

CELL_GRAIN_COLUMNS = ("tickets", "revenue")
PARTIAL_COLUMNS = ("n_tickets", "sum_amount", "n_amounts", "sum_tax", "sum_share", "n_shares")


def is_cell_grain(tickets: DataFrame) -> bool:
    """MSR0: the table holds pre-aggregated cells."""
    return set(CELL_GRAIN_COLUMNS) <= set(tickets.columns)


def is_partial_grain(tickets: DataFrame) -> bool:
    """The table holds ``partial_sums``."""
    return set(PARTIAL_COLUMNS) <= set(tickets.columns)


def partial_sums(tickets: DataFrame) -> list[Column]:
    """Aggregates from which all five measures follow, at the grain of
    ``tickets``: what each mean divides by is kept beside its sum."""
    if is_partial_grain(tickets):
        return [F.sum(c).alias(c) for c in PARTIAL_COLUMNS]
    if is_cell_grain(tickets):
        n, amount, n_amounts = F.sum("tickets"), "revenue", F.sum("tickets")
    else:
        n, amount, n_amounts = F.count(F.lit(1)), "total_amount", F.count("total_amount")
    if is_cell_grain(tickets) and "tax_share_sum" in tickets.columns:
        share, n_shares = F.sum("tax_share_sum"), F.sum("tickets")
    else:
        share, n_shares = F.sum("tax_share"), F.count("tax_share")
    values = (n, F.sum(amount), n_amounts, F.sum("tax_amount"), share, n_shares)
    return [v.alias(c) for v, c in zip(values, PARTIAL_COLUMNS, strict=True)]


def ticket_count(tickets: DataFrame) -> Column:
    """MSR1: rows at ticket grain (long), re-summed cells at cell grain (double)."""
    if is_partial_grain(tickets):
        kind = tickets.schema["n_tickets"].dataType
        return F.coalesce(F.sum("n_tickets"), F.lit(0).cast(kind)).alias("tickets")
    if is_cell_grain(tickets):
        return sum0("tickets").alias("tickets")
    return F.count(F.lit(1)).alias("tickets")


def revenue(tickets: DataFrame) -> Column:
    """MSR2: summed amounts, 0 when there is none."""
    if is_partial_grain(tickets):
        return sum0("sum_amount").alias("revenue")
    return sum0("revenue" if is_cell_grain(tickets) else "total_amount").alias("revenue")


def avg_ticket_value(tickets: DataFrame) -> Column:
    """MSR3: mean of non-null amounts, or revenue per ticket at cell grain (N16)."""
    if is_partial_grain(tickets):
        return safe_divide(sum0("sum_amount"), sum0("n_amounts")).alias("avg_ticket_value")
    if is_cell_grain(tickets):
        return safe_divide(sum0("revenue"), sum0("tickets")).alias("avg_ticket_value")
    return F.avg("total_amount").alias("avg_ticket_value")


def tax_amount(tickets: DataFrame) -> Column:
    """MSR4: summed taxes (same at ticket and cell grain)."""
    return sum0("sum_tax" if is_partial_grain(tickets) else "tax_amount").alias("tax_amount")


def avg_tax_share(tickets: DataFrame) -> Column:
    """MSR5: mean tax share; at cell grain the summed shares per ticket."""
    if is_partial_grain(tickets):
        return safe_divide(sum0("sum_share"), sum0("n_shares")).alias("avg_tax_share")
    if is_cell_grain(tickets) and "tax_share_sum" in tickets.columns:
        return safe_divide(
            sum0("tax_share_sum"), sum0("tickets")
        ).alias("avg_tax_share")
    return F.avg("tax_share").alias("avg_tax_share")
