"""Metamorphic check: with no null or zero amounts, every mart gives the
same numbers from ticket cells as from tickets."""

import pytest
from pyspark.sql import functions as F

from aeromart.operators import marts
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import build_ticket_summary_enriched, build_tickets_enriched
from aeromart.operators.summaries import ticket_summary
from aeromart.sources.fixtures import airline_tables


@pytest.fixture(scope="module")
def both(spark):
    src = airline_tables(spark, "/root/testdata/sf0.001")
    raw = src["tickets"].where(F.col("total_amount").isNotNull() & (F.col("total_amount") != 0))
    dim = build_route_dimension(src["routes"], src["airports"])
    return build_tickets_enriched(raw, dim), build_ticket_summary_enriched(ticket_summary(raw), dim)


def rows(df, keys, measures):
    out = {}
    for r in df.collect():
        out[tuple(r[k] for k in keys)] = tuple(round(float(r[m]), 6) if r[m] is not None else None for m in measures)
    return out


@pytest.mark.parametrize(
    "mart,keys,measures",
    [
        (marts.revenue_by_route, ["route_code"], ["tickets", "revenue", "avg_ticket_value", "tax_amount"]),
        (marts.revenue_by_month, ["departure_month", "cabin_class"], ["tickets", "revenue"]),
        (marts.cabin_mix, ["cabin_class"], ["tickets", "revenue", "avg_ticket_value", "revenue_share"]),
        (marts.route_efficiency, ["route_code"], ["revenue_per_distance", "avg_ticket_value_per_minute"]),
        (marts.tax_by_route, ["route_code"], ["tickets", "tax_amount", "avg_tax_share"]),
    ],
)
def test_cell_grain_equals_ticket_grain(both, mart, keys, measures):
    tickets, cells = both
    assert rows(mart(tickets), keys, measures) == rows(mart(cells), keys, measures)
