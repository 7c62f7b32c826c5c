"""DS8 views for one filter state, and the ticket-grain preparation."""

import datetime as dt
import os
import tempfile

import pytest

from aeromart.operators.overview import as_dict
from aeromart.plans.dashboard import Slice, dashboard_views, filter_options, has_tickets, kpi_labels
from aeromart.plans.prepare import prepare_to_storage
from aeromart.plans.registry import Prepared
from aeromart.sources.fixtures import airline_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def p(spark):
    return Prepared.of(spark, SF)


def test_all_views_for_a_slice(p):
    selection = Slice(start_date=dt.date(1995, 1, 1), end_date=dt.date(2001, 12, 31),
                      cabin_classes=["ECONOMY", "BUSINESS", "PREMIUM", "FIRST"], min_distance=0.0)
    assert has_tickets(p.tickets, selection)
    views = dashboard_views(p.tickets, p.flights, selection)
    counts = {name: df.count() for name, df in views.items()}
    assert counts["top_routes"] == 12 and counts["top_yield"] == 15 and counts["top_aircraft"] == 12
    assert counts["efficiency_table"] == 50 and counts["route_table"] == 100 and counts["findings"] == 5
    assert counts["segments"] == 20
    top = [r["revenue"] for r in views["top_routes"].collect()]
    assert top == sorted(top)                      # bars re-sorted ascending
    metrics = as_dict(views["overview"])
    assert metrics["tickets"] == views["route_summary"].groupBy().sum("tickets").first()[0]
    labels = {r["metric"]: r["label"] for r in kpi_labels(views["overview"]).collect()}
    assert labels["avg_tax_share"].endswith("%") and "," in labels["revenue"]


def test_empty_slice_stops(p):
    assert not has_tickets(p.tickets, Slice(routes=["NO-SUCH-ROUTE"]))


def test_filter_options(p):
    opts = filter_options(p.tickets, p.flights)
    cabins = [r["value"] for r in opts["cabin_class"].collect()]
    assert cabins == ["BUSINESS", "ECONOMY", "FIRST", "PREMIUM"]
    bounds = opts["date_bounds"].first()
    assert bounds["min_date"] <= bounds["max_date"]
    assert opts["max_distance"].first()["max_distance"] > 900


def test_ticket_grain_preparation(spark):
    out = tempfile.mkdtemp(prefix="aeromart-tickets-")
    written = prepare_to_storage(airline_tables(spark, SF), out, as_of_year=2026)
    assert sorted(os.listdir(out)) == sorted(f"{n}.parquet" for n in written)
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert written["tickets_enriched"].count() == lineitem   # unique dimension keys: no fan-out
    assert "age_band" in written["tickets_enriched"].columns
    assert "passenger_country" in written["passenger_segments"].columns
    sold = written["flights_enriched"].groupBy().sum("tickets_sold").first()[0]
    assert sold == written["tickets_enriched"].count()


def test_dashboard_over_prepared_cell_grain_data(spark):
    """The reference's interactive flow: job output -> load -> slice -> views."""
    from aeromart.plans import job
    from aeromart.sources.parquet import load_prepared_data

    out = tempfile.mkdtemp(prefix="aeromart-dash-")
    job.main(["--source", "testdata", "--input", SF, "--output", out, "--as-of-year", "2026"])
    data = load_prepared_data(spark, out)
    tickets, flights = data["tickets_enriched"], data["flights_enriched"]
    selection = Slice(start_date=dt.date(1996, 1, 1), end_date=dt.date(1999, 12, 31),
                      cabin_classes=["ECONOMY", "BUSINESS"], min_distance=905.0)
    assert has_tickets(tickets, selection)
    views = dashboard_views(tickets, flights, selection)
    counts = {name: df.count() for name, df in views.items()}
    assert counts["findings"] == 5 and counts["segments"] == 2   # cells carry no passenger data (N21)
    m = as_dict(views["overview"])
    assert m["tickets"] == views["route_summary"].groupBy().sum("tickets").first()[0]
    assert 0 < m["avg_tax_share"] < 1
