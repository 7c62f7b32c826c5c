"""The reference's three tests plus values computed by hand from its formulas."""

import pytest

from aeromart import (
    build_flights_enriched,
    build_route_dimension,
    build_ticket_summary_enriched,
    build_tickets_enriched,
    cabin_mix,
    fleet_utilization,
    overview_metrics,
    revenue_by_month,
    revenue_by_route,
    route_efficiency,
    tax_by_route,
)
from aeromart.operators.overview import as_dict
from tests import reference_data as R


def by_key(df, key):
    return {row[key]: row.asDict() for row in df.collect()}


@pytest.fixture(scope="module")
def prepared(spark):
    route_dim = build_route_dimension(R.routes(spark), R.airports(spark))
    tickets = build_tickets_enriched(R.tickets(spark), route_dim)
    flights = build_flights_enriched(R.flights(spark), route_dim, R.airplanes(spark), tickets, as_of_year=2026)
    cells = build_ticket_summary_enriched(R.ticket_summary(spark), route_dim)
    return route_dim, tickets, flights, cells


def test_revenue_and_efficiency_outputs(prepared):
    _, tickets, _, _ = prepared
    revenue = revenue_by_route(tickets)
    assert revenue.first()["route_code"] == "R1"
    assert "BUSINESS" in [r["cabin_class"] for r in cabin_mix(tickets).collect()]
    assert "revenue_per_distance" in route_efficiency(tickets).columns


def test_fleet_utilization_output(prepared):
    _, _, flights, _ = prepared
    fleet = fleet_utilization(flights)
    assert sum(r["scheduled_flights"] for r in fleet.collect()) == 2
    assert "avg_load_factor" in fleet.columns


def test_aggregated_ticket_summary_outputs(prepared):
    _, _, _, cells = prepared
    r1 = by_key(revenue_by_route(cells), "route_code")["R1"]
    assert (r1["tickets"], r1["revenue"], r1["avg_ticket_value"]) == (12.0, 1800.0, 150.0)
    economy = by_key(cabin_mix(cells), "cabin_class")["ECONOMY"]
    assert (economy["tickets"], economy["revenue"]) == (15.0, 1300.0)


def test_route_dimension_values(prepared):
    route_dim, _, _, _ = prepared
    rows = by_key(route_dim, "route_code")
    assert rows["R1"]["route_label"] == "Madrid -> London"
    assert rows["R1"]["flight_hours"] == 2.5
    assert rows["R2"]["route_label"] == "Barcelona -> Madrid"
    assert rows["R2"]["flight_hours"] == pytest.approx(1.166667, abs=1e-6)
    assert rows["R1"]["origin_airport_tax_ref"] == 10.0
    assert rows["R1"]["destination_country"] == "United Kingdom"


def test_ticket_taxes(prepared):
    _, tickets, _, _ = prepared
    rows = by_key(tickets, "ticket_id")
    expected = {"T1": (15.0, 0.130435), "T2": (15.0, 0.047619), "T3": (13.0, 0.139785)}
    for ticket_id, (tax, share) in expected.items():
        assert rows[ticket_id]["tax_amount"] == tax
        assert rows[ticket_id]["tax_share"] == pytest.approx(share, abs=1e-6)
    assert rows["T1"]["departure_month"] == "2026-01"
    assert rows["T1"]["departure_year"] == 2026
    assert rows["T2"]["cabin_class"] == "BUSINESS"


def test_marts_at_ticket_grain(prepared):
    _, tickets, _, _ = prepared
    routes = by_key(revenue_by_route(tickets), "route_code")
    assert (routes["R1"]["tickets"], routes["R1"]["revenue"], routes["R1"]["avg_ticket_value"], routes["R1"]["tax_amount"]) == (2, 430.0, 215.0, 30.0)
    assert (routes["R2"]["tickets"], routes["R2"]["revenue"], routes["R2"]["avg_ticket_value"], routes["R2"]["tax_amount"]) == (1, 93.0, 93.0, 13.0)

    cabins = cabin_mix(tickets).collect()
    assert [r["cabin_class"] for r in cabins] == ["BUSINESS", "ECONOMY"]
    assert cabins[0]["revenue_share"] == pytest.approx(0.602294, abs=1e-6)
    assert cabins[1]["avg_ticket_value"] == 104.0

    months = [(r["departure_month"], r["cabin_class"], r["revenue"], r["tickets"]) for r in revenue_by_month(tickets).collect()]
    assert months == [("2026-01", "BUSINESS", 315.0, 1), ("2026-01", "ECONOMY", 208.0, 2)]

    eff = by_key(route_efficiency(tickets), "route_code")
    assert eff["R1"]["revenue_per_distance"] == pytest.approx(0.344)
    assert eff["R1"]["avg_ticket_value_per_distance"] == pytest.approx(0.172)
    assert eff["R1"]["avg_ticket_value_per_minute"] == pytest.approx(1.433333, abs=1e-6)
    assert eff["R2"]["avg_ticket_value_per_minute"] == pytest.approx(1.328571, abs=1e-6)

    taxes = tax_by_route(tickets).collect()
    assert [r["route_code"] for r in taxes] == ["R2", "R1"]
    assert taxes[1]["avg_tax_share"] == pytest.approx(0.089027, abs=1e-6)


def test_fleet_values(prepared):
    _, _, flights, _ = prepared
    fleet = by_key(fleet_utilization(flights), "airplane")
    a1, a2 = fleet["A1"], fleet["A2"]
    assert (a1["scheduled_flights"], a1["assigned_distance"], a1["ticket_revenue"], a1["tickets_sold"], a1["seat_capacity"]) == (1, 1250.0, 430.0, 2, 156.0)
    assert a1["avg_load_factor"] == pytest.approx(0.012821, abs=1e-6)
    assert a1["estimated_fuel_gallons"] == 1875.0
    assert (a2["assigned_distance"], a2["ticket_revenue"], a2["tickets_sold"], a2["seat_capacity"]) == (500.0, 93.0, 1, 100.0)
    assert a2["avg_load_factor"] == pytest.approx(0.01)
    assert a2["estimated_fuel_gallons"] == pytest.approx(606.666667, abs=1e-6)
    assert a1["aircraft_age_years"] == 6 and a2["aircraft_age_years"] == 7
    assert a1["maintenance_flight_hours"] == 1000.0


def test_overview_ticket_grain(prepared):
    _, tickets, flights, _ = prepared
    m = as_dict(overview_metrics(tickets, flights))
    assert m["revenue"] == 523.0 and m["tickets"] == 3.0 and m["routes"] == 2.0
    assert m["avg_ticket_value"] == pytest.approx(174.333333, abs=1e-6)
    assert m["avg_tax_share"] == pytest.approx(0.105946, abs=1e-6)
    assert (m["scheduled_flights"], m["aircraft"]) == (2.0, 2.0)
    assert m["avg_load_factor"] == pytest.approx(0.011410, abs=1e-6)


def test_overview_cell_grain(prepared):
    _, _, _, cells = prepared
    m = as_dict(overview_metrics(cells))
    assert (m["revenue"], m["tickets"], m["routes"]) == (2100.0, 17.0, 2.0)
    assert m["avg_ticket_value"] == pytest.approx(123.529412, abs=1e-6)
    assert m["avg_tax_share"] == pytest.approx(0.144118, abs=1e-6)
    assert "scheduled_flights" not in m


def test_cell_grain_marts(prepared):
    _, _, _, cells = prepared
    taxes = by_key(tax_by_route(cells), "route_code")
    assert taxes["R1"]["avg_tax_share"] == pytest.approx(0.141667, abs=1e-6)
    assert taxes["R2"]["avg_tax_share"] == pytest.approx(0.15)
    assert (taxes["R1"]["tax_amount"], taxes["R2"]["tax_amount"]) == (230.0, 45.0)
    r2 = by_key(revenue_by_route(cells), "route_code")["R2"]
    assert (r2["tickets"], r2["revenue"], r2["avg_ticket_value"]) == (5.0, 300.0, 60.0)
    cabins = by_key(cabin_mix(cells), "cabin_class")
    assert cabins["ECONOMY"]["avg_ticket_value"] == pytest.approx(86.666667, abs=1e-6)
    assert cabins["ECONOMY"]["revenue_share"] == pytest.approx(0.619048, abs=1e-6)
    assert (cabins["BUSINESS"]["tickets"], cabins["BUSINESS"]["revenue"], cabins["BUSINESS"]["avg_ticket_value"]) == (2.0, 800.0, 400.0)
    assert cabins["BUSINESS"]["revenue_share"] == pytest.approx(0.380952, abs=1e-6)
