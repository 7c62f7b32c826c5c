"""The shared base: what is rolled up from it, how often facts are read for
it, and that bases merge."""

import pytest
from pyspark.sql import functions as F

from aeromart.functions import measures as M
from aeromart.operators import marts
from aeromart.operators.base import MONTHS, ROUTES, SEGMENTS, fleet_base, merged, of_set, read_bases, stored_bases, ticket_base
from aeromart.operators.findings import summarize_key_findings, ticket_findings
from aeromart.operators.overview import as_dict, overview_metrics
from aeromart.plans.dashboard import dashboard_views, filter_options
from aeromart.plans.prepare import prepare_to_storage
from aeromart.plans.registry import Prepared
from aeromart.session import shared_scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def p(spark):
    return Prepared.of(spark, SF)


@pytest.fixture(scope="module")
def bases(spark, p):
    return stored_bases(p.tickets, p.flights, shared_scratch_path(spark, "test-bases"))


def close(a, b):
    def key(row):
        return tuple(round(v + 1e-8, 6) if isinstance(v, float) else v for v in row)  # ties off the last digit

    assert sorted(map(key, a.collect()), key=str) == sorted(map(key, b.select(*a.columns).collect()), key=str)


def scans(df, path):
    return df._jdf.queryExecution().executedPlan().toString().count(path)


@pytest.fixture(scope="module")
def written(spark, p):
    """(tickets fact, its path, flights fact, its path)"""
    out = []
    for df, name in ((p.tickets, "tf"), (p.flights, "ff")):
        path = shared_scratch_path(spark, name)
        df.write.parquet(path)
        out += [spark.read.parquet(path), path]
    return out


TICKET_MARTS = [
    (marts.revenue_by_month, MONTHS),
    (marts.cabin_mix, MONTHS),
    (marts.revenue_by_route, ROUTES),
    (marts.route_efficiency, ROUTES),
    (marts.tax_by_route, ROUTES),
    (marts.passenger_segments, SEGMENTS),
]


@pytest.mark.parametrize(("mart", "key_set"), TICKET_MARTS)
@pytest.mark.parametrize("grain", ["tickets", "cells_enriched"])
def test_marts_from_the_base_equal_those_from_the_fact(p, mart, key_set, grain):
    fact = getattr(p, grain)
    a, b = mart(fact), mart(of_set(ticket_base(fact), key_set))
    assert {f.name: f.dataType for f in a.schema} == {f.name: f.dataType for f in b.schema}
    close(a, b)


@pytest.mark.parametrize("mart", [marts.fleet_utilization, marts.fleet_by_model])
@pytest.mark.parametrize("fact", ["flights", "flights_cells"])
def test_fleet_marts_from_the_base_equal_those_from_the_fact(p, mart, fact):
    close(mart(getattr(p, fact)), mart(fleet_base(getattr(p, fact))))


def test_overview_and_findings_from_bases(p, bases):
    tickets, flights = bases
    a, b = as_dict(overview_metrics(p.tickets, p.flights)), as_dict(overview_metrics(of_set(tickets, ROUTES), flights))
    assert a == pytest.approx(b)
    assert summarize_key_findings(p.tickets, p.flights).collect() == summarize_key_findings(tickets, flights).collect()


def rows(spark, data):
    schema = "route_code string, route_label string, origin string, destination string, origin_country string, destination_country string, origin_continent string, destination_continent string, distance double, flight_minutes double, departure_month string, cabin_class string, total_amount double, tax_amount double, tax_share double"
    return spark.createDataFrame(data, schema)


def hard_tickets(spark):
    """Null and empty keys, routes without a name, amounts and shares that are null."""
    data = []
    for i in range(60):
        code = [None, "", "R1", "r1", "R 1", "Ü"][i % 6]
        far = [None, 0.0, 7.5][i % 3] if code is None else 100.0
        amount = None if i % 5 == 0 else float(i)
        data.append((code, None, "A", None, None, "X", None, "Y", far, None, "2020-01", ["E", None][i % 2], amount, float(i % 3), None if i % 7 == 0 else i / 100))
    return rows(spark, data)


def test_distinct_counts_over_null_and_text_keys(spark):
    tickets = hard_tickets(spark)
    base = ticket_base(tickets)
    assert as_dict(overview_metrics(tickets))["routes"] == as_dict(overview_metrics(of_set(base, ROUTES)))["routes"] == 6.0
    flights = spark.createDataFrame([("A", "m"), (None, "m"), (None, None), ("A", None), ("B", None), (None, "m")], "airplane string, model string")
    for c in ("distance", "ticket_revenue", "tickets_sold", "seat_capacity", "estimated_load_factor", "estimated_fuel_gallons"):
        flights = flights.withColumn(c, F.lit(2.0))
    a, b = (marts.fleet_by_model(x).collect() for x in (flights, fleet_base(flights)))
    assert a == b and {r["model"]: r["aircraft"] for r in a} == {"m": 2, None: 3}
    none = as_dict(overview_metrics(tickets, flights))
    assert none["aircraft"] == 3.0 and none["scheduled_flights"] == 6.0


def test_bases_merge(spark, p):
    for tickets in (hard_tickets(spark), p.tickets):
        odd = F.xxhash64("route_code", "departure_month", "total_amount") % 2 == 0
        parts = merged(*[ticket_base(tickets.where(w)) for w in (odd, ~odd)])
        whole = ticket_base(tickets)
        assert parts.columns == whole.columns
        close(whole, parts)
        close(marts.route_efficiency(of_set(whole, ROUTES)), marts.route_efficiency(of_set(parts, ROUTES)))
    early = F.month("departure") < 6
    close(marts.fleet_utilization(p.flights), marts.fleet_utilization(merged(*[fleet_base(p.flights.where(w)) for w in (early, ~early)])))


def test_a_base_of_no_rows(spark):
    none = hard_tickets(spark).where("false")
    assert ticket_base(none).count() == 0
    assert as_dict(overview_metrics(of_set(ticket_base(none), ROUTES))) == {"revenue": 0, "tickets": 0, "avg_ticket_value": 0, "routes": 0, "avg_tax_share": 0}
    assert ticket_findings(none).count() == 0


def test_findings_skip_null_numbers(spark):
    """No route has a distance and no ticket a share: two sentences less."""
    tickets = hard_tickets(spark).withColumn("distance", F.lit(None).cast("double")).withColumn("tax_share", F.lit(None).cast("double"))
    assert [r["finding_id"] for r in ticket_findings(tickets).orderBy("finding_id").collect()] == [1, 2]


# ------------------------------------------------------------------ scans
def test_key_findings_read_the_tickets_once(written):
    tickets, tickets_path, flights, flights_path = written
    findings = summarize_key_findings(tickets, flights)
    assert scans(findings, tickets_path) == 1 and scans(findings, flights_path) == 1
    assert scans(overview_metrics(tickets, flights), tickets_path) == 1


def test_dashboard_views_read_no_fact(written):
    tickets, tickets_path, flights, flights_path = written
    assert scans(tickets, tickets_path) == scans(flights, flights_path) == 1
    for name, view in (dashboard_views(tickets, flights) | filter_options(tickets, flights)).items():
        assert scans(view, tickets_path) == scans(view, flights_path) == 0, name
    base = ticket_base(tickets)
    text = base._jdf.queryExecution().executedPlan().toString()
    assert scans(base, tickets_path) == 1 and text.count("Exchange") == 1 and "partial_sum" in text


def test_a_mart_reads_its_own_key_set(spark, tmp_path, p):
    tickets, _ = stored_bases(p.tickets, p.flights, str(tmp_path))
    text = marts.revenue_by_month(of_set(tickets, MONTHS))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_set" in text and "PushedFilters" in text
    assert set(M.PARTIAL_COLUMNS) <= set(tickets.columns)


def test_the_job_keeps_its_bases(spark, tmp_path, p):
    prepared = prepare_to_storage(p.src, str(tmp_path / "out"), 2026, base_folder=str(tmp_path / "bases"))
    tickets, flights = read_bases(spark, str(tmp_path / "bases"))
    close(prepared["tax_by_route"], marts.tax_by_route(of_set(tickets, ROUTES)))
    assert summarize_key_findings(tickets, flights).count() == 5
