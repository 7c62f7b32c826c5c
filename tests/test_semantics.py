
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from aeromart.functions import expressions as X
from aeromart.operators import filters, marts
from aeromart.operators.cleaning import clean_table, require
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import build_flights_enriched, build_ticket_summary_enriched, build_tickets_enriched
from aeromart.operators.findings import summarize_key_findings
from aeromart.operators.joins import join_dimension
from aeromart.operators.ordering import top_n
from aeromart.operators.overview import as_dict, overview_metrics
from aeromart.operators.summaries import ticket_summary
from tests import reference_data as R


def values(df, column):
    return [r[column] for r in df.collect()]


def one(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_n1_trim_removes_unicode_white_space(spark):
    df = one(spark, "s string", ("\t a b \n",), (" x　",), (" y ",), (None,))
    assert values(clean_table(df), "s") == ["a b", "x", "y", None]


def test_n2_lenient_double(spark):
    texts = ["1e3", "-2.5", ".5", "5.", "inf", "1_000", "abc", "0x1p3", "1d", "1f", ""]
    df = spark.createDataFrame([(t,) for t in texts], "price string")
    got = values(clean_table(df), "price")
    assert got[:5] == [1000.0, -2.5, 0.5, 5.0, float("inf")]
    assert got[5:] == [None] * 6


def test_n3_lenient_timestamp_layouts(spark):
    texts = [
        "2026-01-02", "2026-01-02 03:04:05", "2026-01-02T03:04:05", "2026-01-02 03:04:05.123456",
        "2026-01-02T03:04:05.5", "2026", "2026-01", "2026-01-02 10", "2026-01-02T03:04:05Z",
        "2026-01-02 03:04:05+01:00", "2026-02-30", "2026-1-02",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "departure string")
    got = values(clean_table(df), "departure")
    assert got[:5] == [
        dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 2, 3, 4, 5), dt.datetime(2026, 1, 2, 3, 4, 5),
        dt.datetime(2026, 1, 2, 3, 4, 5, 123456), dt.datetime(2026, 1, 2, 3, 4, 5, 500000),
    ]
    assert got[5:11] == [None] * 6
    assert got[11] == dt.datetime(2026, 1, 2)  # months and days may have one digit


def test_n3_dates_become_timestamps_and_timestamps_stay(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 5))], "birth_date date, arrival timestamp_ntz")
    cleaned = clean_table(df)
    assert dict(cleaned.dtypes) == {"birth_date": "timestamp_ntz", "arrival": "timestamp_ntz"}


@pytest.fixture(scope="module")
def tickets(spark):
    route_dim = build_route_dimension(R.routes(spark), R.airports(spark))
    return build_tickets_enriched(R.tickets(spark), route_dim)


def test_n4_empty_list_means_no_filter(tickets):
    assert filters.filter_tickets(tickets, cabin_classes=[], routes=None).count() == 3
    assert filters.filter_tickets(tickets, cabin_classes=["ECONOMY"]).count() == 2


def test_n5_null_in_filtered_column_drops_row(spark, tickets):
    extra = one(spark, "route_code string, origin_continent string", ("RX", None))
    df = tickets.select("route_code", "origin_continent").unionByName(extra)
    assert filters.filter_tickets(df, origin_continents=["Europe"]).count() == 3


def test_n6_cell_grain_date_range_keeps_whole_cells(spark):
    raw = one(
        spark,
        "ticket_id string, passenger_id string, flight_id string, route_code string, departure string, class string, "
        "price double, airport_tax double, local_tax double, total_amount double",
        ("a", "p", "f", "R1", "2026-01-05 10:00:00", "E", 1.0, 0.0, 0.0, 1.0),
        ("b", "p", "f", "R1", "2026-01-20 10:00:00", "E", 1.0, 0.0, 0.0, 1.0),
    )
    cells = build_ticket_summary_enriched(ticket_summary(raw), build_route_dimension(R.routes(spark), R.airports(spark)))
    assert values(cells, "departure_date") == [dt.date(2026, 1, 5)]
    kept = filters.filter_tickets(cells, start_date=dt.date(2026, 1, 5), end_date=dt.date(2026, 1, 10))
    assert values(kept, "tickets") == [2.0]
    assert filters.filter_tickets(cells, start_date=dt.date(2026, 1, 6)).count() == 0


def test_n7_sum_of_nothing_is_zero(spark):
    df = one(spark, "g string, x double", ("a", None), ("a", None))
    assert df.groupBy("g").agg(X.sum0("x").alias("s")).first()["s"] == 0.0


def test_n8_distinct_count_counts_null(spark):
    df = one(spark, "x string", ("a",), (None,), ("a",), ("b",))
    assert df.agg(X.distinct_count_with_null("x").alias("n")).first()["n"] == 3


def test_n9_descending_puts_nulls_first(spark):
    df = one(spark, "departure_month string, cabin_class string, total_amount double",
             ("2026-01", None, 5.0), ("2026-01", "B", 1.0))
    assert values(marts.revenue_by_month(df), "cabin_class") == [None, "B"]


def test_n10_ties_break_on_keys(spark):
    df = one(spark, "route_code string, route_label string, origin string, destination string, total_amount double, tax_amount double, tax_share double",
             ("R2", "x", "a", "b", 5.0, 0.0, 0.0), ("R1", "y", "a", "b", 5.0, 0.0, 0.0))
    df = df.withColumns({c: F.lit(None).cast("string") for c in ["origin_country", "destination_country", "origin_continent", "destination_continent"]})
    assert values(marts.revenue_by_route(df), "route_code") == ["R1", "R2"]


def test_n11_top_n(spark, tickets):
    assert top_n(tickets, 0).count() == 3 and top_n(tickets, None).count() == 3
    assert marts.revenue_by_route(tickets, top=1).count() == 1
    with pytest.raises(ValueError):
        top_n(tickets, -1)


def test_n12_duplicate_airport_is_picked_stably_duplicate_route_fans_out(spark):
    airports = R.airports(spark).unionByName(
        one(spark, "iata_code string, airport string, city string, country string, continent string, latitude double, longitude double, airport_tax double",
            ("MAD", "AAA", "Madrid Old", "Spain", "Europe", 0.0, 0.0, 1.0)))
    routes = R.routes(spark).unionByName(R.routes(spark).where("route_code = 'R2'"))
    dim = build_route_dimension(routes, airports)
    assert sorted(values(dim, "route_code")) == ["R1", "R2", "R2"]
    assert set(values(dim.where("route_code = 'R1'"), "origin_airport")) == {"AAA"}
    tickets = build_tickets_enriched(R.tickets(spark), dim)
    assert tickets.count() == 4


def test_n13_aircraft_age_uses_as_of_year(spark):
    dim = build_route_dimension(R.routes(spark), R.airports(spark))
    t = build_tickets_enriched(R.tickets(spark), dim)
    f = build_flights_enriched(R.flights(spark), dim, R.airplanes(spark), t, as_of_year=2030)
    assert sorted(values(f, "aircraft_age_years")) == [10, 11]


def test_n14_age_bands(spark):
    df = one(spark, "age int", (-3,), (24,), (25,), (49,), (64,), (65,), (None,))
    got = values(df.select(X.age_band("age").alias("b")), "b")
    assert got == ["Under 25", "Under 25", "25-34", "35-49", "50-64", "65+", "Unknown"]


def test_n15_total_amount_derived_only_when_absent(spark):
    dim = build_route_dimension(R.routes(spark), R.airports(spark))
    no_total = R.tickets(spark).drop("total_amount")
    derived = {r["ticket_id"]: r["total_amount"] for r in build_tickets_enriched(no_total, dim).collect()}
    assert derived == {"T1": 115.0, "T2": 315.0, "T3": 93.0}
    with_null = R.tickets(spark).withColumn("total_amount", F.lit(None).cast("double"))
    assert set(values(build_tickets_enriched(with_null, dim), "total_amount")) == {None}


def test_n16_mean_differs_by_grain(spark):
    df = one(spark, "cabin_class string, total_amount double", ("E", 10.0), ("E", None))
    assert marts.cabin_mix(df).first()["avg_ticket_value"] == 10.0
    cells = one(spark, "cabin_class string, tickets double, revenue double", ("E", 2.0, 10.0))
    assert marts.cabin_mix(cells).first()["avg_ticket_value"] == 5.0


def test_n17_null_keys_never_join_but_group(spark):
    fact = one(spark, "k string, v int", (None, 1), ("a", 2))
    dim = one(spark, "k string, d string", (None, "x"), ("a", "y"))
    assert [r["d"] for r in join_dimension(fact, dim, "k").orderBy("v").collect()] == [None, "y"]
    grouped = one(spark, "g string, x int", (None, 1), (None, 2)).groupBy("g").count()
    assert grouped.count() == 1


def test_n18_name_clash_gets_right_suffix(spark):
    fact = one(spark, "k string, v int", ("a", 1))
    dim = one(spark, "k string, v int", ("a", 9))
    assert join_dimension(fact, dim, "k").columns == ["k", "v", "v_right"]


def test_n19_unmatched_tickets_form_one_group(spark):
    dim = build_route_dimension(R.routes(spark), R.airports(spark))
    extra = R.tickets(spark).where("ticket_id = 'T3'").withColumn("route_code", F.lit("RX"))
    t = build_tickets_enriched(R.tickets(spark).unionByName(extra).unionByName(extra), dim)
    rx = marts.revenue_by_route(t).where("route_code = 'RX'").collect()
    assert len(rx) == 1 and rx[0]["tickets"] == 2 and rx[0]["route_label"] is None


def test_n20_cabin_mapping(spark):
    texts = ["E", " econ ", "Economy", "p", "Premium Economy", "bus", "BUSINESS", "first", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = values(df.select(X.cabin_class("c").alias("k")), "k")
    assert got == ["ECONOMY", "ECONOMY", "ECONOMY", "PREMIUM", "PREMIUM", "BUSINESS", "BUSINESS", "FIRST", None]


def test_n21_segments_without_passengers_group_by_cabin(tickets):
    assert marts.passenger_segments(tickets).columns == ["cabin_class", "tickets", "revenue", "avg_ticket_value"]


def test_n21_no_segment_keys_gives_empty_table(spark):
    assert marts.passenger_segments(one(spark, "x int", (1,))).columns == []


def test_n22_findings_skip_null_numbers(spark):
    dim = build_route_dimension(R.routes(spark), R.airports(spark))
    t = build_tickets_enriched(R.tickets(spark), dim).withColumn("tax_share", F.lit(None).cast("double"))
    f = build_flights_enriched(R.flights(spark), dim, R.airplanes(spark), t, as_of_year=2026)
    ids = values(summarize_key_findings(t, f), "finding_id")
    assert sorted(ids) == [1, 2, 3, 4]


def test_n23_flight_without_aircraft(spark):
    dim = build_route_dimension(R.routes(spark), R.airports(spark))
    t = build_tickets_enriched(R.tickets(spark), dim)
    flights = R.flights(spark).withColumn("airplane", F.lit("NOPE"))
    f = build_flights_enriched(flights, dim, R.airplanes(spark), t, as_of_year=2026)
    rows = f.collect()
    assert {r["seat_capacity"] for r in rows} == {0.0}
    assert {r["estimated_load_factor"] for r in rows} == {None}
    assert {r["tickets_sold"] for r in rows} == {1, 2}
    assert as_dict(overview_metrics(t, f))["avg_load_factor"] == 0.0


def test_n24_fuel_null_factor_sums_to_zero(spark):
    df = one(spark, "airplane string, model string, distance double, ticket_revenue double, tickets_sold long, "
                    "seat_capacity double, estimated_load_factor double, estimated_fuel_gallons double",
             ("A", "M", 1.0, 1.0, 1, 1.0, 1.0, None))
    assert marts.fleet_utilization(df).first()["estimated_fuel_gallons"] == 0.0


def test_n25_min_distance_treats_null_as_zero(spark):
    df = one(spark, "distance double", (None,), (0.0,), (5.0,))
    assert filters.filter_tickets(df, min_distance=0).count() == 3
    assert filters.filter_tickets(df, min_distance=1).count() == 1


def test_n26_required_columns(spark):
    with pytest.raises(ValueError, match="route_code, origin"):
        require(one(spark, "x int", (1,)), ["route_code", "origin"], "routes")
    with pytest.raises(ValueError, match="flight_minutes"):
        build_route_dimension(R.routes(spark).drop("flight_minutes"), R.airports(spark))


def test_sums_and_means_leave_nothing_out(spark):
    def mix(*amounts):
        rows = spark.createDataFrame([("E", float(a)) for a in amounts], "cabin_class string, total_amount double")
        return marts.cabin_mix(rows).first()

    assert mix("2e14", "1")["revenue"] == 2e14 + 1
    assert mix("2e14", "1")["avg_ticket_value"] == (2e14 + 1) / 2
    assert abs(mix(*["0.00004"] * 10)["revenue"] - 0.0004) < 1e-12
    assert math.isnan(mix("1", "nan", "3")["revenue"])
    assert mix("1", "inf")["revenue"] == math.inf


def test_exact_sum_refuses_what_it_cannot_hold(spark):
    from pyspark.errors import PySparkException

    from aeromart.functions.expressions import exact_sum

    ok = spark.createDataFrame([(0.1,)] * 10, "x double").agg(exact_sum("x").alias("s")).first()["s"]
    assert float(ok) == 1.0
    for bad in (float("nan"), float("inf"), 1e30):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "x double").agg(exact_sum("x")).collect()


def test_short_layouts_newlines_and_zones(spark):
    from aeromart.operators.cleaning import cast_numbers, parse_temporal

    rows = spark.createDataFrame([("2026-1-5",), ("2026-01-05 1:02:03",), ("2026-01-05\n",)], "departure string")
    got = [r["departure"] for r in parse_temporal(rows, ["departure"]).collect()]
    assert [str(x) for x in got] == ["2026-01-05 00:00:00", "2026-01-05 01:02:03", "None"]
    assert cast_numbers(spark.createDataFrame([("12\n",)], "price string"), ["price"]).first()["price"] is None
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            zoned = spark.sql("select timestamp_seconds(1767279600) as departure")  # 2026-01-01 15:00 UTC
            assert str(parse_temporal(zoned, ["departure"]).selectExpr("cast(departure as string) t").first()["t"]) == "2026-01-01 15:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
