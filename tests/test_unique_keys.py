"""Dimensions whose key is known to be unique: joins that nobody reads are
left out, repeated keys still multiply rows, and folds shuffle less."""

import pytest
from pyspark.sql import functions as F

from aeromart.operators.base import ticket_base
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import build_tickets_enriched, ticket_totals_by_flight
from aeromart.operators.joins import join_dimension, known_unique
from aeromart.operators.overview import ticket_metrics

ROUTES = [("R1", "A", "B", 100.0, 60.0), ("R2", "B", "A", None, None), (None, "A", "A", 7.0, 7.0), (None, "B", "B", 7.0, 7.0)]
AIRPORTS = [("A", "Aa", "City", "X", "Europe"), ("B", "Bb", None, "Y", "Asia")]
PASSENGERS = [("1", "F", "1990-05-01", "X", " vip "), ("2", "M", None, "Y", None), (None, "M", "1950-01-01", "X", "N"), (None, "F", "1950-01-01", "Y", "Y")]
TICKETS = [
    ("T1", "1", "F1", "R1", "2020-01-02 10:00:00", "econ", 10.0, 1.0, None, 11.0),
    ("T2", "1", "F1", "R2", "2020-02-02 10:00:00", "Bus", 20.0, None, 2.0, 0.0),
    ("T3", "2", "F1", "R9", None, None, 30.0, 3.0, 1.0, None),
    ("T4", "9", "F2", None, "2021-01-02 10:00:00", "first", 40.0, 3.0, 1.0, 44.0),
    ("T5", None, None, "R1", "2021-01-02 10:00:00", "E", 50.0, float("nan"), 1.0, 51.0),
]


def tables(spark, more_routes=(), more_passengers=()):
    tickets = spark.createDataFrame(
        TICKETS,
        "ticket_id string, passenger_id string, flight_id string, route_code string, departure string, class string, price double, airport_tax double, local_tax double, total_amount double",
    )
    routes = spark.createDataFrame([*ROUTES, *more_routes], "route_code string, origin string, destination string, distance double, flight_minutes double")
    airports = spark.createDataFrame(AIRPORTS, "iata_code string, airport string, city string, country string, continent string")
    passengers = spark.createDataFrame([*PASSENGERS, *more_passengers], "id string, gender string, birth_date string, country string, vipcard string")
    return tickets, known_unique(build_route_dimension(routes, airports), "route_code"), passengers


REPEATED = {"more_routes": [("R1 ", "B", "B", 5.0, 5.0)], "more_passengers": [(" 1", "M", "2001-01-01", "Z", "N")]}


def left_joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")


def texts(df):
    return sorted(str(r) for r in df.collect())


def test_totals_join_no_dimension_whose_keys_are_unique(spark):
    tickets, routes, passengers = tables(spark)
    fact = build_tickets_enriched(tickets, routes, passengers)
    totals = ticket_totals_by_flight(fact)
    assert left_joins(fact) >= 2 and left_joins(totals) == left_joins(ticket_metrics(fact)) == 0
    assert texts(totals) == texts(ticket_totals_by_flight(tickets))


def test_repeated_keys_still_multiply_rows(spark):
    fact = build_tickets_enriched(*tables(spark, **REPEATED))
    sold = {r["flight_id"]: r["tickets_sold"] for r in ticket_totals_by_flight(fact).collect()}
    # T1: two passengers by two routes, T2: two passengers, T5: two routes
    assert sold == {"F1": 7, "F2": 1, None: 2} and fact.count() == 10


def test_a_key_is_known_unique_only_if_it_is(spark):
    dim = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "k string, v int")
    fact = spark.createDataFrame([("a",), (None,), ("c",), ("a",)], "k string")
    assert texts(join_dimension(fact, known_unique(dim, "k"), "k")) == texts(join_dimension(fact, dim, "k"))
    repeated = dim.union(dim)
    assert known_unique(repeated, "k") is repeated
    assert known_unique(dim.where("false"), "k").count() == 0


@pytest.mark.parametrize("more", [{}, REPEATED])
def test_rows_planned_for_folds_are_the_same(spark, more):
    tickets, routes, passengers = tables(spark, **more)
    clash = routes.withColumns({"departure_year": F.lit(1), "price": F.lit(2), "vip_card": F.lit("Y")})
    dated = routes.withColumns({"departure_year": F.lit(1), "price": F.lit(2)})
    given = tickets.withColumns({"tax_amount": F.lit(-1.0), "tax_share": F.lit("s")})
    cases = [(tickets, routes, passengers), (given, dated, passengers), (tickets, clash.withColumn("age_band", F.lit("x")), passengers), (given, dated, None)]
    for case in cases:
        a, b = (build_tickets_enriched(*case, for_folds=x) for x in (False, True))
        assert a.schema == b.schema and texts(a) == texts(b)


def test_folds_derive_before_the_joins(spark):
    tickets, routes, passengers = tables(spark)
    base = ticket_base(build_tickets_enriched(tickets, routes, passengers, for_folds=True))
    tree = base._jdf.queryExecution().optimizedPlan().toString()
    above, below = tree[: tree.index("Join LeftOuter")], tree[tree.index("Join LeftOuter") :]
    assert "AS tax_amount#" in below and "AS age_band#" in below
    assert "AS tax_amount#" not in above and "birth_date" not in above
