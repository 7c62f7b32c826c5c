"""A fact dealt once for a join and for the layout after it."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from aeromart.operators.dealing import PART, Dealing, cuts, join_dealt, join_dealt_group, key_group, place, places
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import build_tickets_enriched, ticket_totals_by_flight, tickets_enriched_dealt, tickets_to_lay_out
from aeromart.operators.joins import join_dimension
from aeromart.plans import colocated
from aeromart.plans.registry import Prepared
from aeromart.session import shared_scratch_path
from aeromart.sources import parquet as pq
from tests.test_layout import LAID_AIRPORTS, LAID_ROUTES, LAID_TICKETS, no_broadcast, plan  # noqa: F401


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_cuts_are_quantiles_and_tied_where_a_value_is_hot():
    assert cuts(range(12), 4) == [3, 6, 9]
    assert cuts(["b", None, "a", "b", "b", "b", "c", "d"], 3) == ["b", "b"]
    assert cuts([1, 2, 1, 2, 3, 3], 3) == [2, 3]
    assert cuts([None], 3) == [] == cuts([], 3)


@pytest.mark.parametrize("at", [[], ["d"], ["b", "d", "d", "d", "f"], ["d", "d"]])
def test_a_row_goes_where_its_keys_dimension_rows_are(spark, at):
    rows = spark.range(700).selectExpr("element_at(array('a', 'b', 'c', 'd', 'e', 'f', null), cast(id % 7 as int) + 1) as k", "xxhash64(id) as h")
    got = rows.select("k", place(F.col("k"), at, F.col("h")).alias("one"), places(F.col("k"), at).alias("all")).collect()
    assert all(0 <= r["one"] <= len(at) and (r["k"] is None or r["one"] in r["all"]) for r in got)
    met = {}
    for r in got:
        met.setdefault(r["k"], set()).add(r["one"])
    assert all(met[k] == set(next(r["all"] for r in got if r["k"] == k)) for k in "abcdef")
    assert met[None] == set(range(len(at) + 1))
    firsts = [min(met[k]) for k in "abcdef"]
    assert firsts == sorted(firsts) and len(met["d"]) == max(1, at.count("d"))


@pytest.mark.parametrize("parts, most", [(1, 64), (40, 64), (40, 3)])
def test_a_dealt_join_has_the_rows_of_the_plain_one(spark, monkeypatch, no_broadcast, parts, most):  # noqa: F811
    monkeypatch.setattr("aeromart.operators.dealing.MOST_RANGES", most)
    # a third on one key, unmatched and null keys, null groups, rows that come twice
    fact = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'K7', if(id % 31 = 0, null, concat('K', id % 50))) as key", "if(id % 41 = 0, null, cast(id % 5 as int)) as month", "cast(id % 1500 as string) as payload"
    )
    dim = spark.createDataFrame([*[(f"K{i}", i) for i in range(40)], ("K7", 700), (None, -1)], "key string, value int")
    dealt = join_dealt(fact, dim, Dealing.of(fact.select("key", "month"), "key", F.col("month"), 4, parts))
    assert rows_of(dealt.drop(PART)) == rows_of(join_dimension(fact, dim, "key"))
    text = plan(dealt)
    assert text.count("Exchange") == 2 and text.count("shufflepartitionidpassthrough") == 2
    if (parts, most) == (40, 64):
        hot = dealt.where("key = 'K7'").groupBy(PART).count().collect()
        assert len(hot) > 8 and max(r["count"] for r in hot) < 500
    none = fact.where("false")
    assert join_dealt(none, dim, Dealing.of(none.select("key", "month"), "key", F.col("month"), 4, parts)).count() == 0


def test_one_month_is_dealt_to_all_groups(spark):
    fact = spark.range(2000).selectExpr("concat('K', id % 97) as key", "3 as month", "id")
    dim = spark.range(97).selectExpr("concat('K', id) as key", "id as value")
    dealt = join_dealt(fact, dim, Dealing.of(fact.select("key", "month"), "key", F.col("month"), 12, 48))
    sizes = [r["count"] for r in dealt.groupBy(PART).count().collect()]
    assert len(sizes) >= 40 and max(sizes) < 200 and dealt.where("value is null").count() == 0


@pytest.mark.parametrize("twice", [False, True])
def test_a_layout_of_many_routes_moves_rows_once_for_routes_and_months(spark, tmp_path, no_broadcast, monkeypatch, twice):  # noqa: F811
    tickets = spark.createDataFrame(
        [*LAID_TICKETS, *[(f"U{i}", "1", "F3", f"R{i % 5}", f"2020-{i % 12 + 1:02d}-03 10:00:00", "E", float(i), 1.0, 1.0, 2.0) for i in range(60)]],
        "ticket_id string, passenger_id string, flight_id string, route_code string, departure string, class string, price double, airport_tax double, local_tax double, total_amount double",
    )
    routes = spark.createDataFrame([*LAID_ROUTES, *[("R1 ", "B", "B", 5.0, 5.0)] * twice], "route_code string, origin string, destination string, distance double, flight_minutes double")
    airports = spark.createDataFrame(LAID_AIRPORTS, "iata_code string, airport string, city string, country string, continent string")
    passengers = spark.createDataFrame([("1", "F", dt.date(1990, 5, 1), "X", " vip "), ("2", "M", None, "Y", None)], "id string, gender string, birth_date date, country string, vipcard string")
    monkeypatch.setattr("aeromart.operators.facts.MAX_ROWS_HELD", 3)
    dim = build_route_dimension(routes, airports)
    whole = build_tickets_enriched(tickets, dim, passengers)
    rows, widen = tickets_to_lay_out(tickets, dim, routes, airports, passengers)
    text = plan(rows)
    assert "SortMergeJoin [route_code" in text and text.count("shufflepartitionidpassthrough") == 2
    pq.write_fact(rows, str(tmp_path / "fact"), widen)
    got = pq.read_dataset(spark, str(tmp_path / "fact"))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in whole.schema]
    assert rows_of(got) == rows_of(whole) and got.count() >= 66
    # a file has one month, its rows by route: nothing was moved after the join
    raw = spark.read.parquet(str(tmp_path / "fact")).select(F.input_file_name().alias("f"), "by_month", F.monotonically_increasing_id().alias("i"), F.coalesce("route_code", F.lit("")).alias("r"))
    files = {}
    for r in sorted(raw.collect(), key=lambda x: x["i"]):
        files.setdefault(r["f"], []).append(r["r"])
    assert all(f == sorted(f) for f in files.values())
    pq.write_fact(rows.where("false"), str(tmp_path / "none"), widen)
    assert pq.read_dataset(spark, str(tmp_path / "none")).columns == whole.columns


@pytest.mark.parametrize("held, groups", [(50_000, 32), (100, 32), (100, 1)])
def test_colocated_facts_deal_own_columns_once_by_flight(spark, no_broadcast, monkeypatch, held, groups):  # noqa: F811
    """Few routes; many, met where tickets are dealt; many, for more groups than are worth it."""
    monkeypatch.setattr("aeromart.operators.facts.MAX_ROWS_HELD", held)
    monkeypatch.setattr(colocated, "MOST_GROUPS", groups)
    written, write = {}, colocated.write_table

    def seen(df, schema, table, *rest):
        written[table] = df
        return write(df, schema, table, *rest)

    monkeypatch.setattr(colocated, "write_table", seen)
    p = Prepared.of(spark, "/root/testdata/sf0.001")
    facts = colocated.prepare_colocated(spark, p.src, f"test_{uuid.uuid4().hex[:8]}", 9, 2026, shared_scratch_path(spark, "dealt"))
    moved = written["tickets_enriched"]
    assert not {"origin_city", "destination_airport", "route_label", "tax_share", "age_band"} & set(moved.columns)
    assert (PART in moved.columns) == (held == 100 and groups == 32)
    if PART in moved.columns:
        text = plan(moved)
        assert "hashpartitioning(route_code" not in text and text.count("shufflepartitionidpassthrough") == 2
    assert facts["tickets_enriched"].columns == p.tickets.columns
    assert rows_of(facts["tickets_enriched"]) == rows_of(p.tickets.select("*"))
    totals = plan(ticket_totals_by_flight(facts["tickets_enriched"]))
    assert "Exchange" not in totals and "SelectedBucketsCount: 9 out of 9" in totals
    assert rows_of(facts["flights_enriched"].select("flight_id", "tickets_sold", "route_label")) == rows_of(p.flights.select("flight_id", "tickets_sold", "route_label"))


@pytest.mark.parametrize("parts, most", [(1, 64), (40, 64), (40, 3)])
def test_one_move_serves_two_dimensions(spark, monkeypatch, no_broadcast, parts, most):  # noqa: F811
    monkeypatch.setattr("aeromart.operators.dealing.MOST_RANGES", most)
    # hot, unmatched and null keys of both
    fact = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'K7', if(id % 31 = 0, null, concat('K', id % 50))) as key", "if(id % 4 = 0, 'P1', if(id % 37 = 0, null, concat('P', id % 700))) as who", "cast(id % 1500 as string) as payload"
    )
    dim = spark.createDataFrame([*[(f"K{i}", i) for i in range(40)], ("K7", 700), (None, -1)], "key string, value int")
    people = spark.createDataFrame([*[(f"P{i}", i) for i in range(600)], ("P1", 700), (None, -1)], "who string, age int")
    dealing = Dealing.of(fact.select("key", key_group("who")), "key", key_group("who"), 6 if parts > 1 else 1, parts)
    both = join_dealt(join_dealt_group(fact, people, dealing, "who"), dim, dealing)
    assert rows_of(both.drop(PART)) == rows_of(join_dimension(join_dimension(fact, people, "who"), dim, "key"))
    if parts > 1:
        text = plan(both)
        assert text.count("Exchange") == 3 == text.count("shufflepartitionidpassthrough")


@pytest.mark.parametrize("held", [24, 30])
def test_the_whole_fact_meets_many_passengers_and_routes_in_one_move(spark, no_broadcast, monkeypatch, held):  # noqa: F811
    monkeypatch.setattr("aeromart.operators.facts.MAX_ROWS_HELD", held)
    p = Prepared.of(spark, "/root/testdata/sf0.001")
    assert p.src["airports"].count() == 25 and min(p.src[t].count() for t in ("routes", "passengers")) > 30
    dealt = tickets_enriched_dealt(p.src["tickets"], p.route_dim, p.src["routes"], p.src["airports"], p.src["passengers"])
    text = plan(dealt)
    moved = text.count("shufflepartitionidpassthrough")
    # too many airports to hold: the plain joins
    assert (moved, "hashpartitioning(passenger_id" in text) == ((3, False) if held == 30 else (0, True))
    assert [(f.name, f.dataType) for f in dealt.schema] == [(f.name, f.dataType) for f in p.tickets.schema]
    assert rows_of(dealt) == rows_of(p.tickets.select("*"))
