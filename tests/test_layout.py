"""Catalog tables, co-located facts and the layout of written facts."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import build_tickets_enriched, ticket_totals_by_flight, tickets_to_lay_out
from aeromart.operators.filters import filter_tickets
from aeromart.plans.colocated import prepare_colocated, stage_sources
from aeromart.plans.registry import Prepared
from aeromart.session import shared_scratch_path
from aeromart.sources import catalog
from aeromart.sources import parquet as pq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def p(spark):
    return Prepared.of(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def schema(spark):
    name = f"test_{uuid.uuid4().hex[:8]}"
    catalog.create_schema(spark, name, shared_scratch_path(spark, "test-schema"))
    return name


# ------------------------------------------------------------------ catalog
def test_catalog_lists_reads_and_estimates(spark, schema):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "Id int, `Some Name` string")
    catalog.write_table(df, schema, "things")
    assert "things" in catalog.list_tables(spark, schema)
    assert catalog.list_columns(spark, schema, "things") == ["Id", "Some Name"]
    catalog.analyse_table(spark, schema, "things")
    assert catalog.estimate_table_rows(spark, schema, "things") == 3
    assert catalog.read_table(spark, schema, "things").columns == ["id", "some_name"]
    assert catalog.read_table(spark, schema, "things", ["SOME_NAME", "gone"]).columns == ["some_name"]
    with pytest.raises(ValueError, match="none of the wanted"):
        catalog.read_table(spark, schema, "things", ["gone"])
    with pytest.raises(RuntimeError, match="AIRPORTS"):
        catalog.read_project_tables(spark, schema)
    with pytest.raises(ValueError, match="Unsafe"):
        catalog.list_columns(spark, schema, "x` y")


def test_a_table_without_statistics_has_no_estimate(spark, schema):
    path = shared_scratch_path(spark, "unknown")
    spark.range(5).write.parquet(path)
    spark.sql(f"CREATE TABLE {schema}.unknown (id BIGINT) USING parquet LOCATION '{path}'")
    assert catalog.estimate_table_rows(spark, schema, "unknown") is None
    assert catalog.read_table(spark, schema, "unknown").count() == 5


def test_views_are_no_tables(spark, schema):
    spark.sql(f"CREATE VIEW {schema}.seen AS SELECT 1 AS x")
    assert "seen" not in catalog.list_tables(spark, schema)


# ------------------------------------------------------------------ co-located facts
def test_joins_and_totals_leave_bucketed_facts_where_they_are(spark, p, no_broadcast):
    name = f"test_{uuid.uuid4().hex[:8]}"
    facts = prepare_colocated(spark, p.src, name, 4, 2026, shared_scratch_path(spark, "colocated"))
    totals = plan(ticket_totals_by_flight(facts["tickets_enriched"]))
    assert "Exchange" not in totals and "SelectedBucketsCount: 4 out of 4" in totals
    flights = plan(facts["flights_enriched"])
    assert "SortMergeJoin [flight_id" in flights and "hashpartitioning(flight_id" not in flights
    # the same from facts that are not laid out moves both sides
    assert "hashpartitioning(flight_id" in plan(p.flights)
    tickets, passengers = (spark.table(f"{name}.{t}") for t in ("tickets", "passengers"))
    joined = plan(tickets.join(passengers, F.col("passenger_id") == F.col("id"), "left"))
    assert "SortMergeJoin" in joined and "Exchange" not in joined
    a = {r["flight_id"]: r["tickets_sold"] for r in facts["flights_enriched"].collect()}
    b = {r["flight_id"]: r["tickets_sold"] for r in p.flights.select("*").collect()}
    assert a == b


def test_staged_tables_are_clean_and_whole(spark, schema):
    raw = {
        "tickets": spark.createDataFrame([(" 7 ", " T1"), (None, "T2"), ("8", "T3 ")], "passenger_id string, ticket_id string"),
        "routes": spark.createDataFrame([("R1",)], "route_code string"),
    }
    staged = stage_sources(raw, schema, 2, shared_scratch_path(spark, "staged"))
    assert sorted(map(tuple, staged["tickets"].select("passenger_id", "ticket_id").collect()), key=str) == [("7", "T1"), ("8", "T3"), (None, "T2")]
    assert staged["routes"] is raw["routes"] and set(staged) == set(raw)


# ------------------------------------------------------------------ layout
@pytest.fixture(scope="module")
def by_month(spark, p):
    path = shared_scratch_path(spark, "by-month")
    pq.write_fact(p.tickets, path)
    return path


def test_a_month_slice_lists_one_folder(spark, p, by_month):
    fact = pq.read_dataset(spark, by_month)
    month = filter_tickets(fact, dt.date(1996, 3, 1), dt.date(1996, 3, 31))
    text = plan(month)
    assert re.search(r"PartitionFilters: \[[^\]]*by_month", text)
    files = {f for f in month.inputFiles()}
    listed = {r["f"] for r in month.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) > len(listed) and {f.split("by_month=")[1][:7] for f in listed} == {"1996-03"}
    want = p.tickets.where("departure_date between date'1996-03-01' and date'1996-03-31'")
    assert month.count() == want.count() > 0


def test_a_written_fact_reads_as_it_was(spark, p, by_month):
    fact = pq.read_dataset(spark, by_month)
    assert [(f.name, f.dataType) for f in fact.schema] == [(f.name, f.dataType) for f in p.tickets.schema]
    assert sorted(map(str, fact.collect())) == sorted(map(str, p.tickets.select("*").collect()))


def test_files_hold_few_routes(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("id", "concat('R', lpad(cast(id % 100 as string), 2, '0')) as route_code", "concat('2020-0', 1 + id % 2) as departure_month")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pq.write_fact(rows, str(tmp_path / "fact"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spans = spark.read.parquet(str(tmp_path / "fact")).groupBy(F.input_file_name()).agg(F.count_distinct("route_code").alias("n")).collect()
    assert len(spans) >= 4 and max(r["n"] for r in spans) <= 30


def test_months_that_are_null_or_of_other_lengths_stay_right(spark, tmp_path):
    rows = spark.createDataFrame(
        [(dt.date(1996, 3, 5), "1996-03"), (dt.date(1996, 4, 5), "1996-04"), (None, None), (dt.date(1996, 3, 6), "+10000-01")], "departure_date date, departure_month string"
    )
    for df in (rows, None):
        if df is None:
            pq.write_fact(rows, str(tmp_path / "odd"))
            df = pq.read_dataset(spark, str(tmp_path / "odd"))
        got = filter_tickets(df, "1996-03-01", dt.datetime(1996, 3, 31))
        assert sorted(r["departure_month"] for r in got.collect()) == ["+10000-01", "1996-03"]
        assert filter_tickets(df).count() == 4
    pq.write_fact(rows.where("false"), str(tmp_path / "none"))
    assert pq.read_dataset(spark, str(tmp_path / "none")).count() == 0


def test_rows_of_a_file_lie_by_route(spark, by_month):
    at = F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    rows = spark.read.parquet(by_month).select(at.alias("at"), F.coalesce("route_code", F.lit("")).alias("r")).collect()
    files = {}
    for row in sorted(rows, key=lambda x: x["at"]["i"]):
        files.setdefault(row["at"]["f"], []).append(row["r"])
    assert max(len(set(f)) for f in files.values()) > 2
    assert all(f == sorted(f) for f in files.values())


LAID_ROUTES = [("R1", "A", "B", 100.0, 60.0), ("R2", "B", "A", None, None), ("R3", None, "C", 5.0, 0.0), (None, "A", "A", 7.0, 7.0)]
LAID_AIRPORTS = [("A", "Aa", "City", "X", "Europe"), ("B", "Bb", None, "Y", "Asia"), ("A", "Aa", "Other", "X", "Europe"), (None, "Cc", "None", "Z", "Asia")]
LAID_TICKETS = [
    ("T1", "1", "F1", "R1", "2020-01-02 10:00:00", "econ", 10.0, 1.0, None, 11.0),
    ("T2", "1", "F1", " R2", "2020-02-02 10:00:00", "Bus", 20.0, None, 2.0, 0.0),
    ("T2", "1", "F1", " R2", "2020-02-02 10:00:00", "Bus", 20.0, None, 2.0, 0.0),
    ("T3", "2", "F1", "R9", None, None, 30.0, 3.0, 1.0, None),
    ("T4", "9", "F2", None, "2021-01-02 10:00:00", "first", 40.0, 3.0, 1.0, 44.0),
    (None, None, None, "R3", "2021-01-02 10:00:00", "E", 50.0, float("nan"), 1.0, 51.0),
]


@pytest.mark.parametrize("case", ["plain", "repeated keys", "no passengers", "clash", "many airports"])
def test_a_layout_moves_own_columns_only(spark, tmp_path, no_broadcast, monkeypatch, case):
    twice = case == "repeated keys"
    tickets = spark.createDataFrame(
        LAID_TICKETS,
        "ticket_id string, passenger_id string, flight_id string, route_code string, departure string, class string, price double, airport_tax double, local_tax double, total_amount double",
    )
    routes = spark.createDataFrame([*LAID_ROUTES, *[("R1 ", "B", "B", 5.0, 5.0)] * twice], "route_code string, origin string, destination string, distance double, flight_minutes double")
    airports = spark.createDataFrame(LAID_AIRPORTS, "iata_code string, airport string, city string, country string, continent string")
    passengers = spark.createDataFrame(
        [("1", "F", "1990-05-01", "X", " vip "), ("2", "M", None, "Y", None), *[(" 1", "M", "2001-01-01", "Z", "N")] * twice],
        "id string, gender string, birth_date string, country string, vipcard string",
    )
    passengers = None if case == "no passengers" else passengers
    if case == "clash":
        routes = routes.withColumn("class", F.lit("long"))
    if case == "many airports":
        monkeypatch.setattr("aeromart.operators.facts.MAX_ROWS_HELD", 1)
    dim = build_route_dimension(routes, airports)
    whole = build_tickets_enriched(tickets, dim, passengers)
    rows, widen = tickets_to_lay_out(tickets, dim, routes, airports, passengers)
    assert (widen is None) == (case in ("clash", "many airports"))
    if widen:
        assert not {"origin_city", "destination_airport", "route_label", "tax_share", "age_band"} & set(rows.columns)
        moved = plan(widen(rows.repartitionByRange("departure_month", "route_code")))
        top = moved[: moved.index("rangepartitioning")]
        assert top.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in top
    pq.write_fact(rows, str(tmp_path / "fact"), widen)
    got = pq.read_dataset(spark, str(tmp_path / "fact"))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in whole.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() >= 6
    pq.write_fact(rows.where("false"), str(tmp_path / "none"), widen)
    assert pq.read_dataset(spark, str(tmp_path / "none")).columns == whole.columns


def test_many_routes_are_merged_however_small_their_file(spark, p, monkeypatch):
    def join_of_routes():
        return plan(tickets_to_lay_out(p.src["tickets"], p.route_dim, p.src["routes"], p.src["airports"])[0])

    assert "BroadcastHashJoin [route_code" in join_of_routes()
    monkeypatch.setattr("aeromart.operators.facts.MAX_ROWS_HELD", 100)
    assert p.src["airports"].count() <= 100 < p.src["routes"].count() and "SortMergeJoin [route_code" in join_of_routes()
