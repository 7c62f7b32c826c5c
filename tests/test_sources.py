"""Sources and sinks: names, identifiers, Parquet folders, CSV, JDBC SQL text, the job."""

import datetime as dt
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from aeromart.operators.summaries import ticket_summary
from aeromart.sources import csv as csv_io
from aeromart.sources import jdbc
from aeromart.sources import parquet as pq
from aeromart.sources.naming import normalize_column_names, snake_case, validate_identifier
from tests import reference_data as R


def test_snake_case():
    assert snake_case("  Ticket ID ") == "ticket_id"
    assert snake_case("TOTAL-AMOUNT(€)") == "total_amount"
    assert snake_case("__A__b__") == "a_b"


def test_normalize_column_names_rejects_clashes(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a-B` int")
    with pytest.raises(ValueError, match="a_b"):
        normalize_column_names(df)
    assert normalize_column_names(spark.createDataFrame([(1,)], "`Route Code` int")).columns == ["route_code"]


def test_validate_identifier():
    assert validate_identifier(" ops_data ") == "OPS_DATA"
    for bad in ["1ABC", "A-B", "A;DROP", "", "a b"]:
        with pytest.raises(ValueError):
            validate_identifier(bad)


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="aeromart-src-")
    tickets = R.tickets(spark).toDF(*[c.upper() for c in R.tickets(spark).columns])
    tickets.write.parquet(f"{path}/tickets.parquet")
    for name, df in {"routes": R.routes(spark), "airports": R.airports(spark), "flights": R.flights(spark),
                     "airplanes": R.airplanes(spark)}.items():
        df.write.parquet(f"{path}/{name}.parquet")
    R.routes(spark).write.parquet(f"{path}/passengers_missing_here")
    return path


def test_list_tables_columns_counts(spark, folder):
    assert pq.list_tables(spark, folder) == ["airplanes", "airports", "flights", "passengers_missing_here", "routes", "tickets"]
    assert pq.list_columns(spark, folder, "routes")[:2] == ["route_code", "origin"]
    counts = {r["table_name"]: r["row_count"] for r in pq.table_row_counts(spark, folder).collect()}
    assert counts["tickets"] == 3 and counts["routes"] == 2
    assert pq.estimate_table_rows(spark, folder, "routes") == 2
    assert pq.estimate_table_rows(spark, folder, "nope") is None


def test_read_table_selects_existing_in_request_order(spark, folder):
    df = pq.read_table(spark, folder, "tickets", ["PRICE", "NOT_THERE", "TICKET_ID"])
    assert df.columns == ["price", "ticket_id"]
    assert pq.read_table(spark, folder, "routes").columns == sorted(R.routes(spark).columns)
    with pytest.raises(ValueError):
        pq.read_table(spark, folder, "routes", ["NOPE"])


def test_read_project_tables_reports_missing(spark, folder):
    with pytest.raises(RuntimeError, match="PASSENGERS"):
        pq.read_project_tables(spark, folder)


def test_summary_tables_from_folder(spark, folder):
    tables = pq.read_project_summary_tables(spark, folder)
    assert set(tables) == {"routes", "airports", "flights", "airplanes", "ticket_summary", "ticket_by_flight"}
    assert tables["ticket_summary"].count() == 3


def test_prepared_round_trip(spark):
    out = tempfile.mkdtemp(prefix="aeromart-out-")
    with pytest.raises(FileNotFoundError, match="tickets_enriched.parquet"):
        pq.load_prepared_data(spark, out)
    pq.write_prepared_datasets({"tickets_enriched": R.tickets(spark), "flights_enriched": R.flights(spark)}, out)
    loaded = pq.load_prepared_data(spark, out)
    assert set(loaded) == {"tickets_enriched", "flights_enriched"}
    assert loaded["tickets_enriched"].count() == 3
    files = os.listdir(f"{out}/tickets_enriched.parquet")
    assert any(f.endswith(".zstd.parquet") for f in files)


def test_csv_round_trip(spark):
    out = tempfile.mkdtemp(prefix="aeromart-csv-") + "/routes"
    df = R.routes(spark)
    csv_io.write_csv(df, out)
    back = csv_io.read_csv(spark, out, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_jdbc_summary_sql_text():
    sql = jdbc.ticket_summary_sql("ops_data")
    assert '"OPS_DATA"."TICKETS"' in sql
    assert "WHEN UPPER(TRIM(\"CLASS\")) IN ('E', 'ECON', 'ECONOMY') THEN 'ECONOMY'" in sql
    assert "VARCHAR_FORMAT(\"DEPARTURE\", 'YYYY-MM')" in sql
    assert "SUBSTR(CAST(\"DEPARTURE\" AS VARCHAR(26)), 1, 7)" in jdbc.ticket_summary_sql("S", "ansi")
    assert jdbc.ticket_by_flight_sql("s").startswith('SELECT "FLIGHT_ID", COUNT(*)')
    with pytest.raises(ValueError):
        jdbc.ticket_summary_sql("x; drop table t")


def test_jdbc_column_selection():
    assert jdbc.select_columns(["B", "a", "C"], ["c", "missing", "a"]) == ["C", "A"]
    assert jdbc.select_columns(["B", "A"], None) == ["A", "B"]
    with pytest.raises(ValueError):
        jdbc.select_columns(["A"], ["B"])


def test_jdbc_catalog_queries_use_validated_names():
    src = jdbc.JdbcSource(url="jdbc:unused", schema="ops_data")
    assert "TABSCHEMA = 'OPS_DATA'" in jdbc._catalog_query(src, 0)
    assert "TABNAME = 'TICKETS'" in jdbc._catalog_query(src, 1, "tickets")
    assert jdbc._catalog_query(jdbc.JdbcSource("u", "s", dialect="ansi"), 2, "t") is None


def test_summary_grain_matches_sql_semantics(spark):
    t = R.tickets(spark).withColumn("total_amount", F.when(F.col("ticket_id") == "T3", None).otherwise(F.col("total_amount")))
    cells = {(r["route_code"], r["cabin_class"]): r.asDict() for r in ticket_summary(t).collect()}
    assert cells[("R2", "ECONOMY")]["revenue"] is None          # SQL sum over no value
    assert cells[("R2", "ECONOMY")]["tax_share_sum"] is None
    assert cells[("R2", "ECONOMY")]["tax_amount"] == 13.0
    assert cells[("R1", "ECONOMY")]["departure_date"].isoformat() == "2026-01-01"


def test_job_on_test_tables(spark):
    from aeromart.plans import job

    out = tempfile.mkdtemp(prefix="aeromart-job-")
    job.main(["--source", "testdata", "--input", "/root/testdata/sf0.001", "--output", out, "--as-of-year", "2026"])
    names = sorted(p for p in os.listdir(out) if p.endswith(".parquet"))
    assert names == sorted(f"{n}.parquet" for n in [
        "route_dimension", "tickets_enriched", "flights_enriched", "revenue_by_month", "revenue_by_route",
        "route_efficiency", "fleet_utilization", "passenger_segments", "tax_by_route"])
    text = "".join(r["value"] + "\n" for r in spark.read.text(f"{out}/generated_findings.md").collect())
    assert text.startswith("# Generated Findings") and "- Top revenue route is" in text
    cells = spark.read.parquet(f"{out}/tickets_enriched.parquet")
    assert "tickets" in cells.columns and "tax_share" in cells.columns


def test_job_partition_option():
    from aeromart.plans.job import parse_args, parse_partitioning

    args = parse_args(["--source", "jdbc", "--url", "jdbc:x", "--schema", "S", "--output", "x",
                       "--partition", "tickets=TICKET_ID:64", "--partition", "FLIGHTS=FLIGHT_ID:8"])
    assert parse_partitioning(args.partition) == {
        "TICKETS": {"partition_column": "TICKET_ID", "num_partitions": 64},
        "FLIGHTS": {"partition_column": "FLIGHT_ID", "num_partitions": 8},
    }
    with pytest.raises(ValueError):
        parse_partitioning(["TICKETS=ID"])
    for bad in (["--source", "parquet", "--output", "x"], ["--source", "jdbc", "--output", "x"]):
        with pytest.raises(SystemExit):
            parse_args(bad)


def test_jdbc_reads_of_large_tables_need_ranges():
    from aeromart.sources import jdbc

    with pytest.raises(ValueError, match="TICKETS, FLIGHTS"):
        jdbc.require_ranges(["TICKETS", "FLIGHTS", "ROUTES"], {})
    given = {"partition_column": "DEPARTURE", "num_partitions": 4}
    jdbc.require_ranges(["TICKETS", "ROUTES"], {"TICKETS": given})


def test_jdbc_ranges_have_equally_many_rows():
    sql = jdbc.split_points_sql('"S"."TICKETS"', "departure", 8)
    assert 'NTILE(8) OVER (ORDER BY "DEPARTURE")' in sql and 'WHERE "DEPARTURE" IS NOT NULL' in sql and "GROUP BY TILE" in sql
    assert jdbc.range_predicates("ID", [1, 5, 9]) == ['("ID" < 5 OR "ID" IS NULL)', '"ID" >= 5 AND "ID" < 9', '"ID" >= 9']
    # a hot value that is the first of several tiles makes one range
    assert jdbc.range_predicates("ID", [1, 5, 5, 5, 9]) == jdbc.range_predicates("ID", [1, 5, 9])
    assert jdbc.range_predicates("ID", []) == jdbc.range_predicates("ID", [7, 7]) == ["1 = 1"]
    days = jdbc.range_predicates("DAY", [dt.date(2026, 1, 1), dt.date(2026, 2, 1)])
    assert days == ["(\"DAY\" < DATE '2026-02-01' OR \"DAY\" IS NULL)", "\"DAY\" >= DATE '2026-02-01'"]
    assert jdbc.literal("O'Hare") == "'O''Hare'" and jdbc.literal(dt.datetime(2026, 1, 2, 3)) == "TIMESTAMP '2026-01-02 03:00:00.000000'"
    for bad in (None, True):
        with pytest.raises(ValueError):
            jdbc.literal(bad)
    with pytest.raises(ValueError):
        jdbc.range_predicates('X" OR 1=1 --', [1, 2])


def test_every_value_is_in_one_range():
    duck = duckdb.connect()
    points = [2, 4, 4, 7]
    conditions = jdbc.range_predicates("K", points)
    values = duck.execute('SELECT UNNEST([NULL, -1, 2, 3, 4, 5, 6, 7, 8]) AS "K"').df()  # noqa: F841
    for c in conditions:
        assert duck.execute(f"SELECT count(*) FROM values WHERE {c}").fetchall()[0][0] > 0
    total = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions)
    assert duck.execute(f"SELECT min({total}), max({total}) FROM values").fetchall() == [(1, 1)]


def test_summaries_by_flight_are_cut_below_the_grouping():
    queries = jdbc.ticket_by_flight_queries("s", ["F1", "F5", "F7"])
    assert len(queries) == 3
    for q in queries:
        assert q.index(" WHERE ") < q.index(" GROUP BY ") and q.endswith('GROUP BY "FLIGHT_ID"')
    assert "WHERE (\"FLIGHT_ID\" < 'F5' OR \"FLIGHT_ID\" IS NULL) GROUP BY" in queries[0]
    # an empty table has no split point: one query, which finds no row
    assert jdbc.ticket_by_flight_queries("s", []) == [jdbc.ticket_by_flight_sql("s", "1 = 1")]


def test_range_queries_give_the_rows_of_the_whole(spark):
    """The queries as SQL text over the test tables, in a database of this process."""
    duck = duckdb.connect()
    duck.execute('CREATE SCHEMA "S"')
    duck.execute("""CREATE TABLE "S"."TICKETS" AS SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN 'F0' ELSE 'F' || l_orderkey END AS "FLIGHT_ID",
        l_extendedprice AS "TOTAL_AMOUNT" FROM '/root/testdata/sf0.001/lineitem.parquet'""")
    points = [r[0] for r in duck.execute(jdbc.split_points_sql('"S"."TICKETS"', "FLIGHT_ID", 16)).fetchall()]
    queries = jdbc.ticket_by_flight_queries("s", points)
    assert 8 < len(queries) <= 16
    parts = [sorted(map(str, duck.execute(q).fetchall())) for q in queries]
    whole = sorted(map(str, duck.execute(jdbc.ticket_by_flight_sql("s")).fetchall()))
    assert sorted(sum(parts, [])) == whole
    sizes = [sum(r[1] for r in duck.execute(q).fetchall()) for q in queries]
    assert sorted(sizes)[-2] < 3 * sorted(sizes)[len(sizes) // 2]  # but for the range of the hot flight


def test_job_from_a_parquet_source_folder(spark):
    """SRC1/SRC4/SRC5 end to end: the six tables as upper-case Parquet
    tables (as a database export would name them), both grains."""
    from aeromart.plans import job
    from aeromart.sources.fixtures import airline_tables

    src = tempfile.mkdtemp(prefix="aeromart-srcfolder-")
    for name, df in airline_tables(spark, "/root/testdata/sf0.001").items():
        df.toDF(*[c.upper() for c in df.columns]).write.parquet(f"{src}/{name}.parquet")
    for flag in ([], ["--raw-tickets"]):
        out = tempfile.mkdtemp(prefix="aeromart-jobout-")
        job.main(["--source", "parquet", "--input", src, "--output", out, "--as-of-year", "2026", *flag])
        prepared = pq.load_prepared_data(spark, out)
        routes = prepared["revenue_by_route"]
        assert routes.count() == 198
        total = routes.groupBy().sum("tickets").first()[0]
        assert total == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
        assert ("tickets_sold" in prepared["flights_enriched"].columns)
