"""Plan shape: pruning and pushdown reach the scan, no side is hinted, plans
are built without jobs, aggregates are partial + final, and no Python runs
in any registered query."""

import pytest

from aeromart.operators import filters, marts
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import build_flights_enriched, build_tickets_enriched
from aeromart.operators.joins import join_dimension
from aeromart.plans.registry import QUERIES, Prepared

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def p(spark):
    return Prepared.of(spark, SF)


def test_no_python_in_any_registered_query(spark):
    for name, fn in QUERIES.items():
        text = plan(fn(spark, SF))
        for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
            assert marker not in text, (name, marker)


def test_filter_and_projection_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    sliced = filters.filter_tickets(df.withColumnRenamed("l_shipdate", "departure_date"), start_date="1996-01-01")
    text = plan(sliced.select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_a_dimension_that_grew_is_not_broadcast(spark, tmp_path):
    fact = spark.range(100).withColumnRenamed("id", "k")
    path = str(tmp_path / "dim")
    spark.range(10).selectExpr("id as k", "id as v").write.parquet(path)
    small = join_dimension(fact, spark.read.parquet(path), "k")
    assert "BroadcastHashJoin" in plan(small)
    spark.range(2_000_000).selectExpr("id as k", "rand() as v").write.mode("overwrite").parquet(path)
    large = join_dimension(fact, spark.read.parquet(path), "k", how="left")
    assert "BroadcastHashJoin" not in plan(large)


def test_a_dimension_of_long_texts_is_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "wide")
    long_text = "array_join(transform(sequence(1, 9000), i -> cast(rand() as string)), '')"
    spark.range(400).selectExpr("id as k", f"{long_text} as v").write.parquet(path)
    joined = join_dimension(spark.range(10).withColumnRenamed("id", "k"), spark.read.parquet(path), "k")
    assert "BroadcastHashJoin" not in plan(joined)


def test_plans_are_built_without_jobs(spark, p):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        dim = build_route_dimension(p.src["routes"], p.src["airports"])
        tickets = build_tickets_enriched(p.src["tickets"], dim)
        build_flights_enriched(p.src["flights"], dim, p.src["airplanes"], tickets, 2026)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_fact_is_narrow_when_it_meets_the_passengers(p):
    """Passengers come before routes: no route column is below their join."""
    tree = p.tickets._jdf.queryExecution().optimizedPlan().toString()
    below = tree[tree.index("passenger_id") :]
    joins = [i for i, line in enumerate(tree.splitlines()) if "Join LeftOuter" in line]
    assert "route_code" in tree.splitlines()[joins[0]] and "passenger_id" in tree.splitlines()[joins[1]], below


def test_no_join_of_the_fact_carries_derived_columns(spark, p):
    tree = p.tickets._jdf.queryExecution().optimizedPlan().toString()
    first_join = tree.index("Join LeftOuter")
    for column in ("cabin_class", "tax_share", "ticket_departure", "departure_month", "departure_year"):
        assert f"AS {column}#" not in tree[first_join:]
    dim = p.route_dim.selectExpr("*", "1 as tax_share", "2 as price", "3 as departure_year")
    columns = build_tickets_enriched(p.src["tickets"], dim).columns
    assert columns[: len(columns) - 3] == [c for c in columns if not c.endswith("_right")]
    assert columns[-3:] == ["tax_share_right", "price_right", "departure_year_right"]


def test_aggregates_are_partial_then_final(p):
    text = plan(marts.revenue_by_route(p.tickets))
    assert "partial_sum" in text and "partial_count" in text


def test_cabin_share_aggregates_the_tickets_once(p):
    text = plan(marts.cabin_mix(p.tickets))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Subquery" not in text
    assert text.count("lineitem.parquet") == plan(p.tickets).count("lineitem.parquet")
