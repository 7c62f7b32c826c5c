"""A route holding a third of all tickets: the sort-merge path splits the
hot partition (AQE skew join) and gives the same result as the broadcast
path; the mart aggregates it map-side."""

import pytest
from pyspark.sql import functions as F

from aeromart.operators import marts
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.joins import join_dimension
from aeromart.sources.fixtures import airline_tables

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_route_is_split_and_results_agree(spark, skew_conf):
    src = airline_tables(spark, "/root/testdata/sf0.001")
    route_dim = build_route_dimension(src["routes"], src["airports"])
    # every third ticket goes to route R7
    hot = src["tickets"].withColumns(
        {
            "route_code": F.when(F.xxhash64("ticket_id", "price") % 3 == 0, F.lit("R7")).otherwise(F.col("route_code")),
            "tax_amount": F.coalesce("airport_tax", F.lit(0.0)) + F.coalesce("local_tax", F.lit(0.0)),
        }
    )
    share = hot.where("route_code = 'R7'").count() / hot.count()
    assert 0.3 < share < 0.4

    shuffled = join_dimension(hot, route_dim, "route_code")
    rows = shuffled.collect()
    final_plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in final_plan
    assert "SortMergeJoin(skew=true)" in final_plan and "AQEShuffleRead skewed" in final_plan

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10g")
    broadcast = join_dimension(hot, route_dim, "route_code")
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows) == sorted(broadcast.collect())

    per_route = {r["route_code"]: r["tickets"] for r in marts.revenue_by_route(shuffled).collect()}
    assert per_route["R7"] == hot.where("route_code = 'R7'").count()
