"""Fact-to-dimension joins.

Every join in the reference is a left outer equi-join of a fact onto a
dimension.  No side is hinted here (``facts.tickets_to_move`` counts
its airports and routes and hints by that): a dimension is broadcast when Spark knows,
from file statistics or from a finished shuffle (AQE), that it is below
``spark.sql.autoBroadcastJoinThreshold``; else the join sorts and merges,
and AQE splits skewed fact partitions (``spark.sql.adaptive.skewJoin``).
A plan is built without running a job.

``known_unique`` is the exception: one job tells whether a dimension's key
repeats.  Where it does not, Spark leaves out a join whose columns nobody
reads, so a fold of the fact shuffles it for its own dimensions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    suffix: str = "_right",
) -> DataFrame:
    """Left-join ``dim`` onto ``fact`` keeping the fact's column order.

    Output columns: all fact columns, then the dimension's non-key
    columns; a dimension column whose name already exists on the fact
    side gets ``suffix`` (N18).  Duplicate dimension keys multiply fact
    rows, as an equi-join does (N12).
    """
    keys = [on] if isinstance(on, str) else list(on)
    fact_cols = set(fact.columns)
    renames = {c: f"{c}{suffix}" for c in dim.columns if c not in keys and c in fact_cols}
    if renames:
        dim = dim.withColumnsRenamed(renames)
    dim_payload = [c for c in dim.columns if c not in keys]
    return fact.join(dim, on=keys, how=how).select(*fact.columns, *dim_payload)


def known_unique(dim: DataFrame, key: str) -> DataFrame:
    """``dim`` with a key that Spark's optimizer knows to be unique, if it is
    (rows without a key join nothing and don't count); else ``dim`` as it is,
    whose repeated keys multiply fact rows (N12)."""
    keys = dim.select(key).where(F.col(key).isNotNull())
    repeated = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    return dim.dropDuplicates([key]) if repeated.isEmpty() else dim
