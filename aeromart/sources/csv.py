"""CSV export of a result table (SNK2) and its read-back.

The export is a normal distributed write (one file per partition, with a
header each): a route summary grows with the route count, so it is not
funnelled through one task.  ``coalesce(1)`` is offered only for results
the caller knows to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str) -> str:
    out = df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back with an explicit schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)
