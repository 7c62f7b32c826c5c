"""Tables of Spark's catalog as sources and sinks (SRC1, SRC4, SRC6-SRC8).

A schema of the session's catalog plays the role of the relational schema.
Row estimates come from what ``ANALYZE TABLE`` has recorded, so asking for
one reads no data; a table that was never analysed has none.

Written tables can be bucketed: rows of one key are then in one bucket, and
joins and aggregates on the key leave the table where it is, as long as
both sides have as many buckets.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from aeromart.operators.dealing import PART
from aeromart.schemas import PROJECT_TABLES
from aeromart.sources.naming import check_tables, normalize_column_names, pick_columns, quoted


def create_schema(spark: SparkSession, schema: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(schema)}{place}")


def list_tables(spark: SparkSession, schema: str) -> list[str]:
    """SRC6: table names, ordered; views are left out."""
    return sorted(t.name for t in spark.catalog.listTables(schema) if t.tableType != "TEMPORARY" and t.tableType != "VIEW")


def list_columns(spark: SparkSession, schema: str, table: str) -> list[str]:
    """SRC7: column names in their order."""
    return spark.table(quoted(schema, table)).columns


def estimate_table_rows(spark: SparkSession, schema: str, table: str) -> int | None:
    """SRC8: rows by the catalog's statistics; None where it has none."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(schema, table)} AS JSON").first()[0]
    rows = json.loads(described).get("statistics", {}).get("num_rows")
    return None if rows is None else int(rows)


def analyse_table(spark: SparkSession, schema: str, table: str) -> None:
    """Record the table's number of rows in the catalog."""
    spark.sql(f"ANALYZE TABLE {quoted(schema, table)} COMPUTE STATISTICS")


def read_table(spark: SparkSession, schema: str, table: str, columns: Iterable[str] | None = None) -> DataFrame:
    """SRC1: requested columns that exist, in request order; all, sorted, when
    none are requested."""
    df = normalize_column_names(spark.table(quoted(schema, table)))
    return df.select(*pick_columns(df.columns, columns, f"{schema}.{table}"))


def read_project_tables(
    spark: SparkSession, schema: str, table_columns: Mapping[str, list[str]] | None = None
) -> dict[str, DataFrame]:
    """SRC4: every project table, lazily; a missing one is an error."""
    wanted = table_columns or PROJECT_TABLES
    names = check_tables(wanted, list_tables(spark, schema), schema)
    return {table.lower(): read_table(spark, schema, names[table], columns) for table, columns in wanted.items()}


def write_table(
    df: DataFrame,
    schema: str,
    table: str,
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
    location: str | None = None,
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Write ``df`` as a table, bucketed and sorted by ``bucket_by`` where it is
    given, and read it back.  Rows are dealt to their buckets first, so a
    bucket is one file; rows that come with their part (``dealing.PART``) stay
    where they are, and a bucket has a file for each part of its group.
    ``widen`` adds, row by row, columns that need not be dealt."""
    spark = df.sparkSession
    dealt, df = PART in df.columns, df.drop(PART)
    if bucket_by and not dealt:
        df = df.repartition(buckets, *bucket_by)
    df = widen(df) if widen else df
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(quoted(schema, table))
    return spark.table(quoted(schema, table))
