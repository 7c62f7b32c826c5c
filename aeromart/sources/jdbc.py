"""Relational sources over Spark's JDBC data source (SRC1-SRC8, SRC11).

The reference pulls rows through one client connection in fetch batches.
Here executors read in parallel: a table read can be split into
``num_partitions`` ranges of a column with about equally many rows each,
every range one task with its own connection and ``fetchsize``.  Column selection and
simple filters are pushed into the generated SQL by Spark; the two
ticket summaries are pushed as whole SQL aggregates (``query`` option),
so the database returns cells, not tickets.

Table and schema names are validated identifiers before they are placed
into SQL text (SRC11); there are no user values in the generated SQL.
"""

from __future__ import annotations

import datetime as dt
import functools
import itertools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from aeromart.functions.expressions import CABIN_SPELLINGS
from aeromart.schemas import PROJECT_TABLES, SUMMARY_DIMENSION_TABLES
from aeromart.sources.naming import check_tables, normalize_column_names, pick_columns, validate_identifier

DEFAULT_FETCH_SIZE = 100_000

# Catalog queries per dialect: table list, column list, row estimate.
_CATALOG = {
    "db2": (
        "SELECT TABNAME AS NAME FROM SYSCAT.TABLES WHERE TABSCHEMA = '{schema}' AND TYPE = 'T' ORDER BY TABNAME",
        "SELECT COLNAME AS NAME FROM SYSCAT.COLUMNS WHERE TABSCHEMA = '{schema}' AND TABNAME = '{table}' ORDER BY COLNO",
        "SELECT CARD AS ROWS_ESTIMATE FROM SYSCAT.TABLES WHERE TABSCHEMA = '{schema}' AND TABNAME = '{table}' AND TYPE = 'T'",
    ),
    "ansi": (
        "SELECT TABLE_NAME AS NAME FROM INFORMATION_SCHEMA.TABLES WHERE TABLE_SCHEMA = '{schema}' "
        "AND TABLE_TYPE = 'BASE TABLE' ORDER BY TABLE_NAME",
        "SELECT COLUMN_NAME AS NAME FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_SCHEMA = '{schema}' "
        "AND TABLE_NAME = '{table}' ORDER BY ORDINAL_POSITION",
        None,
    ),
}
# Year-month text of a timestamp column, per dialect.
_MONTH_TEXT = {
    "db2": "VARCHAR_FORMAT({c}, 'YYYY-MM')",
    "ansi": "SUBSTR(CAST({c} AS VARCHAR(26)), 1, 7)",
}

# Tables with a row a ticket or a flight.
LARGE_TABLES = ("TICKETS", "FLIGHTS")


@dataclass(frozen=True)
class JdbcSource:
    """Where and how to connect.  ``options`` carries ``user``,
    ``password``, ``driver`` and any other JDBC reader option; they are
    passed to Spark as given and never logged."""

    url: str
    schema: str
    options: Mapping[str, str] = field(default_factory=dict)
    dialect: str = "db2"

    def qualified(self, table: str) -> str:
        return f'"{validate_identifier(self.schema)}"."{validate_identifier(table)}"'


def reader(spark: SparkSession, source: JdbcSource, fetch_size: int = DEFAULT_FETCH_SIZE) -> DataFrameReader:
    # wall-time timestamps: dates do not depend on the session's zone
    r = spark.read.format("jdbc").option("url", source.url).option("preferTimestampNTZ", "true")
    for key, value in source.options.items():
        r = r.option(key, value)
    if fetch_size > 0:
        r = r.option("fetchsize", str(fetch_size))
    return r


def read_query(
    spark: SparkSession, source: JdbcSource, query: str, fetch_size: int = DEFAULT_FETCH_SIZE
) -> DataFrame:
    """SRC2: the database runs ``query``; columns come back snake_case."""
    return normalize_column_names(reader(spark, source, fetch_size).option("query", query).load())


def _catalog_query(source: JdbcSource, index: int, table: str | None = None) -> str | None:
    template = _CATALOG[source.dialect][index]
    if template is None:
        return None
    schema = validate_identifier(source.schema)
    return template.format(schema=schema, table=validate_identifier(table) if table else "")


def list_tables(spark: SparkSession, source: JdbcSource) -> list[str]:
    """SRC6: table names of the schema, ordered (a short list)."""
    rows = read_query(spark, source, _catalog_query(source, 0), 0).collect()
    return [str(r[0]).strip() for r in rows]


def list_columns(spark: SparkSession, source: JdbcSource, table: str) -> list[str]:
    """SRC7: column names in ordinal order."""
    rows = read_query(spark, source, _catalog_query(source, 1, table), 0).collect()
    return [str(r[0]).strip() for r in rows]


def estimate_table_rows(spark: SparkSession, source: JdbcSource, table: str) -> int | None:
    """SRC8: the catalog's row estimate; None when unknown or negative."""
    query = _catalog_query(source, 2, table)
    if query is None:
        return None
    rows = read_query(spark, source, query, 0).collect()
    if not rows or rows[0][0] is None or int(rows[0][0]) < 0:
        return None
    return int(rows[0][0])


def select_columns(available: list[str], columns: list[str] | None) -> list[str]:
    """The database's names of the columns to read (see ``pick_columns``)."""
    return pick_columns([validate_identifier(c) for c in available], columns, "the table")


def literal(value: object) -> str:
    """A value that came from the database, as an SQL literal."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"{value!r} can't be a split point")
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"DATE '{value:%Y-%m-%d}'"
    return "'" + str(value).replace("'", "''") + "'"


def split_points_sql(table: str, column: str, ranges: int) -> str:
    """The first value of each of ``ranges`` tiles of equally many rows."""
    col = f'"{validate_identifier(column)}"'
    tiles = f"SELECT {col} AS K, NTILE({int(ranges)}) OVER (ORDER BY {col}) AS TILE FROM {table} WHERE {col} IS NOT NULL"
    return f"SELECT MIN(K) AS SPLIT_POINT FROM ({tiles}) TILES GROUP BY TILE ORDER BY 1"


def range_predicates(column: str, points: Iterable[object]) -> list[str]:
    """Conditions that put every row into one range: values below the second
    split point and nulls into the first, and so on.  Repeated points (a
    value of several tiles' rows) make no empty range; no point, one range."""
    col = f'"{validate_identifier(column)}"'
    inner = [literal(p) for p in list(dict.fromkeys(points))[1:]]
    if not inner:
        return ["1 = 1"]
    middle = [f"{col} >= {a} AND {col} < {b}" for a, b in itertools.pairwise(inner)]
    return [f"({col} < {inner[0]} OR {col} IS NULL)", *middle, f"{col} >= {inner[-1]}"]


def equal_depth_ranges(spark: SparkSession, source: JdbcSource, table: str, column: str, ranges: int) -> list[str]:
    """SRC3: conditions of ranges with about equally many rows each; the
    database finds the split points, of which there are at most ``ranges``."""
    rows = read_query(spark, source, split_points_sql(source.qualified(table), column, ranges), 0).collect()
    return range_predicates(column, [r[0] for r in rows])


def read_table(
    spark: SparkSession,
    source: JdbcSource,
    table: str,
    columns: list[str] | None = None,
    fetch_size: int = DEFAULT_FETCH_SIZE,
    partition_column: str | None = None,
    lower_bound: str | int | None = None,
    upper_bound: str | int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """SRC1 + SRC3: a table read as parallel range scans.

    With ``partition_column`` and ``num_partitions`` each executor task
    reads one range: of equally many rows, by split points that the database
    finds, so a skewed column does not end in one connection; or of equal
    width, where both bounds are given.  Without them the read is one task.
    The column selection is pushed into the generated SELECT.
    """
    available = list_columns(spark, source, table)
    selected = select_columns(available, columns)
    r = reader(spark, source, fetch_size)
    if not (partition_column and num_partitions):
        df = r.option("dbtable", source.qualified(table)).load()
    elif lower_bound is None or upper_bound is None:
        ranges = equal_depth_ranges(spark, source, table, partition_column, num_partitions)
        df = r.jdbc(source.url, source.qualified(table), predicates=ranges)
    else:
        df = (
            r.option("dbtable", source.qualified(table))
            .option("partitionColumn", validate_identifier(partition_column))
            .option("lowerBound", str(lower_bound))
            .option("upperBound", str(upper_bound))
            .option("numPartitions", str(num_partitions))
            .load()
        )
    by_upper = {validate_identifier(c): c for c in df.columns}
    return normalize_column_names(df.select(*[by_upper[c] for c in selected]))


def _cabin_case(expr: str) -> str:
    branches = []
    for cabin in ("ECONOMY", "PREMIUM", "BUSINESS"):
        spellings = ", ".join(f"'{s}'" for s, v in CABIN_SPELLINGS.items() if v == cabin)
        branches.append(f"WHEN {expr} IN ({spellings}) THEN '{cabin}'")
    return f"CASE {' '.join(branches)} ELSE {expr} END"


def ticket_summary_sql(schema: str, dialect: str = "db2") -> str:
    """AGG12 as SQL text for the database (same cells as
    ``aeromart.operators.summaries.ticket_summary``)."""
    table = f'"{validate_identifier(schema)}"."TICKETS"'
    month = _MONTH_TEXT[dialect].format(c='"DEPARTURE"')
    cabin = _cabin_case('UPPER(TRIM("CLASS"))')
    tax = 'COALESCE("AIRPORT_TAX", 0) + COALESCE("LOCAL_TAX", 0)'
    return (
        f'SELECT "ROUTE_CODE", MIN(CAST("DEPARTURE" AS DATE)) AS "DEPARTURE_DATE", {month} AS "DEPARTURE_MONTH", '
        f'{cabin} AS "CABIN_CLASS", COUNT(*) AS "TICKETS", SUM("TOTAL_AMOUNT") AS "REVENUE", '
        f'AVG("TOTAL_AMOUNT") AS "AVG_TICKET_VALUE", SUM({tax}) AS "TAX_AMOUNT", '
        f'SUM(CASE WHEN "TOTAL_AMOUNT" IS NOT NULL AND "TOTAL_AMOUNT" <> 0 THEN ({tax}) / "TOTAL_AMOUNT" END) '
        f'AS "TAX_SHARE_SUM" FROM {table} GROUP BY "ROUTE_CODE", {month}, {cabin}'
    )


def ticket_by_flight_sql(schema: str, condition: str | None = None) -> str:
    """AGG13 as SQL text for the database; ``condition`` on the flight is put
    below the grouping, so each range groups only its own tickets."""
    table = f'"{validate_identifier(schema)}"."TICKETS"'
    where = f" WHERE {condition}" if condition else ""
    return (
        f'SELECT "FLIGHT_ID", COUNT(*) AS "TICKETS_SOLD", SUM("TOTAL_AMOUNT") AS "TICKET_REVENUE" '
        f'FROM {table}{where} GROUP BY "FLIGHT_ID"'
    )


def ticket_by_flight_queries(schema: str, points: Iterable[object]) -> list[str]:
    """One grouped query for each range of flights."""
    return [ticket_by_flight_sql(schema, c) for c in range_predicates("FLIGHT_ID", points)]


def read_by_flight(spark: SparkSession, source: JdbcSource, ranges: int, fetch_size: int = DEFAULT_FETCH_SIZE) -> DataFrame:
    """AGG13 read as ranges of flights with about equally many tickets; every
    ticket is grouped once, by the query of its flight's range."""
    rows = read_query(spark, source, split_points_sql(source.qualified("TICKETS"), "FLIGHT_ID", ranges), 0).collect()
    parts = [read_query(spark, source, q, fetch_size) for q in ticket_by_flight_queries(source.schema, [r[0] for r in rows])]
    return functools.reduce(DataFrame.unionByName, parts)


def require_ranges(tables: Iterable[str], partitioning: Mapping[str, dict]) -> None:
    """Tickets and flights are never read through one connection: each needs
    a numeric or date column to cut ranges on."""
    missing = [t for t in LARGE_TABLES if t in set(tables) and not partitioning.get(t)]
    if missing:
        raise ValueError(
            f"{', '.join(missing)}: name a numeric or date column and a number of ranges "
            "(--partition TABLE=COLUMN:N, for example TICKETS=DEPARTURE:256)"
        )


def read_project_tables(
    spark: SparkSession,
    source: JdbcSource,
    table_columns: Mapping[str, list[str]] | None = None,
    fetch_size: int = DEFAULT_FETCH_SIZE,
    partitioning: Mapping[str, dict] | None = None,
) -> dict[str, DataFrame]:
    """SRC4: all project tables (lazy reads); a missing table is an error.
    ``partitioning`` maps a table to ``read_table`` range options."""
    table_columns = table_columns or PROJECT_TABLES
    partitioning = partitioning or {}
    require_ranges(table_columns, partitioning)
    names = check_tables(table_columns, list_tables(spark, source), source.schema)
    return {
        table.lower(): read_table(spark, source, names[table], columns, fetch_size, **partitioning.get(table, {}))
        for table, columns in table_columns.items()
    }


def read_project_summary_tables(
    spark: SparkSession,
    source: JdbcSource,
    fetch_size: int = DEFAULT_FETCH_SIZE,
    partitioning: Mapping[str, dict] | None = None,
) -> dict[str, DataFrame]:
    """SRC5: dimensions plus the two ticket aggregates computed by the
    database."""
    tables = read_project_tables(spark, source, SUMMARY_DIMENSION_TABLES, fetch_size, partitioning)
    tables["ticket_summary"] = read_query(spark, source, ticket_summary_sql(source.schema, source.dialect), fetch_size)
    # one row a flight: as many ranges of flights as TICKETS is given
    ranges = (partitioning or {}).get("TICKETS")
    if not ranges:
        require_ranges(["TICKETS"], {})
    tables["ticket_by_flight"] = read_by_flight(spark, source, int(ranges["num_partitions"]), fetch_size)
    return tables
