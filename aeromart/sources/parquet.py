"""Parquet folders as sources and sinks.

Source side: a folder with one Parquet dataset per table (``name.parquet``
file or ``name`` directory) plays the role of the relational schema: list
tables (SRC6), list columns (SRC7), row counts from footers (SRC8), read
selected columns (SRC1/SRC4, pruned at the scan), and load prepared
datasets (SRC9).  Sink side: write datasets as zstd Parquet (SNK1).

Paths go through Hadoop's file system API via Spark, so the same code
reads a local folder, HDFS or an object store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromart.operators.dealing import PART
from aeromart.schemas import PROJECT_TABLES, SUMMARY_DIMENSION_TABLES
from aeromart.sources.naming import check_tables, normalize_column_names, pick_columns

#: Partition column of facts that are laid out by month.
MONTH_FOLDER = "by_month"
PREPARED_REQUIRED = ["tickets_enriched", "flights_enriched"]


def _fs_entries(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(name, is_directory) of the entries of ``folder`` (any Hadoop FS)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(path)]


def _table_paths(spark: SparkSession, folder: str, parquet_suffix_only: bool = False) -> dict[str, str]:
    """Tables of a folder: ``name.parquet`` (file or directory) or, unless
    ``parquet_suffix_only``, a plain directory ``name`` with no extension.
    Hidden and ``_``-prefixed entries and other extensions are skipped."""
    paths: dict[str, str] = {}
    for name, is_dir in _fs_entries(spark, folder):
        if name.startswith(("_", ".")):
            continue
        if name.endswith(".parquet"):
            stem = name[: -len(".parquet")]
        elif is_dir and "." not in name and not parquet_suffix_only:
            stem = name
        else:
            continue
        paths[stem] = f"{folder.rstrip('/')}/{name}"
    return paths


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """SRC6: table names in the folder, ordered."""
    return sorted(_table_paths(spark, folder))


def table_path(spark: SparkSession, folder: str, table: str) -> str:
    paths = _table_paths(spark, folder)
    key = table if table in paths else table.lower()
    if key not in paths:
        raise FileNotFoundError(f"no table {table!r} in {folder}")
    return paths[key]


def list_columns(spark: SparkSession, folder: str, table: str) -> list[str]:
    """SRC7: column names in stored order (from the footer, no data read)."""
    return spark.read.parquet(table_path(spark, folder, table)).columns


def table_row_count(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """SRC8 as a one-row frame ``(table_name, row_count)``.

    Parquet answers a bare count from footer statistics, so no column
    data is read.
    """
    df = spark.read.parquet(table_path(spark, folder, table))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table).alias("table_name"), "row_count"
    )


def estimate_table_rows(spark: SparkSession, folder: str, table: str) -> int | None:
    """SRC8 as a number: the row count from Parquet footers, None when the
    table is missing."""
    try:
        return table_row_count(spark, folder, table).first()["row_count"]
    except FileNotFoundError:
        return None


def table_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC6 + SRC8: ``(table_name, row_count)`` for every table."""
    frames = [table_row_count(spark, folder, t) for t in list_tables(spark, folder)]
    if not frames:
        return spark.createDataFrame([], "table_name string, row_count long")
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def read_table(
    spark: SparkSession, folder: str, table: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """SRC1 for a Parquet folder.

    Names are normalised to snake_case; requested columns that exist are
    kept in request order (absent ones are dropped silently); with no
    request, all columns sorted by name.  No match is an error.  The
    select prunes the Parquet scan to those columns.
    """
    df = normalize_column_names(spark.read.parquet(table_path(spark, folder, table)))
    return df.select(*pick_columns(df.columns, columns, f"{folder}/{table}"))


def read_project_tables(
    spark: SparkSession,
    folder: str,
    table_columns: Mapping[str, list[str]] | None = None,
) -> dict[str, DataFrame]:
    """SRC4: every project table, lazily; a missing table is an error."""
    wanted = table_columns or PROJECT_TABLES
    names = check_tables(wanted, list_tables(spark, folder), folder)
    return {t.lower(): read_table(spark, folder, names[t], columns) for t, columns in wanted.items()}


def read_project_summary_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """SRC5 for a folder: dimensions raw plus the two ticket summaries,
    aggregated by Spark from the tickets table."""
    from aeromart.operators.summaries import ticket_by_flight, ticket_summary

    tables = read_project_tables(spark, folder, SUMMARY_DIMENSION_TABLES)
    tickets = read_table(spark, folder, "tickets", PROJECT_TABLES["TICKETS"])
    tables["ticket_summary"] = ticket_summary(tickets)
    tables["ticket_by_flight"] = ticket_by_flight(tickets)
    return tables


def load_prepared_data(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """SRC9: every ``*.parquet`` dataset keyed by its stem; the two
    enriched facts must exist."""
    paths = _table_paths(spark, folder, parquet_suffix_only=True)
    missing = [n for n in PREPARED_REQUIRED if n not in paths]
    if missing:
        raise FileNotFoundError(
            "Missing prepared data files: " + ", ".join(f"{n}.parquet" for n in missing)
        )
    return {name: read_dataset(spark, paths[name]) for name in sorted(paths)}


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_fact(df: DataFrame, path: str, widen: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write a tickets fact with a folder for each month, its rows clustered by
    route inside, so that a slice lists only its months and skips the row
    groups of other routes.

    The ranges are of month, route and row hash: a route that holds most of a
    month is cut too.  Every column stays in the files, in its place; the
    folders' month is a column beside them.  ``widen`` adds the columns that
    follow from those of ``df`` row by row: only ``df`` is shuffled.  Rows that
    come with their part (``dealing.PART``) lie in ranges already and stay
    where they are.
    """
    widen = widen or (lambda rows: rows)
    dealt, df = PART in df.columns, df.drop(PART)
    keys = [c for c in ("departure_month", "route_code") if c in df.columns]
    if "departure_month" not in keys:
        return write_dataset(widen(df), path)
    spread = [*[F.col(k) for k in keys], F.xxhash64(*df.columns)]
    wide = widen(df if dealt else df.repartitionByRange(*spread)).withColumn(MONTH_FOLDER, F.col("departure_month"))
    # the folder's column first: the writer drops any other order for its own
    clustered = wide.sortWithinPartitions(MONTH_FOLDER, *keys[1:])
    clustered.write.mode("overwrite").option("compression", "zstd").partitionBy(MONTH_FOLDER).parquet(path)
    if not any(is_folder for _, is_folder in _fs_entries(df.sparkSession, path)):
        write_dataset(widen(df), path)  # no row, no folder: one file keeps the schema


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A written dataset.  Where it has folders by month, their name stands for
    the month, so filters on it prune folders; columns keep their order."""
    df = spark.read.parquet(path)
    if MONTH_FOLDER not in df.columns:
        return df
    month = F.col(MONTH_FOLDER).cast("string").alias("departure_month")
    return df.select(*[month if c == "departure_month" else F.col(c) for c in df.columns if c != MONTH_FOLDER])


def write_prepared_datasets(datasets: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """SNK1: each dataset as ``<folder>/<name>.parquet`` (zstd, statistics
    on by default), overwriting.  Returns the written paths."""
    written = {}
    for name, df in datasets.items():
        path = f"{folder.rstrip('/')}/{name}.parquet"
        write_dataset(df, path)
        written[name] = path
    return written
