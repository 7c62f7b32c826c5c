"""DS7: the preparation job (``spark-submit -m aeromart.plans.job`` or
``python -m aeromart.plans.job``).

Reads the six source tables (Parquet folder, JDBC database, or the
driver's test tables), builds and writes the nine prepared datasets, and
writes the findings as Markdown.  Default mode is the summary grain
(ticket cells); ``--raw-tickets`` keeps ticket grain, which on Spark is
no longer the slow path it is for a single machine.
"""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import DataFrame, SparkSession

from aeromart.operators.base import read_bases
from aeromart.operators.findings import findings_markdown, summarize_key_findings
from aeromart.operators.summaries import summarize_tickets
from aeromart.plans.prepare import prepare_to_storage
from aeromart.session import build_session, shared_scratch_path


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Build the prepared airline datasets with Spark.")
    p.add_argument("--source", choices=["parquet", "jdbc", "catalog", "testdata"], default="parquet")
    p.add_argument("--input", help="Parquet folder with the source tables, or a test-data folder.")
    p.add_argument("--output", required=True, help="Shared folder for the prepared Parquet datasets.")
    p.add_argument("--base-folder", help="Shared folder for the bases of partial sums (default: scratch).")
    p.add_argument("--raw-tickets", action="store_true", help="Keep ticket grain instead of monthly cells.")
    p.add_argument("--as-of-year", type=int, default=None, help="Year for aircraft age (default: this year).")
    p.add_argument("--url", help="JDBC URL (jdbc source).")
    p.add_argument("--schema", help="Database schema (jdbc source) or schema of the session's catalog (catalog source).")
    p.add_argument("--driver", help="JDBC driver class (jdbc source).")
    p.add_argument("--user-env", default="DB_USERNAME", help="Environment variable with the user name.")
    p.add_argument("--password-env", default="DB_PASSWORD", help="Environment variable with the password.")
    p.add_argument("--dialect", choices=["db2", "ansi"], default="db2")
    p.add_argument("--batch-size", type=int, default=100_000, help="JDBC fetch size; 0 leaves the driver default.")
    p.add_argument(
        "--partition",
        action="append",
        default=[],
        metavar="TABLE=COLUMN:N",
        help="Read TABLE in N parallel ranges of a numeric or date COLUMN (jdbc source; repeatable).",
    )
    p.add_argument("--master", default=None, help="Spark master (normally set by spark-submit).")
    args = p.parse_args(argv)
    if args.source in ("parquet", "testdata") and not args.input:
        p.error(f"--input is required with --source {args.source}")
    if args.source == "jdbc" and not (args.url and args.schema):
        p.error("--url and --schema are required with --source jdbc")
    if args.source == "catalog" and not args.schema:
        p.error("--schema is required with --source catalog")
    return args


def parse_partitioning(specs: list[str]) -> dict[str, dict]:
    """``TABLE=COLUMN:N`` -> ``{TABLE: {"partition_column": COLUMN, "num_partitions": N}}``."""
    out: dict[str, dict] = {}
    for spec in specs:
        table, _, rest = spec.partition("=")
        column, _, count = rest.partition(":")
        if not (table and column and count.isdigit()):
            raise ValueError(f"expected TABLE=COLUMN:N, got {spec!r}")
        out[table.strip().upper()] = {"partition_column": column.strip(), "num_partitions": int(count)}
    return out


def read_sources(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    if args.source == "testdata":
        from aeromart.sources.fixtures import airline_tables

        tables = airline_tables(spark, args.input)
        return tables if args.raw_tickets else summarize_tickets(tables)
    if args.source == "catalog":
        from aeromart.sources import catalog

        tables = catalog.read_project_tables(spark, args.schema)
        return tables if args.raw_tickets else summarize_tickets(tables)
    if args.source == "parquet":
        from aeromart.sources import parquet

        if args.raw_tickets:
            return parquet.read_project_tables(spark, args.input)
        return parquet.read_project_summary_tables(spark, args.input)
    from aeromart.sources import jdbc

    options = {k: v for k, v in {
        "user": os.environ.get(args.user_env),
        "password": os.environ.get(args.password_env),
        "driver": args.driver,
    }.items() if v}
    source = jdbc.JdbcSource(url=args.url, schema=args.schema, options=options, dialect=args.dialect)
    partitioning = parse_partitioning(args.partition)
    if args.raw_tickets:
        return jdbc.read_project_tables(spark, source, fetch_size=args.batch_size, partitioning=partitioning)
    return jdbc.read_project_summary_tables(spark, source, fetch_size=args.batch_size, partitioning=partitioning)


def write_findings(spark: SparkSession, findings: DataFrame, folder: str) -> str:
    """SNK3: at most five sentences, written as one Markdown file."""
    path = f"{folder.rstrip('/')}/generated_findings.md"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(findings_markdown(findings).encode()))
    finally:
        stream.close()
    return path


def main(argv: list[str] | None = None) -> dict[str, float]:
    args = parse_args(argv)
    started = time.perf_counter()
    spark = build_session(master=args.master, app_name="aeromart-prepare")
    raw = read_sources(spark, args)
    base_folder = args.base_folder or shared_scratch_path(spark, "bases")
    prepare_to_storage(raw, args.output, args.as_of_year, base_folder=base_folder)
    prepared = time.perf_counter()
    findings = summarize_key_findings(*read_bases(spark, base_folder))
    write_findings(spark, findings, args.output)
    timings = {"prepare_seconds": prepared - started, "total_seconds": time.perf_counter() - started}
    print({"output": args.output, **timings}, flush=True)
    return timings


if __name__ == "__main__":
    main()
