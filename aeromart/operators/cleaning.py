"""Cleaning and projection steps (PRJ1-PRJ6) as DataFrame -> DataFrame.

Everything here is a per-row projection: no shuffle, no action, and it
fuses into the scan's whole-stage-codegen span.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeromart.functions.expressions import lenient_double, lenient_timestamp, strip_whitespace, utc_wall_time

# Columns coerced by name in the standard cleaning step.
MONEY_COLUMNS = ["price", "airport_tax", "local_tax", "total_amount"]
NUMERIC_COLUMNS = [
    "distance",
    "flight_minutes",
    "seats_business",
    "seats_premium",
    "seats_economy",
    "fuel_gallons_hour",
    "maintenance_takeoffs",
    "maintenance_flight_hours",
    "total_flight_distance",
]
TEMPORAL_COLUMNS = ["departure", "departure_date", "arrival", "birth_date", "build_date"]


def existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """PRJ1: the requested columns that exist, in request order."""
    present = set(df.columns)
    return [c for c in columns if c in present]


def rename_existing(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ2: rename the columns that exist; absent names are ignored."""
    present = set(df.columns)
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in present})


def require(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """N26: fail early, with every missing name, when a needed column is absent."""
    missing = [c for c in columns if c not in set(df.columns)]
    if missing:
        raise ValueError(f"{what} is missing required column(s): {', '.join(missing)}")
    return df


def clean_strings(df: DataFrame) -> DataFrame:
    """PRJ3: strip Unicode white space at both ends of every string column."""
    targets = {
        f.name: strip_whitespace(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(targets) if targets else df


def cast_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """PRJ4: lenient cast to double of the listed columns that exist."""
    types = {f.name: f.dataType for f in df.schema.fields}
    targets = {}
    for c in existing(df, columns):
        dtype = types[c]
        if isinstance(dtype, T.DoubleType):
            continue
        if isinstance(dtype, T.StringType):
            targets[c] = lenient_double(c)
        elif isinstance(dtype, T.NumericType):
            targets[c] = F.col(c).cast("double")
        else:
            targets[c] = F.col(c).try_cast("double")
    return df.withColumns(targets) if targets else df


def parse_temporal(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """PRJ5: text in five layouts, dates and zoned timestamps (as UTC wall
    time) to timestamp_ntz; wall-time timestamps stay."""
    types = {f.name: f.dataType for f in df.schema.fields}
    targets = {}
    for c in existing(df, columns):
        dtype = types[c]
        if isinstance(dtype, T.StringType):
            targets[c] = lenient_timestamp(c)
        elif isinstance(dtype, T.DateType):
            targets[c] = F.col(c).cast("timestamp_ntz")
        elif isinstance(dtype, T.TimestampType):
            targets[c] = utc_wall_time(c)
    return df.withColumns(targets) if targets else df


def clean_table(df: DataFrame) -> DataFrame:
    """PRJ6: standard cleaning = strings, then numbers, then timestamps."""
    return (
        df.transform(clean_strings)
        .transform(cast_numbers, MONEY_COLUMNS + NUMERIC_COLUMNS)
        .transform(parse_temporal, TEMPORAL_COLUMNS)
    )


def cast_strings(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """PRJ7: join keys as strings on both sides of every join."""
    targets = {c: F.col(c).cast("string") for c in existing(df, columns)}
    return df.withColumns(targets) if targets else df
