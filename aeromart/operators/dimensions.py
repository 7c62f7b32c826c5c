"""DS1: the route dimension (routes + origin and destination airports)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromart.functions.expressions import route_label, safe_divide
from aeromart.operators.cleaning import cast_strings, clean_table, existing, rename_existing, require
from aeromart.operators.joins import join_dimension

# Airport attributes carried onto routes, and their names
# on each end of the route.
AIRPORT_COLUMNS = [
    "iata_code",
    "airport",
    "city",
    "country",
    "continent",
    "timezone",
    "latitude",
    "longitude",
    "airport_tax",
]


def _end_names(prefix: str) -> dict[str, str]:
    names = {"iata_code": prefix}
    for column in AIRPORT_COLUMNS[1:]:
        suffix = "_ref" if column == "airport_tax" else ""
        names[column] = f"{prefix}_{column}{suffix}"
    return names


ORIGIN_NAMES = _end_names("origin")
DESTINATION_NAMES = _end_names("destination")


def unique_by_key(df: DataFrame, key: str) -> DataFrame:
    """DED1 with a stable pick (N12): per key, the smallest row.

    Rows are compared on the remaining columns in order, nulls first.
    This is an aggregate, so it is combined map-side before the shuffle
    and a heavily repeated key cannot overload one task.
    """
    others = [c for c in df.columns if c != key]
    if not others:
        return df.select(key).distinct()
    picked = df.groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def airport_dimension(airports: DataFrame) -> DataFrame:
    """Cleaned airports, one row per code, key as string."""
    airports = require(clean_table(airports), ["iata_code", "city"], "airports")
    airports = airports.select(*existing(airports, AIRPORT_COLUMNS))
    return unique_by_key(cast_strings(airports, ["iata_code"]), "iata_code")


def own_route_columns(routes: DataFrame) -> DataFrame:
    """Cleaned routes, keys as strings, before any airport is joined."""
    routes = require(
        clean_table(routes), ["route_code", "origin", "destination", "flight_minutes"], "routes"
    )
    return cast_strings(routes, ["route_code", "origin", "destination"])


def with_airports(routes: DataFrame, airport_dim: DataFrame) -> DataFrame:
    """Rows with an ``origin``, a ``destination`` and ``flight_minutes``, with
    what follows from them: origin_* and destination_* airport attributes,
    ``route_label`` and ``flight_hours``."""
    dim = join_dimension(routes, rename_existing(airport_dim, ORIGIN_NAMES), "origin")
    dim = join_dimension(dim, rename_existing(airport_dim, DESTINATION_NAMES), "destination")
    return dim.withColumns(
        {
            "route_label": route_label(
                F.col("origin_city"), F.col("origin"), F.col("destination_city"), F.col("destination")
            ),
            "flight_hours": safe_divide(F.col("flight_minutes"), F.lit(60)),
        }
    )


def build_route_dimension(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """DS1: route columns, origin_* and destination_* airport attributes,
    ``route_label`` ("city -> city", codes where a city is missing) and
    ``flight_hours`` (minutes / 60)."""
    return with_airports(own_route_columns(routes), airport_dimension(airports))
