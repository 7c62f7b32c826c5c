"""Co-located facts: cleaned sources and facts as bucketed tables.

Tickets are staged by passenger and passengers by id, with as many buckets,
so the ticket fact meets its passengers where it is; the fact is written by
flight and flights are staged by flight, so per-flight totals are grouped
and joined where they are.  Each staged table is dealt out once, when it is
written; no later join or grouping on its key moves it again.

Only own columns are dealt by flight: airport attributes and derived columns
are added after it.  Many routes are met on the way: tickets are dealt once, by
groups of buckets and ranges of routes.  A bucket then has a file for each
range, and a route goes to each group, so beyond ``MOST_GROUPS`` of them (the
square root of the buckets) tickets are moved by route and by flight instead.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromart.operators.cleaning import cast_strings, clean_table
from aeromart.operators.dimensions import build_route_dimension
from aeromart.operators.facts import MOST_GROUPS, build_flights_enriched, tickets_to_move
from aeromart.sources.catalog import create_schema, write_table

#: Source tables that are bucketed, and by which column.
STAGED_BY = {"tickets": "passenger_id", "passengers": "id", "flights": "flight_id"}


def stage_sources(raw_tables: Mapping[str, DataFrame], schema: str, buckets: int, location: str | None = None) -> dict[str, DataFrame]:
    """The cleaned tickets, passengers and flights as bucketed tables of
    ``schema``, keys as strings; other tables are passed on as they are."""
    out = dict(raw_tables)
    for name, key in STAGED_BY.items():
        if name in raw_tables:
            cleaned = cast_strings(clean_table(raw_tables[name]), [key])
            place = f"{location.rstrip('/')}/{name}" if location else None
            out[name] = write_table(cleaned, schema, name, [key], buckets, place)
    return out


def prepare_colocated(
    spark: SparkSession, raw_tables: Mapping[str, DataFrame], schema: str, buckets: int, as_of_year: int | None = None, location: str | None = None
) -> dict[str, DataFrame]:
    """The route dimension and both enriched facts (ticket grain) from bucketed
    tables; ``tickets_enriched`` is written by flight."""
    create_schema(spark, schema, location)
    staged = stage_sources(raw_tables, schema, buckets, location)
    route_dim = build_route_dimension(staged["routes"], staged["airports"])
    groups = math.isqrt(max(buckets, 1))
    bucket = F.pmod(F.hash("flight_id"), F.lit(buckets)) if groups <= MOST_GROUPS else None
    sources = [staged.get(t) for t in ("routes", "airports", "passengers")]
    tickets, widen = tickets_to_move(staged["tickets"], route_dim, *sources, cleaned=True, group=bucket, groups=groups, parts=buckets)
    place = f"{location.rstrip('/')}/tickets_enriched" if location else None
    fact = write_table(tickets, schema, "tickets_enriched", ["flight_id"], buckets, place, widen)
    flights = build_flights_enriched(staged["flights"], route_dim, staged["airplanes"], fact, as_of_year, cleaned=True)
    return {"route_dimension": route_dim, "tickets_enriched": fact, "flights_enriched": flights}


