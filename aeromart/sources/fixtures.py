"""The driver's test tables seen as the six airline source tables.

The test data has no airline tables; these lazy views derive them from
``region nation customer supplier part orders lineitem`` with nulls,
zeros, unmatched keys, padded text and every cabin spelling, so every
rule of the library is exercised.  The same expressions exist as SQL
(``aeromart.plans.oracle``) for the independent check.

Each view is a projection of one table (plus a broadcast of the 25-row
nation/region tables where a name is needed), so it grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TPCH_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Fixed values of the mapping (FIXTURES.md section C).
CLASS_BY_LINE_NUMBER = {1: "E", 2: " econ ", 3: "Economy", 4: "premium economy", 5: "Bus", 6: "First"}
VIPCARD_BY_SEGMENT = {"BUILDING": "Y", "AUTOMOBILE": " vip ", "MACHINERY": "N", "HOUSEHOLD": "true"}
UNMATCHED_ROUTE = "RX"


def read_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names or TPCH_TABLES}


def _code(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _code2(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), 2, "0"))


def airports(t: Mapping[str, DataFrame]) -> DataFrame:
    # nation and region have 25 and 5 rows at every scale factor.
    nation, region = t["nation"], t["region"]
    joined = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "inner")
    return joined.select(
        _code2("N", F.col("n_nationkey")).alias("iata_code"),
        F.col("n_name").alias("airport"),
        F.when(F.col("n_nationkey") == 5, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))
        .alias("city"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("continent"),
        (F.col("n_nationkey") * 0.5).alias("airport_tax"),
    )


def routes(t: Mapping[str, DataFrame]) -> DataFrame:
    key = F.col("p_partkey")
    return t["part"].select(
        _code("R", key).alias("route_code"),
        _code2("N", key % 25).alias("origin"),
        _code2("N", (key * 7 + 3) % 26).alias("destination"),
        F.when(key % 50 == 0, F.lit(0.0))
        .when(key % 50 == 1, F.lit(None).cast("double"))
        .otherwise(F.col("p_retailprice"))
        .alias("distance"),
        F.when(key % 40 == 7, F.lit(None).cast("int")).otherwise(F.col("p_size") * 10).alias("flight_minutes"),
    )


def tickets(t: Mapping[str, DataFrame]) -> DataFrame:
    li = t["lineitem"]
    orders = t["orders"].select("o_orderkey", "o_custkey")
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    line = F.col("l_linenumber")
    price = F.col("l_extendedprice")
    tax_product = price * F.col("l_tax")
    local_tax = price * F.col("l_discount")
    cabin = None
    for number, spelling in CLASS_BY_LINE_NUMBER.items():
        cabin = F.when(line == number, F.lit(spelling)) if cabin is None else cabin.when(line == number, F.lit(spelling))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ticket_id"),
        F.col("o_custkey").alias("passenger_id"),
        _code("F", F.col("l_orderkey")).alias("flight_id"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(UNMATCHED_ROUTE))
        .otherwise(_code("R", F.col("l_partkey")))
        .alias("route_code"),
        F.col("l_shipdate").alias("departure"),
        cabin.alias("class"),
        price.alias("price"),
        F.when(line == 6, F.lit(None).cast("double")).otherwise(tax_product).alias("airport_tax"),
        local_tax.alias("local_tax"),
        F.when((line == 7) & (F.col("l_quantity") == 50), F.lit(None).cast("double"))
        .when((line == 7) & (F.col("l_quantity") == 49), F.lit(0.0))
        .otherwise(price + tax_product + local_tax)
        .alias("total_amount"),
    )


def flights(t: Mapping[str, DataFrame]) -> DataFrame:
    # Number of aircraft codes: suppliers + 2, so two codes never match.
    suppliers = t["supplier"].select(F.count(F.lit(1))).scalar()
    key = F.col("o_orderkey")
    return t["orders"].select(
        _code("F", key).alias("flight_id"),
        _code("R", F.col("o_custkey")).alias("route_code"),
        F.col("o_orderdate").alias("departure"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")).alias("arrival"),
        _code("A", key % (suppliers + 2)).alias("airplane"),
    )


def airplanes(t: Mapping[str, DataFrame]) -> DataFrame:
    key = F.col("s_suppkey")
    return t["supplier"].select(
        _code("A", key).alias("aircraft_registration"),
        _code("M", F.col("s_nationkey")).alias("model"),
        F.when(key % 11 == 0, F.lit(None).cast("long")).otherwise(key % 3 * 4).alias("seats_business"),
        (key % 5 * 6).alias("seats_premium"),
        (key % 7 * 30).alias("seats_economy"),
        F.date_add(F.lit("1990-01-01").cast("date"), (key % 9000).cast("int")).alias("build_date"),
        F.abs(F.col("s_acctbal")).alias("fuel_gallons_hour"),
        (key * 13 % 1000).alias("maintenance_takeoffs"),
    )


def passengers(t: Mapping[str, DataFrame]) -> DataFrame:
    customer, nation = t["customer"], t["nation"]
    joined = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey, "inner")
    key = F.col("c_custkey")
    card = None
    for segment, value in VIPCARD_BY_SEGMENT.items():
        cond = F.col("c_mktsegment") == segment
        card = F.when(cond, F.lit(value)) if card is None else card.when(cond, F.lit(value))
    return joined.select(
        key.alias("id"),
        F.when(key % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        F.when(key % 50 == 0, F.lit(None).cast("date"))
        .otherwise(F.date_add(F.lit("1930-01-01").cast("date"), (key * 7919 % 29000).cast("int")))
        .alias("birth_date"),
        F.col("n_name").alias("country"),
        card.alias("vipcard"),
    )


class LazyTables(Mapping):
    """Tables that are opened when they are asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def airline_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """The six source tables (lazy) for one test-data folder; only the files
    of those that are used are opened."""
    t = LazyTables({n: lambda n=n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TPCH_TABLES})
    views = {"airports": airports, "routes": routes, "tickets": tickets, "flights": flights, "airplanes": airplanes, "passengers": passengers}
    return LazyTables({name: lambda view=view: view(t) for name, view in views.items()})
