"""SQL twins of the registered queries, for DuckDB over the driver's views.

Written independently of the DataFrame code: the common table
expressions below re-derive the six airline tables (already cleaned)
and the enriched facts from ``region nation customer supplier part
orders lineitem``; each query then states its operator in plain SQL.
Sums and means are those of doubles; their last digits depend on the order
of rows, so the presentation rules of ``registry`` round them here too.
"""

from __future__ import annotations


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _cabin(x: str) -> str:
    k = f"upper({_trim(x)})"
    return (
        f"CASE WHEN {k} IN ('E', 'ECON', 'ECONOMY') THEN 'ECONOMY' "
        f"WHEN {k} IN ('P', 'PREMIUM', 'PREMIUM ECONOMY') THEN 'PREMIUM' "
        f"WHEN {k} IN ('B', 'BUS', 'BUSINESS') THEN 'BUSINESS' ELSE {k} END"
    )


def _sum0(x: str) -> str:
    return f"coalesce(CAST(sum({x}) AS DOUBLE), 0.0)"


def _distinct_with_null(x: str) -> str:
    return f"(count(DISTINCT {x}) + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END))"


AS_OF_YEAR = 2026

CTES = f"""
airport_raw AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iata_code,
         {_trim('n_name')} AS airport,
         CASE WHEN n_nationkey = 5 THEN NULL ELSE {_trim("'  ' || n_name || ' '")} END AS city,
         {_trim('n_name')} AS country,
         {_trim('r_name')} AS continent,
         CAST(n_nationkey AS DOUBLE) * 0.5 AS airport_tax
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
airport_dim AS (
  SELECT * FROM airport_raw
  QUALIFY row_number() OVER (PARTITION BY iata_code ORDER BY airport NULLS FIRST, city NULLS FIRST,
          country NULLS FIRST, continent NULLS FIRST, airport_tax NULLS FIRST) = 1
),
routes_clean AS (
  SELECT 'R' || CAST(p_partkey AS VARCHAR) AS route_code,
         'N' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') AS origin,
         'N' || lpad(CAST((p_partkey * 7 + 3) % 26 AS VARCHAR), 2, '0') AS destination,
         CASE WHEN p_partkey % 50 = 0 THEN 0.0::DOUBLE WHEN p_partkey % 50 = 1 THEN NULL
              ELSE p_retailprice END AS distance,
         CAST(CASE WHEN p_partkey % 40 = 7 THEN NULL ELSE p_size * 10 END AS DOUBLE) AS flight_minutes
  FROM part
),
route_dim AS (
  SELECT r.route_code, r.origin, r.destination, r.distance, r.flight_minutes,
         o.airport AS origin_airport, o.city AS origin_city, o.country AS origin_country,
         o.continent AS origin_continent, o.airport_tax AS origin_airport_tax_ref,
         d.airport AS destination_airport, d.city AS destination_city, d.country AS destination_country,
         d.continent AS destination_continent, d.airport_tax AS destination_airport_tax_ref,
         coalesce(o.city, r.origin) || ' -> ' || coalesce(d.city, r.destination) AS route_label,
         r.flight_minutes / 60 AS flight_hours
  FROM routes_clean r
  LEFT JOIN airport_dim o ON r.origin = o.iata_code
  LEFT JOIN airport_dim d ON r.destination = d.iata_code
),
tickets_clean AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ticket_id,
         CAST(o_custkey AS VARCHAR) AS passenger_id,
         'F' || CAST(l_orderkey AS VARCHAR) AS flight_id,
         CASE WHEN l_partkey % 97 = 0 THEN 'RX' ELSE 'R' || CAST(l_partkey AS VARCHAR) END AS route_code,
         l_shipdate AS departure,
         {_trim("CASE l_linenumber WHEN 1 THEN 'E' WHEN 2 THEN ' econ ' WHEN 3 THEN 'Economy' "
                "WHEN 4 THEN 'premium economy' WHEN 5 THEN 'Bus' WHEN 6 THEN 'First' END")} AS class,
         l_extendedprice AS price,
         CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice * l_tax END AS airport_tax,
         l_extendedprice * l_discount AS local_tax,
         CASE WHEN l_linenumber = 7 AND l_quantity = 50 THEN NULL
              WHEN l_linenumber = 7 AND l_quantity = 49 THEN 0.0::DOUBLE
              ELSE l_extendedprice + l_extendedprice * l_tax + l_extendedprice * l_discount END AS total_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
passenger_dim AS (
  SELECT CAST(c_custkey AS VARCHAR) AS passenger_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS passenger_gender,
         CASE WHEN c_custkey % 50 = 0 THEN NULL
              ELSE CAST(DATE '1930-01-01' + CAST(c_custkey * 7919 % 29000 AS INTEGER) AS TIMESTAMP)
         END AS passenger_birth_date,
         {_trim('n_name')} AS passenger_country,
         {_trim("CASE c_mktsegment WHEN 'BUILDING' THEN 'Y' WHEN 'AUTOMOBILE' THEN ' vip ' "
                "WHEN 'MACHINERY' THEN 'N' WHEN 'HOUSEHOLD' THEN 'true' END")} AS vip_card
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
tickets_base AS (
  SELECT t.*, {_cabin('t.class')} AS cabin_class,
         coalesce(t.airport_tax, 0) + coalesce(t.local_tax, 0) AS tax_amount
  FROM tickets_clean t
),
tickets_enriched AS (
  SELECT b.ticket_id, b.passenger_id, b.flight_id, b.route_code, b.departure, b.class, b.price,
         b.airport_tax, b.local_tax, b.total_amount, b.cabin_class, b.tax_amount,
         b.tax_amount / nullif(b.total_amount, 0) AS tax_share,
         b.departure AS ticket_departure,
         CAST(b.departure AS DATE) AS departure_date,
         strftime(b.departure, '%Y-%m') AS departure_month,
         CAST(year(b.departure) AS INTEGER) AS departure_year,
         r.origin, r.destination, r.distance, r.flight_minutes, r.origin_airport, r.origin_city,
         r.origin_country, r.origin_continent, r.origin_airport_tax_ref, r.destination_airport,
         r.destination_city, r.destination_country, r.destination_continent,
         r.destination_airport_tax_ref, r.route_label, r.flight_hours,
         p.passenger_gender, p.passenger_birth_date, p.passenger_country, p.vip_card,
         CAST(year(b.departure) - year(p.passenger_birth_date) AS INTEGER) AS passenger_age,
         CASE WHEN year(b.departure) - year(p.passenger_birth_date) < 25 THEN 'Under 25'
              WHEN year(b.departure) - year(p.passenger_birth_date) < 35 THEN '25-34'
              WHEN year(b.departure) - year(p.passenger_birth_date) < 50 THEN '35-49'
              WHEN year(b.departure) - year(p.passenger_birth_date) < 65 THEN '50-64'
              WHEN p.passenger_birth_date IS NOT NULL AND b.departure IS NOT NULL THEN '65+'
              ELSE 'Unknown' END AS age_band,
         CASE WHEN upper({_trim('p.vip_card')}) IN ('Y', 'YES', 'TRUE', '1', 'VIP') THEN 'VIP'
              ELSE 'Non-VIP' END AS vip_segment
  FROM tickets_base b
  LEFT JOIN route_dim r ON b.route_code = r.route_code
  LEFT JOIN passenger_dim p ON b.passenger_id = p.passenger_id
),
flights_clean AS (
  SELECT 'F' || CAST(o_orderkey AS VARCHAR) AS flight_id,
         'R' || CAST(o_custkey AS VARCHAR) AS route_code,
         o_orderdate AS departure,
         o_orderdate + INTERVAL 2 HOUR AS arrival,
         'A' || CAST(o_orderkey % ((SELECT count(*) FROM supplier) + 2) AS VARCHAR) AS airplane
  FROM orders
),
airplane_dim AS (
  SELECT 'A' || CAST(s_suppkey AS VARCHAR) AS airplane,
         'M' || CAST(s_nationkey AS VARCHAR) AS model,
         CAST(CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey % 3 * 4 END AS DOUBLE) AS seats_business,
         CAST(s_suppkey % 5 * 6 AS DOUBLE) AS seats_premium,
         CAST(s_suppkey % 7 * 30 AS DOUBLE) AS seats_economy,
         CAST(DATE '1990-01-01' + CAST(s_suppkey % 9000 AS INTEGER) AS TIMESTAMP) AS build_date,
         abs(s_acctbal) AS fuel_gallons_hour,
         CAST(s_suppkey * 13 % 1000 AS DOUBLE) AS maintenance_takeoffs,
         CAST({AS_OF_YEAR} - year(DATE '1990-01-01' + CAST(s_suppkey % 9000 AS INTEGER)) AS INTEGER)
           AS aircraft_age_years
  FROM supplier
),
per_flight AS (
  SELECT flight_id, count(*) AS tickets_sold, {_sum0('total_amount')} AS ticket_revenue
  FROM tickets_enriched GROUP BY flight_id
),
ticket_by_flight AS (
  SELECT flight_id, count(*) AS tickets_sold,
         sum(total_amount) AS ticket_revenue
  FROM tickets_clean GROUP BY flight_id
),
flights_joined AS (
  SELECT f.flight_id, f.route_code, f.departure, f.arrival, f.airplane,
         f.departure AS flight_departure, f.arrival AS flight_arrival,
         r.origin, r.destination, r.route_label, r.distance, r.flight_minutes, r.flight_hours,
         r.origin_continent, r.destination_continent,
         a.model, a.seats_business, a.seats_premium, a.seats_economy, a.build_date,
         a.fuel_gallons_hour, a.maintenance_takeoffs, a.aircraft_age_years,
         coalesce(a.seats_business, 0) + coalesce(a.seats_premium, 0) + coalesce(a.seats_economy, 0)
           AS seat_capacity,
         a.fuel_gallons_hour * r.flight_hours AS estimated_fuel_gallons
  FROM flights_clean f
  LEFT JOIN route_dim r ON f.route_code = r.route_code
  LEFT JOIN airplane_dim a ON f.airplane = a.airplane
),
flights_enriched AS (
  SELECT j.flight_id, j.route_code, j.departure, j.arrival, j.airplane, j.flight_departure,
         j.flight_arrival, j.origin, j.destination, j.route_label, j.distance, j.flight_minutes,
         j.flight_hours, j.origin_continent, j.destination_continent, j.model, j.seats_business,
         j.seats_premium, j.seats_economy, j.build_date, j.fuel_gallons_hour, j.maintenance_takeoffs,
         j.aircraft_age_years,
         coalesce(p.tickets_sold, 0) AS tickets_sold,
         coalesce(p.ticket_revenue, 0.0) AS ticket_revenue,
         j.seat_capacity,
         coalesce(p.tickets_sold, 0) / nullif(j.seat_capacity, 0) AS estimated_load_factor,
         j.estimated_fuel_gallons
  FROM flights_joined j LEFT JOIN per_flight p ON j.flight_id = p.flight_id
),
flights_enriched_cells AS (
  SELECT j.flight_id, j.route_code, j.departure, j.arrival, j.airplane, j.flight_departure,
         j.flight_arrival, j.origin, j.destination, j.route_label, j.distance, j.flight_minutes,
         j.flight_hours, j.origin_continent, j.destination_continent, j.model, j.seats_business,
         j.seats_premium, j.seats_economy, j.build_date, j.fuel_gallons_hour, j.maintenance_takeoffs,
         j.aircraft_age_years,
         coalesce(CAST(p.tickets_sold AS DOUBLE), 0.0) AS tickets_sold,
         coalesce(p.ticket_revenue, 0.0) AS ticket_revenue,
         j.seat_capacity,
         coalesce(CAST(p.tickets_sold AS DOUBLE), 0.0) / nullif(j.seat_capacity, 0) AS estimated_load_factor,
         j.estimated_fuel_gallons
  FROM flights_joined j LEFT JOIN ticket_by_flight p ON j.flight_id = p.flight_id
),
cells AS (
  SELECT route_code,
         min(CAST(departure AS DATE)) AS departure_date,
         strftime(departure, '%Y-%m') AS departure_month,
         {_cabin('class')} AS cabin_class,
         count(*) AS tickets,
         sum(total_amount) AS revenue,
         avg(total_amount) AS avg_ticket_value,
         sum(coalesce(airport_tax, 0) + coalesce(local_tax, 0)) AS tax_amount,
         sum(CASE WHEN total_amount IS NOT NULL AND total_amount <> 0
                  THEN (coalesce(airport_tax, 0) + coalesce(local_tax, 0)) / total_amount END) AS tax_share_sum
  FROM tickets_clean
  GROUP BY route_code, strftime(departure, '%Y-%m'), {_cabin('class')}
),
cells_enriched AS (
  SELECT c.route_code, c.departure_date, c.departure_month, c.cabin_class,
         CAST(c.tickets AS DOUBLE) AS tickets, c.revenue, c.avg_ticket_value, c.tax_amount, c.tax_share_sum,
         c.tax_share_sum / nullif(CAST(c.tickets AS DOUBLE), 0) AS tax_share,
         r.origin, r.destination, r.distance, r.flight_minutes, r.origin_airport, r.origin_city,
         r.origin_country, r.origin_continent, r.origin_airport_tax_ref, r.destination_airport,
         r.destination_city, r.destination_country, r.destination_continent,
         r.destination_airport_tax_ref, r.route_label, r.flight_hours
  FROM cells c LEFT JOIN route_dim r ON c.route_code = r.route_code
)
"""


def q(body: str) -> str:
    return f"WITH {CTES.strip()}\n{body.strip()}\n"


def dates_as_text(sql: str, columns: list[str]) -> str:
    """DATE columns as ISO text, as the registered Spark queries render them."""
    repl = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({repl}) FROM ({sql})"


ROUTE_KEYS = "route_code, route_label, origin, destination, origin_country, destination_country, origin_continent, destination_continent"
EFF_KEYS = "route_code, route_label, origin, destination, distance, flight_minutes, origin_continent, destination_continent"
TAX_KEYS = "route_code, route_label, origin, destination"


def _nf(keys: str) -> str:
    return ", ".join(f"{k.strip()} ASC NULLS FIRST" for k in keys.split(","))


# ---- measures by grain ------------------------------------------------------
def _tickets(cells: bool) -> str:
    return "coalesce(sum(tickets), 0.0)" if cells else "count(*)"


def _revenue(cells: bool) -> str:
    return _sum0("revenue") if cells else _sum0("total_amount")


def _avg_value(cells: bool) -> str:
    if cells:
        return f"{_sum0('revenue')} / nullif(coalesce(sum(tickets), 0.0), 0)"
    return "avg(total_amount)"


def _tax(cells: bool) -> str:
    return _sum0("tax_amount")


def _tax_share(cells: bool) -> str:
    if cells:
        return "coalesce(sum(tax_share_sum), 0.0) / nullif(coalesce(sum(tickets), 0.0), 0)"
    return "avg(tax_share)"


def _mart_revenue_by_month(src: str, cells: bool) -> str:
    return f"""SELECT departure_month, cabin_class, {_revenue(cells)} AS revenue, {_tickets(cells)} AS tickets
FROM {src} GROUP BY departure_month, cabin_class"""


def _mart_cabin_mix(src: str, cells: bool) -> str:
    return f"""SELECT *, revenue / nullif(sum(revenue) OVER (), 0) AS revenue_share
FROM (SELECT cabin_class, {_tickets(cells)} AS tickets, {_revenue(cells)} AS revenue, {_avg_value(cells)} AS avg_ticket_value
      FROM {src} GROUP BY cabin_class)"""


def _mart_revenue_by_route(src: str, cells: bool) -> str:
    return f"""SELECT {ROUTE_KEYS}, {_tickets(cells)} AS tickets, {_revenue(cells)} AS revenue,
       {_avg_value(cells)} AS avg_ticket_value, {_tax(cells)} AS tax_amount
FROM {src} GROUP BY {ROUTE_KEYS}"""


def _mart_route_efficiency(src: str, cells: bool) -> str:
    return f"""SELECT *, revenue / nullif(distance, 0) AS revenue_per_distance,
       avg_ticket_value / nullif(distance, 0) AS avg_ticket_value_per_distance,
       avg_ticket_value / nullif(flight_minutes, 0) AS avg_ticket_value_per_minute
FROM (SELECT {EFF_KEYS}, {_tickets(cells)} AS tickets, {_revenue(cells)} AS revenue,
             {_avg_value(cells)} AS avg_ticket_value
      FROM {src} GROUP BY {EFF_KEYS})"""


def _mart_tax_by_route(src: str, cells: bool) -> str:
    return f"""SELECT {TAX_KEYS}, {_tickets(cells)} AS tickets, {_revenue(cells)} AS revenue,
       {_tax(cells)} AS tax_amount, round({_tax_share(cells)}, 6) AS avg_tax_share
FROM {src} GROUP BY {TAX_KEYS}"""


def _mart_fleet(src: str, cells: bool = False) -> str:
    sold = "coalesce(sum(tickets_sold), 0.0)" if cells else "CAST(coalesce(sum(tickets_sold), 0) AS BIGINT)"
    return f"""SELECT airplane, model, count(*) AS scheduled_flights,
       {_sum0('distance')} AS assigned_distance,
       {_sum0('ticket_revenue')} AS ticket_revenue,
       {sold} AS tickets_sold,
       max(seat_capacity) AS seat_capacity,
       round(avg(estimated_load_factor), 6) AS avg_load_factor,
       {_sum0('estimated_fuel_gallons')} AS estimated_fuel_gallons,
       max(aircraft_age_years) AS aircraft_age_years,
       max(maintenance_takeoffs) AS maintenance_takeoffs
FROM {src} GROUP BY airplane, model"""


SEGMENTS = f"""SELECT passenger_country, vip_segment, age_band, cabin_class, count(*) AS tickets,
       {_sum0('total_amount')} AS revenue, avg(total_amount) AS avg_ticket_value
FROM tickets_enriched GROUP BY passenger_country, vip_segment, age_band, cabin_class"""

ROLLUP = f"""SELECT vip_segment, age_band, cabin_class, CAST(coalesce(sum(tickets), 0) AS BIGINT) AS tickets,
       {_sum0('revenue')} AS revenue, round(avg(avg_ticket_value), 4) AS avg_ticket_value
FROM ({SEGMENTS}) GROUP BY vip_segment, age_band, cabin_class"""

TICKET_SLICE_WHERE = """departure_date >= DATE '1996-01-01' AND departure_date <= DATE '1998-12-31'
  AND cabin_class IN ('ECONOMY', 'BUSINESS') AND origin_continent IN ('ASIA', 'EUROPE')
  AND coalesce(distance, 0.0) >= 905.0"""
FLIGHT_MODELS = ", ".join(f"'M{i}'" for i in range(0, 25, 2))
FLIGHT_SLICE_WHERE = f"""origin_continent IN ('ASIA', 'EUROPE', 'AMERICA')
  AND destination_continent IN ('AFRICA', 'EUROPE') AND model IN ({FLIGHT_MODELS})"""


def _overview(tickets_src: str, flights_src: str, cells: bool) -> str:
    if cells:
        ticket_part = f"""SELECT {_revenue(True)} AS revenue, coalesce(sum(tickets), 0.0) AS tickets,
       {_avg_value(True)} AS avg_ticket_value, {_distinct_with_null('route_code')} AS routes,
       {_tax_share(True)} AS avg_tax_share FROM {tickets_src}"""
    else:
        ticket_part = f"""SELECT {_revenue(False)} AS revenue, count(*) AS tickets,
       {_avg_value(False)} AS avg_ticket_value, {_distinct_with_null('route_code')} AS routes,
       avg(tax_share) AS avg_tax_share FROM {tickets_src}"""
    flight_part = f"""SELECT count(*) AS scheduled_flights, {_distinct_with_null('airplane')} AS aircraft,
       avg(estimated_load_factor) AS avg_load_factor FROM {flights_src}"""
    rows = []
    for name in ["revenue", "tickets", "avg_ticket_value", "routes"]:
        rows.append(f"SELECT '{name}' AS metric, coalesce(CAST({name} AS DOUBLE), 0.0) AS value FROM tp")
    rows.append("SELECT 'avg_tax_share', round(coalesce(CAST(avg_tax_share AS DOUBLE), 0.0), 6) FROM tp")
    for name in ["scheduled_flights", "aircraft"]:
        rows.append(f"SELECT '{name}', coalesce(CAST({name} AS DOUBLE), 0.0) FROM fp WHERE scheduled_flights > 0")
    rows.append(
        "SELECT 'avg_load_factor', round(coalesce(CAST(avg_load_factor AS DOUBLE), 0.0), 6) FROM fp "
        "WHERE scheduled_flights > 0"
    )
    return f"SELECT * FROM (WITH tp AS ({ticket_part}), fp AS ({flight_part})\n" + "\nUNION ALL\n".join(rows) + ")"


def _findings() -> str:
    route = f"""SELECT 1 AS finding_id, 'Top revenue route is ' || coalesce(route_label, 'None') || ' ('
       || coalesce(route_code, 'None') || ') with ' || format('{{:,.0f}}', CAST(tickets AS DOUBLE))
       || ' tickets and ' || format('{{:,.0f}}', revenue) || ' total revenue.' AS finding
FROM ({_mart_revenue_by_route('tickets_enriched', False)})
ORDER BY revenue DESC NULLS FIRST, {_nf(ROUTE_KEYS)} LIMIT 1"""
    cabin = f"""SELECT 2 AS finding_id, coalesce(cabin_class, 'None') || ' is the largest cabin by revenue, contributing '
       || format('{{:.1f}}', revenue_share * 100) || '% of filtered ticket revenue.' AS finding
FROM ({_mart_cabin_mix('tickets_enriched', False)}) WHERE revenue_share IS NOT NULL
ORDER BY revenue DESC NULLS FIRST, cabin_class ASC NULLS FIRST LIMIT 1"""
    yld = f"""SELECT 3 AS finding_id, 'Highest yield route by revenue per distance is ' || coalesce(route_label, 'None')
       || ' at ' || format('{{:,.2f}}', revenue_per_distance) || ' revenue units per distance unit.' AS finding
FROM ({_mart_route_efficiency('tickets_enriched', False)}) WHERE revenue_per_distance IS NOT NULL
ORDER BY revenue_per_distance DESC NULLS LAST, {_nf(EFF_KEYS)} LIMIT 1"""
    fleet = """SELECT 4 AS finding_id, 'Most scheduled aircraft is ' || coalesce(airplane, 'None')
       || CASE WHEN model IS NOT NULL AND model <> '' THEN ' (' || model || ')' ELSE '' END
       || ' with ' || format('{:,.0f}', CAST(n AS DOUBLE)) || ' assigned flights.' AS finding
FROM (SELECT airplane, model, count(*) AS n FROM flights_enriched GROUP BY airplane, model)
ORDER BY n DESC NULLS FIRST, airplane ASC NULLS FIRST, model ASC NULLS FIRST LIMIT 1"""
    tax = f"""SELECT 5 AS finding_id, 'Highest average tax share appears on ' || coalesce(route_label, 'None')
       || ', where taxes average ' || format('{{:.1f}}', s * 100) || '% of ticket value.' AS finding
FROM (SELECT {TAX_KEYS}, avg(tax_share) AS s FROM tickets_enriched GROUP BY {TAX_KEYS}) WHERE s IS NOT NULL
ORDER BY s DESC NULLS LAST, {_nf(TAX_KEYS)} LIMIT 1"""
    return "\nUNION ALL\n".join(f"SELECT * FROM ({part})" for part in [route, cabin, yld, fleet, tax])


def _ranked(inner: str, order: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({inner}))
WHERE rank <= {n}"""


ROUTE_ORDER = f"revenue DESC NULLS FIRST, {_nf(ROUTE_KEYS)}"
YIELD_ORDER = f"revenue_per_distance DESC NULLS LAST, {_nf(EFF_KEYS)}"
TAX_ORDER = f"avg_tax_share DESC NULLS LAST, {_nf(TAX_KEYS)}"
FLEET_ORDER = "scheduled_flights DESC NULLS FIRST, airplane ASC NULLS FIRST, model ASC NULLS FIRST"


def _tax_ranked(n: int) -> str:
    # rank on the unrounded share, then round
    inner = f"""SELECT {TAX_KEYS}, count(*) AS tickets, {_revenue(False)} AS revenue,
       {_tax(False)} AS tax_amount, avg(tax_share) AS avg_tax_share
FROM tickets_enriched GROUP BY {TAX_KEYS}"""
    return f"""SELECT * REPLACE (round(avg_tax_share, 6) AS avg_tax_share) FROM ({_ranked(inner, TAX_ORDER, n)})"""


def _number_text() -> str:
    part, supp, line = "CAST(l_partkey AS VARCHAR)", "CAST(l_suppkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)"
    v = "(l_orderkey + l_linenumber) % 8"
    return (
        f"CASE WHEN {v} = 0 THEN {part} || '.' || {line} WHEN {v} = 1 THEN ' ' || {supp} || 'e2 ' "
        f"WHEN {v} = 2 THEN '-' || {part} WHEN {v} = 3 THEN 'x' || {part} WHEN {v} = 4 THEN {part} || '_000' "
        f"WHEN {v} = 5 THEN '.' || {line} WHEN {v} = 6 THEN {part} || ' ' || {supp} ELSE '0x1p' || {line} END"
    )


def _timestamp_text() -> str:
    day = "strftime(l_shipdate, '%Y-%m-%d')"
    return (
        f"CASE l_linenumber WHEN 1 THEN {day} WHEN 2 THEN {day} || ' 10:30:00' "
        f"WHEN 3 THEN {day} || 'T23:59:59' WHEN 4 THEN {day} || ' 01:02:03.123456' "
        f"WHEN 5 THEN {day} || 'T04:05:06.5' WHEN 6 THEN {day} || ' 25:00:00' ELSE substr({day}, 1, 7) END"
    )


NUMBER_RE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
TIMESTAMP_RE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?)?$"


def _sliced_overview() -> str:
    return _overview(
        f"(SELECT * FROM tickets_enriched WHERE {TICKET_SLICE_WHERE})",
        f"(SELECT * FROM flights_enriched WHERE {FLIGHT_SLICE_WHERE})",
        False,
    )


def _row_counts() -> str:
    tables = [
        "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
        "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
    ]
    return "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in tables)


SQL: dict[str, str] = {
    "clean_strings": f"""SELECT o_orderkey,
       {_trim("CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderpriority WHEN 1 THEN o_orderpriority || chr(9) || chr(10) WHEN 2 THEN chr(13) || ' ' || o_orderpriority || ' ' || chr(12) ELSE o_orderpriority END")} AS priority,
       {_trim("' ' || o_orderstatus || chr(9)")} AS status
FROM orders""",
    "clean_numbers": f"""SELECT l_orderkey, l_linenumber, {_trim(_number_text())} AS raw_text,
       CASE WHEN regexp_matches({_trim(_number_text())}, '{NUMBER_RE}')
            THEN TRY_CAST({_trim(_number_text())} AS DOUBLE) END AS price
FROM lineitem""",
    "clean_timestamps": f"""SELECT l_orderkey, l_linenumber, {_timestamp_text()} AS raw_text,
       CASE WHEN regexp_matches({_timestamp_text()}, '{TIMESTAMP_RE}')
            THEN TRY_CAST({_timestamp_text()} AS TIMESTAMP) END AS departure
FROM lineitem""",
    "route_dimension": q("SELECT * FROM route_dim"),
    "tickets_enriched": q("SELECT * FROM tickets_enriched"),
    "flights_enriched": q("SELECT * FROM flights_enriched"),
    "ticket_summary": q("SELECT * REPLACE (round(tax_share_sum, 9) AS tax_share_sum) FROM cells"),
    "ticket_by_flight": q("SELECT * FROM ticket_by_flight"),
    "ticket_summary_enriched": q(
        "SELECT * REPLACE (round(tax_share_sum, 9) AS tax_share_sum, round(tax_share, 9) AS tax_share) FROM cells_enriched"
    ),
    "flights_enriched_cells": q("SELECT * FROM flights_enriched_cells"),
    "revenue_by_month": q(_mart_revenue_by_month("tickets_enriched", False)),
    "cabin_mix": q(_mart_cabin_mix("tickets_enriched", False)),
    "revenue_by_route": q(_mart_revenue_by_route("tickets_enriched", False)),
    "route_efficiency": q(_mart_route_efficiency("tickets_enriched", False)),
    "fleet_utilization": q(_mart_fleet("flights_enriched")),
    "fleet_by_model": q(
        f"""SELECT model, {_distinct_with_null('airplane')} AS aircraft, count(*) AS scheduled_flights,
       avg(seat_capacity) AS avg_seat_capacity, round(avg(estimated_load_factor), 6) AS avg_load_factor,
       {_sum0('estimated_fuel_gallons')} AS estimated_fuel_gallons
FROM flights_enriched GROUP BY model"""
    ),
    "passenger_segments": q(SEGMENTS),
    "tax_by_route": q(_mart_tax_by_route("tickets_enriched", False)),
    "segment_rollup": q(ROLLUP),
    "revenue_by_month_cells": q(_mart_revenue_by_month("cells_enriched", True)),
    "cabin_mix_cells": q(_mart_cabin_mix("cells_enriched", True)),
    "revenue_by_route_cells": q(_mart_revenue_by_route("cells_enriched", True)),
    "route_efficiency_cells": q(_mart_route_efficiency("cells_enriched", True)),
    "tax_by_route_cells": q(_mart_tax_by_route("cells_enriched", True)),
    "segments_cells": q(
        f"""SELECT cabin_class, {_tickets(True)} AS tickets, {_revenue(True)} AS revenue,
       {_avg_value(True)} AS avg_ticket_value FROM cells_enriched GROUP BY cabin_class"""
    ),
    "fleet_utilization_cells": q(_mart_fleet("flights_enriched_cells", True)),
    "top_routes": q(_ranked(_mart_revenue_by_route("tickets_enriched", False), ROUTE_ORDER, 12)),
    "top_yield": q(_ranked(_mart_route_efficiency("tickets_enriched", False), YIELD_ORDER, 15)),
    "top_aircraft": q(_ranked(_mart_fleet("flights_enriched"), FLEET_ORDER, 15)),
    "top_tax_routes": q(_tax_ranked(15)),
    "efficiency_table": q(
        f"""SELECT route_code, route_label, tickets, revenue, avg_ticket_value, distance, flight_minutes,
       revenue_per_distance, avg_ticket_value_per_minute, rank
FROM ({_ranked(_mart_route_efficiency('tickets_enriched', False), YIELD_ORDER, 50)})"""
    ),
    "fleet_table": q(_ranked(_mart_fleet("flights_enriched"), FLEET_ORDER, 50)),
    "route_table": q(_ranked(_mart_revenue_by_route("tickets_enriched", False), ROUTE_ORDER, 100)),
    "segment_top": q(
        _ranked(
            ROLLUP.replace("round(avg(avg_ticket_value), 4)", "avg(avg_ticket_value)"),
            "revenue DESC NULLS FIRST, vip_segment ASC NULLS FIRST, age_band ASC NULLS FIRST, cabin_class ASC NULLS FIRST",
            20,
        ).replace("SELECT * FROM", "SELECT * REPLACE (round(avg_ticket_value, 4) AS avg_ticket_value) FROM", 1)
    ),
    "filter_tickets": q(f"SELECT * FROM tickets_enriched WHERE {TICKET_SLICE_WHERE}"),
    "filter_tickets_cells": q(
        "SELECT * REPLACE (round(tax_share_sum, 9) AS tax_share_sum, round(tax_share, 9) AS tax_share) "
        f"FROM cells_enriched WHERE {TICKET_SLICE_WHERE}"
    ),
    "filter_flights": q(f"SELECT * FROM flights_enriched WHERE {FLIGHT_SLICE_WHERE}"),
    "scatter_source": q(
        f"""SELECT * FROM ({_mart_route_efficiency('tickets_enriched', False)})
WHERE distance IS NOT NULL AND avg_ticket_value IS NOT NULL AND revenue_per_distance IS NOT NULL"""
    ),
    "filter_options": q(
        """SELECT DISTINCT 'cabin_class' AS field, cabin_class AS value FROM tickets_enriched WHERE cabin_class IS NOT NULL
UNION ALL SELECT DISTINCT 'origin_continent', origin_continent FROM tickets_enriched WHERE origin_continent IS NOT NULL
UNION ALL SELECT DISTINCT 'destination_continent', destination_continent FROM tickets_enriched WHERE destination_continent IS NOT NULL
UNION ALL SELECT DISTINCT 'route_code', route_code FROM tickets_enriched WHERE route_code IS NOT NULL
UNION ALL SELECT DISTINCT 'model', model FROM flights_enriched WHERE model IS NOT NULL"""
    ),
    "date_bounds": q("SELECT min(departure_date) AS min_date, max(departure_date) AS max_date FROM tickets_enriched"),
    "max_distance": q("SELECT coalesce(max(distance), 0.0) AS max_distance FROM tickets_enriched"),
    "overview_metrics": q(_overview("tickets_enriched", "flights_enriched", False)),
    "overview_metrics_cells": q(_overview("cells_enriched", "flights_enriched_cells", True)),
    "slice_overview": q(_sliced_overview()),
    "slice_revenue_by_route": q(
        _mart_revenue_by_route(f"(SELECT * FROM tickets_enriched WHERE {TICKET_SLICE_WHERE})", False)
    ),
    "key_findings": q(_findings()),
    "parquet_roundtrip": q(_mart_revenue_by_route("tickets_enriched", False)),
    "csv_roundtrip": q(_mart_revenue_by_month("tickets_enriched", False)),
    "normalized_columns": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "table_row_counts": _row_counts(),
}

_COUNTED = {
    "route_dimension": "route_dim",
    "tickets_enriched": "tickets_enriched",
    "flights_enriched": "flights_enriched",
    "revenue_by_month": f"({_mart_revenue_by_month('tickets_enriched', False)})",
    "revenue_by_route": f"({_mart_revenue_by_route('tickets_enriched', False)})",
    "route_efficiency": f"({_mart_route_efficiency('tickets_enriched', False)})",
    "fleet_utilization": f"({_mart_fleet('flights_enriched')})",
    "passenger_segments": f"({SEGMENTS})",
    "tax_by_route": f"({_mart_tax_by_route('tickets_enriched', False)})",
}
_CONTENT = {  # dataset: (numbers, texts)
    "route_dimension": ("distance flight_minutes flight_hours origin_airport_tax_ref", "route_code origin_city destination_country route_label"),
    "tickets_enriched": (
        "price total_amount tax_amount distance passenger_age departure_year",
        "ticket_id passenger_id route_code departure_month cabin_class route_label vip_segment age_band",
    ),
    "flights_enriched": ("seat_capacity tickets_sold ticket_revenue estimated_fuel_gallons aircraft_age_years", "flight_id route_code airplane model route_label"),
    "revenue_by_month": ("revenue tickets", "departure_month cabin_class"),
    "revenue_by_route": ("tickets revenue avg_ticket_value tax_amount", "route_code route_label origin_country destination_continent"),
    "route_efficiency": ("tickets revenue distance avg_ticket_value", "route_code route_label origin"),
    "fleet_utilization": ("scheduled_flights assigned_distance ticket_revenue tickets_sold seat_capacity estimated_fuel_gallons", "airplane model"),
    "passenger_segments": ("tickets revenue avg_ticket_value", "passenger_country vip_segment age_band cabin_class"),
    "tax_by_route": ("tickets revenue tax_amount", "route_code route_label destination"),
}


def _content(name: str, src: str) -> str:
    numbers, texts = (x.split() for x in _CONTENT[name])
    total = " + ".join(f"coalesce(sum(CAST({c} AS DOUBLE)), 0.0)" for c in numbers)
    chars = " + ".join(f"coalesce(sum(length({c})), 0)" for c in texts)
    nulls = " + ".join(f"count(*) - count({c})" for c in texts + numbers)
    return f"""SELECT '{name}' AS dataset, count(*) AS row_count, round({total} + 1e-4, 0) AS number_sum,
       CAST({chars} AS BIGINT) AS text_chars, {nulls} AS nulls FROM {src}"""


_BARS = ["revenue", "route_code", "route_label", "origin", "destination", "origin_country", "destination_country"]
_BARS += ["origin_continent", "destination_continent", "tickets", "avg_ticket_value", "tax_amount"]
SQL |= {
    "read_project_tables": "SELECT 'nation' AS source, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation "
    "UNION ALL SELECT 'customer', CAST(c_custkey AS BIGINT), c_name FROM customer",
    "summary_readers": SQL["ticket_summary"],
    "prepared_set": q(" UNION ALL ".join(_content(n, src) for n, src in _COUNTED.items())),
    "month_order": q(
        "SELECT *, row_number() OVER (ORDER BY departure_month ASC NULLS FIRST, cabin_class ASC NULLS FIRST) AS position "
        f"FROM ({_mart_revenue_by_month('tickets_enriched', False)})"
    ),
    "tax_table": q(_tax_ranked(50)),
    "route_bars": q(
        f"SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY {', '.join(f'{c} ASC NULLS FIRST' for c in _BARS)}) AS position "
        f"FROM ({_ranked(_mart_revenue_by_route('tickets_enriched', False), ROUTE_ORDER, 12)})"
    ),
    "slice_routes": q(
        "SELECT * FROM tickets_enriched WHERE destination_continent IN ('ASIA', 'AFRICA') AND route_code IN ("
        + ", ".join(f"'R{i}'" for i in range(1, 200, 3))
        + ")"
    ),
}

# The dashboard of one slice: each view's statement over the sliced facts.
_VIEW_SOURCES = {
    "overview": _overview("tickets_enriched", "flights_enriched", False),
    "findings": _findings(),
    "monthly": _mart_revenue_by_month("tickets_enriched", False),
    "cabin": _mart_cabin_mix("tickets_enriched", False),
    "scatter_source": f"""SELECT * FROM ({_mart_route_efficiency('tickets_enriched', False)})
WHERE distance IS NOT NULL AND avg_ticket_value IS NOT NULL AND revenue_per_distance IS NOT NULL""",
    "efficiency_table": f"""SELECT route_code, route_label, tickets, revenue, avg_ticket_value, distance, flight_minutes,
       revenue_per_distance, avg_ticket_value_per_minute
FROM ({_ranked(_mart_route_efficiency('tickets_enriched', False), YIELD_ORDER, 50)})""",
    "top_yield": _ranked(_mart_route_efficiency("tickets_enriched", False), YIELD_ORDER, 15),
    "top_aircraft": _ranked(_mart_fleet("flights_enriched"), FLEET_ORDER, 15),
    "fleet_table": _ranked(_mart_fleet("flights_enriched"), FLEET_ORDER, 50),
    "model_summary": f"""SELECT model, {_distinct_with_null('airplane')} AS aircraft, count(*) AS scheduled_flights,
       avg(seat_capacity) AS avg_seat_capacity, round(avg(estimated_load_factor), 6) AS avg_load_factor,
       {_sum0('estimated_fuel_gallons')} AS estimated_fuel_gallons
FROM flights_enriched GROUP BY model""",
    "top_taxes": _tax_ranked(15),
    "route_summary": _mart_revenue_by_route("tickets_enriched", False),
    "route_table": _ranked(_mart_revenue_by_route("tickets_enriched", False), ROUTE_ORDER, 100),
    "segments": f"""SELECT vip_segment, age_band, cabin_class, tickets, revenue, round(avg_ticket_value, 4) AS avg_ticket_value
FROM ({_ranked(ROLLUP.replace("round(avg(avg_ticket_value), 4)", "avg(avg_ticket_value)"), "revenue DESC NULLS FIRST, vip_segment ASC NULLS FIRST, age_band ASC NULLS FIRST, cabin_class ASC NULLS FIRST", 20)})""",
}


def _sliced(body: str) -> str:
    slices = f"""sliced_tickets AS (SELECT * FROM tickets_enriched WHERE {TICKET_SLICE_WHERE}),
sliced_flights AS (SELECT * FROM flights_enriched WHERE origin_continent IN ('ASIA', 'EUROPE') AND model IN ({FLIGHT_MODELS}))"""
    body = body.replace("tickets_enriched", "sliced_tickets").replace("flights_enriched", "sliced_flights")
    return f"WITH {CTES.strip()},\n{slices}\n{body.strip()}\n"


SQL |= {f"view_{name}": _sliced(body) for name, body in _VIEW_SOURCES.items()}
SQL["merged_base"] = SQL["revenue_by_route"]
SQL |= {"colocated_tickets": SQL["tickets_enriched"], "colocated_flights": SQL["flights_enriched"], "month_slice": SQL["filter_tickets"]}
SQL["catalog_tables"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) AS row_estimate, '{picked}' AS picked FROM {t}"
    for t, picked in (("customer", "c_name,c_custkey"), ("nation", "n_name"), ("orders", "o_orderkey,o_custkey"))
)

for _name in ["slice_routes", "colocated_tickets", "month_slice", "summary_readers", "tickets_enriched", "ticket_summary", "ticket_summary_enriched", "filter_tickets", "filter_tickets_cells"]:
    SQL[_name] = dates_as_text(SQL[_name], ["departure_date"])
SQL["date_bounds"] = dates_as_text(SQL["date_bounds"], ["min_date", "max_date"])

# Presentation: sums to four decimals, means and ratios to six, after a shift
# that keeps ties off the last digit (see ``registry.sums_rounded``).
_SIX = ("avg_ticket_value", "revenue_share", "revenue_per_distance", "avg_ticket_value_per_distance", "avg_ticket_value_per_minute")
_ROUTE = ["revenue", "avg_ticket_value", "tax_amount"]
_YIELD = ["revenue", "avg_ticket_value", "revenue_per_distance", "avg_ticket_value_per_distance", "avg_ticket_value_per_minute"]
_FLEET = ["assigned_distance", "ticket_revenue", "estimated_fuel_gallons"]
ROUNDED: dict[str, list[str]] = {
    **dict.fromkeys(["tickets_enriched", "filter_tickets", "slice_routes", "colocated_tickets", "month_slice"], ["tax_amount"]),
    **dict.fromkeys(["flights_enriched", "flights_enriched_cells", "filter_flights", "colocated_flights"], ["ticket_revenue", "estimated_fuel_gallons"]),
    **dict.fromkeys(["ticket_summary", "summary_readers", "ticket_summary_enriched", "filter_tickets_cells"], _ROUTE),
    **dict.fromkeys(["revenue_by_route", "revenue_by_route_cells", "top_routes", "route_table", "slice_revenue_by_route", "parquet_roundtrip", "route_bars"], _ROUTE),
    "ticket_by_flight": ["ticket_revenue"],
    **dict.fromkeys(["revenue_by_month", "revenue_by_month_cells", "csv_roundtrip", "month_order"], ["revenue"]),
    **dict.fromkeys(["cabin_mix", "cabin_mix_cells"], ["revenue", "avg_ticket_value", "revenue_share"]),
    **dict.fromkeys(["route_efficiency", "route_efficiency_cells", "top_yield", "scatter_source"], _YIELD),
    "efficiency_table": [c for c in _YIELD if c != "avg_ticket_value_per_distance"],
    **dict.fromkeys(["fleet_utilization", "fleet_utilization_cells", "top_aircraft", "fleet_table"], _FLEET),
    "fleet_by_model": ["estimated_fuel_gallons"],
    **dict.fromkeys(["passenger_segments", "segment_rollup", "segments_cells", "segment_top"], ["revenue", "avg_ticket_value"]),
    **dict.fromkeys(["tax_by_route", "tax_by_route_cells", "top_tax_routes", "tax_table"], ["revenue", "tax_amount"]),
    **dict.fromkeys(["overview_metrics", "overview_metrics_cells", "slice_overview", "view_overview"], ["value"]),
    "view_monthly": ["revenue"],
    "view_cabin": ["revenue", "avg_ticket_value", "revenue_share"],
    **dict.fromkeys(["view_scatter_source", "view_top_yield"], _YIELD),
    "view_efficiency_table": [c for c in _YIELD if c != "avg_ticket_value_per_distance"],
    **dict.fromkeys(["view_top_aircraft", "view_fleet_table"], _FLEET),
    "view_model_summary": ["estimated_fuel_gallons"],
    "view_top_taxes": ["revenue", "tax_amount"],
    **dict.fromkeys(["view_route_summary", "view_route_table", "merged_base"], _ROUTE),
    "view_segments": ["revenue", "avg_ticket_value"],
}
for _name, _columns in ROUNDED.items():
    _rounds = ", ".join(f"round({c} + 1e-8, {6 if c in _SIX else 4}) AS {c}" for c in _columns)
    SQL[_name] = f"SELECT * REPLACE ({_rounds}) FROM ({SQL[_name]})"
