"""Source tables: requested columns (upper-case, as stored in the source
database) and the Spark types they have after cleaning."""

from __future__ import annotations

# The six source tables and the columns read from each.
PROJECT_TABLES: dict[str, list[str]] = {
    "TICKETS": [
        "TICKET_ID",
        "PASSENGER_ID",
        "FLIGHT_ID",
        "ROUTE_CODE",
        "DEPARTURE",
        "CLASS",
        "PRICE",
        "AIRPORT_TAX",
        "LOCAL_TAX",
        "TOTAL_AMOUNT",
    ],
    "ROUTES": [
        "ROUTE_CODE",
        "ORIGIN",
        "DESTINATION",
        "PARENT_ROUTE",
        "LEG_NUMBER",
        "DISTANCE",
        "FLIGHT_MINUTES",
    ],
    "AIRPORTS": [
        "IATA_CODE",
        "AIRPORT",
        "CITY",
        "COUNTRY",
        "CONTINENT",
        "TIMEZONE",
        "LATITUDE",
        "LONGITUDE",
        "AIRPORT_TAX",
    ],
    "FLIGHTS": [
        "FLIGHT_ID",
        "FLIGHT_LEG",
        "FREQUENCY",
        "ROUTE_CODE",
        "DEPARTURE",
        "ARRIVAL",
        "AIRPLANE",
        "PRICE_ECONOMY",
        "PRICE_PREMIUM",
        "PRICE_BUSINESS",
    ],
    "AIRPLANES": [
        "AIRCRAFT_REGISTRATION",
        "MODEL",
        "SEATS_BUSINESS",
        "SEATS_PREMIUM",
        "SEATS_ECONOMY",
        "BUILD_DATE",
        "FUEL_GALLONS_HOUR",
        "MAINTENANCE_TAKEOFFS",
        "MAINTENANCE_FLIGHT_HOURS",
        "TOTAL_FLIGHT_DISTANCE",
    ],
    "PASSENGERS": [
        "ID",
        "GENDER",
        "BIRTH_DATE",
        "COUNTRY",
        "VIPCARD",
    ],
}

# The summary grain reads every table but tickets and passengers.
SUMMARY_DIMENSION_TABLES: dict[str, list[str]] = {
    table: columns for table, columns in PROJECT_TABLES.items() if table not in {"TICKETS", "PASSENGERS"}
}
