"""The reference's own unit-test tables (three tickets, two routes, ...)."""

from __future__ import annotations


def routes(spark):
    return spark.createDataFrame(
        [("R1", "MAD", "LHR", 1250.0, 150.0), ("R2", "BCN", "MAD", 500.0, 70.0)],
        "route_code string, origin string, destination string, distance double, flight_minutes double",
    )


def airports(spark):
    return spark.createDataFrame(
        [
            ("MAD", "Adolfo Suarez Madrid-Barajas", "Madrid", "Spain", "Europe", 40.5, -3.6, 10.0),
            ("BCN", "Barcelona El Prat", "Barcelona", "Spain", "Europe", 41.3, 2.1, 9.0),
            ("LHR", "Heathrow", "London", "United Kingdom", "Europe", 51.5, -0.4, 12.0),
        ],
        "iata_code string, airport string, city string, country string, continent string, "
        "latitude double, longitude double, airport_tax double",
    )


def tickets(spark):
    return spark.createDataFrame(
        [
            ("T1", "P1", "F1", "R1", "2026-01-01 10:00:00", "Economy", 100.0, 10.0, 5.0, 115.0),
            ("T2", "P2", "F1", "R1", "2026-01-01 10:00:00", "Business", 300.0, 10.0, 5.0, 315.0),
            ("T3", "P3", "F2", "R2", "2026-01-02 09:00:00", "Economy", 80.0, 9.0, 4.0, 93.0),
        ],
        "ticket_id string, passenger_id string, flight_id string, route_code string, departure string, "
        "class string, price double, airport_tax double, local_tax double, total_amount double",
    )


def airplanes(spark):
    return spark.createDataFrame(
        [
            ("A1", "A320", 12.0, 24.0, 120.0, "2020-01-01", 750.0, 1000.0),
            ("A2", "E190", 8.0, 12.0, 80.0, "2019-01-01", 520.0, 700.0),
        ],
        "aircraft_registration string, model string, seats_business double, seats_premium double, "
        "seats_economy double, build_date string, fuel_gallons_hour double, maintenance_flight_hours double",
    )


def flights(spark):
    return spark.createDataFrame(
        [
            ("F1", "R1", "2026-01-01 10:00:00", "2026-01-01 12:30:00", "A1"),
            ("F2", "R2", "2026-01-02 09:00:00", "2026-01-02 10:10:00", "A2"),
        ],
        "flight_id string, route_code string, departure string, arrival string, airplane string",
    )


def ticket_summary(spark):
    return spark.createDataFrame(
        [
            ("R1", "2026-01-01", "2026-01", "ECONOMY", "Spain", "Non-VIP", "25-34", 10.0, 1000.0, 100.0, 150.0, 1.5),
            ("R1", "2026-01-01", "2026-01", "BUSINESS", "Spain", "VIP", "35-49", 2.0, 800.0, 400.0, 80.0, 0.2),
            ("R2", "2026-01-02", "2026-01", "ECONOMY", "France", "Non-VIP", "25-34", 5.0, 300.0, 60.0, 45.0, 0.75),
        ],
        "route_code string, departure_date string, departure_month string, cabin_class string, "
        "passenger_country string, vip_segment string, age_band string, tickets double, revenue double, "
        "avg_ticket_value double, tax_amount double, tax_share_sum double",
    )
