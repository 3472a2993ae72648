"""Small literal tables in the star's schema."""

import datetime as dt
from decimal import Decimal

from pyspark.sql.types import DecimalType, StructField, StructType

from slotwise.sources.schemas import TABLES

DAY = dt.date(2023, 6, 30)

BASE = {
    "airlines": {"carrier_code": "AA", "carrier_name": "Alpha", "country": "USA"},
    "airports": {"airport_code": "X", "airport_name": "X Field", "city": "X City"},
    "routes": {
        "route_id": 1,
        "carrier_code": "AA",
        "origin": "X",
        "destination": "Y",
        "scheduled_mins": 100,
    },
    "flights": {
        "flight_id": 1,
        "route_id": 1,
        "flight_date": DAY,
        "flight_number": "AA100",
        "scheduled_dep": 900,
        "scheduled_arr": 1020,
        "actual_dep": 900,
        "actual_arr": 1020,
        "dep_delay_mins": 0,
        "arr_delay_mins": 0,
        "cancelled": 0,
        "diverted": 0,
        "carrier_delay": 0,
        "weather_delay": 0,
        "nas_delay": 0,
        "security_delay": 0,
        "late_aircraft_delay": 0,
        "distance_miles": 500,
    },
    "sla_rules": {
        "rule_id": 1,
        "carrier_code": None,
        "max_delay_rate_pct": 15.0,
        "min_flights_window": 1,
        "window_days": 30,
    },
    "sla_breach_log": {
        "breach_id": 1,
        "route_id": 1,
        "breach_date": DAY,
        "delay_rate_pct": 25.0,
        "total_flights": 4,
        "delayed_flights": 1,
        "rule_id": 1,
        "resolved": 0,
        "created_at": dt.datetime(2023, 6, 30, 12),
    },
}


def table(spark, name, rows):
    """Rows are dicts of what differs from the base row; numbered keys count up."""
    schema = StructType([StructField(f.name, f.dataType) for f in TABLES[name]])
    filled = []
    for n, row in enumerate(rows, 1):
        merged = {**BASE[name], **row}
        if name in ("flights", "sla_breach_log"):
            key = "flight_id" if name == "flights" else "breach_id"
            merged.setdefault(key, n)
            if key not in row:
                merged[key] = n
        for field in schema:
            value = merged.get(field.name)
            if isinstance(field.dataType, DecimalType) and value is not None:
                merged[field.name] = Decimal(str(value))
        filled.append(tuple(merged.get(f.name) for f in schema))
    return spark.createDataFrame(filled, schema)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
