"""The seven tables, their keys, defaults and rules. Nothing is inferred on load."""

from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from slotwise.functions.filters import BREACH_MONTH, MONTH_COLUMN


def _table(required: dict, optional: dict) -> StructType:
    return StructType(
        [StructField(n, t, False) for n, t in required.items()]
        + [StructField(n, t, True) for n, t in optional.items()]
    )


# Delays and flags are integers, not shorts: adding shorts overflows under ANSI mode.
AIRLINES = _table(
    {"carrier_code": StringType(), "carrier_name": StringType()},
    {"country": StringType(), "created_at": TimestampType()},
)
AIRPORTS = _table(
    {"airport_code": StringType(), "airport_name": StringType(), "city": StringType()},
    {
        "state": StringType(),
        "latitude": DecimalType(9, 6),
        "longitude": DecimalType(9, 6),
        "timezone": StringType(),
    },
)
ROUTES = _table(
    {
        "route_id": IntegerType(),
        "carrier_code": StringType(),
        "origin": StringType(),
        "destination": StringType(),
        "scheduled_mins": IntegerType(),
    },
    {},
)
FLIGHTS = _table(
    {
        "flight_id": LongType(),
        "route_id": IntegerType(),
        "flight_date": DateType(),
        "flight_number": StringType(),
        "scheduled_dep": IntegerType(),
        "scheduled_arr": IntegerType(),
    },
    {
        "actual_dep": IntegerType(),
        "actual_arr": IntegerType(),
        "dep_delay_mins": IntegerType(),
        "arr_delay_mins": IntegerType(),
        "cancelled": IntegerType(),
        "diverted": IntegerType(),
        "carrier_delay": IntegerType(),
        "weather_delay": IntegerType(),
        "nas_delay": IntegerType(),
        "security_delay": IntegerType(),
        "late_aircraft_delay": IntegerType(),
        "distance_miles": IntegerType(),
        "created_at": TimestampType(),
    },
)
SLA_RULES = _table(
    {
        "rule_id": IntegerType(),
        "max_delay_rate_pct": DecimalType(5, 2),
        "min_flights_window": IntegerType(),
        "window_days": IntegerType(),
    },
    {
        "carrier_code": StringType(),
        "created_at": TimestampType(),
        "updated_at": TimestampType(),
        "updated_by": StringType(),
    },
)
# Ids and counts of breaches are wide: one route may hold billions of rows.
SLA_BREACH_LOG = _table(
    {
        "breach_id": LongType(),
        "route_id": IntegerType(),
        "breach_date": DateType(),
        "delay_rate_pct": DecimalType(5, 2),
        "total_flights": LongType(),
        "delayed_flights": LongType(),
        "rule_id": IntegerType(),
    },
    {"resolved": IntegerType(), "created_at": TimestampType()},
)
AUDIT_LOG = _table(
    {
        "audit_id": StringType(),
        "table_name": StringType(),
        "operation": StringType(),
        "record_id": LongType(),
    },
    {
        "changed_by": StringType(),
        "changed_at": TimestampType(),
        "old_values": StringType(),
        "new_values": StringType(),
    },
)

# Resolution events of an append-only breach log.
RESOLUTIONS = _table({"breach_id": LongType(), "resolved_at": TimestampType()}, {})

TABLES = {
    "airlines": AIRLINES,
    "airports": AIRPORTS,
    "routes": ROUTES,
    "flights": FLIGHTS,
    "sla_rules": SLA_RULES,
    "sla_breach_log": SLA_BREACH_LOG,
    "audit_log": AUDIT_LOG,
}

# Stored tables: the schemas above plus their partition columns.
PERIOD_COLUMN = "period"
FLIGHTS_STORED = StructType(FLIGHTS.fields + [StructField(MONTH_COLUMN, IntegerType(), False)])
QUARANTINE_STORED = StructType(
    [StructField(field.name, field.dataType) for field in FLIGHTS]
    + [
        StructField("reject_reason", StringType()),
        StructField("row_digest", StringType()),
        StructField(MONTH_COLUMN, IntegerType()),
    ]
)
BREACHES_STORED = StructType(SLA_BREACH_LOG.fields + [StructField(BREACH_MONTH, IntegerType())])
AUDIT_STORED = StructType(AUDIT_LOG.fields + [StructField(PERIOD_COLUMN, IntegerType(), False)])

# Unique keys, foreign keys, defaults and closed value lists per table.
KEYS = {
    "airlines": [("carrier_code",)],
    "airports": [("airport_code",)],
    "routes": [("route_id",), ("carrier_code", "origin", "destination")],
    "flights": [("flight_id",)],
    "sla_rules": [("rule_id",)],
    "sla_breach_log": [("breach_id",), ("route_id", "breach_date", "rule_id")],
    "audit_log": [("audit_id",)],
}
FOREIGN_KEYS = [
    ("routes", "carrier_code", "airlines", "carrier_code"),
    ("routes", "origin", "airports", "airport_code"),
    ("routes", "destination", "airports", "airport_code"),
    ("flights", "route_id", "routes", "route_id"),
    ("sla_rules", "carrier_code", "airlines", "carrier_code"),
    ("sla_breach_log", "route_id", "routes", "route_id"),
    ("sla_breach_log", "rule_id", "sla_rules", "rule_id"),
]
DEFAULTS = {
    "airlines": {"country": "USA"},
    "airports": {"timezone": "America/New_York"},
    "flights": {
        "dep_delay_mins": 0,
        "arr_delay_mins": 0,
        "cancelled": 0,
        "diverted": 0,
        "carrier_delay": 0,
        "weather_delay": 0,
        "nas_delay": 0,
        "security_delay": 0,
        "late_aircraft_delay": 0,
    },
    "sla_rules": {"max_delay_rate_pct": 15.0, "min_flights_window": 100, "window_days": 30},
    "sla_breach_log": {"resolved": 0},
}
DOMAINS = {
    "flights": {"cancelled": [0, 1], "diverted": [0, 1]},
    "sla_breach_log": {"resolved": [0, 1]},
    "audit_log": {"operation": ["INSERT", "UPDATE", "DELETE"]},
}
LENGTHS = {
    "airlines": {"carrier_name": 100, "country": 50},
    "airports": {"airport_name": 150, "city": 100, "timezone": 50},
    "flights": {"flight_number": 8},
}
CODES = ("carrier_code", "airport_code", "origin", "destination")
