"""Derives the flight star from the given order tables.

The order tables have no promised or received time, so delays come from integer arithmetic
over keys and dates. One movement per line item: the part type is the carrier, the supplier's
nation the origin, the customer's nation the destination.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.keys import route_dimension
from slotwise.sources.schemas import AIRLINES, AIRPORTS, FLIGHTS

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Fixed values of the mapping: two calendar anchors, the modulus that packs the keys, and
# the percentage of a delay charged to each cause (late aircraft takes the rest).
SHIP_EPOCH = dt.date(1995, 1, 1)
FIRST_DAY = dt.date(2023, 1, 1)
ID_MODULUS = 9007199254740881
CAUSE_SHARES = {"carrier": 35, "weather": 20, "nas": 20, "security": 2}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their carrier, origin and destination, not yet keyed by route.

    Customers meet the orders before the line items do, so the widest table takes part in
    three joins instead of four. No side is hinted: the planner broadcasts what its file
    size allows, and adaptive execution splits skewed partitions of the rest.
    """
    orders = (
        _read(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("ordered"))
        .join(
            _read(spark, sf_dir, "customer").select(
                F.col("c_custkey").alias("o_custkey"),
                F.col("c_nationkey").cast("string").alias("destination"),
            ),
            "o_custkey",
        )
        .drop("o_custkey")
    )
    items = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_suppkey").alias("s_suppkey"),
        "l_linenumber",
        F.col("l_quantity").cast("int").alias("quantity"),
        F.to_date("l_shipdate").alias("shipped"),
    )
    suppliers = _read(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").cast("string").alias("origin")
    )
    parts = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("carrier_code"))
    joined = (
        items.join(orders, "o_orderkey").join(suppliers, "s_suppkey").join(parts, "p_partkey")
    )
    return _with_delays(joined)


def _with_delays(joined: DataFrame) -> DataFrame:
    order, part, supp, line = (
        F.col(c) for c in ("o_orderkey", "p_partkey", "s_suppkey", "l_linenumber")
    )
    lag = F.abs(F.datediff("shipped", "ordered"))
    h = (order * 7 + part * 3 + line * 11) % 100
    packed = (((order * 1000003 + part) % ID_MODULUS) * 1009 + supp) % ID_MODULUS * 8 + line
    is_cancelled = F.col("cancelled") == 1
    arrival = (
        F.when(is_cancelled, 0)
        .when(F.col("h") < 30, -1 - F.col("lag") % 20)
        .when(F.col("h") < 72, F.col("lag") % 15)
        .when(F.col("h") < 87, 15 + F.col("lag") % 31)
        .when(F.col("h") < 95, 46 + F.col("lag") % 75)
        .otherwise(121 + F.col("lag") % 360)
    )
    charged = {
        f"{cause}_delay": _share(F.col("late"), share) for cause, share in CAUSE_SHARES.items()
    }
    rest = F.col("late")
    for name in charged:
        rest = rest - F.col(name)
    return (
        joined.withColumns(
            {
                "flight_id": packed,
                "flight_date": F.date_add(
                    F.lit(FIRST_DAY), F.datediff("shipped", F.lit(SHIP_EPOCH)) % 365
                ),
                "flight_number": F.concat(F.lit("M"), (order % 900 + 100).cast("string")),
                "scheduled_dep": ((6 + (part + supp) % 15) * 100).cast("int"),
                "lag": lag,
                "h": h,
                "cancelled": F.when((order + part) % 50 == 0, 1).otherwise(0),
                "distance_miles": (300 + (part * 7 + supp) % 2501).cast("int"),
            }
        )
        .withColumn("arr_delay_mins", arrival.cast("int"))
        .withColumns(
            {
                "dep_delay_mins": F.when(is_cancelled, 0).otherwise(
                    F.col("arr_delay_mins") + F.col("quantity") % 16 - 3
                ),
                "late": F.greatest("arr_delay_mins", F.lit(0)),
                "scheduled_arr": F.col("scheduled_dep") + 120,
            }
        )
        .withColumns(
            {
                **charged,
                "actual_dep": F.when(
                    ~is_cancelled, F.col("scheduled_dep") + F.col("dep_delay_mins")
                ),
                "actual_arr": F.when(
                    ~is_cancelled, F.col("scheduled_arr") + F.col("arr_delay_mins")
                ),
            }
        )
        .withColumns(
            {
                "late_aircraft_delay": rest,
                "diverted": F.lit(0),
                "created_at": F.col("flight_date").cast("timestamp"),
            }
        )
        .select(
            "carrier_code", "origin", "destination", *[c for c in FLIGHTS.names if c != "route_id"]
        )
    )


def _share(delay: Column, percent: int) -> Column:
    return F.floor(delay * percent / 100).cast("int")


def scheduled_mins() -> Column:
    """Depends on the two airports only, so any row of a route gives it."""
    pair = F.col("origin").cast("int") * 25 + F.col("destination").cast("int")
    return F.max(50 + pair * 7 % 420)


def airlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _read(spark, sf_dir, "part").select(F.col("p_type").alias("carrier_code")).distinct()
    return codes.select(
        "carrier_code",
        F.col("carrier_code").alias("carrier_name"),
        F.lit("USA").alias("country"),
        F.lit(None).cast("timestamp").alias("created_at"),
    ).select(*AIRLINES.names)


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        key.cast("string").alias("airport_code"),
        F.col("n_name").alias("airport_name"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        (key + 25).cast("decimal(9,6)").alias("latitude"),
        (key * -2 - 70).cast("decimal(9,6)").alias("longitude"),
        F.lit("America/New_York").alias("timezone"),
    ).select(*AIRPORTS.names)


def routes(keyed: DataFrame) -> DataFrame:
    return route_dimension(keyed, scheduled_mins(), sort_code=lambda code: code.cast("int"))


def flights(keyed: DataFrame, r: DataFrame) -> DataFrame:
    natural = ["carrier_code", "origin", "destination"]
    return keyed.join(r.select("route_id", *natural), natural).select(*FLIGHTS.names)
