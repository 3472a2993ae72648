"""Reusable projections over the star. Cancelled rows are included in all three."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.config import CAUSES, DEFAULT_LIMITS, Limits
from slotwise.functions.bands import flag, is_late
from slotwise.functions.columns import arr_delay, route
from slotwise.functions.filters import date_range
from slotwise.functions.measures import (
    averaged,
    highest,
    lowest,
    merge,
    rows,
    rows_where,
    summarise,
    total,
)
from slotwise.functions.rates import mean, pct


def flight_details(
    f: DataFrame, r: DataFrame, a: DataFrame, ap: DataFrame, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Facts with route, carrier, both airports and delay flags.

    The dimensions are joined one by one, each straight from its own scan: the planner then
    knows every size and broadcasts what fits, so the facts stay where they were read.
    """
    start, end = ap.alias("start"), ap.alias("end")
    return (
        f.join(r, "route_id")
        .join(a, "carrier_code")
        .join(start, F.col("origin") == F.col("start.airport_code"))
        .join(end, F.col("destination") == F.col("end.airport_code"))
        .select(
            "flight_id",
            "flight_date",
            "flight_number",
            "carrier_code",
            "carrier_name",
            "origin",
            F.col("start.city").alias("origin_city"),
            F.col("start.state").alias("origin_state"),
            "destination",
            F.col("end.city").alias("dest_city"),
            F.col("end.state").alias("dest_state"),
            "dep_delay_mins",
            "arr_delay_mins",
            "cancelled",
            "diverted",
            *[f"{c}_delay" for c in CAUSES],
            "distance_miles",
            flag(is_late(arr_delay(), limits.delayed_mins)).alias("is_delayed"),
            flag(is_late(arr_delay(), limits.severe_mins)).alias("is_severely_delayed"),
            flag(arr_delay() < 0).alias("is_early"),
        )
    )


def carrier_monthly_scorecard(
    f: DataFrame,
    r: DataFrame,
    a: DataFrame,
    ap: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """On-time figures per carrier and calendar month."""
    late = is_late(arr_delay(), limits.delayed_mins)
    measures = [
        rows("total_flights"),
        total("cancelled_flights", F.col("cancelled")),
        rows_where("delayed_flights", late),
        rows_where("severe_delays", is_late(arr_delay(), limits.severe_mins)),
        rows_where("early_flights", arr_delay() < 0),
        *averaged("arr", arr_delay()),
        total("late_sum", F.when(late, arr_delay())),
    ]
    month = [F.year("flight_date").alias("yr"), F.month("flight_date").alias("mo")]
    per_route = summarise(date_range(f, start, end), ["route_id", *month], measures)
    known = (
        r.join(a, "carrier_code")
        .join(ap.select(F.col("airport_code").alias("origin")), "origin")
        .join(ap.select(F.col("airport_code").alias("destination")), "destination")
        .select("route_id", "carrier_code", "carrier_name")
    )
    all_rows = F.col("total_flights")
    return merge(
        per_route.join(known, "route_id"), ["carrier_code", "carrier_name", "yr", "mo"], measures
    ).select(
        "carrier_code",
        "carrier_name",
        "yr",
        "mo",
        "total_flights",
        "cancelled_flights",
        "delayed_flights",
        "severe_delays",
        mean(F.col("arr_sum"), F.col("arr_n")).alias("avg_arr_delay"),
        mean(F.col("late_sum"), F.col("delayed_flights")).alias("avg_delay_when_late"),
        pct(F.col("delayed_flights"), all_rows).alias("delay_rate_pct"),
        pct(F.col("cancelled_flights"), all_rows).alias("cancel_rate_pct"),
        pct(F.col("early_flights"), all_rows).alias("early_rate_pct"),
    )


def route_performance(f: DataFrame, r: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """All-time figures per route; one aggregation, then the dimension."""
    measures = [
        rows("total_flights"),
        *averaged("arr", arr_delay()),
        rows_where("delayed", is_late(arr_delay(), limits.delayed_mins)),
        total("cancelled_flights", F.col("cancelled")),
        highest("worst_delay", arr_delay()),
        lowest("best_time", arr_delay()),
    ]
    return (
        summarise(f, ["route_id"], measures)
        .join(r, "route_id")
        .select(
            "route_id",
            "carrier_code",
            "origin",
            "destination",
            route().alias("route_label"),
            "total_flights",
            mean(F.col("arr_sum"), F.col("arr_n")).alias("avg_arr_delay"),
            pct(F.col("delayed"), F.col("total_flights")).alias("delay_rate_pct"),
            pct(F.col("cancelled_flights"), F.col("total_flights")).alias("cancel_rate_pct"),
            "worst_delay",
            "best_time",
        )
    )
