"""Airport reports: departure bottlenecks, propagation, pairs and time of day."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.config import DEFAULT_LIMITS, Limits
from slotwise.functions.bands import LONG_SLOTS, SLOTS, is_late, time_slot
from slotwise.functions.columns import arr_delay, dep_delay
from slotwise.functions.filters import date_range, flown, only
from slotwise.functions.measures import (
    averaged,
    highest,
    merge,
    rows,
    rows_where,
    summarise,
    total,
)
from slotwise.functions.rates import fixed, mean, pct, ratio
from slotwise.sources.scratch import settle


def departure_bottlenecks(
    f: DataFrame,
    r: DataFrame,
    ap: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    carrier: str | None = None,
    min_n: int = 50,
    k: int = 20,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The ``k`` origins with the highest mean departure delay.

    The rank only looks at better rows, so it is taken after the top-k and its window holds
    k rows however many airports there are.
    """
    measures = [
        rows("total_departures"),
        *averaged("dep", dep_delay()),
        rows_where("late_departures", is_late(dep_delay(), limits.delayed_mins)),
        highest("worst_dep_delay", dep_delay()),
        rows_where("extreme_delays", is_late(dep_delay(), limits.severe_mins)),
    ]
    per_route = summarise(date_range(flown(f), start, end), ["route_id"], measures)
    per_origin = merge(
        per_route.join(only(r, "carrier_code", carrier), "route_id"), ["origin"], measures
    )
    worst = (
        per_origin.filter(F.col("total_departures") >= min_n)
        .join(ap, F.col("origin") == ap.airport_code)
        .select(
            "airport_code",
            "airport_name",
            "city",
            "state",
            F.col("latitude").cast("double").alias("latitude"),
            F.col("longitude").cast("double").alias("longitude"),
            "total_departures",
            mean(F.col("dep_sum"), F.col("dep_n")).alias("avg_dep_delay"),
            pct(F.col("late_departures"), F.col("total_departures")).alias("dep_delay_rate_pct"),
            "worst_dep_delay",
            "extreme_delays",
        )
        .orderBy(F.desc("avg_dep_delay"), "airport_code")
        .limit(k)
    )
    rank = F.dense_rank().over(Window.orderBy(F.desc("avg_dep_delay")))
    return worst.select(rank.alias("delay_rank"), *worst.columns).orderBy(
        "delay_rank", "airport_code"
    )


def top_by_rate_of_worst(bottlenecks: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` by mean delay, shown in the order of their delay rate."""
    return (
        bottlenecks.orderBy(F.desc("avg_dep_delay"), "airport_code")
        .limit(k)
        .orderBy("dep_delay_rate_pct", "airport_code")
        .select("airport_code", "avg_dep_delay", "dep_delay_rate_pct")
    )


def delay_propagation(
    f: DataFrame,
    r: DataFrame,
    ap: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    carrier: str | None = None,
    min_n: int = 30,
    k: int = 15,
) -> DataFrame:
    """Origins where late incoming aircraft explain the largest part of the arrival delay."""
    measures = [
        rows("flights_affected"),
        *averaged("late_aircraft", F.col("late_aircraft_delay")),
        *averaged("carrier", F.col("carrier_delay")),
        *averaged("nas", F.col("nas_delay")),
        *averaged("arr", arr_delay()),
    ]
    affected = date_range(flown(f), start, end).filter(F.col("late_aircraft_delay") > 0)
    per_route = summarise(affected, ["route_id"], measures)
    per_origin = merge(
        per_route.join(only(r, "carrier_code", carrier), "route_id"), ["origin"], measures
    )
    incoming = ratio(F.col("late_aircraft_sum"), F.col("late_aircraft_n"))
    arrival = ratio(F.col("arr_sum"), F.col("arr_n"))
    return (
        per_origin.filter(F.col("flights_affected") >= min_n)
        .join(ap, F.col("origin") == ap.airport_code)
        .select(
            "airport_code",
            "city",
            "flights_affected",
            fixed(incoming, 2).alias("avg_late_aircraft_delay"),
            mean(F.col("carrier_sum"), F.col("carrier_n")).alias("avg_carrier_delay"),
            mean(F.col("nas_sum"), F.col("nas_n")).alias("avg_nas_delay"),
            fixed(ratio(incoming, arrival) * 100, 1).alias("propagation_ratio_pct"),
        )
        .orderBy(F.desc("propagation_ratio_pct"), "airport_code")
        .limit(k)
    )


def od_matrix(
    f: DataFrame,
    r: DataFrame,
    ap: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    carrier: str | None = None,
    min_n: int = 20,
    k: int = 25,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The ``k`` worst origin-destination pairs, with the delay beyond the schedule buffer."""
    measures = [
        rows("flights"),
        *averaged("arr", arr_delay()),
        rows_where("delayed", is_late(arr_delay(), limits.delayed_mins)),
    ]
    weighted = total("scheduled_sum", F.col("flights") * F.col("scheduled_mins"))
    per_route = summarise(date_range(flown(f), start, end), ["route_id"], measures)
    pairs = (
        per_route.join(only(r, "carrier_code", carrier), "route_id")
        .groupBy("origin", "destination")
        .agg(*[m.again() for m in measures], weighted.first())
        .filter(F.col("flights") >= min_n)
    )
    code, city = F.col("airport_code"), F.col("city")
    start_city = ap.select(code.alias("origin"), city.alias("origin_city"))
    end_city = ap.select(code.alias("destination"), city.alias("dest_city"))
    arrival = ratio(F.col("arr_sum"), F.col("arr_n"))
    scheduled = ratio(F.col("scheduled_sum"), F.col("flights"))
    return (
        pairs.join(start_city, "origin")
        .join(end_city, "destination")
        .select(
            "origin",
            "origin_city",
            "destination",
            "dest_city",
            "flights",
            fixed(arrival, 1).alias("avg_arr_delay"),
            pct(F.col("delayed"), F.col("flights"), 1).alias("delay_rate_pct"),
            fixed(arrival - scheduled * limits.buffer_share, 1).alias("delay_beyond_buffer"),
        )
        .orderBy(F.desc("avg_arr_delay"), "origin", "destination")
        .limit(k)
    )


def _listed(column: str, values: Sequence[str]):
    """The column; a value that is not listed ends the job instead of vanishing in a pivot."""
    stray = F.concat(F.lit(f"{column} outside the given columns: "), F.col(column))
    known = F.col(column).isNull() | F.col(column).isin(list(values))
    return F.when(known, F.col(column)).otherwise(F.raise_error(stray))


def od_pivot(matrix: DataFrame, destinations: Sequence[str] | None = None) -> DataFrame:
    """Delay rates of a matrix, one row per origin and one column per destination.

    Without a list the columns are the destinations of the matrix, at most its k rows.
    """
    if destinations is None:
        matrix = settle(matrix, "od-matrix")
        found = matrix.select("destination").where("destination is not null").distinct()
        destinations = sorted(row.destination for row in found.collect())
    matrix = matrix.withColumn("destination", _listed("destination", destinations))
    return matrix.groupBy("origin").pivot("destination", list(destinations)).agg(
        fixed(F.avg("delay_rate_pct"), 1)
    )


def time_of_day(
    f: DataFrame,
    r: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    carrier: str | None = None,
    slots: tuple = SLOTS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Departure delay per origin and slot of the day, under short or long slot names."""
    measures = [
        rows("flights"),
        *averaged("dep", dep_delay()),
        rows_where("delayed", is_late(dep_delay(), limits.delayed_mins)),
    ]
    slot = time_slot(F.col("scheduled_dep"), slots).alias("time_slot")
    per_route = summarise(date_range(flown(f), start, end), ["route_id", slot], measures)
    return (
        merge(
            per_route.join(only(r, "carrier_code", carrier), "route_id"),
            [F.col("origin").alias("airport_code"), "time_slot"],
            measures,
        )
        .select(
            "airport_code",
            "time_slot",
            "flights",
            mean(F.col("dep_sum"), F.col("dep_n")).alias("avg_dep_delay"),
            pct(F.col("delayed"), F.col("flights")).alias("delay_rate_pct"),
        )
        .orderBy("airport_code", F.desc("avg_dep_delay"), "time_slot")
    )


def tod_pivot(by_slot: DataFrame, slots: Sequence[str] | None = None) -> DataFrame:
    """Mean delays with one column per slot, in day order; without a list, the slots in use."""
    if slots is None:
        by_slot = settle(by_slot, "by-slot")
        slots = present_slots(by_slot)
    by_slot = by_slot.withColumn("time_slot", _listed("time_slot", slots))
    return by_slot.groupBy("airport_code").pivot("time_slot", list(slots)).agg(
        F.first("avg_dep_delay")
    )


def present_slots(by_slot: DataFrame) -> list[str]:
    """The slots that occur, under whichever names, in day order; other names come last."""
    seen = {row.time_slot for row in by_slot.select("time_slot").distinct().collect()} - {None}
    ordered = [slot for pair in zip(SLOTS, LONG_SLOTS, strict=True) for slot in pair]
    return [slot for slot in ordered if slot in seen] + sorted(seen - set(ordered))
