"""Range summaries, semi joins and comparisons with a group mean."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.config import DEFAULT_LIMITS, Limits
from slotwise.functions.bands import is_late
from slotwise.functions.columns import arr_delay
from slotwise.functions.filters import date_range
from slotwise.functions.rates import mean
from slotwise.sources.scratch import settle
from slotwise.sources.tables import run_sql


def date_range_summary(
    f: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Row count and mean arrival delay of a closed date range."""
    return date_range(f, start, end).agg(
        F.count(F.lit(1)).alias("total_flights"),
        mean(F.sum(arr_delay()), F.count(arr_delay())).alias("avg_arr_delay"),
    )


def route_slice(f: DataFrame, route_id: int, since: dt.date) -> DataFrame:
    """Three columns of one route from a date on."""
    return (
        date_range(f, since)
        .filter(F.col("route_id") == route_id)
        .select("route_id", "flight_date", "arr_delay_mins")
    )


def carriers_with_severe_in(
    f: DataFrame, r: DataFrame, a: DataFrame, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Carriers with a severe delay, as ``IN (subquery)``.

    Facts are reduced to distinct routes before they meet anything, so no row of theirs is
    shuffled for the join.
    """
    return run_sql(
        f.sparkSession,
        """
        SELECT carrier_code, carrier_name
        FROM {carriers}
        WHERE carrier_code IN (
            SELECT DISTINCT carrier_code
            FROM {routes} JOIN {severe} USING (route_id)
        )
        """,
        carriers=a,
        routes=r,
        severe=_severe_routes(f, limits),
    )


def carriers_with_severe_exists(
    f: DataFrame, r: DataFrame, a: DataFrame, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """The same carriers as a correlated ``EXISTS``."""
    return run_sql(
        f.sparkSession,
        """
        SELECT c.carrier_code, c.carrier_name
        FROM {carriers} c
        WHERE EXISTS (
            SELECT 1
            FROM {routes} w JOIN {severe} s ON s.route_id = w.route_id
            WHERE w.carrier_code = c.carrier_code
        )
        """,
        carriers=a,
        routes=r,
        severe=_severe_routes(f, limits),
    )


def _severe_routes(f: DataFrame, limits: Limits) -> DataFrame:
    return f.filter(is_late(arr_delay(), limits.severe_mins)).select("route_id").distinct()


def route_means(f: DataFrame) -> DataFrame:
    """Mean arrival delay per route over all dates, written out so that its size is known."""
    return settle(f.groupBy("route_id").agg(F.avg(arr_delay()).alias("avg_delay")), "route-means")


def above_route_avg_join(f: DataFrame, since: dt.date) -> DataFrame:
    """Rows from a date on that are above their route's mean, by join."""
    return (
        date_range(f, since)
        .join(route_means(f), "route_id")
        .filter(arr_delay() > F.col("avg_delay"))
        .select("flight_id", "arr_delay_mins")
    )


def above_route_avg_corr(f: DataFrame, since: dt.date) -> DataFrame:
    """The same rows by a correlated mean over the facts, which Catalyst turns into a join."""
    return run_sql(
        f.sparkSession,
        """
        SELECT m.flight_id, m.arr_delay_mins
        FROM {recent} m
        WHERE m.arr_delay_mins > (
            SELECT avg(g.arr_delay_mins) FROM {facts} g WHERE g.route_id = m.route_id
        )
        """,
        recent=date_range(f, since),
        facts=f,
    )
