"""Service-level breaches: detection, backfill, numbering and resolution."""

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.config import DEFAULT_LIMITS, Limits
from slotwise.functions.bands import is_late
from slotwise.functions.filters import date_range, days_before, flown
from slotwise.functions.measures import merge, rows, rows_where, summarise
from slotwise.functions.rates import pct
from slotwise.operators.keys import number_rows
from slotwise.sources.schemas import SLA_BREACH_LOG


class Rule(NamedTuple):
    rule_id: int | None
    window_days: int | None
    max_delay_rate_pct: object
    min_flights_window: int | None


NO_RULE = Rule(None, None, None, None)

# What callers are told.
UNKNOWN_ID = "Breach ID not found"
RESOLVED = ("Breach #", " marked as resolved.")


def _measures(limits: Limits) -> list:
    return [
        rows("total_flights"),
        rows_where("delayed_flights", is_late(F.col("arr_delay_mins"), limits.delayed_mins)),
    ]


def global_rule(rules: DataFrame) -> Rule:
    """The first rule without a carrier: one row of settings, read on the driver so that its
    window becomes a literal date bound the scan can use."""
    first = (
        rules.filter(F.col("carrier_code").isNull())
        .orderBy("rule_id")
        .select(*Rule._fields)
        .head(1)
    )
    return Rule(*first[0]) if first else NO_RULE


def ruled_routes(
    r: DataFrame, rules: DataFrame, per_carrier_rules: bool = False
) -> tuple[DataFrame, list[int]]:
    """Routes with the rule that applies to them, and the window lengths in use.

    Only the global rule counts unless ``per_carrier_rules`` lets a carrier's own first rule
    go before it.
    """
    shared = global_rule(rules)
    kinds = {name: rules.schema[name].dataType for name in Rule._fields}
    fallback = {
        name: F.lit(value).cast(kinds[name]) for name, value in zip(Rule._fields, shared)
    }
    windows = {shared.window_days}
    if not per_carrier_rules:
        ruled = r.select("route_id", *[v.alias(n) for n, v in fallback.items()])
    else:
        own = (
            rules.filter(F.col("carrier_code").isNotNull())
            .groupBy("carrier_code")
            .agg(F.min_by(F.struct(*Rule._fields), "rule_id").alias("own"))
        )
        windows |= set(own.agg(F.collect_set("own.window_days")).head()[0])
        ruled = r.join(own, "carrier_code", "left").select(
            "route_id",
            *[F.coalesce(F.col(f"own.{n}"), v).alias(n) for n, v in fallback.items()],
        )
    return ruled, sorted(windows - {None})


def daily_counters(f: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Flown and late rows per route and day: the additive input of every evaluation."""
    return summarise(flown(f), ["route_id", "flight_date"], _measures(limits))


def _trailing_totals(
    ruled_counters: DataFrame, window: int, eval_dates: Sequence[dt.date]
) -> DataFrame:
    """Running totals of each route over the days of one window length, at every evaluation date.

    Each counter row is read once: an empty row marks each evaluation date of each route, and a
    range frame sums what lies before it. A route has one row for a day, so a frame's partition
    is bounded by the calendar.
    """
    of_window = ruled_counters.filter(F.col("window_days") == window)
    dates = F.array(*[F.lit(d) for d in sorted(set(eval_dates))])
    marks = of_window.select("route_id", *_RULE_KEYS).distinct().select(
        "*",
        F.explode(dates).alias("flight_date"),
        F.lit(0).cast("bigint").alias("total_flights"),
        F.lit(0).cast("bigint").alias("delayed_flights"),
        F.lit(True).alias("_ends"),
    )
    counted = of_window.select(
        "route_id", *_RULE_KEYS, "flight_date", "total_flights", "delayed_flights",
        F.lit(False).alias("_ends"),
    )
    day = F.datediff("flight_date", F.lit(dt.date(1970, 1, 1)))
    frame = Window.partitionBy("route_id", "rule_id").orderBy(day).rangeBetween(-window, 0)
    return (
        counted.unionByName(marks)
        .withColumns({c: F.sum(c).over(frame) for c in ("total_flights", "delayed_flights")})
        .filter("_ends")
        .withColumnRenamed("flight_date", "breach_date")
        .drop("_ends")
    )


def trailing_breaches(
    counters: DataFrame,
    ruled: DataFrame,
    windows: Sequence[int],
    eval_dates: Sequence[dt.date],
    log: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Breaches on each evaluation date from daily counters.

    For several dates running totals per route replace the range condition, on one small row per
    route and day instead of the facts.
    """
    ruled_counters = counters.join(ruled, "route_id")
    if len(set(eval_dates)) == 1 or not windows:
        end = F.lit(eval_dates[0])
        covered = ruled_counters.filter(
            F.col("flight_date").between(F.date_sub(end, F.col("window_days")), end)
        ).withColumn("breach_date", end)
        totals = merge(covered, ["route_id", "breach_date", *_RULE_KEYS], _measures(limits))
    else:
        found = [_trailing_totals(ruled_counters, w, eval_dates) for w in windows]
        totals = reduce(DataFrame.unionByName, found)
    return _over_threshold(totals, log, eval_dates)


_RULE_KEYS = ("rule_id", "max_delay_rate_pct", "min_flights_window")


def _over_threshold(
    totals: DataFrame, log: DataFrame | None, eval_dates: Sequence[dt.date]
) -> DataFrame:
    """Enough rows and a rounded rate strictly over the threshold, not logged before."""
    kind = SLA_BREACH_LOG["delay_rate_pct"].dataType
    rate = pct(F.col("delayed_flights"), F.col("total_flights")).cast(kind)
    found = totals.withColumn("delay_rate_pct", rate).filter(
        (F.col("total_flights") >= F.col("min_flights_window"))
        & (F.col("delay_rate_pct") > F.col("max_delay_rate_pct"))
    )
    if log is not None:
        logged = date_range(log, min(eval_dates), max(eval_dates), "breach_date")
        found = found.join(
            logged.select("route_id", "breach_date").distinct(),
            ["route_id", "breach_date"],
            "left_anti",
        )
    return found.select(
        "route_id",
        "breach_date",
        "delay_rate_pct",
        "total_flights",
        "delayed_flights",
        "rule_id",
    )


def flag_breaches(
    f: DataFrame,
    r: DataFrame,
    rules: DataFrame,
    log: DataFrame | None = None,
    as_of: dt.date | None = None,
    per_carrier_rules: bool = False,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Routes over the threshold in the closed window that ends on ``as_of``."""
    as_of = as_of or dt.datetime.now(dt.UTC).date()
    if per_carrier_rules:
        return backfill_breaches(f, r, rules, [as_of], log, True, limits)
    ruled, windows = ruled_routes(r, rules)
    recent = date_range(flown(f), days_before(as_of, max(windows, default=0)), as_of)
    totals = (
        summarise(recent, ["route_id"], _measures(limits))
        .withColumn("breach_date", F.lit(as_of))
        .join(ruled, "route_id")
    )
    return _over_threshold(totals, log, [as_of])


def backfill_breaches(
    f: DataFrame,
    r: DataFrame,
    rules: DataFrame,
    eval_dates: Sequence[dt.date],
    log: DataFrame | None = None,
    per_carrier_rules: bool = False,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """:func:`flag_breaches` for many dates in one pass over the facts."""
    if not eval_dates:
        raise ValueError("eval_dates is empty")
    ruled, windows = ruled_routes(r, rules, per_carrier_rules)
    earliest = days_before(min(eval_dates), max(windows, default=0))
    counters = daily_counters(date_range(f, earliest, max(eval_dates)), limits)
    return trailing_breaches(counters, ruled, windows, eval_dates, log, limits)


def number_breaches(
    found: DataFrame, created_at, start_after: int = 0, resolved=None
) -> DataFrame:
    """Log rows for new breaches, numbered by date and route after ``start_after``."""
    numbered = number_rows(found, ["breach_date"], ["route_id"], "breach_id", "bigint")
    return (
        numbered.withColumn("breach_id", F.col("breach_id") + start_after)
        .withColumn("resolved", F.lit(0) if resolved is None else resolved)
        .withColumn("created_at", created_at)
        .select(*SLA_BREACH_LOG.names)
    )


def keyed_breaches(found: DataFrame, created_at) -> DataFrame:
    """Log rows for new breaches, known by their day and route.

    Such an id needs no look at the log, stays when a day is evaluated anew, and is the same on a retry.
    """
    day = F.datediff("breach_date", F.lit(dt.date(1970, 1, 1))).cast("bigint")
    given = {"breach_id": day * 2**32 + F.col("route_id"), "resolved": F.lit(0), "created_at": created_at}
    return found.withColumns(given).select(*SLA_BREACH_LOG.names)


class UnknownBreaches(LookupError):
    """Raised for ids that are not in the log; ``ids`` holds all of them, as a frame."""

    def __init__(self, ids: DataFrame, count: int):
        super().__init__(f"{UNKNOWN_ID}: {count} of the given ids, see the frame in .ids")
        self.ids, self.count = ids, count


def unknown_ids(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct ids of ``ids`` that the log lacks."""
    return ids.select("breach_id").distinct().join(log, "breach_id", "left_anti")


def resolve_breaches(log: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with the given breaches resolved, and one status line per breach.

    An unknown id raises and nothing is resolved. ``ids`` has the column ``breach_id``.
    """
    wanted = ids.select("breach_id").distinct()
    unknown = unknown_ids(log, ids)
    count = unknown.count()
    if count:
        raise UnknownBreaches(unknown, count)
    status = wanted.select(
        "breach_id",
        F.concat(F.lit(RESOLVED[0]), F.col("breach_id"), F.lit(RESOLVED[1])).alias("status"),
    )
    return current_log(log, wanted), status


def current_log(log: DataFrame, resolutions: DataFrame) -> DataFrame:
    """State of an append-only log after its resolution events, however often repeated."""
    done = resolutions.select("breach_id").distinct().withColumn("_done", F.lit(1))
    return (
        log.join(done, "breach_id", "left")
        .withColumn("resolved", F.coalesce("_done", "resolved"))
        .select(*log.columns)
    )
