"""Service-level rules with their history: versions, and the one in force on a day."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.config import DEFAULT_LIMITS, Limits
from slotwise.functions.rates import pct
from slotwise.operators.intervals import days_in_intervals

#: What a version says of a rule.
SETTINGS = ("carrier_code", "max_delay_rate_pct", "min_flights_window", "window_days")
STAMP = ("updated_at", "updated_by")


def rule_versions(changes: DataFrame) -> DataFrame:
    """Every state of every rule with the days it holds: ``valid_from`` to ``valid_to``, both included.

    ``changes`` has a row for each change, the rule's first state too, stamped ``updated_at``. The last
    change of a day holds for the whole day; ``valid_to`` is NULL for the present state. Versions are
    numbered from 1 in each rule. A rule's history is short, so it is ordered in one place.
    """
    days = changes.withColumn("valid_from", F.to_date("updated_at"))
    of_day = Window.partitionBy("rule_id", "valid_from").orderBy(F.desc("updated_at"), F.desc("updated_by"))
    last = days.withColumn("_nr", F.row_number().over(of_day)).where("_nr = 1")
    ordered = Window.partitionBy("rule_id").orderBy("valid_from")
    return last.select(
        "rule_id",
        F.row_number().over(ordered).alias("version"),
        *SETTINGS,
        *STAMP,
        "valid_from",
        F.date_sub(F.lead("valid_from").over(ordered), 1).alias("valid_to"),
    )


def latest_before(
    rows: DataFrame, states: DataFrame, keys: Sequence[str], day: str, since: str, values: Sequence[str]
) -> DataFrame:
    """``rows`` with the ``values`` of the last state of their ``keys`` that began on or before their day.

    States and the days asked for are put in one order and the last state is carried along; nothing
    is compared by ranges. Only distinct (keys, day) are carried, so the frame of a key is bounded by
    the calendar and its states, and a key that most rows have costs no more than another. Rows
    before the first state get NULLs.
    """
    asked = rows.select(*keys, day).distinct().select(*keys, F.col(day).alias("_day"), F.lit(1).alias("_asks"))
    known = states.select(
        *keys, F.col(since).alias("_day"), F.lit(0).alias("_asks"), F.struct(*values).alias("_state")
    )
    both = known.unionByName(asked, allowMissingColumns=True)
    carried = Window.partitionBy(*keys).orderBy("_day", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        both.withColumn("_state", F.last("_state", ignorenulls=True).over(carried))
        .where("_asks = 1")
        .select(*keys, F.col("_day").alias(day), *[F.col(f"_state.{v}").alias(v) for v in values])
    )
    return rows.join(found, [*keys, day], "left")


def current_rules(changes: DataFrame, day: dt.date) -> DataFrame:
    """The rules as they stood on a day, in the columns of a change."""
    held = (F.col("valid_from") <= F.lit(day)) & (F.coalesce("valid_to", F.lit(day)) >= F.lit(day))
    return rule_versions(changes).where(held).select("rule_id", *SETTINGS, *STAMP)


def breaches_by_version(
    counters: DataFrame, versions: DataFrame, days: DataFrame, rule_id: int, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Breaches of one rule on each of ``days`` (breach_date), by the version in force on that day.

    ``counters`` are flown and late rows of a route and day. Versions may differ in the length of
    their window, so each evaluation has an interval of its own.
    """
    asked = days.select("breach_date", F.lit(rule_id).alias("rule_id"))
    settings = ["version", "max_delay_rate_pct", "min_flights_window", "window_days"]
    ruled = latest_before(asked, versions, ["rule_id"], "breach_date", "valid_from", settings)
    windows = ruled.where("version is not null").withColumn(
        "_from", F.date_sub("breach_date", F.col("window_days"))
    )
    met = days_in_intervals(counters, windows, "flight_date", "_from", "breach_date")
    totals = met.groupBy(
        "route_id", "breach_date", "rule_id", "version", "max_delay_rate_pct", "min_flights_window"
    ).agg(F.sum("total_flights").alias("total_flights"), F.sum("delayed_flights").alias("delayed_flights"))
    rate = pct(F.col("delayed_flights"), F.col("total_flights"))
    return totals.withColumn("delay_rate_pct", rate).where(
        "total_flights >= min_flights_window and delay_rate_pct > max_delay_rate_pct"
    ).select(
        "route_id", "breach_date", "rule_id", "version", "delay_rate_pct", "total_flights", "delayed_flights"
    )
