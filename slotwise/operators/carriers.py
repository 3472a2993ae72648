"""Carrier reports: ranking, monthly trend, root causes and their roll-ups."""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.config import CAUSES, DEFAULT_LIMITS, Limits
from slotwise.functions.bands import is_late, trend
from slotwise.functions.columns import arr_delay
from slotwise.functions.filters import date_range, flown, only
from slotwise.functions.measures import (
    Measure,
    averaged,
    merge,
    rows,
    rows_where,
    summarise,
    total,
)
from slotwise.functions.rates import fixed, mean, pct, ratio


def route_carriers(r: DataFrame, a: DataFrame, carrier: str | None = None) -> DataFrame:
    """Routes with their carrier, for one carrier or all."""
    return only(r, "carrier_code", carrier).join(
        a.select("carrier_code", "carrier_name"), "carrier_code"
    )


def _per_carrier(
    f: DataFrame,
    r: DataFrame,
    a: DataFrame,
    measures: list[Measure],
    carrier: str | None,
    extra: tuple = (),
    extra_names: tuple = (),
) -> DataFrame:
    per_route = summarise(f, ["route_id", *extra], measures)
    return merge(
        per_route.join(route_carriers(r, a, carrier), "route_id"),
        ["carrier_code", "carrier_name", *extra_names],
        measures,
    )


def carrier_ranking(
    f: DataFrame,
    r: DataFrame,
    a: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    carrier: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Carriers by delayed share of their flown rows.

    The ranking windows span all carriers, so they run in one task, over one row each.
    """
    late = is_late(arr_delay(), limits.delayed_mins)
    measures = [
        rows("total_flights"),
        total("cancelled_flights", F.col("cancelled")),
        rows_where("delayed", late),
        rows_where("severe_delays", is_late(arr_delay(), limits.severe_mins)),
        *averaged("arr", arr_delay()),
        total("late_sum", F.when(late, arr_delay())),
    ]
    stats = _per_carrier(date_range(flown(f), start, end), r, a, measures, carrier)
    share = fixed(ratio(F.col("delayed"), F.col("total_flights")), 4)
    best_first = Window.orderBy(F.col("_share"))
    return (
        stats.withColumn("_share", share)
        .select(
            F.rank().over(best_first).alias("on_time_rank"),
            "carrier_code",
            "carrier_name",
            "total_flights",
            "delayed",
            "severe_delays",
            mean(F.col("arr_sum"), F.col("arr_n")).alias("avg_arr_delay_mins"),
            mean(F.col("late_sum"), F.col("delayed")).alias("avg_delay_when_late"),
            pct(F.col("delayed"), F.col("total_flights")).alias("delay_rate_pct"),
            pct(F.col("cancelled_flights"), F.col("total_flights")).alias("cancel_rate_pct"),
            fixed(F.percent_rank().over(best_first) * 100, 1).alias("percentile_rank"),
        )
        .orderBy("on_time_rank", "carrier_code")
    )


def carrier_kpis(ranking: DataFrame) -> DataFrame:
    """Headline figures over a ranking; the mean rate weighs every carrier the same."""
    return ranking.agg(
        F.sum("total_flights").alias("total_flights"),
        mean(F.sum("delay_rate_pct"), F.count("delay_rate_pct"), 1).alias("avg_delay_rate_pct"),
        F.sum("severe_delays").alias("severe_delays"),
    )


def monthly_trend(
    f: DataFrame,
    r: DataFrame,
    a: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    carrier: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Delay rate per carrier and month against the carrier's previous month with rows."""
    measures = [rows("flights"), rows_where("delayed", is_late(arr_delay(), limits.delayed_mins))]
    month = F.date_format("flight_date", "yyyy-MM").alias("month_label")
    monthly = _per_carrier(
        date_range(flown(f), start, end), r, a, measures, carrier, (month,), ("month_label",)
    )
    rate, before = F.col("delay_rate_pct"), F.col("prev_month_rate")
    in_order = Window.partitionBy("carrier_code").orderBy("month_label")
    return (
        monthly.select(
            "carrier_code",
            "carrier_name",
            "month_label",
            pct(F.col("delayed"), F.col("flights")).alias("delay_rate_pct"),
        )
        .withColumn("prev_month_rate", F.lag(rate).over(in_order))
        .withColumn("mom_change_pct", fixed(rate - before, 2))
        .withColumn("trend", trend(rate, before))
        .orderBy("carrier_code", "month_label")
    )


def root_cause(
    f: DataFrame,
    r: DataFrame,
    a: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    carrier: str | None = None,
) -> DataFrame:
    """Delay minutes per cause and their share of all minutes, NULL where there are none.

    The grand total sums the row totals: a row with an unknown cause adds nothing to it.
    """
    row_total = sum((F.col(f"{c}_delay") for c in list(CAUSES)[1:]), F.col("carrier_delay"))
    measures = [
        *(total(f"total_{c}_mins", F.col(f"{c}_delay")) for c in CAUSES),
        total("grand_total_delay_mins", row_total),
    ]
    stats = _per_carrier(date_range(flown(f), start, end), r, a, measures, carrier)
    shares = [
        pct(F.col(f"total_{c}_mins"), F.col("grand_total_delay_mins"), 1).alias(f"pct_{c}")
        for c in CAUSES
    ]
    return stats.select("*", *shares).orderBy(
        F.desc("grand_total_delay_mins"), "carrier_code"
    )


def root_cause_long(causes: DataFrame) -> DataFrame:
    """One row per carrier and cause."""
    labels = [
        F.struct(F.lit(label).alias("cause"), F.col(f"pct_{c}").alias("percentage"))
        for c, label in CAUSES.items()
    ]
    return causes.select("carrier_name", F.inline(F.array(*labels)))


def cause_mix(causes: DataFrame) -> DataFrame:
    """Sum of the carriers' percentages per cause, so every carrier weighs the same."""
    return (
        root_cause_long(causes)
        .groupBy("cause")
        .agg(fixed(F.sum("percentage"), 1).alias("percentage"))
    )
