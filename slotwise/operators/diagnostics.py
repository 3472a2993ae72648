"""Distribution checks of the fact table: bands, seasons, cause sums and drift."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.config import DEFAULT_LIMITS, Limits
from slotwise.functions.bands import delay_band, is_late
from slotwise.functions.columns import arr_delay, dep_delay
from slotwise.functions.filters import flown
from slotwise.functions.rates import fixed, mean, pct, ratio
from slotwise.operators.quality import cause_total


def delay_bands(f: DataFrame) -> DataFrame:
    """Share of each delay band per calendar month, over flown rows with a delay."""
    counted = (
        flown(f)
        .filter(arr_delay().isNotNull())
        .groupBy(F.date_format("flight_date", "yyyy-MM").alias("month_label"),
                 delay_band(arr_delay()).alias("delay_band"))
        .agg(F.count(F.lit(1)).alias("flights"))
    )
    in_month = F.sum("flights").over(Window.partitionBy("month_label"))
    return counted.withColumn("share_pct", pct(F.col("flights"), in_month))


def seasonality_index(f: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Delay rate of each month of the year over the rate of all rows.

    The overall rate is summed over the twelve month rows, not over the facts again.
    """
    monthly = (
        flown(f)
        .groupBy(F.month("flight_date").alias("mo"))
        .agg(
            F.count(F.lit(1)).alias("flights"),
            F.count_if(is_late(arr_delay(), limits.delayed_mins)).alias("delayed"),
        )
    )
    year = Window.partitionBy()
    overall = ratio(F.sum("delayed").over(year), F.sum("flights").over(year))
    rate = ratio(F.col("delayed"), F.col("flights"))
    return monthly.select(
        "mo",
        "flights",
        pct(F.col("delayed"), F.col("flights")).alias("delay_rate_pct"),
        fixed(ratio(rate, overall), 3).alias("seasonality_index"),
    )


def cause_reconciliation(f: DataFrame) -> DataFrame:
    """How many late rows have causes that do not add up to the delay."""
    late = arr_delay() > 0
    return f.agg(
        F.count_if(late).alias("late_flights"),
        F.count_if(late & (cause_total() != arr_delay())).alias("mismatches"),
        F.sum(F.when(late, cause_total() - arr_delay())).alias("net_difference_mins"),
    )


def dep_arr_drift(f: DataFrame) -> DataFrame:
    """Range and mean of departure minus arrival delay over flown rows."""
    drift = dep_delay() - arr_delay()
    return flown(f).agg(
        F.min(drift).alias("min_drift_mins"),
        F.max(drift).alias("max_drift_mins"),
        mean(F.sum(drift), F.count(drift)).alias("avg_drift_mins"),
    )
