"""Monthly scorecards for one carrier or all of them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.config import CAUSES, DEFAULT_LIMITS, Limits
from slotwise.functions import bands
from slotwise.functions.filters import calendar_month, date_range, flown, only
from slotwise.functions.measures import averaged, merge, summarise
from slotwise.functions.rates import fixed, ratio
from slotwise.operators.carriers import route_carriers
from slotwise.operators.views import carrier_monthly_scorecard


def monthly_scorecard(
    f: DataFrame,
    r: DataFrame,
    a: DataFrame,
    ap: DataFrame,
    year: int | None,
    month: int | None,
    carrier: str | None = None,
    rank_before_filter: bool = False,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """One month's scorecard with a rank by delay rate.

    The rank counts the carriers that are shown, so one carrier alone is always first of
    one; ``rank_before_filter`` ranks it among all carriers instead. The month is read as a
    date range, which the scan can prune.
    """
    first, last = calendar_month(year, month)
    cards = carrier_monthly_scorecard(f, r, a, ap, first, last, limits)
    if not rank_before_filter:
        cards = only(cards, "carrier_code", carrier)
    same_month = Window.partitionBy("yr", "mo")
    ranked = cards.select(
        "carrier_code",
        "carrier_name",
        "yr",
        "mo",
        "total_flights",
        "cancelled_flights",
        "delayed_flights",
        "avg_arr_delay",
        "delay_rate_pct",
        "cancel_rate_pct",
        "early_rate_pct",
        F.rank().over(same_month.orderBy("delay_rate_pct")).alias("on_time_rank"),
        F.count(F.lit(1)).over(same_month).alias("total_carriers_evaluated"),
    )
    return only(ranked, "carrier_code", carrier) if rank_before_filter else ranked


def dominant_cause(
    f: DataFrame,
    r: DataFrame,
    a: DataFrame,
    year: int | None,
    month: int | None,
    carrier: str | None = None,
) -> DataFrame:
    """Mean minutes per cause for a month and the largest of them, security left aside."""
    first, last = calendar_month(year, month)
    measures = [m for c in CAUSES for m in averaged(c, F.col(f"{c}_delay"))]
    per_route = summarise(date_range(flown(f), first, last), ["route_id"], measures)
    per_carrier = merge(
        per_route.join(route_carriers(r, a, carrier), "route_id"),
        ["carrier_code", "carrier_name"],
        measures,
    )
    means = {c: ratio(F.col(f"{c}_sum"), F.col(f"{c}_n")) for c in CAUSES}
    return per_carrier.select(
        "carrier_code",
        "carrier_name",
        *[fixed(value, 2).alias(f"avg_{c}_delay") for c, value in means.items()],
        bands.dominant_cause(
            means["carrier"], means["weather"], means["nas"], means["late_aircraft"]
        ).alias("dominant_delay_cause"),
    )
