"""Reports over the breach log."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.config import DEFAULT_LIMITS, Limits
from slotwise.functions.bands import pattern, severity, sla_status
from slotwise.functions.columns import route
from slotwise.functions.filters import date_range, days_before, moment, only
from slotwise.functions.rates import fixed, mean, pct
from slotwise.operators.carriers import route_carriers


def active_breaches(
    bl: DataFrame,
    r: DataFrame,
    a: DataFrame,
    rules: DataFrame,
    as_of: dt.date,
    threshold: float | None = None,
    carrier: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Unresolved breaches with overage, severity and age.

    Without a threshold the breach's own rule gives it. A bound threshold also filters, and
    adds the carrier code to the output.
    """
    open_ones = bl.filter(F.col("resolved") == 0)
    if threshold is None:
        limit_column = F.col("max_delay_rate_pct").cast("double")
        open_ones = open_ones.join(rules.select("rule_id", "max_delay_rate_pct"), "rule_id")
    else:
        limit_column = F.lit(float(threshold))
        open_ones = open_ones.filter(F.col("delay_rate_pct") > threshold)
    rate = F.col("delay_rate_pct").cast("double")
    codes = [] if threshold is None else ["carrier_code"]
    return (
        open_ones.join(route_carriers(r, a, carrier), "route_id")
        .select(
            "breach_id",
            "breach_date",
            route().alias("route"),
            "carrier_name",
            *codes,
            "total_flights",
            "delayed_flights",
            rate.alias("delay_rate_pct"),
            limit_column.alias("sla_threshold_pct"),
            fixed(rate - limit_column, 2).alias("overage_pct"),
            severity(rate, limits).alias("severity"),
            F.datediff(F.lit(as_of), "breach_date").alias("days_open"),
        )
        .orderBy(F.desc("delay_rate_pct"), "breach_id")
    )


def breach_kpis(active: DataFrame) -> DataFrame:
    return active.agg(
        F.count(F.lit(1)).alias("active_breaches"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        mean(F.sum(F.col("overage_pct").cast("decimal(18,2)")), F.count("overage_pct"), 1).alias(
            "avg_overage_pct"
        ),
    )


def severity_distribution(active: DataFrame) -> DataFrame:
    return active.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def chronic_offenders(
    bl: DataFrame,
    r: DataFrame,
    a: DataFrame,
    as_of: dt.date,
    window_days: int | None = None,
    min_breaches: int | None = None,
    carrier: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Routes with repeated breaches in the trailing window."""
    window_days = limits.chronic_days if window_days is None else window_days
    min_breaches = limits.chronic_min_breaches if min_breaches is None else min_breaches
    repeated = (
        date_range(bl, days_before(as_of, window_days), column="breach_date")
        .groupBy("route_id")
        .agg(
            F.count(F.lit(1)).alias("breach_count"),
            F.max("delay_rate_pct").alias("peak"),
            F.sum("delay_rate_pct").alias("rate_sum"),
            F.min("breach_date").alias("first_breach"),
            F.max("breach_date").alias("latest_breach"),
        )
        .filter(F.col("breach_count") >= min_breaches)
    )
    return (
        repeated.join(route_carriers(r, a, carrier), "route_id")
        .select(
            "breach_count",
            route().alias("route"),
            "carrier_name",
            "carrier_code",
            mean(F.col("rate_sum"), F.col("breach_count")).alias("avg_delay_rate"),
            F.col("peak").cast("double").alias("peak_delay_rate"),
            "first_breach",
            "latest_breach",
            F.datediff("latest_breach", "first_breach").alias("breach_span_days"),
            pattern(F.col("breach_count"), limits).alias("pattern"),
        )
        .orderBy(F.desc("breach_count"), F.desc("avg_delay_rate"), "route", "carrier_name")
    )


def sla_compliance(
    bl: DataFrame,
    r: DataFrame,
    a: DataFrame,
    as_of: dt.date,
    window_days: int | None = None,
    threshold: float | None = None,
    carrier: str | None = None,
    match_carrier: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Share of each carrier's routes without a breach in the trailing window.

    Resolved breaches count too. ``carrier`` keeps one carrier; ``match_carrier`` only lets
    that carrier's breaches match, so the others stay in the list with full compliance.
    With a threshold the output has the carrier code instead of the status.
    """
    window_days = limits.compliance_days if window_days is None else window_days
    recent = date_range(bl, days_before(as_of, window_days), column="breach_date")
    if threshold is not None:
        recent = recent.filter(F.col("delay_rate_pct") > threshold)
    breached = only(
        recent.select("route_id")
        .distinct()
        .join(r.select("carrier_code", "route_id").distinct(), "route_id"),
        "carrier_code",
        match_carrier,
    ).select("carrier_code", "route_id", F.col("route_id").alias("breached_route"))
    group = ["carrier_name"] if threshold is None else ["carrier_name", "carrier_code"]
    all_routes, clean = F.col("total_routes"), F.col("compliant_routes")
    counted = (
        route_carriers(r, a, carrier)
        .select("carrier_code", "carrier_name", "route_id")
        .distinct()
        .join(breached, ["carrier_code", "route_id"], "left")
        .groupBy(*group)
        .agg(
            F.count("route_id").alias("total_routes"),
            F.count("breached_route").alias("breached_routes"),
        )
        .withColumn("compliant_routes", all_routes - F.col("breached_routes"))
        .withColumn("sla_compliance_pct", pct(clean, all_routes, 1))
    )
    if threshold is None:
        counted = counted.withColumn("sla_status", sla_status(F.col("sla_compliance_pct"), limits))
    return counted.orderBy(F.desc("sla_compliance_pct"), "carrier_name")


def recent_breaches(bl: DataFrame, now: dt.datetime, hours: int = 24) -> DataFrame:
    """Number of unresolved breaches logged in the last hours."""
    since = now - dt.timedelta(hours=hours)
    return bl.filter(
        (F.col("resolved") == 0) & (F.col("created_at") >= moment(since))
    ).agg(F.count(F.lit(1)).alias("cnt"))
