"""Classification columns. The labels are fixed values of the reports."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.config import DEFAULT_LIMITS, Limits

# Departure slots in day order.
SLOTS = ("12AM-6AM", "6AM-10AM", "10AM-2PM", "2PM-6PM", "6PM-12AM")
LONG_SLOTS = (
    "12AM-6AM (Red-eye)",
    "6AM-10AM (Morning)",
    "10AM-2PM (Midday)",
    "2PM-6PM (Afternoon)",
    "6PM-12AM (Evening)",
)
SLOT_RANGES = ((0, 559), (600, 959), (1000, 1359), (1400, 1759))

# Delay bands and the highest delay in each.
DELAY_BANDS = (("early", -1), ("on_time", 14), ("minor", 45), ("moderate", 120))
WORST_BAND = "severe"


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or NULL."""
    return F.when(condition, 1).otherwise(0)


def is_late(delay: Column, minutes: int) -> Column:
    return delay >= minutes


def time_slot(hhmm: Column, slots: tuple = SLOTS) -> Column:
    """Slot of an HHMM integer; minutes 60-99 and NULL fall into the last slot."""
    picked = F.lit(slots[-1])
    for label, (low, high) in zip(slots, SLOT_RANGES):
        picked = F.when(hhmm.between(low, high), label).otherwise(picked)
    return picked


def severity(rate: Column, limits: Limits = DEFAULT_LIMITS) -> Column:
    return (
        F.when(rate >= limits.critical_pct, "CRITICAL")
        .when(rate >= limits.high_pct, "HIGH")
        .otherwise("MEDIUM")
    )


def pattern(breaches: Column, limits: Limits = DEFAULT_LIMITS) -> Column:
    return (
        F.when(breaches >= limits.chronic_structural, "CHRONIC")
        .when(breaches >= limits.chronic_min_breaches, "RECURRING")
        .otherwise("INTERMITTENT")
    )


def sla_status(compliance: Column, limits: Limits = DEFAULT_LIMITS) -> Column:
    return (
        F.when(compliance >= limits.target_pct, "Meets SLA")
        .when(compliance >= limits.at_risk_pct, "At Risk")
        .otherwise("SLA Breach")
    )


def trend(current: Column, previous: Column) -> Column:
    """Direction against the previous value; without one it counts as flat."""
    return (
        F.when(current > previous, "Worsening")
        .when(current < previous, "Improving")
        .otherwise("Flat")
    )


def dominant_cause(carrier: Column, weather: Column, nas: Column, late: Column) -> Column:
    """Largest of four means, ties in argument order.

    ``greatest`` skips NULLs while the wanted comparison yields NULL for them, which
    ends in the last label, so that case is spelled out.
    """
    contenders = (carrier, weather, nas, late)
    unknown = reduce(lambda x, y: x | y, [c.isNull() for c in contenders])
    top = F.greatest(*contenders)
    return (
        F.when(unknown, "Late Aircraft")
        .when(carrier == top, "Carrier Operations")
        .when(weather == top, "Weather")
        .when(nas == top, "National Air System")
        .otherwise("Late Aircraft")
    )


def delay_band(delay: Column) -> Column:
    picked = F.when(delay.isNotNull(), WORST_BAND)
    for label, top in reversed(DELAY_BANDS):
        picked = F.when(delay <= top, label).otherwise(picked)
    return picked


def route_label(origin: Column, destination: Column) -> Column:
    return F.concat(origin, F.lit(" → "), destination)
