"""Thresholds shared by every operator."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Fixed values of the domain; override any of them with ``dataclasses.replace``."""

    delayed_mins: int = 15
    severe_mins: int = 60
    critical_pct: float = 30.0
    high_pct: float = 20.0
    sla_pct: float = 15.0
    target_pct: float = 90.0
    at_risk_pct: float = 75.0
    compliance_days: int = 30
    chronic_days: int = 90
    chronic_min_breaches: int = 3
    chronic_structural: int = 6
    cause_tolerance_mins: int = 10
    buffer_share: float = 0.05


DEFAULT_LIMITS = Limits()

# The five delay causes, in reporting order, and their display names.
CAUSES = {
    "carrier": "Carrier",
    "weather": "Weather",
    "nas": "NAS",
    "security": "Security",
    "late_aircraft": "Late Aircraft",
}
