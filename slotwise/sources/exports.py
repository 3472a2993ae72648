"""CSV files of the reports, with the columns readers get."""

from collections.abc import Mapping

from pyspark.sql import DataFrame

from slotwise.config import CAUSES
from slotwise.sources.tables import export_csv

# Displayed columns per report; None shows all of them.
DISPLAY = {
    "carrier_rankings": [
        "on_time_rank",
        "carrier_name",
        "total_flights",
        "delay_rate_pct",
        "avg_arr_delay_mins",
        "avg_delay_when_late",
        "severe_delays",
        "cancel_rate_pct",
    ],
    "mom_trend": None,
    "root_cause": ["carrier_name", *(f"pct_{cause}" for cause in CAUSES)],
    "airport_stats": [
        "airport_code",
        "airport_name",
        "city",
        "state",
        "total_departures",
        "avg_dep_delay",
        "dep_delay_rate_pct",
        "extreme_delays",
    ],
    "propagation": None,
    "route_heatmap": None,
    "time_of_day": None,
    "active_breaches": [
        "breach_date",
        "route",
        "carrier_name",
        "delay_rate_pct",
        "sla_threshold_pct",
        "overage_pct",
        "severity",
        "days_open",
    ],
    "chronic_offenders": None,
    "sla_compliance": None,
}
RENAMED = {
    "root_cause": {
        "carrier_name": "Carrier",
        **{f"pct_{cause}": label for cause, label in CAUSES.items()},
    }
}


def displayed(name: str, report: DataFrame) -> DataFrame:
    """The report as it is shown: fewer columns, some under other names."""
    columns = DISPLAY[name]
    shown = report.select(*columns) if columns else report
    return shown.withColumnsRenamed(RENAMED.get(name, {}))


def export_reports(reports: Mapping[str, DataFrame], path: str) -> None:
    """One folder per report. The lists of breaches grow with the data and stay in parts."""
    for name, report in reports.items():
        grows = name in ("active_breaches", "chronic_offenders")
        export_csv(displayed(name, report), f"{path}/{name}", one_file=not grows)
