"""Loads the star once per application and hands out its tables.

Reports are run many times over facts that are loaded once. Deriving the facts takes three
shuffles of the widest input, so the result is written to the shared scratch folder in the
report layout, and every query scans only the months and columns it needs.
"""

import datetime as dt
import os
import threading
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.flagging import backfill_breaches, number_breaches
from slotwise.sources import retail
from slotwise.sources.layout import read_flights, write_flights
from slotwise.sources.schemas import SLA_BREACH_LOG, SLA_RULES, TABLES
from slotwise.sources.scratch import scratch_path, settle, sparing

AS_OF = dt.date(2023, 12, 31)
WEEKLY = [dt.date(2023, 7, 2) + dt.timedelta(weeks=week) for week in range(27)]

# Service-level settings for the given data: one rule for all carriers and one of a carrier.
RULES = [
    {"rule_id": 1, "carrier_code": None, "max_delay_rate_pct": "15.00",
     "min_flights_window": 5, "window_days": 180},
    {"rule_id": 2, "carrier_code": "PROMO", "max_delay_rate_pct": "40.00",
     "min_flights_window": 5, "window_days": 270},
]

# The same rules as they changed over the year, each state with the moment it was set.
RULE_CHANGES = [
    RULES[0] | {"updated_at": "2023-01-01 00:00:00", "updated_by": "loader"},
    RULES[0] | {"max_delay_rate_pct": "12.00", "updated_at": "2023-08-15 09:00:00", "updated_by": "desk"},
    RULES[0] | {"max_delay_rate_pct": "18.00", "window_days": 120,
                "updated_at": "2023-08-15 17:30:00", "updated_by": "desk"},
    RULES[0] | {"max_delay_rate_pct": "20.00", "window_days": 90,
                "updated_at": "2023-11-01 08:00:00", "updated_by": "audit"},
    RULES[1] | {"updated_at": "2023-03-01 00:00:00", "updated_by": "loader"},
    RULES[1] | {"max_delay_rate_pct": "35.00", "window_days": 60,
                "updated_at": "2023-10-10 12:00:00", "updated_by": "desk"},
]


@dataclass(frozen=True)
class Star:
    spark: SparkSession
    sf_dir: str
    root: str

    @cached_property
    def flights(self) -> DataFrame:
        return read_flights(self.spark, self.flights_path)

    @property
    def flights_path(self) -> str:
        return f"{self.root}/flights"

    @cached_property
    def routes(self) -> DataFrame:
        return self._stored("routes")

    @cached_property
    def airlines(self) -> DataFrame:
        return self._once("airlines", retail.airlines)

    @cached_property
    def airports(self) -> DataFrame:
        return self._once("airports", retail.airports)

    @cached_property
    def rules(self) -> DataFrame:
        return rules_frame(self.spark)

    @cached_property
    def rule_changes(self) -> DataFrame:
        return rules_frame(self.spark, RULE_CHANGES)

    @cached_property
    def breach_log(self) -> DataFrame:
        """Weekly evaluations of half a year, every fourth breach resolved."""
        path = scratch_path(self.spark, "breach-log")
        found = backfill_breaches(self.flights, self.routes, self.rules, WEEKLY)
        number = F.col("breach_id")
        midnight = F.col("breach_date").cast("timestamp")
        logged_at = F.timestamp_add("HOUR", (number % 24).cast("int"), midnight)
        number_breaches(
            found, logged_at, resolved=F.when(number % 4 == 0, 1).otherwise(0)
        ).write.parquet(path)
        return self.spark.read.schema(SLA_BREACH_LOG).parquet(path)

    def _once(self, table: str, derive) -> DataFrame:
        derive(self.spark, self.sf_dir).write.parquet(f"{self.root}/{table}")
        return self._stored(table)

    def _stored(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")


_LOADED: dict[tuple, Star] = {}
_LOADING = threading.Lock()


def open_star(spark: SparkSession, sf_dir: str) -> Star:
    """The star of a folder of order tables, built on first use.

    A local input that changes is noticed and loaded again. Inputs on a shared file system
    are taken as fixed while the application runs; checking them would mean listing them.
    """
    sf_dir = sf_dir.rstrip("/")
    key = (spark.conf.get("spark.app.id"), sf_dir, _local_versions(sf_dir))
    with _LOADING:
        if key not in _LOADED:
            _LOADED[key] = _build(spark, sf_dir)
    return _LOADED[key]


def _local_versions(sf_dir: str) -> tuple:
    paths = [f"{sf_dir}/{table}.parquet" for table in retail.SOURCES]
    stats = [os.stat(path) for path in paths if os.path.exists(path)]
    return tuple((stat.st_mtime_ns, stat.st_size) for stat in stats)


def _build(spark: SparkSession, sf_dir: str) -> Star:
    star = Star(spark, sf_dir, scratch_path(spark, "star"))
    with sparing(spark):
        staged = settle(retail.movements(spark, sf_dir), "staged")
        retail.routes(staged).write.parquet(f"{star.root}/routes")
        write_flights(retail.flights(staged, star.routes), star.flights_path)
    return star


def rules_frame(spark: SparkSession, rules: list[dict] = RULES) -> DataFrame:
    """A handful of settings as a frame of literals."""
    rows = [
        F.struct(*[F.lit(rule.get(f.name)).cast(f.dataType).alias(f.name) for f in SLA_RULES])
        for rule in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
