"""How the fact table is stored, and what that saves at read time."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.filters import BREACH_MONTH, MONTH_COLUMN, month_number
from slotwise.sources.schemas import (
    AUDIT_LOG,
    AUDIT_STORED,
    FLIGHTS,
    FLIGHTS_STORED,
    PERIOD_COLUMN,
    SLA_BREACH_LOG,
)

#: What is done to rows right before they are written, such as counting them.
Watch = Callable[[DataFrame], DataFrame]

RECORD_DATE = "record_date"


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows


def with_month(f: DataFrame) -> DataFrame:
    return f.select(*FLIGHTS.names, month_number(F.col("flight_date")).alias(MONTH_COLUMN))


def write_flights(
    f: DataFrame, path: str, mode: str = "append", watch: Watch = _as_they_are
) -> None:
    """Partition by month; ranges of route and date inside a month go to files of their own.

    Rows are dealt by ranges of (month, route, date, id) that a sample makes even, so a full month is
    cut into many files that each hold few routes, and a route that fills a month is cut by date.
    Reading one route then opens a few files of a month, and skips most pages of these.
    """
    laid_out = (
        with_month(f)
        .repartitionByRange(MONTH_COLUMN, "route_id", "flight_date", "flight_id")
        .sortWithinPartitions(MONTH_COLUMN, "route_id", "flight_date")
    )
    (
        watch(laid_out)
        .write.mode(mode)
        # overwriting replaces the months that are written and leaves the others
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH_COLUMN)
        .parquet(path)
    )


def drop_months(spark: SparkSession, path: str, months: list[int | None]) -> None:
    """Removes months that have lost all their rows; None is the month of rows without a date."""
    for month in months:
        name = "__HIVE_DEFAULT_PARTITION__" if month is None else month
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MONTH_COLUMN}={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_quarantine(rejected: DataFrame, path: str, watch: Watch = _as_they_are) -> None:
    """Refused facts with their reason and digest, by month like the accepted ones."""
    month = month_number(F.col("flight_date")).alias(MONTH_COLUMN)
    dealt = rejected.select(*FLIGHTS.names, "reject_reason", "row_digest", month)
    (
        watch(dealt.hint("rebalance", F.col(MONTH_COLUMN)))
        .write.mode("append")
        .partitionBy(MONTH_COLUMN)
        .parquet(path)
    )


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLIGHTS_STORED).parquet(path)


def write_breaches(rows: DataFrame, path: str, watch: Watch = _as_they_are) -> None:
    """Partition the breach log by month, so that a day's run reads no other months."""
    month = month_number(F.col("breach_date")).alias(BREACH_MONTH)
    dealt = rows.select(*SLA_BREACH_LOG.names, month).hint("rebalance", F.col(BREACH_MONTH))
    watch(dealt).write.mode("append").partitionBy(BREACH_MONTH).parquet(path)


def dealt_by_month(f: DataFrame) -> DataFrame:
    """Facts dealt to tasks by month, with months of many rows cut."""
    return f.withColumn(PERIOD_COLUMN, month_number(F.col("flight_date"))).hint("rebalance", F.col(PERIOD_COLUMN))


def write_audit(
    rows: DataFrame, path: str, watch: Watch = _as_they_are, dealt: bool = False
) -> None:
    """Partition by table and by the month of the audited record, 0 where it has none.

    The change log grows with the facts; this lets a job look up the events of its own
    records without reading the rest. Rows that are ``dealt`` by month already stay where they are.
    """
    period = F.coalesce(month_number(F.col(RECORD_DATE)), F.lit(0))
    events = rows.select(*AUDIT_LOG.names, period.alias(PERIOD_COLUMN))
    if not dealt:
        events = events.hint("rebalance", F.col("table_name"), F.col(PERIOD_COLUMN))
    (
        watch(events)
        .write.mode("append")
        .partitionBy("table_name", PERIOD_COLUMN)
        .parquet(path)
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_STORED).parquet(path)
