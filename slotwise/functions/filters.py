"""Row filters that reach the scan.

Bounds are Python dates, so they become literals: the Parquet reader gets them as pushed
filters and, on a month-partitioned table, as partition filters.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH_COLUMN = "flight_month"
BREACH_MONTH = "breach_month"
#: The partition column that goes with a date.
MONTHS = {"flight_date": MONTH_COLUMN, "breach_date": BREACH_MONTH}


def month_number(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def flown(f: DataFrame) -> DataFrame:
    """Rows that were not cancelled; an unknown flag is left out as well."""
    return f.filter(F.col("cancelled") == 0)


def date_range(
    f: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    column: str = "flight_date",
) -> DataFrame:
    """Closed range, either end open when None; a reversed pair is swapped.

    Where the table carries the month partition column, the same bounds are put on it,
    since Spark cannot derive a partition filter from the date by itself.
    """
    if start is not None and end is not None and start > end:
        start, end = end, start
    month = MONTHS.get(column)
    by_month = month in f.columns
    if start is not None:
        f = f.filter(F.col(column) >= F.lit(start))
        if by_month:
            f = f.filter(F.col(month) >= start.year * 100 + start.month)
    if end is not None:
        f = f.filter(F.col(column) <= F.lit(end))
        if by_month:
            f = f.filter(F.col(month) <= end.year * 100 + end.month)
    return f


def moment(when: dt.datetime) -> Column:
    """A timestamp literal read in the session time zone, as the stored ones are."""
    return F.lit(when.isoformat(sep=" ")).cast("timestamp")


def months_before(day: dt.date, months: int) -> dt.date:
    """Same day ``months`` earlier, clamped to the end of a shorter month."""
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    last = (dt.date(year + month // 11, (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


def days_before(day: dt.date, days: int) -> dt.date:
    return day - dt.timedelta(days=days)


def calendar_month(year: int | None, month: int | None) -> tuple[dt.date, dt.date]:
    """First and last day of a month; both numbers are required."""
    if year is None or month is None:
        raise ValueError("year and month cannot be None")
    first = dt.date(year, month, 1)
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return first, following - dt.timedelta(days=1)


def only(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Equality filter that is skipped for None and "All"."""
    return df if value in (None, "All") else df.filter(F.col(column) == value)
