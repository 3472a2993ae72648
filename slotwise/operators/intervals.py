"""Days that fall into intervals of days, found by bins instead of comparing every pair."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a bin, unless the caller knows how long most intervals are.
BIN_DAYS = 32
_EPOCH = dt.date(1970, 1, 1)


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(_EPOCH))


def days_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    day: str,
    first: str,
    last: str,
    keys: Sequence[str] = (),
    bin_days: int = BIN_DAYS,
) -> DataFrame:
    """Rows of ``points`` with each interval [``first``, ``last``] of the same ``keys`` they lie in.

    An interval stands once in every bin it meets, a point in one bin; both meet by an equality of
    bin and keys, and the bounds are checked on what meets. A long interval is cut into its bins,
    so a bin holds whatever falls into its days and a hot key is spread over the calendar; a join that
    is still uneven is split, as nothing else needs its rows together. A NULL ``first`` or ``last`` is
    open, towards the first or last bin that has a point; a NULL day lies in no interval.
    """
    width = F.lit(bin_days)
    bin_of = lambda c: F.floor(day_number(c) / width).cast("int")
    placed = points.where(F.col(day).isNotNull()).withColumn("_bin", bin_of(F.col(day)))
    edge = points.agg(F.min(day).alias("low"), F.max(day).alias("high")).head()
    low, high = edge.low or _EPOCH, edge.high or _EPOCH
    # bins without points are not made, however long an interval is
    start = F.greatest(F.coalesce(F.col(first), F.lit(low)), F.lit(low))
    end = F.least(F.coalesce(F.col(last), F.lit(high)), F.lit(high))
    cut = (
        intervals.withColumns({"_start": start, "_end": end})
        .where("_start <= _end")
        .withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_start")), bin_of(F.col("_end")))))
    )
    return (
        placed.join(cut, ["_bin", *keys])
        .where(F.col(day).between(F.col("_start"), F.col("_end")))
        .drop("_bin", "_start", "_end")
    )
