"""Ranks over whole tables: no task sorts or counts more than one range of the rows.

A global window without partition keys brings every row to one task. Here the rows are dealt to
ranges of the order, each is sorted and numbered by itself, and what lies before a range is one figure
for each range. Rows that tie may fill many ranges; their rank is carried from where they begin.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.sources.scratch import settle

#: Low bits of a row's mark that hold its place within its range.
PLACE_BITS = 33
RANGE, PLACE = "_range", "_place"


def laid_out(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` stored in ``order``, each row with its range (ascending) and its place in it from 0.

    ``order`` must tell rows apart as far as their places matter, and should end in a key that
    spreads ties, or a value that fills a third of the table stays in one range. The table is read
    twice (the ranges are drawn from a sample), so pass one that is stored.
    """
    mark = F.monotonically_increasing_id()
    stored = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", mark), name)
    return stored.select(
        *df.columns,
        F.shiftright("_mark", PLACE_BITS).cast("int").alias(RANGE),
        F.col("_mark").bitwiseAND((1 << PLACE_BITS) - 1).alias(PLACE),
    )


def row_places(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Rows of each group numbered from 0 in ``order`` (``_nr``), with the group's size (``_rows``).

    ``order`` begins with what puts a group's rows together. A group may span any number of ranges.
    """
    placed = laid_out(df, order, name)
    each = placed.groupBy(RANGE, *group).agg(F.count(F.lit(1)).alias("_here"), F.min(PLACE).alias("_first"))
    # a group has one row here for each range it touches
    whole = Window.partitionBy(*group)
    before = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(
        RANGE, *group, "_first",
        F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"),
        F.sum("_here").over(whole).alias("_rows"),
    )
    starts = settle(starts, f"{name}-starts")
    return placed.join(starts, [RANGE, *group]).select(
        *df.columns, (F.col("_before") + F.col(PLACE) - F.col("_first")).alias("_nr"), "_rows"
    )


def global_ranks(df: DataFrame, value: str, key: Sequence[str]) -> DataFrame:
    """``df`` with ``rank``, ``dense_rank`` and ``percent_rank`` of ``value`` over all rows, NULLs first.

    ``key`` tells rows with equal values apart, so that they may fill any number of ranges. What
    comes to the driver is one row for each range: its size, its values' number, the first and the last.
    """
    spark = df.sparkSession
    order = [F.col(value).asc_nulls_first(), *key]
    placed = laid_out(settle(df, "to-rank"), order, "ranked-ranges")
    inside = Window.partitionBy(RANGE).orderBy(F.col(value).asc_nulls_first())
    local = placed.withColumns({"_local": F.rank().over(inside), "_dense": F.dense_rank().over(inside)})
    local = settle(local, "ranked-inside")
    each = local.groupBy(RANGE).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("_dense").alias("kinds"),
        F.max(F.when(F.col("_dense") == 1, F.col(value))).alias("first"),
        F.max_by(value, "_dense").alias("last"),
        F.max("_local").alias("last_local"),
    )
    starts, before, dense, run, previous = [], 0, 0, 0, None
    for row in sorted(each.collect(), key=lambda r: r[RANGE]):
        # a value that goes on from the range before keeps the rank it began with
        goes_on = previous is not None and previous[0] == row.first
        first_rank = run if goes_on else before + 1
        starts.append((row[RANGE], before, dense - goes_on, first_rank))
        dense += row.kinds - goes_on
        run = first_rank if row.kinds == 1 else before + row.last_local
        before, previous = before + row.rows, (row.last,)
    shift = spark.createDataFrame(starts, f"{RANGE} int, _before bigint, _dense_before bigint, _run bigint")
    rank = F.when(F.col("_dense") == 1, F.col("_run")).otherwise(F.col("_before") + F.col("_local"))
    share = (rank - 1) / F.lit(before - 1).cast("double") if before > 1 else F.lit(0.0)
    return local.join(shift, RANGE).select(
        *df.columns,
        rank.cast("bigint").alias("rank"),
        (F.col("_dense_before") + F.col("_dense")).cast("bigint").alias("dense_rank"),
        share.alias("percent_rank"),
    )
