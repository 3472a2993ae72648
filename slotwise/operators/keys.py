"""Surrogate keys without a global sort."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.sources.schemas import ROUTES
from slotwise.sources.scratch import settle


def number_rows(
    df: DataFrame, lead: Sequence[str], order: Sequence[str], name: str, kind: str = "int"
) -> DataFrame:
    """Dense numbers 1..n in the order of ``lead`` then ``order``.

    Rows are numbered inside each ``lead`` group, and the groups before it are added as an
    offset. A group is numbered by one task, so it must be of limited size, such as the routes of
    one day; only one row per group reaches the single task that sums the offsets. The input is
    read twice, so it is written out first and not derived twice.
    """
    df = settle(df, f"{name}-input")
    sizes = df.groupBy(*lead).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *lead, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy(*lead).orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, list(lead))
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast(kind))
        .drop("_inside", "_offset")
    )


def route_dimension(
    keyed: DataFrame, scheduled_mins: Column, sort_code: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """One row per (carrier, origin, destination) seen in the facts, numbered in key order.

    ``scheduled_mins`` aggregates the rows of a route. ``sort_code`` says how airport codes
    order, for codes that are not plain text.
    """
    seen = keyed.groupBy("carrier_code", "origin", "destination").agg(
        scheduled_mins.cast("int").alias("scheduled_mins")
    )
    ordered = seen.withColumns(
        {"_from": sort_code(F.col("origin")), "_to": sort_code(F.col("destination"))}
    )
    numbered = number_rows(ordered, ["carrier_code", "_from"], ["_to"], "route_id")
    return numbered.select(*ROUTES.names)
