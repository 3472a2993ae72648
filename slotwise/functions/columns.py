"""Columns that most operators use. Functions, since a column needs a running session."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.bands import route_label


def arr_delay() -> Column:
    return F.col("arr_delay_mins")


def dep_delay() -> Column:
    return F.col("dep_delay_mins")


def route() -> Column:
    return route_label(F.col("origin"), F.col("destination"))
