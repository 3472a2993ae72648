"""Mergeable measures: aggregate facts before they meet a dimension.

Every report groups by an attribute of the route. Aggregating the facts by ``route_id``
first, joining the dimensions to that small result and merging it once more gives the same
numbers as joining first, but the facts are never shuffled or joined: each map task reduces
its rows to one per route, so a route that holds a third of all rows costs no more than any
other.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIRST = {"count_if": F.count_if, "sum": F.sum, "max": F.max, "min": F.min, "filled": F.count}
_AGAIN = {"count_if": F.sum, "sum": F.sum, "max": F.max, "min": F.min, "filled": F.sum}


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str
    value: Column

    def first(self) -> Column:
        return _FIRST[self.kind](self.value).alias(self.name)

    def again(self) -> Column:
        return _AGAIN[self.kind](F.col(self.name)).alias(self.name)


def rows(name: str) -> Measure:
    return Measure(name, "filled", F.lit(1))


def rows_where(name: str, condition: Column) -> Measure:
    return Measure(name, "count_if", condition)


def total(name: str, value: Column) -> Measure:
    return Measure(name, "sum", value)


def filled(name: str, value: Column) -> Measure:
    return Measure(name, "filled", value)


def highest(name: str, value: Column) -> Measure:
    return Measure(name, "max", value)


def lowest(name: str, value: Column) -> Measure:
    return Measure(name, "min", value)


def averaged(name: str, value: Column) -> tuple[Measure, Measure]:
    """The two parts of a mean, ``<name>_sum`` and ``<name>_n``."""
    return total(f"{name}_sum", value), filled(f"{name}_n", value)


def summarise(df: DataFrame, keys: list, measures: list[Measure]) -> DataFrame:
    return df.groupBy(*keys).agg(*[m.first() for m in measures])


def merge(df: DataFrame, keys: list, measures: list[Measure]) -> DataFrame:
    return df.groupBy(*keys).agg(*[m.again() for m in measures])
