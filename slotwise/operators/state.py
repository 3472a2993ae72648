"""The state of facts at any moment, rebuilt from the change log alone."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from slotwise.functions.filters import moment
from slotwise.operators.audit import INSERT_IMAGE, UPDATE_IMAGE
from slotwise.sources.schemas import FLIGHTS


def _image_type(members: dict[str, str]) -> StructType:
    return StructType([StructField(name, FLIGHTS[column].dataType) for name, column in members.items()])


def facts_as_of(events: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """flight_id and the logged columns of every fact as of ``at`` (its end, if not given).

    Images are parsed by their declared types. Per fact the value of a column is that of the last event
    that carries it: inserts carry six columns, updates four. Events of one moment go in the order
    insert, then update; of two updates of one fact at one moment either may count last. An
    update of a fact that was never inserted gives a row with what it says. A column's value and its
    moment are single figures, so facts are combined on the map side by hashing; the flight's
    number, a text, is an insert's own and goes by the first key order.
    """
    own = events.where((F.col("table_name") == "flights") & F.col("operation").isin("INSERT", "UPDATE"))
    if at is not None:
        own = own.where(F.col("changed_at") <= moment(at))
    inserted = F.from_json("new_values", _image_type(INSERT_IMAGE))
    updated = F.from_json("new_values", _image_type(UPDATE_IMAGE))
    is_insert = F.col("operation") == "INSERT"
    turn = F.unix_micros("changed_at") * 2 + F.when(is_insert, 0).otherwise(1)
    parsed = own.select(
        F.col("record_id").alias("flight_id"),
        turn.alias("_turn"),
        is_insert.alias("_new"),
        F.when(is_insert, inserted).alias("_i"),
        F.when(~is_insert, updated).alias("_u"),
    )
    columns = []
    for name, column in {**INSERT_IMAGE, **UPDATE_IMAGE}.items():
        kind = FLIGHTS[column].dataType
        if name in INSERT_IMAGE and name in UPDATE_IMAGE:
            value, turn = F.coalesce(f"_i.{name}", f"_u.{name}"), F.col("_turn")
        else:
            carried = F.col("_new") if name in INSERT_IMAGE else ~F.col("_new")
            source = "_i" if name in INSERT_IMAGE else "_u"
            value, turn = F.col(f"{source}.{name}"), F.when(carried, F.col("_turn"))
        if isinstance(kind, StringType):
            columns.append(F.max(value).alias(column))
            continue
        # days as numbers: a value that fits a register is combined by hashing
        plain = F.unix_date(value) if isinstance(kind, DateType) else value
        last = F.max_by(plain, turn)
        last = F.date_from_unix_date(last) if isinstance(kind, DateType) else last.cast(IntegerType())
        columns.append(last.alias(column))
    return parsed.groupBy("flight_id").agg(*columns)
