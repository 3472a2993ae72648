"""Loads on-time performance CSV files as facts and routes."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from slotwise.operators.keys import route_dimension
from slotwise.sources.schemas import DEFAULTS, FLIGHTS
from slotwise.sources.scratch import settle
from slotwise.sources.tables import fill_defaults, normalise_codes

# Target field and its column in the public on-time performance download.
COLUMNS = {
    "flight_date": "FL_DATE",
    "carrier_code": "OP_UNIQUE_CARRIER",
    "flight_number": "OP_CARRIER_FL_NUM",
    "origin": "ORIGIN",
    "destination": "DEST",
    "scheduled_dep": "CRS_DEP_TIME",
    "actual_dep": "DEP_TIME",
    "dep_delay_mins": "DEP_DELAY",
    "scheduled_arr": "CRS_ARR_TIME",
    "actual_arr": "ARR_TIME",
    "arr_delay_mins": "ARR_DELAY",
    "cancelled": "CANCELLED",
    "diverted": "DIVERTED",
    "scheduled_elapsed": "CRS_ELAPSED_TIME",
    "distance_miles": "DISTANCE",
    "carrier_delay": "CARRIER_DELAY",
    "weather_delay": "WEATHER_DELAY",
    "nas_delay": "NAS_DELAY",
    "security_delay": "SECURITY_DELAY",
    "late_aircraft_delay": "LATE_AIRCRAFT_DELAY",
}
TEXTS = ("carrier_code", "flight_number", "origin", "destination")
REQUIRED = ("flight_date", *TEXTS, "scheduled_dep", "scheduled_arr")
BROKEN = "_broken_line"
WRONG = "_wrong_value"


def read_ontime(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str] = COLUMNS,
    date_format: str = "yyyy-MM-dd",
) -> tuple[DataFrame, DataFrame]:
    """Typed rows keyed by carrier, origin and destination, and the lines that do not fit.

    Only one header is read ahead, for the column order; a file with another order is an error.
    Every field is then cast by what it is for. A blank is a missing value; anything else that
    cannot be cast, or is no whole number, makes the line one that does not fit. The delays of a
    cancelled movement are 0 where they are blank. Columns that the file lacks are left out.

    Texts are parsed once: the typed lines are written out, and whoever reads the result reads these.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = StructType([StructField(name, StringType()) for name in [*header, BROKEN]])
    raw = (
        spark.read.schema(schema)
        .options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
        .option("enforceSchema", False)
        .csv(path)
    )
    fields, numeric = {}, {}
    for field, source in columns.items():
        if source not in header and field not in REQUIRED:
            continue
        given = F.trim(source)
        if field == "flight_date":
            fields[field] = F.try_to_timestamp(source, F.lit(date_format)).cast("date")
        elif field in TEXTS:
            fields[field] = given
        else:
            numeric[field] = given
            fields[field] = F.col("_whole")[len(numeric) - 1]
    # one expression over the list of all numbers: written out per column, the code that Spark makes of it
    # is too long to be compiled
    given = F.col("_given")
    whole = F.transform(
        F.transform(given, lambda text: text.try_cast("double")),
        lambda number: F.when(number == F.floor(number), number).try_cast("int"),
    )
    wrong = F.exists(F.zip_with(given, whole, lambda text, value: (text != "") & value.isNull()), lambda x: x)
    raw = raw.withColumn("_given", F.array(*numeric.values()))
    raw = raw.withColumns({"_whole": whole, WRONG: F.coalesce(wrong, F.lit(False))})
    if "cancelled" in fields:
        gone = fields["cancelled"] == 1
        for field in ("dep_delay_mins", "arr_delay_mins"):
            if field in fields:
                fields[field] = F.when(gone, F.coalesce(fields[field], F.lit(0))).otherwise(
                    fields[field]
                )
    typed = raw.select(
        *[value.alias(name) for name, value in fields.items()],
        BROKEN,
        WRONG,
    )
    typed = settle(typed, "ontime-typed")
    complete = F.col(BROKEN).isNull() & ~F.col(WRONG)
    for name in REQUIRED:
        complete = complete & F.col(name).isNotNull()
    kept = normalise_codes(typed.filter(complete).drop(BROKEN, WRONG))
    return kept, typed.filter(~complete).drop(WRONG)


def ontime_routes(keyed: DataFrame) -> DataFrame:
    """Routes seen in the rows, their duration the rounded mean of the scheduled ones."""
    usual = F.round(F.avg("scheduled_elapsed"))
    return route_dimension(keyed, F.coalesce(usual, F.lit(0)))


#: Columns that the load makes itself.
MADE = ("flight_id", "route_id", "created_at")


def ontime_flights(keyed: DataFrame, r: DataFrame) -> DataFrame:
    """Facts in the star's schema; the id is a hash of what identifies a flight."""
    natural = ["carrier_code", "origin", "destination"]
    identity = F.xxhash64("flight_date", "flight_number", "scheduled_dep", *natural)
    absent = [name for name in DEFAULTS["flights"] if name not in keyed.columns]
    filled = fill_defaults(keyed, "flights", absent)
    optional = [name for name in FLIGHTS.names if name not in (*filled.columns, *MADE)]
    filled = filled.withColumns(
        {name: F.lit(None).cast(FLIGHTS[name].dataType) for name in optional}
    )
    return (
        filled.withColumns({"flight_id": identity, "created_at": F.current_timestamp()})
        .join(r.select("route_id", *natural), natural)
        .select(*FLIGHTS.names)
    )
