"""Reading and writing whole tables."""

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from slotwise.functions.filters import moment
from slotwise.sources.schemas import CODES, DEFAULTS, TABLES


def load(spark: SparkSession, table: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Typed load of one of the seven tables, codes trimmed and upper-cased."""
    df = spark.read.schema(TABLES[table]).format(fmt).options(**options).load(path)
    return normalise_codes(df)


def normalise_codes(df: DataFrame) -> DataFrame:
    """Codes compare without regard to case or padding in the source; make that explicit."""
    return df.withColumns({c: F.upper(F.trim(c)) for c in CODES if c in df.columns})


def fill_defaults(
    df: DataFrame, table: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Column defaults, of the given columns only if there is a list; a column the input lacks
    altogether is added with its default."""
    schema: StructType = TABLES[table]
    values = DEFAULTS.get(table, {})
    values = {name: v for name, v in values.items() if columns is None or name in columns}
    filled = {}
    for name, value in values.items():
        kind = schema[name].dataType
        literal = F.lit(Decimal(str(value)) if isinstance(kind, DecimalType) else value).cast(kind)
        filled[name] = F.coalesce(F.col(name), literal) if name in df.columns else literal
    return df.withColumns(filled)


def insert_if_absent(
    target: DataFrame, incoming: DataFrame, key: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """The rows of ``incoming`` whose key the target lacks, the first per key by ``order_by``.

    Rows of known keys go first. Of the others only the first of each key in each task is sent on,
    as Spark applies a limit on a rank before the shuffle.
    """
    absent = incoming.join(target.select(*key), list(key), "left_anti")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order_by))
    return absent.withColumn("_place", place).filter("_place = 1").select(*incoming.columns)


def upsert_rules(
    rules: DataFrame, changes: DataFrame, changed_by: str, changed_at: dt.datetime
) -> DataFrame:
    """Rules with changes applied by ``rule_id``; changed rows carry the change stamp."""
    stamped = changes.withColumns(
        {
            "updated_at": moment(changed_at),
            "updated_by": F.lit(changed_by),
        }
    ).select(*TABLES["sla_rules"].names)
    kept = rules.join(changes.select("rule_id"), "rule_id", "left_anti")
    return kept.select(*TABLES["sla_rules"].names).unionByName(stamped)


def export_csv(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, one_file: bool = False
) -> None:
    """CSV with a header. ``one_file`` is for report-size output only."""
    out = df.select(*columns) if columns else df
    if one_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)


def run_sql(
    spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame
) -> DataFrame:
    """Parametrised SQL: ``:name`` markers bind values, ``{name}`` refers to a frame."""
    return spark.sql(text, args=args, **frames)
