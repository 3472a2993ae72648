"""Small helpers the text operators share."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.sources.scratch import discard, scratch_path, settle

__all__ = ["discard", "fresh", "keyed_text", "partitions_for", "read", "scratch_path", "settle", "table"]

#: What one task is given of a stage that works on whole groups, in bytes.
TASK_BYTES = 16 * 2**20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` under the names an operator uses; all others are left behind.

    An operator never sees a caller's further columns, so their names cannot clash with its own.
    """
    return df.select(*[F.col(f"`{given}`").alias(own) for own, given in columns.items()])


def keyed_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return table(docs, id=doc_id, text=text)


def fresh(stem: str) -> str:
    """A column name that no table of a caller has."""
    return f"{stem}_{uuid.uuid4().hex[:10]}"


def partitions_for(total_bytes: int, spark: SparkSession, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for that many bytes, never fewer than the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total_bytes) // task_bytes))
