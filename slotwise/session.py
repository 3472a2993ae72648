"""Session settings the library is written for."""

from pyspark.sql import SparkSession

# Adaptive execution does the run-time work the operators count on: merging small
# shuffle partitions, splitting skewed join partitions and splitting rebalanced writes.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


BYTES_PER_PARTITION = 128 * 1024 * 1024


def partitions_for(shuffled_bytes: int) -> int:
    """Initial shuffle partitions for a job that moves that many bytes, at least 200.

    Adaptive execution merges partitions that turn out small but never cuts ordinary ones, so
    the initial number has to fit the largest shuffle.
    """
    return max(200, -(-shuffled_bytes // BYTES_PER_PARTITION))


def session(
    app_name: str = "slotwise", shuffled_bytes: int | None = None, **extra: str
) -> SparkSession:
    """A session with :data:`SETTINGS`; keyword names use ``__`` for dots."""
    settings = dict(SETTINGS)
    if shuffled_bytes is not None:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(
            partitions_for(shuffled_bytes)
        )
    settings.update({key.replace("__", "."): value for key, value in extra.items()})
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
