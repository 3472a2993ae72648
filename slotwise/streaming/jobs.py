"""The ingest checks, audit and breach evaluation as Structured Streaming jobs.

Every sink writes one folder per micro-batch and overwrites it, so a batch that is run again
after a failure leaves the same result. Batch numbers belong to a checkpoint: a new checkpoint over
an output that has batches already would count rows twice, so it is refused.

What is read back does not depend on how the input was cut into batches or in which order it came.
"""

import datetime as dt
from collections.abc import Iterable
from contextlib import AbstractContextManager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    BooleanType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from slotwise.config import DEFAULT_LIMITS, Limits
from slotwise.functions.bands import is_late
from slotwise.functions.filters import (
    MONTH_COLUMN,
    date_range,
    days_before,
    flown,
    moment,
    month_number,
)
from slotwise.operators.audit import INSERT_IMAGE, audit_new, breach_alerts, with_audit_ids
from slotwise.operators.flagging import (
    daily_counters,
    keyed_breaches,
    ruled_routes,
    trailing_breaches,
)
from slotwise.operators.quality import validate
from slotwise.plans.jobs import audited_records, insert_events, read_or_empty
from slotwise.sources.layout import write_audit
from slotwise.sources.schemas import AUDIT_LOG, AUDIT_STORED, FLIGHTS, FLIGHTS_STORED, RESOLUTIONS, SLA_BREACH_LOG
from slotwise.sources.scratch import SPARING, settings

#: Files of one micro-batch, unless the caller says otherwise.
FILES_PER_BATCH = 1000
#: No fact is dated before this.
EARLIEST = dt.date(1990, 1, 1)
IMPLAUSIBLE_DATE = "implausible flight_date"
#: For how long a feed may deliver something again.
REDELIVERY = "7 days"
#: Days of an event-time window.
WINDOW_DAYS = 7
#: When a row of a stream was delivered: what redelivery is measured by.
DELIVERED = "_delivered"
#: The id of a row that only says how far a feed has come; ids of breaches are positive.
HEARTBEAT = -1

#: Names the state store of a session.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
#: State on the executors' disks, of bounded memory; a batch checkpoints what it changed.
STATE_ON_DISK = {
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",
    f"{_ROCKS}.trackTotalNumberOfRows": "false",
    f"{_ROCKS}.boundedMemoryUsage": "true",
    f"{_ROCKS}.maxMemoryUsageMB": "2000",
}
#: Versions of state that a checkpoint keeps: a restart goes on from the last one or the one before.
FEW_VERSIONS = {"spark.sql.streaming.minBatchesToRetain": "2"}

COUNTERS = StructType(
    [
        FLIGHTS["route_id"],
        FLIGHTS["flight_date"],
        StructField("total_flights", LongType()),
        StructField("delayed_flights", LongType()),
        StructField("batch_id", IntegerType()),
        StructField(MONTH_COLUMN, IntegerType()),
    ]
)
DAYS = StructType(
    [
        StructField("first_day", DateType()),
        StructField("last_day", DateType()),
        StructField("batch_id", IntegerType()),
    ]
)
WINDOW_PARTS = StructType(
    [
        StructField("window_start", DateType()),
        FLIGHTS["route_id"],
        StructField("total_flights", LongType()),
        StructField("delayed_flights", LongType()),
        StructField("late", BooleanType()),
        StructField("batch_id", IntegerType()),
    ]
)
EVALUATED = StructType(
    [
        StructField("breach_date", DateType()),
        StructField("route_id", IntegerType()),
        SLA_BREACH_LOG["delay_rate_pct"],
        StructField("total_flights", LongType()),
        StructField("delayed_flights", LongType()),
        StructField("rule_id", IntegerType()),
        StructField("batch_id", IntegerType()),
    ]
)
CHECKED = StructType(
    FLIGHTS.fields
    + [
        StructField("reject_reason", StringType()),
        StructField("batch_id", IntegerType()),
        StructField("outcome", StringType()),
    ]
)


def flight_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int = FILES_PER_BATCH
) -> DataFrame:
    """Stored fact files as a stream of bounded batches."""
    return (
        spark.readStream.schema(FLIGHTS_STORED)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def delivered_flights(
    spark: SparkSession, path: str, max_files_per_trigger: int = FILES_PER_BATCH
) -> DataFrame:
    """:func:`flight_stream` with the moment each file was delivered."""
    stream = flight_stream(spark, path, max_files_per_trigger)
    return stream.select("*", F.col("_metadata.file_modification_time").alias(DELIVERED))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _each_batch(
    stream: DataFrame, write, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Runs ``write`` for every batch; ``path`` is where it leaves a folder for each."""
    spark = stream.sparkSession
    batches = f"{path}/batch_id=*"
    if not _exists(spark, f"{checkpoint}/metadata") and _exists(spark, f"{batches}/*"):
        raise ValueError(
            f"{path} holds batches of another checkpoint; give the stream a new output folder"
        )
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _state_on_disk(spark: SparkSession) -> AbstractContextManager[None]:
    """For queries started inside, unless the session names a state store; a query keeps what it was started with."""
    store = {} if spark.conf.get(STATE_STORE, None) else STATE_ON_DISK
    return settings(spark, store | FEW_VERSIONS | SPARING)


def validate_stream(
    stream: DataFrame, path: str, checkpoint: str, limits: Limits = DEFAULT_LIMITS
) -> StreamingQuery:
    """Splits arriving facts into ``outcome=accepted`` and ``outcome=rejected`` in one write."""

    def write(batch: DataFrame, batch_id: int) -> None:
        outcome = F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
        (
            validate(batch.select(*FLIGHTS.names), limits)
            .withColumn("outcome", outcome)
            .write.mode("overwrite")
            .partitionBy("outcome")
            .parquet(f"{path}/batch_id={batch_id}")
        )

    return _each_batch(stream, write, path, checkpoint)


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHECKED).parquet(path)


def audit_stream(stream: DataFrame, path: str, checkpoint: str, **stamp) -> StreamingQuery:
    """Insert events of arriving facts in the change log, in its own layout.

    Events that a failed run has stored already are found by their id and left out. They were in the output
    before this run began, so what the run itself stores is never read back. Under a checkpoint
    that goes on only the first batch may have been stored in part; without one all batches are looked up.
    """
    spark = stream.sparkSession
    goes_on = _exists(spark, f"{checkpoint}/metadata")
    # the files of the log are listed here, once
    stored = read_or_empty(spark, path, AUDIT_STORED)
    to_look_up = [] if stored.isEmpty() else [stored]

    def write(batch: DataFrame, batch_id: int) -> None:
        events = with_audit_ids(audit_new(batch, **stamp))
        for before in to_look_up:
            start, end = batch.agg(F.min("flight_date"), F.max("flight_date")).head()
            known = insert_events(before, "flights", start, end, undated=True).select("audit_id")
            events = events.join(known, "audit_id", "left_anti")
        write_audit(events, path)
        if goes_on:
            to_look_up.clear()

    return _each_batch(stream, write, path, checkpoint)


def audit_once_stream(
    stream: DataFrame, path: str, checkpoint: str, within: str = REDELIVERY, **stamp
) -> StreamingQuery:
    """Insert events of arriving facts, each once, however often a feed delivers it ``within`` that time.

    An event is known by what it says, as two hashes of 64 bits; the image and the id of an event are made once it is known to
    be new. State holds the hashes of the last ``within`` of deliveries, on the executors' disks unless the session names
    a state store, and drops older ones, so no stored event is read back; a checkpoint keeps the last versions of it, and a
    batch leaves no shuffle files. Facts of any date, or of none, are treated alike. Something delivered again later than that
    is audited again. ``stream`` comes from :func:`delivered_flights`. A checkpoint of the form that kept ids in state cannot be gone on with.
    """
    said = ["flight_id", *INSERT_IMAGE.values()]
    # a hash passes over nulls, so it is told which there are
    missing = sum((F.col(name).isNull().cast("int") * 2**n for n, name in enumerate(said)), F.lit(0))
    hashes = {"_first": F.xxhash64(missing, *said), "_second": F.xxhash64(F.lit(1), missing, *said)}
    given = stream.select(*said, DELIVERED).withColumns(hashes).withWatermark(DELIVERED, within)
    once = with_audit_ids(audit_new(given.dropDuplicatesWithinWatermark(list(hashes)), **stamp))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    with _state_on_disk(stream.sparkSession):
        return _each_batch(once, write, path, checkpoint)


def read_audited_once(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, AUDIT_LOG)


def log_stream(spark: SparkSession, path: str, max_files_per_trigger: int = FILES_PER_BATCH) -> DataFrame:
    """A breach log as a stream; its rows are taken as they were logged."""
    files = spark.readStream.schema(SLA_BREACH_LOG).option("maxFilesPerTrigger", max_files_per_trigger)
    return files.parquet(path)


def resolution_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int = FILES_PER_BATCH
) -> DataFrame:
    files = spark.readStream.schema(RESOLUTIONS).option("maxFilesPerTrigger", max_files_per_trigger)
    return files.parquet(path)


def unresolved_stream(
    log: DataFrame,
    resolutions: DataFrame,
    path: str,
    checkpoint: str,
    within_hours: int = 24,
    lateness: str = "3 days",
) -> StreamingQuery:
    """Breaches that nobody resolved within ``within_hours`` of their being logged, each once.

    Both sides are streams. A breach waits in state for an event of its own in that time, and comes out
    once no such event can still arrive: when both sides have passed its deadline by ``lateness``.
    Then it leaves the state, as do events that no breach can still ask for. What comes later than
    ``lateness`` is not met any more. A side that is silent holds the other up; a row with the id
    ``HEARTBEAT`` moves its time on and is reported nowhere.
    """
    logged = log.select("breach_id", "route_id", "breach_date", "created_at").withWatermark("created_at", lateness)
    events = resolutions.select(F.col("breach_id").alias("_id"), "resolved_at").withWatermark("resolved_at", lateness)
    in_time = F.expr(
        f"breach_id = _id AND resolved_at >= created_at"
        f" AND resolved_at <= created_at + INTERVAL {int(within_hours)} HOURS"
    )
    met = logged.join(events, in_time, "left_outer")

    def write(batch: DataFrame, batch_id: int) -> None:
        overdue = batch.filter(F.col("_id").isNull() & (F.col("breach_id") != HEARTBEAT))
        overdue.select("breach_id", "route_id", "breach_date", "created_at").write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    return _each_batch(met, write, path, checkpoint)


def read_unresolved(spark: SparkSession, path: str) -> DataFrame:
    """Every overdue breach that :func:`unresolved_stream` has reported."""
    names = ["breach_id", "route_id", "breach_date", "created_at"]
    return read_or_empty(spark, path, StructType([SLA_BREACH_LOG[n] for n in names]))


def counter_stream(
    stream: DataFrame, path: str, checkpoint: str, limits: Limits = DEFAULT_LIMITS
) -> StreamingQuery:
    """Daily route counters as additive parts, one per batch and month.

    Counts add up across batches whatever their order, so this needs neither state nor a
    watermark, and a row counts however late it comes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_counters(batch, batch_id, path, limits)

    return _each_batch(stream, write, path, checkpoint)


def _write_counters(batch: DataFrame, batch_id: int, path: str, limits: Limits) -> None:
    counted = daily_counters(batch, limits)
    (
        counted.withColumn(MONTH_COLUMN, month_number(F.col("flight_date")))
        .write.mode("overwrite")
        .partitionBy(MONTH_COLUMN)
        .parquet(f"{path}/batch_id={batch_id}")
    )


def read_counters(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """The counters of a closed range of days; parts of other months are not opened."""
    parts = date_range(read_or_empty(spark, path, COUNTERS), start, end)
    return parts.groupBy("route_id", "flight_date").agg(
        F.sum("total_flights").alias("total_flights"),
        F.sum("delayed_flights").alias("delayed_flights"),
    )


def read_closed_counters(spark: SparkSession, path: str, lateness_days: int = 3) -> DataFrame:
    """All counters, with ``closed`` for days that lie before the latest one by more than the
    lateness. A row that comes later still is counted; it only finds its day closed."""
    counters = read_counters(spark, path)
    latest = counters.agg(F.max("flight_date")).head()[0]
    edge = None if latest is None else days_before(latest, lateness_days)
    return counters.withColumn("closed", F.col("flight_date") < F.lit(edge))


def window_start(date: Column, days: int) -> Column:
    """The first day of the tumbling window of ``days`` days that holds a date, counted from 1970-01-01."""
    return F.date_sub(date, F.pmod(F.unix_date(date), F.lit(days)))


def windowed_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    days: int = WINDOW_DAYS,
    lateness: str = "3 days",
    limits: Limits = DEFAULT_LIMITS,
) -> StreamingQuery:
    """Flown and late rows per route and event-time window, open windows held in state.

    A window is in state until the watermark, ``lateness`` behind the latest date seen, has passed
    its end; then its counts are final there. Rows that come later still, and rows without a date,
    go to a side output as additive parts, so none is lost (:func:`read_windows` adds them up).

    Both outputs are branches of one query, so they are cut alike: in update mode a batch tells every
    window that took a row, and a window takes all rows of a batch or none. What the batch brought for a
    window that it does not tell is what the watermark kept out. One shuffle of counts tells them apart.
    """
    given = flown(stream).select(
        "route_id",
        "flight_date",
        F.timestamp_seconds(F.unix_date("flight_date") * 86400).alias("_at"),
        F.coalesce(is_late(F.col("arr_delay_mins"), limits.delayed_mins).cast("bigint"), F.lit(0)).alias("_delayed"),
    )
    total, delayed = F.count(F.lit(1)), F.sum("_delayed")
    held = (
        given.withWatermark("_at", lateness)
        .groupBy(F.window("_at", f"{int(days)} days").alias("_window"), "route_id")
        .agg(total.alias("_total"), delayed.alias("_late"))
    )
    first_day = F.date_from_unix_date((F.unix_seconds("_window.start") / 86400).cast("int"))
    told = held.select(
        first_day.alias("window_start"), "route_id", F.lit(True).alias("_held"), "_total", "_late"
    )
    brought = given.select(
        window_start(F.col("flight_date"), days).alias("window_start"),
        "route_id",
        F.lit(False).alias("_held"),
        F.lit(1).cast("bigint").alias("_total"),
        F.col("_delayed").alias("_late"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        def of(name: str, held: bool) -> Column:
            return F.sum(F.when(F.col("_held") == F.lit(held), F.col(name)))

        late = of("_total", True).isNull()
        batch.groupBy("window_start", "route_id").agg(
            F.coalesce(of("_total", True), of("_total", False)).alias("total_flights"),
            F.coalesce(of("_late", True), of("_late", False)).alias("delayed_flights"),
            late.alias("late"),
        ).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _each_batch(told.unionByName(brought), write, path, checkpoint, "update")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Counts of each window and route: what its state came to, and what came too late for it.

    Counts in state only grow, so the greatest is the last one told.
    """
    parts = read_or_empty(spark, path, WINDOW_PARTS)
    of = {
        name: F.coalesce(F.max(F.when(~F.col("late"), F.col(name))), F.lit(0))
        + F.coalesce(F.sum(F.when(F.col("late"), F.col(name))), F.lit(0))
        for name in ("total_flights", "delayed_flights")
    }
    after = F.coalesce(F.sum(F.when(F.col("late"), F.col("total_flights"))), F.lit(0))
    return parts.groupBy("window_start", "route_id").agg(
        *[value.alias(name) for name, value in of.items()], after.alias("late_flights")
    )


def days_to_evaluate(
    touched: Iterable[dt.date], latest: dt.date, before: dt.date | None, window: int
) -> list[dt.date]:
    """Days whose outcome a batch may have changed: those whose window holds a touched day, and
    those that have passed since the latest day of the batches before."""
    found = set()
    for day in touched:
        ahead = min(window, (latest - day).days)
        found.update(day + dt.timedelta(days=n) for n in range(ahead + 1))
    if before is not None:
        found.update(before + dt.timedelta(days=n) for n in range(1, (latest - before).days + 1))
    return sorted(found)


def breach_stream(
    stream: DataFrame,
    r: DataFrame,
    rules: DataFrame,
    path: str,
    checkpoint: str,
    per_carrier_rules: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    plausible: tuple[dt.date, dt.date] | None = None,
) -> StreamingQuery:
    """Counts each batch and evaluates every day that it touched or that has passed since.

    Rows dated outside ``plausible`` (by default from 1990 to a year from today) are kept in
    ``aside`` with a reason, not counted: one wrong date would make days without end to evaluate.

    ``path`` holds the counters, the days that each batch evaluated and what it found. A batch's
    outcome for a day replaces earlier ones (see :func:`read_breaches`), so late rows reopen
    their days. Counters of earlier batches are read back, in the months of the windows only,
    instead of being held in state.
    """
    today = dt.datetime.now(dt.UTC).date()
    bounds = plausible or (EARLIEST, today + dt.timedelta(days=366))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counters, days, found = (f"{path}/{name}" for name in ("counters", "days", "found"))
        date = F.col("flight_date")
        strange = F.coalesce((date < F.lit(bounds[0])) | (date > F.lit(bounds[1])), F.lit(False))
        batch.filter(strange).select(*FLIGHTS.names, F.lit(IMPLAUSIBLE_DATE).alias("reject_reason")).write.mode(
            "overwrite"
        ).parquet(f"{path}/aside/batch_id={batch_id}")
        _write_counters(batch.filter(~strange), batch_id, counters, limits)
        own = spark.read.schema(COUNTERS).parquet(f"{counters}/batch_id={batch_id}")
        # rows without a date are counted, but lie on no day that could be evaluated
        dated = own.select("flight_date").filter("flight_date IS NOT NULL").distinct()
        touched = sorted(row[0] for row in dated.collect())
        earlier = read_or_empty(spark, days, DAYS).filter(F.col("batch_id") < batch_id)
        before = earlier.agg(F.max("last_day")).head()[0]
        ruled, windows = ruled_routes(r, rules, per_carrier_rules)
        window = max(windows, default=0)
        ends = []
        if touched:
            latest = max(touched[-1], before or touched[-1])
            ends = days_to_evaluate(touched, latest, before, window)
        outcome = spark.createDataFrame([], EVALUATED)
        if ends:
            recent = read_counters(spark, counters, days_before(ends[0], window), ends[-1])
            outcome = trailing_breaches(recent, ruled, windows, ends, None, limits)
        names = [name for name in EVALUATED.names if name != "batch_id"]
        folder = f"batch_id={batch_id}"
        outcome.select(*names).write.mode("overwrite").parquet(f"{found}/{folder}")
        _days_frame(spark, ends).write.mode("overwrite").parquet(f"{days}/{folder}")

    return _each_batch(stream, write, f"{path}/days", checkpoint)


def _days_frame(spark: SparkSession, days: list[dt.date]) -> DataFrame:
    """Runs of evaluated days as (first, last)."""
    runs: list[list[dt.date]] = []
    for day in days:
        if runs and day - runs[-1][1] == dt.timedelta(days=1):
            runs[-1][1] = day
        else:
            runs.append([day, day])
    return spark.createDataFrame([tuple(run) for run in runs], "first_day date, last_day date")


def read_breaches(spark: SparkSession, path: str) -> DataFrame:
    """What the last batch that evaluated a day found on it, for every day."""
    runs = read_or_empty(spark, f"{path}/days", DAYS)
    each = runs.select("batch_id", F.explode(F.sequence("first_day", "last_day")).alias("breach_date"))
    last = each.groupBy("breach_date").agg(F.max("batch_id").alias("batch_id"))
    found = read_or_empty(spark, f"{path}/found", EVALUATED)
    return found.join(last, ["breach_date", "batch_id"]).drop("batch_id")


def log_breaches(
    spark: SparkSession, path: str, audit_path: str, now: dt.datetime | None = None
) -> DataFrame:
    """The breaches of a stream as a log, and an alert for each that has none yet.

    An alert is known by what it says, so a breach that late rows change is announced again.
    """
    stamp = F.current_timestamp() if now is None else moment(now)
    log = keyed_breaches(read_breaches(spark, path), stamp)
    start, end = log.agg(F.min("breach_date"), F.max("breach_date")).head()
    if start is not None:
        alerts = with_audit_ids(breach_alerts(log, changed_at=now))
        sent = audited_records(spark, audit_path, "sla_breach_log", start, end)
        write_audit(alerts.join(sent.select("audit_id"), "audit_id", "left_anti"), audit_path)
    return log
