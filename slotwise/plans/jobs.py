"""End-to-end jobs: ingest with checks and audit, and the daily breach run.

Parquet appends are not one transaction. Each job writes the leading table first and derives
the rest from what is stored, so running it again completes what a failed run left out and
adds nothing twice.
"""

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slotwise.config import DEFAULT_LIMITS, Limits
from slotwise.functions.filters import BREACH_MONTH, MONTH_COLUMN, moment, month_number
from slotwise.operators.audit import (
    audit_new,
    audit_updates,
    breach_alerts,
    repeated_old_keys,
    with_audit_ids,
)
from slotwise.operators.flagging import (
    current_log,
    flag_breaches,
    keyed_breaches,
    resolve_breaches,
)
from slotwise.operators.keysets import having, lacking
from slotwise.operators.quality import (
    REPEATED_KEY,
    REPEATED_STORED_KEY,
    STORED_KEY,
    accepted,
    missing_reason,
    rejected,
    validate,
)
from slotwise.sources.counters import Counters
from slotwise.sources.keyed import KeyIndex
from slotwise.sources.layout import (
    dealt_by_month,
    drop_months,
    with_month,
    write_audit,
    write_breaches,
    write_flights,
    write_quarantine,
)
from slotwise.sources.schemas import (
    AUDIT_STORED,
    BREACHES_STORED,
    FLIGHTS,
    FLIGHTS_STORED,
    PERIOD_COLUMN,
    QUARANTINE_STORED,
    RESOLUTIONS,
)
from slotwise.sources.scratch import settle, sparing

#: What an ingest counts: rows it was given, stored, kept aside and audited.
INGEST_COUNTERS = ("given", "stored", "aside", "audited")


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table, or no rows while nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest_flights(
    incoming: DataFrame,
    flights_path: str,
    quarantine_path: str,
    audit_path: str,
    changed_by: str | None = None,
    changed_at: dt.datetime | None = None,
    limits: Limits = DEFAULT_LIMITS,
    clamp_early: bool = False,
    index: KeyIndex | None = None,
) -> dict[str, int]:
    """Stores the facts that may be stored, keeps all others aside under a reason, audits.

    Refused are rows that break a rule or lack a required value, further rows of a key in the
    batch, and rows whose key is stored already with other values, in whatever month. A row that
    is stored as it is counts as done, so a batch may be given again.

    With an ``index`` that every job on these facts is given, stored keys are looked up there
    instead of in the key column of all months.

    Returns how many rows were given, stored, kept aside and audited, as the writes counted them.
    """
    spark = incoming.sparkSession
    counters = Counters()

    def counted(name: str) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: counters.watch(name, rows)

    with sparing(spark):
        checked = validate(incoming.select(*FLIGHTS.names), limits, clamp_early)
        reason = F.coalesce(missing_reason(), F.col("reject_reason"))
        checked = settle(counters.watch("given", checked.withColumn("reject_reason", reason)), "checked")
        first, further = one_of_each_key(accepted(checked))
        stored = read_or_empty(spark, flights_path, FLIGHTS_STORED)
        fresh, done, other = _by_what_is_stored(first, stored, index)
        bad = reduce(
            DataFrame.unionByName,
            [
                rejected(checked),
                further.withColumn("reject_reason", F.lit(REPEATED_KEY)),
                other.withColumn("reject_reason", F.lit(STORED_KEY)),
            ],
        )
        write_quarantine(_not_aside(spark, bad, quarantine_path), quarantine_path, counted("aside"))
        if fresh is not None:
            if index is not None:
                index.add(fresh)
            write_flights(fresh, flights_path, watch=counted("stored"))
        # rows of an earlier run that failed before it audited are audited now
        start, end, rows = done.agg(F.min("flight_date"), F.max("flight_date"), F.count(F.lit(1))).head()
        unaudited = None
        if start is not None:
            audited = audited_records(spark, audit_path, "flights", start, end)
            unaudited = _unless_known(done, rows, audited.select(F.col("record_id").alias("flight_id")))
        if unaudited is not None:
            # facts are dealt to the months of the log as they are; images and ids, which are longer, come after
            events = with_audit_ids(audit_new(dealt_by_month(unaudited), changed_by, changed_at))
            write_audit(events, audit_path, counted("audited"), dealt=True)
    return counters.read(*INGEST_COUNTERS)


def _row_digest(names: Sequence[str]) -> Column:
    """128 bits of a row, NULL values included."""
    return F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def _short_digest(names: Sequence[str]) -> Column:
    """:func:`_row_digest` in 16 bytes, for what is shuffled and not stored."""
    return F.unhex(_row_digest(names))


#: What makes two facts of a key the same; when a row was made does not count.
CONTENT = [name for name in FLIGHTS.names if name != "created_at"]


def one_of_each_key(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of each ``flight_id``, all further rows).

    Only keys that repeat are looked at row by row. Equal rows are counted first, so that a
    key with any number of copies comes down to a few rows where they lie; the row of least
    digest is kept. All other rows stay where they lie.
    """
    keys = f.groupBy("flight_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    keys = settle(keys.select("flight_id"), "repeated-keys")
    if keys.isEmpty():
        return f, f.filter(F.lit(False))
    single, repeated = lacking(f, keys), having(f, keys)
    kinds = repeated.groupBy(*f.columns).agg(F.count(F.lit(1)).alias("_copies"))
    kinds = settle(kinds.withColumn("_mark", F.xxhash64(_row_digest(f.columns))), "row-kinds")
    least = kinds.groupBy("flight_id").agg(F.min("_mark").alias("_least"))
    chosen = kinds.join(least, "flight_id").withColumn("_rest", F.col("_copies") - F.when(
        F.col("_mark") == F.col("_least"), 1).otherwise(0))
    kept = settle(chosen.filter("_mark = _least").select(*f.columns), "kept")
    further = chosen.filter("_rest > 0").select(
        *f.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "_rest")).alias("_copy")
    )
    return single.unionByName(kept), further.select(*f.columns)


def _hit_months(f: DataFrame, stored: DataFrame, index: KeyIndex | None) -> list[int | None]:
    """The months in which keys of ``f`` are, or may be, stored."""
    if index is not None:
        return _months(index.places(f), MONTH_COLUMN)
    keys = f.select("flight_id")
    return _months(stored.select("flight_id", MONTH_COLUMN).join(keys, "flight_id", "left_semi"), MONTH_COLUMN)


def _clashes(f: DataFrame, stored: DataFrame, index: KeyIndex | None) -> DataFrame:
    """(flight_id, same): keys of ``f`` that are stored, and whether the stored row is the same.

    Of the stored facts only the key is read in all months, or the index instead; whole rows are
    read in the months that hold a key, and come down to key and digest where they lie.
    """
    given = f.select("flight_id", _short_digest(CONTENT).alias("_given"))
    known = stored.filter(_in_months(F.col(MONTH_COLUMN), _hit_months(f, stored, index))).select(
        "flight_id", _short_digest(CONTENT).alias("_stored")
    )
    return known.join(given, "flight_id").groupBy("flight_id").agg(
        F.bool_or(F.col("_stored") == F.col("_given")).alias("same")
    )


def _by_what_is_stored(
    f: DataFrame, stored: DataFrame, index: KeyIndex | None
) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(rows of keys that are not stored, these and rows that are stored as they are, rows of other stored values).

    ``f`` holds a key once and is a stored table or a cheap view of one. Keys and digests are told apart, and whole
    rows are shuffled only where neither few keys are stored nor all. None is said where all keys are stored.
    """
    none = f.filter(F.lit(False))
    if stored.isEmpty():
        return f, f, none
    here = settle(_clashes(f, stored, index), "keys-stored")
    other = settle(here.filter("not same").select("flight_id"), "keys-of-other-values")
    fresh = _unless_these(f, f.count(), here)
    return fresh, lacking(f, other), none if other.isEmpty() else having(f, other)


def _unless_these(rows: DataFrame, total: int, known: DataFrame) -> DataFrame | None:
    """Rows of no key of ``known``, of ``total`` rows with a key each that hold all of these; None if none is left."""
    return None if known.count() == total else lacking(rows, known)


def _unless_known(rows: DataFrame, total: int, known: DataFrame) -> DataFrame | None:
    """:func:`_unless_these` for ``known`` that may hold other keys, and keys several times."""
    if known.isEmpty():
        return rows
    met = rows.select("flight_id").join(known, "flight_id", "left_semi")
    return _unless_these(rows, total, settle(met, "known"))


def _not_aside(spark: SparkSession, bad: DataFrame, path: str) -> DataFrame:
    """Refused rows that are not kept aside yet; of equal rows, those beyond the number kept.

    A row is known by the digest that is stored with it. Equal rows have one date, so only the months
    of the refused rows are looked at, and of these only the digests.
    """
    names = [*CONTENT, "reject_reason"]
    made = F.max("created_at").alias("created_at")
    kinds = bad.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"), made)
    kinds = settle(kinds.withColumn("row_digest", _row_digest(names)), "refused")
    months = _months(kinds.select(month_number(F.col("flight_date")).alias(MONTH_COLUMN)), MONTH_COLUMN)
    aside = read_or_empty(spark, path, QUARANTINE_STORED).filter(_in_months(F.col(MONTH_COLUMN), months))
    if aside.isEmpty():
        return _copied(kinds.withColumn("_left", F.col("_copies")), bad.columns)
    held = aside.groupBy("row_digest").agg(F.count(F.lit(1)).alias("_held"))
    left = F.col("_copies") - F.coalesce("_held", F.lit(0))
    return _copied(kinds.join(held, "row_digest", "left").withColumn("_left", left), bad.columns)


def _copied(kinds: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each refused row with its digest, ``_left`` times."""
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), "_left")).alias("_copy")
    return kinds.filter("_left > 0").select(*names, "row_digest", copies).drop("_copy")


def update_flights(
    changes: DataFrame,
    flights_path: str,
    audit_path: str,
    null_safe: bool = True,
    changed_by: str | None = None,
    changed_at: dt.datetime | None = None,
    change_id: str = "",
    quarantine_path: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
    clamp_early: bool = False,
    index: KeyIndex | None = None,
) -> DataFrame:
    """Replaces stored facts by changed ones and audits the change; unknown keys are returned.

    ``change_id`` names the batch, so that a fact may take the same change again later.
    Changes that break a rule or lack a required value, further changes of a key in the batch, and
    all stored copies of a changed key that is stored more than once, are kept aside in
    ``quarantine_path`` before anything is replaced; the folder's default is the one of the facts with
    ``_aside`` after its name. A key stored more than once is audited against the copy that an
    ingest would have kept.

    Only the months that hold a changed fact, before or after, are written anew, and a month
    that loses its last row is removed. A change that says what is stored already writes nothing. The audit goes first: a run that fails in between finds the
    same changes, under the same ids, again. If it fails before a month is removed, a fact that
    moved is stored in both, and the next run takes the copies for what they are. ``index`` is the one
    that the ingest keeps, if it keeps one.
    """
    spark = changes.sparkSession
    with sparing(spark) as keep:
        checked = validate(changes.select(*FLIGHTS.names), limits, clamp_early)
        reason = F.coalesce(missing_reason(), F.col("reject_reason"))
        checked = settle(checked.withColumn("reject_reason", reason), "given")
        changes, further = one_of_each_key(accepted(checked))
        stored = read_or_empty(spark, flights_path, FLIGHTS_STORED)
        keys = changes.select("flight_id")
        before = stored
        if index is not None:
            before = stored.filter(_in_months(F.col(MONTH_COLUMN), _hit_months(changes, stored, index)))
        old = settle(before.join(keys, "flight_id", "left_semi"), "old-facts")
        several = settle(repeated_old_keys(changes, old).select("flight_id"), "keys-stored-twice")
        copies = settle(having(old, several), "copies-stored")
        bad = reduce(
            DataFrame.unionByName,
            [
                rejected(checked),
                further.withColumn("reject_reason", F.lit(REPEATED_KEY)),
                copies.select(*FLIGHTS.names, F.lit(REPEATED_STORED_KEY).alias("reject_reason")),
            ],
        )
        aside = quarantine_path or f"{flights_path.rstrip('/')}_aside"
        write_quarantine(_not_aside(spark, bad, aside), aside)
        kept, _ = one_of_each_key(copies)
        once = lacking(old, several)
        single = once.unionByName(kept)
        events = with_audit_ids(
            audit_updates(
                changes, single, null_safe=null_safe, changed_by=changed_by, changed_at=changed_at
            ),
            change_id,
        )
        known = read_or_empty(spark, audit_path, AUDIT_STORED).filter(
            (F.col("table_name") == "flights")
            & (F.col("operation") == "UPDATE")
            & _in_months(F.col(PERIOD_COLUMN), _months(with_month(changes), MONTH_COLUMN))
        )
        if not known.isEmpty():
            events = events.join(known.select("audit_id"), "audit_id", "left_anti")
        write_audit(events, audit_path)
        as_stored = settle(_unchanged(changes, once), "unchanged")
        replaced = _unless_in(old.select("flight_id", MONTH_COLUMN), as_stored)
        replaced = settle(replaced, "replaced")
        if not replaced.isEmpty():
            found = having(changes, replaced)
            moved = with_month(found).select(MONTH_COLUMN)
            touched = _months(replaced.select(MONTH_COLUMN).unionByName(moved), MONTH_COLUMN)
            here = stored.filter(_in_months(F.col(MONTH_COLUMN), touched))
            rest = lacking(here, replaced)
            whole = settle(rest.select(*FLIGHTS.names).unionByName(found), "touched-months")
            if index is not None:
                index.add(found)
            write_flights(whole, flights_path, "overwrite")
            left = set(_months(with_month(whole), MONTH_COLUMN))
            drop_months(spark, flights_path, [month for month in touched if month not in left])
        missing = settle(_unless_in(keys, old), "unknown-keys")
        return keep(settle(having(changes, missing), "unknown"))


def _unchanged(changes: DataFrame, old: DataFrame) -> DataFrame:
    """Keys whose one stored row in ``old`` is what the change says, in every column."""
    digest = _short_digest(FLIGHTS.names)
    held = old.select("flight_id", digest.alias("_held"))
    given = changes.select("flight_id", digest.alias("_given"))
    return held.join(given, "flight_id").filter("_held = _given").select("flight_id")


def _months(rows: DataFrame, column: str) -> list[int | None]:
    """The calendar months of some rows, None among them for rows without a date."""
    return [row[0] for row in rows.select(column).distinct().collect()]


def _in_months(column: Column, months: Sequence[int | None]) -> Column:
    found = column.isin([month for month in months if month is not None])
    return found | column.isNull() if None in months else found


def _unless_in(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known.select("flight_id"), "flight_id", "left_anti")


def audited_records(
    spark: SparkSession,
    path: str,
    table: str,
    first: dt.date | None,
    last: dt.date | None,
    undated: bool = False,
) -> DataFrame:
    """Insert events of a table for records dated in the months of the range.

    ``undated`` adds the events of records without a date; without a range they are all.
    """
    return insert_events(read_or_empty(spark, path, AUDIT_STORED), table, first, last, undated)


def insert_events(
    events: DataFrame, table: str, first: dt.date | None, last: dt.date | None, undated: bool = False
) -> DataFrame:
    """:func:`audited_records` of a change log that is read already."""
    wanted = F.lit(False)
    if first is not None:
        wanted = F.col(PERIOD_COLUMN).between(
            first.year * 100 + first.month, last.year * 100 + last.month
        )
    if undated:
        wanted = wanted | (F.col(PERIOD_COLUMN) == 0)
    return events.filter((F.col("table_name") == table) & wanted & (F.col("operation") == "INSERT"))


def run_daily_breaches(
    f: DataFrame,
    r: DataFrame,
    rules: DataFrame,
    log_path: str,
    audit_path: str,
    as_of: dt.date | None = None,
    now: dt.datetime | None = None,
    per_carrier_rules: bool = False,
    limits: Limits = DEFAULT_LIMITS,
) -> int:
    """Flags, logs and announces the breaches of a day; returns how many were new."""
    day = as_of or dt.datetime.now(dt.UTC).date()

    def find(log: DataFrame) -> DataFrame:
        return flag_breaches(f, r, rules, log, day, per_carrier_rules, limits)

    return append_breaches(f.sparkSession, find, log_path, audit_path, day, now)


def append_breaches(
    spark: SparkSession,
    find: Callable[[DataFrame], DataFrame],
    log_path: str,
    audit_path: str,
    day: dt.date,
    now: dt.datetime | None = None,
) -> int:
    """Appends what ``find`` returns for the current log, then every alert that the log still lacks.

    A run that died between log and alerts is made good by the next one, however long that takes:
    ids of the log and of alerts are compared over all months, two narrow columns, and whole rows are read
    in the months that lack an alert. The log is stored by month and known by day and route.
    """
    counters = Counters()
    stamp = F.current_timestamp() if now is None else moment(now)
    fresh = keyed_breaches(find(read_log(spark, log_path)), stamp)
    write_breaches(fresh, log_path, lambda rows: counters.watch("logged", rows))
    log = read_log(spark, log_path)
    sent = read_or_empty(spark, audit_path, AUDIT_STORED).filter(
        (F.col("table_name") == "sla_breach_log") & (F.col("operation") == "INSERT")
    )
    silent = log.select("breach_id", BREACH_MONTH).join(
        sent.select(F.col("record_id").alias("breach_id")), "breach_id", "left_anti"
    )
    silent = settle(silent, "unannounced")
    months = _months(silent, BREACH_MONTH)
    if months:
        here = log.filter(_in_months(F.col(BREACH_MONTH), months))
        lost = here.join(silent.select("breach_id"), "breach_id", "left_semi")
        write_audit(with_audit_ids(breach_alerts(lost, changed_at=now)), audit_path)
    return counters.read("logged")["logged"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored breach log with the month it is partitioned by."""
    return read_or_empty(spark, path, BREACHES_STORED)


def record_resolutions(
    ids: DataFrame, log_path: str, events_path: str, resolved_at: dt.datetime | None = None
) -> DataFrame:
    """Appends a resolution event per breach and returns the status lines.

    An unknown id raises before anything is written. The log itself is never rewritten.
    """
    spark = ids.sparkSession
    log = read_log(spark, log_path)
    _, status = resolve_breaches(log, ids)
    stamp = F.current_timestamp() if resolved_at is None else moment(resolved_at)
    events = status.select(
        F.col("breach_id").cast("bigint").alias("breach_id"), stamp.alias("resolved_at")
    )
    events.write.mode("append").parquet(events_path)
    return status


def read_current_log(spark: SparkSession, log_path: str, events_path: str) -> DataFrame:
    """The breach log with its resolutions applied."""
    return current_log(
        read_log(spark, log_path),
        read_or_empty(spark, events_path, RESOLUTIONS),
    )
