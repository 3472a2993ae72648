"""Every operator as a named query over the given tables."""

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from slotwise.config import Limits
from slotwise.functions.bands import is_late
from slotwise.functions.filters import flown, month_number, months_before
from slotwise.operators import (
    airports,
    audit,
    breaches,
    carriers,
    diagnostics,
    flagging,
    intervals,
    quality,
    ranks,
    rule_history,
    scorecard,
    selection,
    sketches,
    state,
    views,
)
from slotwise.plans import catalog
from slotwise.plans.jobs import ingest_flights, read_log, run_daily_breaches, update_flights
from slotwise.sources import retail
from slotwise.sources import tables as stored
from slotwise.sources.exports import displayed, export_reports
from slotwise.sources.keyed import KeyIndex, find_facts
from slotwise.sources.layout import read_audit, read_flights, write_flights
from slotwise.sources.ontime_csv import COLUMNS, ontime_flights, ontime_routes, read_ontime
from slotwise.sources.schemas import FLIGHTS, QUARANTINE_STORED, SLA_BREACH_LOG, TABLES
from slotwise.sources.scratch import SPARING, scratch_path, settings, settle
from slotwise.sources.star import AS_OF, WEEKLY, Star, open_star
from slotwise.streaming import jobs

CARRIER = "MEDIUM"
THRESHOLD = 25.0
ROUTE_ID = 42
SINCE = dt.date(2023, 6, 1)
QUARTER = (dt.date(2023, 1, 1), dt.date(2023, 3, 31))
NOW = dt.datetime(2023, 12, 31, 18)
#: Delays so long that some carriers have none.
RARE = Limits(severe_mins=478)
#: Codes of all airports, the columns of a pivot by destination.
NATIONS = [str(nation) for nation in range(25)]
#: Hours in which a breach should be resolved.
WITHIN_HOURS = 240
#: Days of three daily runs; the first is long past when the others come.
RUNS = [AS_OF - dt.timedelta(days=days) for days in (42, 7, 0)]
#: Buckets of the indexes made here, fit for the given tables.
LOOKUP_BUCKETS = 8
DAILY = [dt.date(2023, 10, 1) + dt.timedelta(days=day) for day in range(92)]

_QUERIES: dict[str, Callable[[Star], DataFrame]] = {}


def query(fn: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(open_star(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


# Carriers


@query
def carrier_ranking(s: Star) -> DataFrame:
    return carriers.carrier_ranking(s.flights, s.routes, s.airlines, months_before(AS_OF, 12))


@query
def carrier_ranking_one_carrier(s: Star) -> DataFrame:
    return carriers.carrier_ranking(s.flights, s.routes, s.airlines, SINCE, AS_OF, CARRIER)


@query
def carrier_kpis(s: Star) -> DataFrame:
    return carriers.carrier_kpis(carrier_ranking(s))


@query
def monthly_trend(s: Star) -> DataFrame:
    return carriers.monthly_trend(s.flights, s.routes, s.airlines)


@query
def root_cause(s: Star) -> DataFrame:
    return carriers.root_cause(s.flights, s.routes, s.airlines)


@query
def root_cause_long(s: Star) -> DataFrame:
    return carriers.root_cause_long(root_cause(s))


@query
def cause_mix(s: Star) -> DataFrame:
    return carriers.cause_mix(root_cause(s))


# Airports


@query
def departure_bottlenecks(s: Star) -> DataFrame:
    return airports.departure_bottlenecks(s.flights, s.routes, s.airports)


@query
def top10_by_rate_of_worst(s: Star) -> DataFrame:
    return airports.top_by_rate_of_worst(departure_bottlenecks(s))


@query
def delay_propagation(s: Star) -> DataFrame:
    return airports.delay_propagation(s.flights, s.routes, s.airports)


@query
def od_matrix(s: Star) -> DataFrame:
    return airports.od_matrix(s.flights, s.routes, s.airports)


@query
def od_pivot(s: Star) -> DataFrame:
    return airports.od_pivot(od_matrix(s), NATIONS)


@query
def time_of_day(s: Star) -> DataFrame:
    return airports.time_of_day(s.flights, s.routes)


@query
def tod_pivot(s: Star) -> DataFrame:
    return airports.tod_pivot(time_of_day(s))


# Breach log reports


@query
def active_breaches(s: Star) -> DataFrame:
    return breaches.active_breaches(s.breach_log, s.routes, s.airlines, s.rules, AS_OF)


@query
def active_breaches_threshold(s: Star) -> DataFrame:
    return breaches.active_breaches(
        s.breach_log, s.routes, s.airlines, s.rules, AS_OF, THRESHOLD, CARRIER
    )


@query
def breach_kpis(s: Star) -> DataFrame:
    return breaches.breach_kpis(active_breaches(s))


@query
def severity_distribution(s: Star) -> DataFrame:
    return breaches.severity_distribution(active_breaches(s))


@query
def chronic_offenders(s: Star) -> DataFrame:
    return breaches.chronic_offenders(s.breach_log, s.routes, s.airlines, AS_OF)


@query
def sla_compliance(s: Star) -> DataFrame:
    return breaches.sla_compliance(s.breach_log, s.routes, s.airlines, AS_OF)


@query
def sla_compliance_threshold(s: Star) -> DataFrame:
    return breaches.sla_compliance(
        s.breach_log, s.routes, s.airlines, AS_OF, threshold=THRESHOLD, match_carrier=CARRIER
    )


@query
def recent_breaches(s: Star) -> DataFrame:
    return breaches.recent_breaches(s.breach_log, NOW)


# Views and procedures


@query
def flight_details(s: Star) -> DataFrame:
    return views.flight_details(s.flights, s.routes, s.airlines, s.airports)


@query
def carrier_monthly_scorecard(s: Star) -> DataFrame:
    return views.carrier_monthly_scorecard(s.flights, s.routes, s.airlines, s.airports)


@query
def route_performance(s: Star) -> DataFrame:
    return views.route_performance(s.flights, s.routes)


@query
def monthly_scorecard(s: Star) -> DataFrame:
    return scorecard.monthly_scorecard(s.flights, s.routes, s.airlines, s.airports, 2023, 3)


@query
def monthly_scorecard_one_carrier(s: Star) -> DataFrame:
    return scorecard.monthly_scorecard(
        s.flights, s.routes, s.airlines, s.airports, 2023, 3, CARRIER
    )


@query
def monthly_scorecard_ranked_among_all(s: Star) -> DataFrame:
    return scorecard.monthly_scorecard(
        s.flights, s.routes, s.airlines, s.airports, 2023, 3, CARRIER, rank_before_filter=True
    )


@query
def dominant_cause(s: Star) -> DataFrame:
    return scorecard.dominant_cause(s.flights, s.routes, s.airlines, 2023, 3)


def _found(df: DataFrame) -> DataFrame:
    return df.withColumn("delay_rate_pct", F.col("delay_rate_pct").cast("double"))


@query
def flag_breaches(s: Star) -> DataFrame:
    """The last evaluation, with the log as it was before that day."""
    log = s.breach_log.filter(F.col("breach_date") < F.lit(AS_OF))
    return _found(flagging.flag_breaches(s.flights, s.routes, s.rules, log, AS_OF))


@query
def flag_breaches_rerun(s: Star) -> DataFrame:
    """The same evaluation once it is in the log: nothing is new."""
    again = flagging.flag_breaches(s.flights, s.routes, s.rules, s.breach_log, AS_OF)
    return again.agg(F.count(F.lit(1)).alias("new_breaches"))


@query
def flag_breaches_carrier_rules(s: Star) -> DataFrame:
    return _found(
        flagging.flag_breaches(s.flights, s.routes, s.rules, None, AS_OF, per_carrier_rules=True)
    )


@query
def breach_backfill(s: Star) -> DataFrame:
    return _found(flagging.backfill_breaches(s.flights, s.routes, s.rules, WEEKLY))


@query
def breach_backfill_daily(s: Star) -> DataFrame:
    """Every day of the last quarter."""
    return _found(flagging.backfill_breaches(s.flights, s.routes, s.rules, DAILY))


@query
def resolve_breaches(s: Star) -> DataFrame:
    """Resolves every critical breach of the last evaluation."""
    ids = s.breach_log.filter(
        (F.col("breach_date") == F.lit(AS_OF)) & (F.col("delay_rate_pct") >= 30)
    )
    log, _ = flagging.resolve_breaches(s.breach_log, ids)
    return log.select("breach_id", "route_id", "breach_date", "resolved")


# Selections


@query
def date_range_summary(s: Star) -> DataFrame:
    return selection.date_range_summary(s.flights, *QUARTER)


@query
def route_slice(s: Star) -> DataFrame:
    return selection.route_slice(s.flights, ROUTE_ID, dt.date(2023, 1, 1))


@query
def carriers_with_severe_in(s: Star) -> DataFrame:
    return selection.carriers_with_severe_in(s.flights, s.routes, s.airlines, RARE)


@query
def carriers_with_severe_exists(s: Star) -> DataFrame:
    return selection.carriers_with_severe_exists(s.flights, s.routes, s.airlines, RARE)


@query
def above_route_avg_join(s: Star) -> DataFrame:
    return selection.above_route_avg_join(s.flights, SINCE)


@query
def above_route_avg_corr(s: Star) -> DataFrame:
    return selection.above_route_avg_corr(s.flights, SINCE)


# Change capture: the old state lacks December and has evening departures five minutes earlier


def _old_state(s: Star) -> DataFrame:
    evening = F.when(F.col("scheduled_dep") >= 1800, 5).otherwise(0)
    return s.flights.filter(F.col("flight_date") < F.lit(dt.date(2023, 12, 1))).withColumn(
        "arr_delay_mins", F.col("arr_delay_mins") - evening
    )


def _without_stamp(rows: DataFrame) -> DataFrame:
    return rows.select("table_name", "operation", "record_id", "old_values", "new_values")


@query
def audit_inserts(s: Star) -> DataFrame:
    return _without_stamp(audit.audit_inserts(s.flights, _old_state(s)))


@query
def audit_updates(s: Star) -> DataFrame:
    return _without_stamp(audit.audit_updates(s.flights, _old_state(s)))


@query
def breach_alerts(s: Star) -> DataFrame:
    return _without_stamp(audit.breach_alerts(s.breach_log))


# Quality


@query
def reject_cause_sum(s: Star) -> DataFrame:
    found = quality.rejected(quality.validate(s.flights), quality.CAUSES_TOO_LARGE)
    return found.select("flight_id", "arr_delay_mins", "reject_reason")


@query
def reject_cancelled_departed(s: Star) -> DataFrame:
    """Facts whose missing departure times were filled from the schedule."""
    filled = s.flights.withColumn("actual_dep", F.coalesce("actual_dep", "scheduled_dep"))
    found = quality.rejected(quality.validate(filled), quality.CANCELLED_DEPARTED)
    return found.select("flight_id", "actual_dep", "reject_reason")


@query
def orphans(s: Star) -> DataFrame:
    """Every foreign key, with the airports of one region taken out."""
    return quality.orphans(
        {
            "airlines": s.airlines,
            "airports": s.airports.filter(F.col("state") != "ASIA"),
            "routes": s.routes,
            "flights": s.flights,
            "sla_rules": s.rules,
            "sla_breach_log": s.breach_log,
        }
    )


@query
def duplicate_keys(s: Star) -> DataFrame:
    return quality.duplicate_keys(s.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def null_domain_counts(s: Star) -> DataFrame:
    required = [field.name for field in FLIGHTS if not field.nullable]
    return quality.null_domain_counts(
        s.flights,
        "flights",
        [*required, "actual_dep", "actual_arr"],
        {"cancelled": [0, 1], "diverted": [0, 1], "scheduled_dep": list(range(600, 1900, 100))},
        {"flight_number": 8},
    )


@query
def delay_bands(s: Star) -> DataFrame:
    return diagnostics.delay_bands(s.flights)


@query
def seasonality_index(s: Star) -> DataFrame:
    return diagnostics.seasonality_index(s.flights)


@query
def cause_reconciliation(s: Star) -> DataFrame:
    return diagnostics.cause_reconciliation(s.flights)


@query
def dep_arr_drift(s: Star) -> DataFrame:
    return diagnostics.dep_arr_drift(s.flights)


@query
def route_dimension(s: Star) -> DataFrame:
    """Routes numbered from movements, which carry natural keys only."""
    return retail.routes(retail.movements(s.spark, s.sf_dir))


@query
def delay_percentiles(s: Star) -> DataFrame:
    """Every flown fact's place among all arrival delays."""
    known = flown(s.flights).filter(F.col("arr_delay_mins").isNotNull()).select("flight_id", "arr_delay_mins")
    ranked = ranks.global_ranks(known, "arr_delay_mins", ["flight_id"])
    return ranked.select(
        "flight_id",
        "arr_delay_mins",
        F.col("rank").alias("delay_rank"),
        F.col("dense_rank").alias("delay_dense_rank"),
        F.col("percent_rank").alias("delay_percent_rank"),
    )


# Rules with a history


@query
def rule_history_versions(s: Star) -> DataFrame:
    """Every version of every rule with the days it holds and who set it."""
    found = rule_history.rule_versions(s.rule_changes)
    rate = F.col("max_delay_rate_pct").cast("double").alias("max_delay_rate_pct")
    return found.select(
        "rule_id", "version", "carrier_code", rate, "window_days", "updated_by", "valid_from", "valid_to"
    )


@query
def rules_in_force(s: Star) -> DataFrame:
    """The rules as they stood at the end of September."""
    found = rule_history.current_rules(s.rule_changes, dt.date(2023, 9, 30))
    rate = F.col("max_delay_rate_pct").cast("double").alias("max_delay_rate_pct")
    return found.select("rule_id", "carrier_code", rate, "min_flights_window", "window_days", "updated_by")


@query
def breaches_by_rule_version(s: Star) -> DataFrame:
    """Weekly evaluations of the rule for all carriers, each by the version in force on its day."""
    days = s.spark.createDataFrame([(day,) for day in WEEKLY], "breach_date date")
    counters = flagging.daily_counters(s.flights)
    return rule_history.breaches_by_version(
        counters, rule_history.rule_versions(s.rule_changes), days, rule_id=1
    )


@query
def facts_in_rule_windows(s: Star) -> DataFrame:
    """Flown and late facts of each carrier while each version of a rule for it was valid."""
    versions = rule_history.rule_versions(s.rule_changes).select(
        "rule_id", "version", "carrier_code", "valid_from", "valid_to"
    )
    counters = flagging.daily_counters(s.flights).join(s.routes.select("route_id", "carrier_code"), "route_id")
    daily = counters.groupBy("carrier_code", "flight_date").agg(
        F.sum("total_flights").alias("total_flights"), F.sum("delayed_flights").alias("delayed_flights")
    )
    span = ("flight_date", "valid_from", "valid_to")
    own = intervals.days_in_intervals(
        daily, versions.filter("carrier_code IS NOT NULL"), *span, keys=["carrier_code"]
    )
    shared = intervals.days_in_intervals(
        daily, versions.filter("carrier_code IS NULL").drop("carrier_code"), *span
    )
    names = ["rule_id", "version", "carrier_code"]
    met = own.select(*names, "total_flights", "delayed_flights").unionByName(
        shared.select(*names, "total_flights", "delayed_flights")
    )
    return met.groupBy(*names).agg(
        F.sum("total_flights").alias("total_flights"), F.sum("delayed_flights").alias("delayed_flights")
    )


@query
def facts_as_of(s: Star) -> DataFrame:
    """Facts rebuilt from their log as of an evening: after a day's updates, before December came in.

    The log says nothing of which of two facts of one key stands, so keys that the given table
    repeats are left to ingest_outcomes, which keeps one of them.
    """
    once = s.flights.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    facts = s.flights.join(once.select("flight_id"), "flight_id", "left_semi")
    old = _old_state(s).join(once.select("flight_id"), "flight_id", "left_semi")
    before = facts.filter(F.col("flight_date") < F.lit(dt.date(2023, 12, 1)))
    hours = [dt.datetime(2023, 12, 1, hour) for hour in (6, 12, 20)]
    log = (
        audit.audit_new(old, "loader", hours[0])
        .unionByName(audit.audit_updates(before, old, null_safe=True, changed_by="desk", changed_at=hours[1]))
        .unionByName(audit.audit_inserts(facts, old, changed_by="loader", changed_at=hours[2]))
    )
    return state.facts_as_of(log, dt.datetime(2023, 12, 1, 18))


# Sources and sinks


def _stored_tables(s: Star) -> dict[str, DataFrame]:
    """All seven tables as they are loaded from files."""
    events = audit.audit_new(s.flights).unionByName(audit.breach_alerts(s.breach_log))
    tables = {
        "airlines": s.airlines,
        "airports": s.airports,
        "routes": s.routes,
        "flights": s.flights,
        "sla_rules": s.rules,
        "sla_breach_log": s.breach_log,
        "audit_log": audit.with_audit_ids(events),
    }
    root = scratch_path(s.spark, "seven-tables")
    for name, df in tables.items():
        df.select(*[c for c in TABLES[name].names if c in df.columns]).write.parquet(f"{root}/{name}")
    return {name: stored.load(s.spark, name, f"{root}/{name}") for name in tables}


@query
def load_counts(s: Star) -> DataFrame:
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in _stored_tables(s).items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def declared_duplicates(s: Star) -> DataFrame:
    """Every declared key of every table, after some rows were loaded twice."""
    tables = _stored_tables(s)
    twice = {
        "airlines": F.col("carrier_code") == CARRIER,
        "airports": F.col("state") == "ASIA",
        "routes": F.col("route_id") % 100 == 7,
        "flights": F.col("flight_id") % 500 == 11,
        "sla_rules": F.col("rule_id") == 1,
        "sla_breach_log": F.col("breach_id") % 500 == 13,
        "audit_log": F.col("record_id") % 500 == 11,
    }
    found = [
        quality.declared_duplicates(df.unionByName(df.filter(twice[name])), name)
        for name, df in tables.items()
    ]
    # the id of an event is a digest; its record says as much
    return reduce(DataFrame.unionByName, found).groupBy("table_name", "key_columns").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("row_count").alias("row_count")
    )


@query
def declared_counts(s: Star) -> DataFrame:
    """What each table declares of its columns, with required values of some rows removed."""
    gone = {
        "airlines": ("carrier_name", F.col("carrier_code") == CARRIER),
        "airports": ("city", F.col("state") == "ASIA"),
        "routes": ("scheduled_mins", F.col("route_id") % 100 == 7),
        "flights": ("flight_number", F.col("flight_id") % 500 == 11),
        "sla_rules": ("window_days", F.col("rule_id") == 1),
        "sla_breach_log": ("rule_id", F.col("breach_id") % 500 == 13),
        "audit_log": ("operation", F.col("record_id") % 500 == 11),
    }
    found = []
    for name, df in _stored_tables(s).items():
        column, where = gone[name]
        spoiled = df.withColumn(column, F.when(~where, F.col(column)))
        found.append(quality.declared_counts(spoiled, name))
    return reduce(DataFrame.unionByName, found)


def _batches(s: Star) -> list[DataFrame]:
    """Facts with copies and missing values, other rows of stored keys, and the first batch again."""
    base = s.flights.select(*FLIGHTS.names)
    key = F.col("flight_id")
    first = reduce(
        DataFrame.unionByName,
        [
            base,
            base.filter(key % 50 == 0),
            base.filter(key % 90 == 1).withColumn("flight_number", F.lit(None).cast("string")),
            base.filter(key % 110 == 2).withColumn("flight_date", F.lit(None).cast("date")),
        ],
    )
    moved = base.filter(key % 70 == 3).withColumn("flight_date", F.date_add("flight_date", 31))
    return [first, moved, first]


@query
def job_counters(s: Star) -> DataFrame:
    """What each of three ingests was given, stored, kept aside and audited, as its writes counted it."""
    root = scratch_path(s.spark, "counters")
    paths = [f"{root}/{name}" for name in ("flights", "quarantine", "audit")]
    counted = [ingest_flights(batch, *paths, changed_by="loader", changed_at=NOW) for batch in _batches(s)]
    lines = [(n, name, rows) for n, found in enumerate(counted, 1) for name, rows in found.items()]
    return s.spark.createDataFrame(lines, "batch int, counter string, row_count bigint")


@query
def key_lookup(s: Star) -> DataFrame:
    """Whole facts of every key that is known to be severely late, by an index of keys and months."""
    index = KeyIndex(s.spark, scratch_path(s.spark, "keys"), LOOKUP_BUCKETS)
    index.add(s.flights)
    severe = flown(s.flights).filter(is_late(F.col("arr_delay_mins"), Limits().severe_mins))
    places = settle(index.places(severe), "places")
    found = find_facts(s.spark, s.flights_path, places)
    return found.select("flight_id", "flight_date", "flight_number", "route_id", "arr_delay_mins", "cancelled")


@query
def indexed_ingest_outcomes(s: Star) -> DataFrame:
    """What ingest_outcomes reports, of jobs that look stored keys up in an index, and what the index holds."""
    root = scratch_path(s.spark, "indexed")
    paths = [f"{root}/{name}" for name in ("flights", "quarantine", "audit")]
    index = KeyIndex(s.spark, f"{root}/keys", LOOKUP_BUCKETS)
    for batch in _batches(s):
        ingest_flights(batch, *paths, changed_by="loader", changed_at=NOW, index=index)
    rows = F.count(F.lit(1)).alias("row_count")
    counted = {
        "facts": read_flights(s.spark, paths[0]),
        "audit": read_audit(s.spark, paths[2]),
        "indexed": index.read().distinct(),
    }
    aside = s.spark.read.schema(QUARANTINE_STORED).parquet(paths[1])
    lines = [df.agg(rows).select(F.lit(name).alias("outcome"), "row_count") for name, df in counted.items()]
    lines.append(aside.groupBy(F.col("reject_reason").alias("outcome")).agg(rows))
    return reduce(DataFrame.unionByName, lines)


@query
def daily_run_outcomes(s: Star) -> DataFrame:
    """The log after three daily runs, the later ones given twice, and how often each breach was announced.

    The first run died between log and alerts, six weeks before the last.
    """
    root = scratch_path(s.spark, "daily")
    log, events = f"{root}/log", f"{root}/audit"
    run_daily_breaches(s.flights, s.routes, s.rules, log, f"{root}/lost", RUNS[0], NOW)
    for day in RUNS[1:]:
        for _ in range(2):
            run_daily_breaches(s.flights, s.routes, s.rules, log, events, day, NOW)
    alerts = read_audit(s.spark, events).groupBy(F.col("record_id").alias("breach_id")).agg(
        F.count(F.lit(1)).alias("alerts")
    )
    found = read_log(s.spark, log).join(alerts, "breach_id", "left")
    return _found(found).select(
        "route_id", "breach_date", "delay_rate_pct", "total_flights", "delayed_flights", "alerts"
    )


@query
def window_sketches(s: Star) -> DataFrame:
    """Routes and delay percentiles of each month, exact, and whether sketches merged from days agree.

    A distinct count agrees within three standard errors, a percentile if its rank is within the
    stated error.
    """
    month = month_number(F.col("flight_date"))
    daily = settle(sketches.daily_sketches(s.flights), "daily-sketches")
    found = settle(sketches.estimates(sketches.merged(daily, month.alias("month"))), "window-sketches")
    exact = sketches.exact_windows(s.flights, month, "month").join(found, "month")
    for name, share in (("p50", 0.5), ("p90", 0.9)):
        near = sketches.rank_shares(s.flights, month, "month", found, f"{name}_estimate")
        low, high = share - sketches.RANK_ERROR, share + sketches.RANK_ERROR
        exact = exact.join(
            near.select("month", ((F.col("below") <= high) & (F.col("upto") >= low)).alias(f"{name}_agrees")),
            "month",
        )
    off = F.abs(F.col("routes_estimate") - F.col("routes")) <= sketches.DISTINCT_ERROR * F.col("routes")
    return exact.select(
        "month", "total_flights", "routes", "p50", "p90", off.alias("routes_agree"), "p50_agrees", "p90_agrees"
    )


def _reports(s: Star) -> None:
    catalog.register(s.flights, s.routes, s.airlines, s.airports, s.rules, s.breach_log)
    catalog.register_reports(s.spark)


@query
def sql_carrier_delays(s: Star) -> DataFrame:
    """A report that is a table function, called from SQL text by name."""
    _reports(s)
    return s.spark.sql(
        "SELECT * FROM carrier_delays(first_day => :first, last_day => :last)",
        {"first": QUARTER[0], "last": QUARTER[1]},
    )


@query
def sql_route_days(s: Star) -> DataFrame:
    """The days of one route; the second argument is left at its default."""
    _reports(s)
    return s.spark.sql("SELECT * FROM route_days(:which)", {"which": ROUTE_ID})


@query
def ingest_outcomes(s: Star) -> DataFrame:
    """Three batches: facts with copies and missing values, other rows of stored keys, and the
    first batch again."""
    root = scratch_path(s.spark, "ingest")
    paths = [f"{root}/{name}" for name in ("flights", "quarantine", "audit")]
    for batch in _batches(s):
        ingest_flights(batch, *paths, changed_by="loader", changed_at=NOW)
    facts = read_flights(s.spark, paths[0]).agg(F.count(F.lit(1)).alias("row_count"))
    events = read_audit(s.spark, paths[2]).agg(F.count(F.lit(1)).alias("row_count"))
    aside = s.spark.read.schema(QUARANTINE_STORED).parquet(paths[1]).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return (
        facts.select(F.lit("facts").alias("outcome"), "row_count")
        .unionByName(events.select(F.lit("audit").alias("outcome"), "row_count"))
        .unionByName(aside.select(F.col("reject_reason").alias("outcome"), "row_count"))
    )


@query
def update_outcomes(s: Star) -> DataFrame:
    """Stored facts of the old state, brought to the present one; what is stored, audited, refused.

    Some facts are the only ones of their month and move to another, some are stored twice; some
    changes come twice, some lack a date or a number. All of it is given a second time. Delays
    are added up over keys that the given table holds once; of others either row may be kept.
    """
    root = scratch_path(s.spark, "update")
    facts, log, aside = (f"{root}/{name}" for name in ("flights", "audit", "aside"))
    key = F.col("flight_id")
    old = _old_state(s).select(*FLIGHTS.names)
    alone = old.filter(key % 400 == 7).withColumns(
        {"flight_id": -key, "flight_date": F.lit(dt.date(2022, 2, 10))}
    )
    write_flights(
        reduce(DataFrame.unionByName, [old, old.filter(key % 70 == 3), alone]), facts
    )
    base = s.flights.select(*FLIGHTS.names)
    changes = reduce(
        DataFrame.unionByName,
        [
            base,
            base.filter(key % 50 == 0),
            base.filter(key % 90 == 1).withColumn("flight_number", F.lit(None).cast("string")),
            base.filter(key % 110 == 2).withColumn("flight_date", F.lit(None).cast("date")),
            alone.withColumn("flight_date", F.lit(dt.date(2023, 1, 15))),
        ],
    )
    for _ in range(2):
        unknown = update_flights(
            changes, facts, log, changed_by="loader", changed_at=NOW, quarantine_path=aside, clamp_early=True
        )
    rows = F.count(F.lit(1)).alias("row_count")
    none = F.lit(None).cast("bigint").alias("arr_delay_mins")
    kept = read_flights(s.spark, facts)
    several = s.flights.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = several.select(F.abs("flight_id").alias("_key"), F.lit(1).alias("_several"))
    marked = kept.join(several, F.abs("flight_id") == F.col("_key"), "left")
    delays = F.sum(F.when(F.col("_several").isNull(), F.col("arr_delay_mins"))).alias("arr_delay_mins")
    refused = s.spark.read.schema(QUARANTINE_STORED).parquet(aside).groupBy("reject_reason").agg(rows)
    lines = [
        marked.agg(rows, delays).select(F.lit("facts").alias("outcome"), "row_count", "arr_delay_mins"),
        *[
            found.agg(rows).select(F.lit(name).alias("outcome"), "row_count", none)
            for name, found in (
                ("left in the month they moved from", kept.filter(F.col("flight_month") == 202202)),
                ("audit", read_audit(s.spark, log)),
                ("unknown", unknown),
            )
        ],
        refused.select(F.col("reject_reason").alias("outcome"), "row_count", none),
    ]
    return reduce(DataFrame.unionByName, lines)


@query
def ontime_roundtrip(s: Star) -> DataFrame:
    """Facts written as an on-time file, some values spoiled, and loaded again."""
    path = scratch_path(s.spark, "ontime")
    case = F.col("flight_id") % 40
    text = {name: F.col(name).cast("string") for name in COLUMNS if name != "scheduled_elapsed"}
    text["scheduled_elapsed"] = F.col("scheduled_mins").cast("string")
    text["arr_delay_mins"] = (
        F.when(case == 0, "4O").when(case == 1, None).when(case == 2, "7.9")
        .otherwise(text["arr_delay_mins"])
    )
    text["cancelled"] = F.when(case == 3, "yes").otherwise(text["cancelled"])
    text["flight_date"] = F.when(case == 4, "soon").otherwise(text["flight_date"])
    lines = s.flights.join(s.routes, "route_id")
    lines.select(*[text[name].alias(source) for name, source in COLUMNS.items()]).write.option(
        "header", True
    ).csv(path)
    keyed, bad = read_ontime(s.spark, path)
    facts = ontime_flights(keyed, ontime_routes(keyed))
    measures = [
        F.count(F.lit(1)).alias("row_count"),
        F.count("arr_delay_mins").alias("known_delays"),
        F.sum(F.col("arr_delay_mins")).alias("arr_delay_mins"),
    ]
    kept = facts.agg(*measures).select(F.lit("kept").alias("outcome"), "*")
    refused = bad.agg(*measures).select(F.lit("refused").alias("outcome"), "row_count")
    return kept.unionByName(refused, allowMissingColumns=True)


@query
def append_facts(s: Star) -> DataFrame:
    """Two appends to one table, read back per month."""
    path = scratch_path(s.spark, "appended")
    middle = F.lit(dt.date(2023, 7, 1))
    write_flights(s.flights.filter(F.col("flight_date") < middle), path)
    write_flights(s.flights.filter(F.col("flight_date") >= middle), path)
    return (
        read_flights(s.spark, path)
        .groupBy("flight_month")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("arr_delay_mins").alias("arr_delay_mins"))
    )


@query
def insert_if_absent(s: Star) -> DataFrame:
    """First use of each flight number on a route that was not flown before July."""
    used = flown(s.flights).filter(F.col("flight_date") < F.lit(dt.date(2023, 7, 1)))
    return stored.insert_if_absent(
        used,
        s.flights.select("route_id", "flight_number", "flight_date", "flight_id"),
        ["route_id", "flight_number"],
        ["flight_date", "flight_id"],
    )


@query
def export_roundtrip(s: Star) -> DataFrame:
    ranking = carrier_ranking(s)
    path = scratch_path(s.spark, "ranking-csv")
    export_reports({"carrier_rankings": ranking}, path)
    schema = displayed("carrier_rankings", ranking).schema
    return s.spark.read.schema(schema).option("header", True).csv(f"{path}/carrier_rankings")


REPORTS = {
    "mom_trend": monthly_trend,
    "root_cause": root_cause,
    "airport_stats": departure_bottlenecks,
    "propagation": delay_propagation,
    "route_heatmap": od_matrix,
    "time_of_day": time_of_day,
    "active_breaches": active_breaches,
    "chronic_offenders": chronic_offenders,
    "sla_compliance": sla_compliance,
}


def _exported(name: str, report: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    def run(s: Star) -> DataFrame:
        found = report(s)
        path = scratch_path(s.spark, f"{name}-csv")
        export_reports({name: found}, path)
        schema = displayed(name, found).schema
        # two columns may be shown under one name; a frame needs two
        names = [f.name for f in schema]
        alone = [n if names.index(n) == i else f"{n} {i + 1}" for i, n in enumerate(names)]
        unique = StructType([StructField(n, f.dataType) for n, f in zip(alone, schema, strict=True)])
        return s.spark.read.schema(unique).option("header", True).csv(f"{path}/{name}")

    return run


for _name, _report in REPORTS.items():
    _QUERIES[f"export_{_name}"] = _exported(_name, _report)


# Streams: a few files at a time, in the order they were written
FILES = 3


def _run(started) -> None:
    started.awaitTermination()


def _deliver(facts: DataFrame, path: str) -> None:
    """Facts as the next files of a feed, which has no layout: they are neither dealt out nor sorted."""
    with settings(facts.sparkSession, SPARING):
        facts.write.mode("append").parquet(path)


def _fact_stream(s: Star) -> DataFrame:
    return jobs.flight_stream(s.spark, s.flights_path, max_files_per_trigger=FILES)


@query
def stream_validate(s: Star) -> DataFrame:
    path = scratch_path(s.spark, "stream-validate")
    _run(jobs.validate_stream(_fact_stream(s), f"{path}/out", f"{path}/checkpoint"))
    return (
        jobs.read_validated(s.spark, f"{path}/out")
        .groupBy("outcome", "reject_reason")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("arr_delay_mins").alias("arr_delay_mins"))
    )


@query
def stream_audit(s: Star) -> DataFrame:
    path = scratch_path(s.spark, "stream-audit")
    _run(jobs.audit_stream(_fact_stream(s), f"{path}/out", f"{path}/checkpoint"))
    events = read_audit(s.spark, f"{path}/out")
    return events.select(
        "audit_id", "table_name", "operation", "record_id", "old_values", "new_values"
    )


@query
def stream_daily_counts(s: Star) -> DataFrame:
    """Daily counts, and which days are closed to the feed's lateness."""
    path = scratch_path(s.spark, "stream-days")
    _run(jobs.counter_stream(_fact_stream(s), f"{path}/out", f"{path}/checkpoint"))
    return jobs.read_closed_counters(s.spark, f"{path}/out")


@query
def stream_counters(s: Star) -> DataFrame:
    """Additive counters."""
    path = scratch_path(s.spark, "stream-counters")
    _run(jobs.counter_stream(_fact_stream(s), f"{path}/out", f"{path}/checkpoint"))
    return jobs.read_counters(s.spark, f"{path}/out")


@query
def stream_windowed_counts(s: Star) -> DataFrame:
    """Weekly counts held in state, and what came too late for it, of a feed that is restarted half way."""
    path = scratch_path(s.spark, "stream-windows")
    halves = F.xxhash64("flight_id") % 2 == 0
    for half in (halves, ~halves):
        _deliver(s.flights.filter(half), f"{path}/feed")
        stream = jobs.flight_stream(s.spark, f"{path}/feed", FILES)
        _run(jobs.windowed_stream(stream, f"{path}/out", f"{path}/checkpoint", lateness="30 days"))
    return jobs.read_windows(s.spark, f"{path}/out").drop("late_flights")


@query
def stream_breaches(s: Star) -> DataFrame:
    """The breaches of every day of the feed, as they stand once all of it has come."""
    path = scratch_path(s.spark, "stream-breaches")
    _run(jobs.breach_stream(_fact_stream(s), s.routes, s.rules, f"{path}/out", f"{path}/checkpoint"))
    log = jobs.log_breaches(s.spark, f"{path}/out", f"{path}/audit", NOW)
    return _found(log).drop("created_at")


@query
def stream_audit_once(s: Star) -> DataFrame:
    """Insert events of a feed that delivers every file twice."""
    path = scratch_path(s.spark, "stream-once")
    for _ in range(2):
        _deliver(s.flights, f"{path}/feed")
    stream = jobs.delivered_flights(s.spark, f"{path}/feed", FILES)
    _run(jobs.audit_once_stream(stream, f"{path}/out", f"{path}/checkpoint"))
    return jobs.read_audited_once(s.spark, f"{path}/out").select(
        "audit_id", "table_name", "operation", "record_id", "old_values", "new_values"
    )


def _resolutions(s: Star) -> DataFrame:
    """Every third breach is resolved, between an hour and a month after it was logged."""
    number = F.col("breach_id")
    hours = ((number * 37) % 720 + 1).cast("int")
    return s.breach_log.filter(number % 3 == 0).select(
        "breach_id", F.timestamp_add("HOUR", hours, F.col("created_at")).alias("resolved_at")
    )


@query
def stream_unresolved(s: Star) -> DataFrame:
    """Breaches that nobody resolved in time, from streams of breaches and resolutions in any order."""
    path = scratch_path(s.spark, "stream-unresolved")
    log = s.breach_log.select(*SLA_BREACH_LOG.names)
    by_chance = F.xxhash64("breach_id")
    log.repartitionByRange(6, by_chance).write.parquet(f"{path}/log")
    _resolutions(s).repartitionByRange(6, by_chance).write.parquet(f"{path}/resolved")
    # both feeds go on, which closes what lies behind
    later = F.lit("2030-01-01 00:00:00").cast("timestamp")
    said = {"breach_id": F.lit(jobs.HEARTBEAT), "created_at": later}
    beat = s.spark.range(1).select(
        *[said.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SLA_BREACH_LOG]
    )
    beat.write.mode("append").parquet(f"{path}/log")
    beat.select("breach_id", later.alias("resolved_at")).write.mode("append").parquet(f"{path}/resolved")
    _run(
        jobs.unresolved_stream(
            jobs.log_stream(s.spark, f"{path}/log", FILES),
            jobs.resolution_stream(s.spark, f"{path}/resolved", FILES),
            f"{path}/out",
            f"{path}/checkpoint",
            WITHIN_HOURS,
            "400 days",
        )
    )
    return jobs.read_unresolved(s.spark, f"{path}/out").select("breach_id", "route_id", "breach_date")
