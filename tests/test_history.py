"""Rules with their history, intervals, state from the log, ranks over rows, and timed streams."""

import datetime as dt
import random

import pytest
from frames import table
from pyspark.sql import functions as F

from slotwise.operators import audit, intervals, ranks, rule_history, state
from slotwise.plans.jobs import update_flights
from slotwise.sources.layout import read_audit, read_flights, write_flights
from slotwise.sources.schemas import FLIGHTS, FLIGHTS_STORED, QUARANTINE_STORED, RESOLUTIONS, SLA_BREACH_LOG
from slotwise.streaming import jobs

NOW = dt.datetime(2023, 7, 1, 8)
DAY = dt.date(2023, 3, 1)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def loose(spark, changes):
    """Fact rows that may lack required values."""
    base = rows(table(spark, "flights", [{}]))[0]
    made = [{**dict(zip(FLIGHTS.names, base, strict=True)), **c} for c in changes]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FLIGHTS)
    return spark.createDataFrame([tuple(m[n] for n in FLIGHTS.names) for m in made], schema)


# Updates


def test_a_fact_that_moves_leaves_its_month(spark, tmp_path):
    facts, log = f"{tmp_path}/f", f"{tmp_path}/a"
    february, january = dt.date(2023, 2, 3), dt.date(2023, 1, 9)
    write_flights(table(spark, "flights", [{"flight_date": january}, {"flight_date": february}]), facts)
    moved = loose(spark, [{"flight_id": 2, "flight_date": january}])
    for _ in range(2):
        update_flights(moved, facts, log, changed_at=NOW)
        assert sorted(rows(read_flights(spark, facts), "flight_id", "flight_month")) == [(1, 202301), (2, 202301)]


def test_an_update_spares_the_month_without_a_date(spark, tmp_path):
    facts, log, aside = (f"{tmp_path}/{x}" for x in "fab")
    undated = loose(spark, [{"flight_id": n, "flight_date": None} for n in (1, 2)])
    schema = FLIGHTS_STORED
    write_flights(undated, facts)
    write_flights(loose(spark, [{"flight_id": 3}]), facts)
    changes = [
        {"flight_id": 1, "flight_date": DAY}, {"flight_id": 3, "flight_date": None},
        {"flight_id": 3, "flight_number": None},
        {"flight_id": 3, "cancelled": 1, "actual_dep": 5},
    ]
    for _ in range(2):
        update_flights(loose(spark, changes), facts, log, changed_at=NOW, quarantine_path=aside)
    stored = spark.read.schema(schema).parquet(facts)
    assert sorted(rows(stored, "flight_id", F.col("flight_month").cast("string"))) == [
        (1, "202303"), (2, None), (3, "202306"),
    ]
    held = spark.read.schema(QUARANTINE_STORED).parquet(aside)
    assert sorted(rows(held, "flight_id", "reject_reason")) == [
        (3, "cancelled with departure time"), (3, "missing flight_date"), (3, "missing flight_number"),
    ]


def test_a_key_stored_twice_is_audited_when_it_changes(spark, tmp_path):
    facts, log = f"{tmp_path}/f", f"{tmp_path}/a"
    write_flights(loose(spark, [{"arr_delay_mins": 3}, {"arr_delay_mins": 3}]), facts)
    for _ in range(2):
        update_flights(loose(spark, [{"arr_delay_mins": 7}]), facts, log, changed_at=NOW)
    assert rows(read_flights(spark, facts), "flight_id", "arr_delay_mins") == [(1, 7)]
    assert rows(read_audit(spark, log), "record_id", "operation") == [(1, "UPDATE")]


# Rules


def changes(spark, *given):
    made = [(r, None, rate, 1, window, dt.datetime.fromisoformat(at), by) for r, rate, window, at, by in given]
    return spark.createDataFrame(
        made,
        "rule_id int, carrier_code string, max_delay_rate_pct double, min_flights_window int, "
        "window_days int, updated_at timestamp, updated_by string",
    )


def test_versions_follow_each_other_and_the_last_of_a_day_holds(spark):
    given = changes(
        spark, (1, 15.0, 30, "2023-01-01 08:00", "a"), (1, 11.0, 30, "2023-02-01 08:00", "b"),
        (1, 12.0, 10, "2023-02-01 09:00", "c"), (2, 9.0, 5, "2023-02-02 00:00", "d"),
    )
    found = rows(
        rule_history.rule_versions(given).orderBy("rule_id", "version"),
        "rule_id", "version", "max_delay_rate_pct", "updated_by", "valid_from", "valid_to",
    )
    assert found == [
        (1, 1, 15.0, "a", dt.date(2023, 1, 1), dt.date(2023, 1, 31)),
        (1, 2, 12.0, "c", dt.date(2023, 2, 1), None),
        (2, 1, 9.0, "d", dt.date(2023, 2, 2), None),
    ]
    assert rows(rule_history.current_rules(given, dt.date(2023, 2, 1)), "rule_id", "window_days") == [(1, 10)]
    assert rows(rule_history.current_rules(given, dt.date(2022, 2, 1))) == []


def test_the_last_state_on_or_before_a_day(spark):
    rng = random.Random(5)
    states = sorted({(k, rng.randrange(60)) for k in "ab" for _ in range(6)})
    asked = [(rng.choice("abc"), rng.randrange(60)) for _ in range(200)]
    day = lambda n: DAY + dt.timedelta(days=n)
    left = spark.createDataFrame([(k, day(n), i) for i, (k, n) in enumerate(asked)], "k string, day date, i int")
    right = spark.createDataFrame([(k, day(n), n) for k, n in states], "k string, since date, v int")
    found = rule_history.latest_before(left, right, ["k"], "day", "since", ["v"])
    want = {i: max((n for s, n in states if s == k and n <= d), default=None) for i, (k, d) in enumerate(asked)}
    assert {r.i: r.v for r in found.collect()} == want


# Intervals


@pytest.mark.parametrize("bin_days", [1, 7, 400])
def test_days_in_intervals_against_all_pairs(spark, bin_days):
    rng = random.Random(9)
    day = lambda n: None if n is None else DAY + dt.timedelta(days=n)
    points = [(rng.choice("ab"), rng.choice([None, *range(-40, 40)]), i) for i in range(120)]
    spans = []
    for j in range(30):
        a = rng.randrange(-60, 60)
        b = rng.choice([None, a - 1, a, a + rng.randrange(90)])
        spans.append((rng.choice("ab"), rng.choice([a, a, None]), b, j))
    left = spark.createDataFrame([(k, day(n), i) for k, n, i in points], "k string, day date, i int")
    right = spark.createDataFrame([(k, day(a), day(b), j) for k, a, b, j in spans], "k string, a date, b date, j int")
    found = intervals.days_in_intervals(left, right, "day", "a", "b", ["k"], bin_days)
    want = sorted(
        (i, j) for k, n, i in points for m, a, b, j in spans
        if k == m and n is not None and (a is None or a <= n) and (b is None or n <= b)
    )
    assert sorted(rows(found, "i", "j")) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(intervals.days_in_intervals(left.where("false"), right, "day", "a", "b", ["k"])) == []


# State


def test_facts_as_of_follows_inserts_and_updates(spark):
    old = loose(spark, [{"flight_id": n, "arr_delay_mins": n, "dep_delay_mins": None} for n in (1, 2, 3)])
    new = loose(spark, [{"flight_id": 1, "arr_delay_mins": None, "cancelled": 1}, {"flight_id": 2, "arr_delay_mins": 9}])
    hour = lambda n: dt.datetime(2023, 7, 1, n)
    log = audit.audit_new(old, "x", hour(1)).unionByName(
        audit.audit_updates(new, old, null_safe=True, changed_by="x", changed_at=hour(3))
    )
    names = ("flight_id", "flight_date", "flight_number", "arr_delay_mins", "cancelled", "diverted")
    day = dt.date(2023, 6, 30)
    assert sorted(rows(state.facts_as_of(log, hour(2)), *names)) == [(n, day, "AA100", n, 0, None) for n in (1, 2, 3)]
    assert sorted(rows(state.facts_as_of(log), *names)) == [
        (1, day, "AA100", None, 1, 0), (2, day, "AA100", 9, 0, 0), (3, day, "AA100", 3, 0, None),
    ]
    assert rows(state.facts_as_of(log, hour(0))) == []


# Ranks


def test_ranks_with_ties_across_ranges(spark):
    rng = random.Random(3)
    values = [None] * 40 + [7] * 400 + [rng.randrange(30) for _ in range(200)] + [99] * 150
    rng.shuffle(values)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranks.laid_out(frame, [F.col("v").asc_nulls_first(), "i"], "test")
        assert placed.where("v = 7").select(ranks.RANGE).distinct().count() > 3
        ranked = ranks.global_ranks(frame, "v", ["i"])
        plan = ranked._jdf.queryExecution().toString()
        got = {r.i: (r["rank"], r.dense_rank, r.percent_rank) for r in ranked.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda v: -1 if v is None else v
    order = sorted(key(v) for v in values)
    kinds = sorted(set(order))
    n = len(values) - 1
    assert got == {
        i: (order.index(key(v)) + 1, kinds.index(key(v)) + 1, order.index(key(v)) / n) for i, v in enumerate(values)
    }
    assert "SinglePartition" not in plan
    one = ranks.global_ranks(frame.where("i = 3"), "v", ["i"]).collect()[0]
    assert (one["rank"], one.dense_rank, one.percent_rank) == (1, 1, 0.0)
    assert ranks.global_ranks(frame.where("false"), "v", ["i"]).collect() == []


# Streams


def test_events_are_audited_once_across_a_restart(spark, tmp_path):
    feed, out, mark = (f"{tmp_path}/{x}" for x in ("feed", "out", "mark"))
    given = [{"flight_id": 1}, {"flight_id": 2, "flight_date": None}]
    for batch in (given, given, [{"flight_id": 3}], given):
        write_flights(loose(spark, batch), feed)
        for size in (1, 3):
            stream = jobs.delivered_flights(spark, feed, size)
            jobs.audit_once_stream(stream, out, mark, changed_by="x", changed_at=NOW).awaitTermination()
    assert sorted(rows(jobs.read_audited_once(spark, out), "record_id")) == [(1,), (2,), (3,)]


def test_breaches_nobody_resolves_in_time(spark, tmp_path):
    log, done, out, mark = (f"{tmp_path}/{x}" for x in ("log", "done", "out", "mark"))
    at = lambda h: dt.datetime(2023, 6, 1) + dt.timedelta(hours=h)

    def logged(*given):
        made = table(spark, "sla_breach_log", [{"breach_id": n, "created_at": at(h)} for n, h in given])
        made.select(*SLA_BREACH_LOG.names).write.mode("append").parquet(log)

    def resolved(*given):
        spark.createDataFrame([(n, at(h)) for n, h in given], RESOLUTIONS).write.mode("append").parquet(done)

    def run():
        jobs.unresolved_stream(
            jobs.log_stream(spark, log, 1), jobs.resolution_stream(spark, done, 1), out, mark, 24, "2 days"
        ).awaitTermination()
        return sorted(n for n, in rows(jobs.read_unresolved(spark, out), "breach_id"))

    # 1 in time, 2 too late, 3 never, 4 before it was logged, 5 twice
    resolved((2, 30), (5, 3), (5, 9))
    logged((1, 0), (2, 1), (3, 2), (4, 20), (5, 2))
    resolved((1, 24), (4, 10))
    assert run() == []
    logged((jobs.HEARTBEAT, 500))
    resolved((jobs.HEARTBEAT, 500))
    assert run() == [2, 3, 4]
    logged((6, 501), (jobs.HEARTBEAT, 900))
    resolved((jobs.HEARTBEAT, 900))
    assert run() == [2, 3, 4, 6]


def test_a_wrong_date_does_not_stop_the_evaluation(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    day = dt.date(2023, 6, 30)
    given = [{"flight_id": n, "flight_date": day, "arr_delay_mins": 40} for n in range(6)]
    write_flights(loose(spark, [*given, {"flight_id": 9, "flight_date": dt.date(9999, 1, 1)}]), feed)
    write_flights(loose(spark, [{"flight_id": 10, "flight_date": dt.date(1, 1, 1)}]), feed)
    r, rules = table(spark, "routes", [{}]), table(spark, "sla_rules", [{}])
    jobs.breach_stream(jobs.flight_stream(spark, feed, 1), r, rules, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    assert rows(jobs.read_breaches(spark, f"{tmp_path}/o"), "breach_date", "total_flights") == [(day, 6)]
    aside = spark.read.parquet(f"{tmp_path}/o/aside")
    assert sorted(rows(aside, "flight_id", "reject_reason")) == [(9, jobs.IMPLAUSIBLE_DATE), (10, jobs.IMPLAUSIBLE_DATE)]
