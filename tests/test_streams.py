"""The streams give what the batch operators give, in any number of batches."""

import datetime as dt
from pathlib import Path

import pytest
from frames import rows, table

from slotwise.operators.audit import audit_new, with_audit_ids
from slotwise.operators.flagging import backfill_breaches, daily_counters, flag_breaches
from slotwise.plans import registry
from slotwise.sources.layout import read_audit, read_flights, write_flights
from slotwise.sources.schemas import FLIGHTS
from slotwise.sources.scratch import scratch_root
from slotwise.streaming import jobs

NOW = dt.datetime(2023, 7, 1, 8)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Five files; the last one written holds the oldest rows."""
    path = str(tmp_path_factory.mktemp("flights"))
    first = dt.date(2023, 1, 1)
    for month in (2, 3, 4, 5, 1):
        rows_of_month = [
            {
                "flight_id": month * 100 + n,
                "route_id": n % 3 + 1,
                "flight_date": first.replace(month=month) + dt.timedelta(days=n % 28),
                "arr_delay_mins": 20 if n % 4 == 0 else 0,
                "nas_delay": 99 if n % 10 == 0 else 0,
                "cancelled": 1 if n % 17 == 0 else 0,
            }
            for n in range(60)
        ]
        write_flights(table(spark, "flights", rows_of_month).coalesce(1), path)
    return path


def stream(spark, stored, files=1000):
    return jobs.flight_stream(spark, stored, files)


CUTS = pytest.mark.parametrize("files", [1000, 2, 1])


@CUTS
def test_counters_add_up_however_late(spark, stored, tmp_path, files):
    jobs.counter_stream(
        stream(spark, stored, files), f"{tmp_path}/out", f"{tmp_path}/c"
    ).awaitTermination()
    expected = daily_counters(read_flights(spark, stored))
    assert sorted(rows(jobs.read_counters(spark, f"{tmp_path}/out"))) == sorted(rows(expected))


@CUTS
def test_closed_days_lose_no_late_row(spark, stored, tmp_path, files):
    jobs.counter_stream(
        stream(spark, stored, files), f"{tmp_path}/out", f"{tmp_path}/c"
    ).awaitTermination()
    expected = daily_counters(read_flights(spark, stored))
    got = jobs.read_closed_counters(spark, f"{tmp_path}/out", lateness_days=3)
    assert sorted(rows(got.drop("closed"))) == sorted(rows(expected))
    still_open = got.filter("not closed").agg({"flight_date": "min"}).head()[0]
    assert still_open == dt.date(2023, 5, 25)


def test_a_lost_checkpoint_never_counts_twice(spark, stored, tmp_path):
    def run(checkpoint):
        jobs.counter_stream(
            stream(spark, stored, 2), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}"
        ).awaitTermination()

    run("c1")
    with pytest.raises(ValueError, match="another checkpoint"):
        run("c2")
    run("c1")
    expected = daily_counters(read_flights(spark, stored))
    assert sorted(rows(jobs.read_counters(spark, f"{tmp_path}/out"))) == sorted(rows(expected))


@CUTS
def test_validation_keeps_every_row(spark, stored, tmp_path, files):
    jobs.validate_stream(
        stream(spark, stored, files), f"{tmp_path}/out", f"{tmp_path}/c"
    ).awaitTermination()
    split = jobs.read_validated(spark, f"{tmp_path}/out")
    counts = dict(rows(split.groupBy("outcome").count()))
    assert counts["rejected"] > 0
    assert sum(counts.values()) == 300
    assert split.filter("outcome = 'accepted' AND reject_reason IS NOT NULL").count() == 0


@CUTS
def test_audit(spark, stored, tmp_path, files):
    expected = with_audit_ids(audit_new(read_flights(spark, stored), changed_by="stream"))
    columns = ("audit_id", "record_id", "new_values", "changed_by")
    for checkpoint in ("c1", "c2"):
        # the second start forgets its checkpoint; its events are all known
        jobs.audit_stream(
            stream(spark, stored, files), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}",
            changed_by="stream",
        ).awaitTermination()
        got = read_audit(spark, f"{tmp_path}/out")
        assert sorted(rows(got, *columns)) == sorted(rows(expected, *columns))
    assert got.filter("period = 0").count() == 0


def test_days_to_evaluate():
    day = [dt.date(2023, 1, 1) + dt.timedelta(days=n) for n in range(30)]
    assert jobs.days_to_evaluate([day[0]], day[0], None, 5) == [day[0]]
    assert jobs.days_to_evaluate([day[9]], day[9], day[5], 5) == day[6:10]
    assert jobs.days_to_evaluate([day[2]], day[9], day[9], 5) == day[2:8]


@CUTS
def test_breaches_of_every_day(spark, stored, tmp_path, files):
    r = table(spark, "routes", [{"route_id": n} for n in (1, 2, 3)])
    rules = table(spark, "sla_rules", [{"window_days": 60}])
    f = read_flights(spark, stored)
    every_day = [dt.date(2023, 1, 1) + dt.timedelta(days=n) for n in range(148)]
    columns = ("route_id", "breach_date", "delay_rate_pct", "total_flights", "delayed_flights")
    expected = sorted(rows(backfill_breaches(f, r, rules, every_day), *columns))
    singly = [
        row for day in every_day[100:104] for row in rows(flag_breaches(f, r, rules, None, day), *columns)
    ]
    assert sorted(singly) == [e for e in expected if e[1] in every_day[100:104]]
    out = f"{tmp_path}/out"
    jobs.breach_stream(
        stream(spark, stored, files), r, rules, out, f"{tmp_path}/c"
    ).awaitTermination()
    assert sorted(rows(jobs.read_breaches(spark, out), *columns)) == expected
    for _ in range(2):
        log = jobs.log_breaches(spark, out, f"{tmp_path}/audit", NOW)
        assert log.select("breach_id").distinct().count() == len(expected)
        assert read_audit(spark, f"{tmp_path}/audit").count() == len(expected)


@pytest.fixture(scope="module")
def undated(spark, tmp_path_factory):
    """Three files: dated rows alone, rows without a date alone, and both."""
    path = str(tmp_path_factory.mktemp("undated"))
    day = dt.date(2023, 1, 1)
    for n, days in enumerate(([day, day], [None, None], [None, day + dt.timedelta(days=1)])):
        some = [
            {"flight_id": 10 * n + k, "flight_date": d, "arr_delay_mins": 20} for k, d in enumerate(days)
        ]
        table(spark, "flights", some).coalesce(1).write.mode("append").parquet(path)
    return path


@CUTS
def test_audit_of_rows_without_a_date(spark, undated, tmp_path, files):
    for checkpoint in ("c1", "c2"):
        # the second start runs every batch again
        jobs.audit_stream(
            stream(spark, undated, files), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}"
        ).awaitTermination()
        got = rows(read_audit(spark, f"{tmp_path}/out"), "record_id")
        assert sorted(got) == [(0,), (1,), (10,), (11,), (20,), (21,)]


@CUTS
def test_breaches_beside_rows_without_a_date(spark, undated, tmp_path, files):
    r = table(spark, "routes", [{"route_id": 1}])
    rules = table(spark, "sla_rules", [{"window_days": 60}])
    out = f"{tmp_path}/out"
    jobs.breach_stream(
        stream(spark, undated, files), r, rules, out, f"{tmp_path}/c"
    ).awaitTermination()
    found = rows(jobs.read_breaches(spark, out), "breach_date", "total_flights")
    assert sorted(found) == [(dt.date(2023, 1, 1), 2), (dt.date(2023, 1, 2), 3)]
    undated_flights = jobs.read_counters(spark, f"{out}/counters").filter("flight_date IS NULL")
    assert rows(undated_flights, "total_flights") == [(3,)]


def test_a_feed_is_delivered_as_it_is_read(spark, stored, tmp_path):
    """Neither dealt out nor sorted: a file for each task that reads, whatever months it holds."""
    facts = read_flights(spark, stored)
    sent = facts.rdd.getNumPartitions()
    for times in (1, 2):
        registry._deliver(facts, f"{tmp_path}/feed")
        assert len(list(tmp_path.glob("feed/**/*.parquet"))) == times * sent
    got = rows(stream_once(spark, f"{tmp_path}/feed", tmp_path))
    assert sorted(got, key=repr) == sorted(rows(facts, *FLIGHTS.names) * 2, key=repr)


def stream_once(spark, feed, tmp_path):
    jobs.validate_stream(stream(spark, feed, 1), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    return jobs.read_validated(spark, f"{tmp_path}/out").select(*FLIGHTS.names)


@pytest.mark.parametrize("name", ["stream_windowed_counts", "stream_audit_once"])
def test_batches_of_a_feed_do_not_go_by_months(spark, name):
    """A year of a few rows is a few files, not one and more for each month."""
    root = Path(scratch_root(spark))
    before = set(root.glob("stream-*"))
    registry.all_queries()[name](spark, "/root/testdata/sf0.001").collect()
    (made,) = set(root.glob("stream-*")) - before
    assert 2 <= len(list(made.glob("out/batch_id=*"))) <= 4


def test_ids_of_events_are_held_on_disk(spark, tmp_path):
    """What is known is held outside the executors' memory; nulls in other places are another event."""
    said = [{}, {}, {"dep_delay_mins": None, "arr_delay_mins": 5}, {"dep_delay_mins": 5, "arr_delay_mins": None}]
    write_flights(table(spark, "flights", [{"flight_id": 1} | some for some in said]), f"{tmp_path}/feed")
    feed = jobs.delivered_flights(spark, f"{tmp_path}/feed")
    query = jobs.audit_once_stream(feed, f"{tmp_path}/out", f"{tmp_path}/c")
    query.awaitTermination()
    assert jobs.read_audited_once(spark, f"{tmp_path}/out").count() == 3
    (state,) = query.lastProgress["stateOperators"]
    assert any(name.startswith("rocksdb") for name in state["customMetrics"])
    assert spark.conf.get(jobs.STATE_STORE, None) is None


def test_a_checkpoint_keeps_few_versions(spark, tmp_path):
    for n in range(6):
        one = table(spark, "flights", [{"flight_id": n, "flight_date": dt.date(2023, 6, 5)}])
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    feed = jobs.delivered_flights(spark, f"{tmp_path}/feed", 1)
    jobs.audit_once_stream(feed, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert jobs.read_audited_once(spark, f"{tmp_path}/out").count() == 6
    assert len(list(Path(tmp_path, "c", "offsets").glob("[0-9]*"))) <= 4
