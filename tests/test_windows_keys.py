"""Event-time windows in state with a side output, and lookups by an index of keys."""

import datetime as dt
import re

import pytest
from frames import rows, table
from pyspark.sql import functions as F
from test_plans import plan, setting

from slotwise.operators.flagging import daily_counters
from slotwise.plans.jobs import ingest_flights, update_flights
from slotwise.sources.keyed import KeyIndex, find_facts
from slotwise.sources.layout import read_flights, write_flights
from slotwise.streaming import jobs

DAY = dt.date(2023, 1, 2)
WINDOW = ("window_start", "route_id", "total_flights", "delayed_flights")


def feed(spark, path, weeks, first_id=1):
    """A file for each entry: some rows of that week, one cancelled; None is a file of rows without a date."""
    for n, week in enumerate(weeks):
        some = [
            {
                "flight_id": first_id + 10 * n + k,
                "route_id": k % 3 + 1,
                "flight_date": None if week is None else DAY + dt.timedelta(days=7 * week + k % 7),
                "arr_delay_mins": 20 if k % 2 else None if k == 4 else 0,
                "cancelled": 1 if k == 9 else 0,
            }
            for k in range(10)
        ]
        write_flights(table(spark, "flights", some).coalesce(1), path)


def expected_windows(spark, path, days=7):
    counted = daily_counters(read_flights(spark, path))
    by_week = counted.groupBy(jobs.window_start(F.col("flight_date"), days), "route_id")
    return sorted(rows(by_week.agg(F.sum("total_flights"), F.sum("delayed_flights"))), key=repr)


def run(spark, path, out, files, **options):
    stream = jobs.flight_stream(spark, path, files)
    jobs.windowed_stream(stream, f"{out}/out", f"{out}/c", **options).awaitTermination()
    return jobs.read_windows(spark, f"{out}/out")


@pytest.mark.parametrize("files", [1000, 2, 1])
def test_state_and_side_output_make_the_batch(spark, tmp_path, files):
    path = f"{tmp_path}/feed"
    feed(spark, path, [0, 1, 6, 2, None, 0, 7, 6, 1])
    got = run(spark, path, tmp_path, files)
    assert sorted(rows(got, *WINDOW), key=repr) == expected_windows(spark, path)
    late = got.agg(F.sum("late_flights")).head()[0]
    # rows without a date are never in state; of the others none is late in one batch
    assert late == 9 if files == 1000 else late > 9


def test_a_restart_keeps_windows_and_side_output(spark, tmp_path):
    path = f"{tmp_path}/feed"
    feed(spark, path, [0, 1, 6])
    run(spark, path, tmp_path, 1)
    feed(spark, path, [6, 0, 8, 1, 6], 500)
    got = run(spark, path, tmp_path, 1)
    assert sorted(rows(got, *WINDOW), key=repr) == expected_windows(spark, path)
    assert {w for w, n in rows(got, "window_start", "late_flights") if n} >= {dt.date(2022, 12, 29)}
    again = run(spark, path, tmp_path, 1)
    assert sorted(rows(again), key=repr) == sorted(rows(got), key=repr)


def test_closed_windows_leave_the_state(spark, tmp_path):
    path = f"{tmp_path}/feed"
    feed(spark, path, list(range(12)))
    stream = jobs.flight_stream(spark, path, 1)
    query = jobs.windowed_stream(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    query.awaitTermination()
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 0 < held <= 9  # three routes, of windows that may still get rows


def test_windows_of_other_lengths_and_no_rows(spark, tmp_path):
    path, empty = f"{tmp_path}/feed", f"{tmp_path}/empty"
    table(spark, "flights", []).write.parquet(empty)
    assert rows(run(spark, empty, tmp_path / "none", 1)) == []
    feed(spark, path, [0, 3, 0])
    got = run(spark, path, tmp_path, 1, days=3, lateness="0 days")
    assert sorted(rows(got, *WINDOW), key=repr) == expected_windows(spark, path, 3)


def facts(spark, ids, **other):
    return table(spark, "flights", [{"flight_id": i, "flight_date": DAY + dt.timedelta(days=i % 300), **other} for i in ids])


@pytest.fixture
def indexed(spark, tmp_path):
    stored = facts(spark, range(0, 4000, 2))
    write_flights(stored, f"{tmp_path}/facts")
    index = KeyIndex(spark, f"{tmp_path}/keys", 16)
    index.add(stored)
    return f"{tmp_path}/facts", index


def rows_read(frame):
    """Rows that the scans of a frame came to, and its plan."""
    frame.collect()
    executed = frame._jdf.queryExecution().executedPlan()
    leaves = executed.collectLeaves()
    metrics = [leaves.apply(i).metrics() for i in range(leaves.length())]
    return sum(m.apply("numOutputRows").value() for m in metrics), executed.toString()


def test_a_literal_key_opens_its_bucket_only(spark, indexed):
    _, index = indexed
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        found, text = rows_read(index.of([1234]))
        assert 0 < found < 200 and "SelectedBucketsCount: 1 out of 16" in text
        assert rows_read(index.read())[0] == 2000
        assert [r.flight_id for r in index.of([1234]).collect()] == [1234]


def test_the_filter_passes_over_keys_that_are_not_there(spark, indexed):
    """Odd keys lie between stored ones, so ranges of values cannot tell; rows are read in vain rarely."""
    _, index = indexed
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        read = [rows_read(index.of([key]))[0] for key in range(1001, 1025, 2)]
    assert sum(1 for n in read if n) <= 3


def test_lookups_never_shuffle_the_index(spark, indexed):
    path, index = indexed
    wanted = facts(spark, [10, 11, 20, 20, 3998])
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        lines = plan(index.read().join(wanted.select("flight_id"), "flight_id", "left_semi"))
    at = next(n for n, line in enumerate(lines) if "Scan parquet" in line and "slotwise_keys" in line)
    depth = len(re.match(r"[\s:+\-|]*", lines[at]).group())
    above = [line for line in lines[:at] if len(re.match(r"[\s:+\-|]*", line).group()) < depth]
    joins = [n for n, line in enumerate(above) if "SortMergeJoin" in line]
    assert joins and not any("Exchange" in line for line in above[joins[-1] :])
    places = index.places(wanted)
    assert sorted(r[0] for r in rows(places, "flight_id")) == [10, 20, 3998]
    assert sorted(r[0] for r in rows(find_facts(spark, path, places), "flight_id")) == [10, 20, 3998]


def test_an_index_is_found_again_with_its_buckets(spark, indexed, tmp_path):
    _, index = indexed
    again = KeyIndex(spark, f"{tmp_path}/keys", 99)
    assert again.buckets == 16 and again.read().count() == 2000
    (tmp_path / "keys" / "buckets_7").mkdir()
    with pytest.raises(ValueError, match="one is expected"):
        KeyIndex(spark, f"{tmp_path}/keys")


def test_jobs_with_an_index_store_what_they_store_without(spark, tmp_path):
    first = facts(spark, [*range(60), 5, 5])
    second = facts(spark, range(40, 80), arr_delay_mins=3)
    moved = facts(spark, range(10, 20)).withColumn("flight_date", F.date_add("flight_date", 90))
    undated = facts(spark, [3]).withColumn("flight_date", F.lit(None).cast("date"))
    outcomes = []
    for name in ("plain", "indexed"):
        root = f"{tmp_path}/{name}"
        paths = [f"{root}/facts", f"{root}/aside", f"{root}/audit"]
        index = KeyIndex(spark, f"{root}/keys", 4) if name == "indexed" else None
        counted = [ingest_flights(b, *paths, changed_by="t", index=index) for b in (first, second, first)]
        update_flights(
            moved.unionByName(undated), paths[0], paths[2], changed_by="t", quarantine_path=paths[1], index=index
        )
        # a key that has moved is found in its new month, and is not stored a second time
        counted.append(ingest_flights(moved, *paths, changed_by="t", index=index))
        stored = read_flights(spark, paths[0]).select("flight_id", "flight_date", "arr_delay_mins")
        outcomes.append((counted, sorted(rows(stored), key=repr)))
    assert outcomes[0] == outcomes[1]
    assert outcomes[0][0][3]["stored"] == 0


def test_keys_of_a_run_that_died_before_its_facts_do_no_harm(spark, tmp_path):
    index = KeyIndex(spark, f"{tmp_path}/keys", 4)
    batch = facts(spark, range(30))
    index.add(batch)
    paths = [f"{tmp_path}/{name}" for name in ("facts", "aside", "audit")]
    for stored in (30, 0):
        counted = ingest_flights(batch, *paths, changed_by="t", index=index)
        assert counted["stored"] == stored and counted["aside"] == 0
    assert index.places(batch).count() == 30
