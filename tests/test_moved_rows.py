"""What ingests and updates move and write: whole rows once, and nothing for rows that stay."""

import datetime as dt
import re
from pathlib import Path

from frames import rows, table

from slotwise.plans.jobs import _clashes, ingest_flights, update_flights
from slotwise.sources.layout import dealt_by_month, read_audit, read_flights, write_audit, write_flights
from slotwise.sources.schemas import FLIGHTS

NOW = dt.datetime(2023, 7, 1, 8)
JUNE, JULY = dt.date(2023, 6, 5), dt.date(2023, 7, 5)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def shuffled(df):
    """Columns of each exchange of a plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", text)
    return [[name.split("#")[0].strip() for name in line.split(",")] for line in found]


def test_an_update_that_changes_nothing_writes_nothing(spark, tmp_path):
    facts, audit = f"{tmp_path}/facts", f"{tmp_path}/audit"
    old = table(spark, "flights", [{"flight_date": JUNE}, {"flight_date": JULY}, {"flight_date": JULY}])
    write_flights(old, facts)
    new = old.selectExpr(*[
        "CASE WHEN flight_id = 1 THEN 77 ELSE arr_delay_mins END AS arr_delay_mins" if n == "arr_delay_mins" else n
        for n in FLIGHTS.names
    ])
    before = files(f"{facts}/flight_month=202307")
    for turn in range(2):
        held = files(facts)
        assert rows(update_flights(new, facts, audit, changed_by="loader", changed_at=NOW)) == []
        # July takes no change
        assert files(f"{facts}/flight_month=202307") == before
        assert (files(facts) == held) == (turn == 1)
    found = {r["flight_id"]: r["arr_delay_mins"] for r in read_flights(spark, facts).collect()}
    assert found[1] == 77 and len(found) == 3
    assert read_audit(spark, audit).count() == 1


def test_an_update_still_replaces_copies_that_say_the_same(spark, tmp_path):
    facts, audit = f"{tmp_path}/facts", f"{tmp_path}/audit"
    one = table(spark, "flights", [{"flight_date": JUNE}])
    write_flights(one.unionByName(one), facts)
    update_flights(one, facts, audit, changed_by="loader", changed_at=NOW)
    assert rows(read_flights(spark, facts), "flight_id") == [(1,)]


def test_a_null_and_a_value_are_not_the_same(spark, tmp_path):
    facts, audit = f"{tmp_path}/facts", f"{tmp_path}/audit"
    one = table(spark, "flights", [{"actual_dep": None, "actual_arr": 900}])
    write_flights(one, facts)
    swapped = one.selectExpr(*[
        {"actual_dep": "900 AS actual_dep", "actual_arr": "CAST(NULL AS INT) AS actual_arr"}.get(n, n)
        for n in FLIGHTS.names
    ])
    update_flights(swapped, facts, audit, changed_by="loader", changed_at=NOW)
    assert rows(read_flights(spark, facts), "actual_dep", "actual_arr") == [(900, None)]


def test_stored_rows_are_compared_by_key_and_digest(spark, tmp_path):
    facts = f"{tmp_path}/facts"
    f = table(spark, "flights", [{"flight_date": JUNE}, {"flight_date": JULY}])
    write_flights(f, facts)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _clashes(f, read_flights(spark, facts), None)
        moved = shuffled(found)
        assert moved and all(len(columns) <= 2 for columns in moved)
        assert sorted(rows(found, "flight_id", "same")) == [(1, True), (2, True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_images_of_an_ingest_are_made_after_the_shuffle(spark, tmp_path, monkeypatch):
    seen = []

    def write(events, path, watch, **how):
        seen.extend(shuffled(events))
        write_audit(events, path, watch, **how)

    monkeypatch.setattr("slotwise.plans.jobs.write_audit", write)
    f = table(spark, "flights", [{"flight_date": JUNE}, {"flight_date": JULY}])
    paths = [f"{tmp_path}/{name}" for name in ("flights", "quarantine", "audit")]
    ingest_flights(f, *paths, changed_by="loader", changed_at=NOW)
    assert any("period" in columns for columns in seen)
    assert all("new_values" not in columns for columns in seen)
    assert sorted(rows(read_audit(spark, paths[2]), "record_id", "period")) == [(1, 202306), (2, 202307)]
    assert dealt_by_month(f).count() == 2
