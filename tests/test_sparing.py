"""What jobs leave on disk, and keys told apart by a map of bits."""

import datetime as dt
from pathlib import Path

import pytest
from frames import rows, table

from slotwise.operators import keysets
from slotwise.plans.jobs import ingest_flights, update_flights
from slotwise.sources.layout import read_flights, write_flights
from slotwise.sources.scratch import SPARING, scratch_root, settings

NOW = dt.datetime(2023, 7, 1, 8)
JUNE, JULY = dt.date(2023, 6, 5), dt.date(2023, 7, 5)


def left_behind(spark):
    return {str(p) for p in Path(scratch_root(spark)).glob("*")}


def test_jobs_leave_no_tables_of_their_own(spark, tmp_path):
    paths = [f"{tmp_path}/{name}" for name in ("flights", "quarantine", "audit")]
    f = table(spark, "flights", [{"flight_date": JUNE}, {"flight_date": JULY}, {"flight_id": 1, "flight_date": JUNE}])
    before = left_behind(spark)
    for _ in range(2):
        ingest_flights(f, *paths, changed_by="loader", changed_at=NOW)
    assert left_behind(spark) == before
    changes = table(spark, "flights", [{"flight_date": JUNE, "arr_delay_mins": 9}, {"flight_id": 8}])
    unknown = update_flights(changes, paths[0], paths[2], changed_by="loader", changed_at=NOW)
    (kept,) = left_behind(spark) - before
    assert "/unknown-" in kept and rows(unknown, "flight_id") == [(8,)]
    assert all(spark.conf.get(name, None) is None for name in SPARING)


def test_a_session_keeps_its_own_settings(spark):
    name = "spark.sql.parquet.compression.codec"
    spark.conf.set(name, "gzip")
    try:
        with settings(spark, SPARING):
            assert spark.conf.get(name) == "gzip"
        assert spark.conf.get(name) == "gzip"
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("bits", [2**16, 2**26, 4])
def test_rows_are_told_by_their_keys(spark, tmp_path, monkeypatch, bits):
    """Whether the map holds the keys well, badly or not at all; a row without a key has none."""
    monkeypatch.setattr(keysets, "BITS", bits)
    ids = [*range(-40, 40), 5, None]
    given = spark.createDataFrame([(n, str(n)) for n in ids], "flight_id bigint, said string")
    for wanted in ([], [5], list(range(-40, 0)), [n for n in ids if n is not None]):
        spark.createDataFrame([(n,) for n in wanted], "flight_id bigint").write.mode("overwrite").parquet(f"{tmp_path}/k")
        keys = spark.read.parquet(f"{tmp_path}/k")
        having, lacking = (rows(f(given, keys)) for f in (keysets.having, keysets.lacking))
        assert sorted(having) == sorted((n, str(n)) for n in ids if n in wanted)
        assert sorted(lacking, key=repr) == sorted(((n, str(n)) for n in ids if n not in wanted), key=repr)


def test_a_batch_that_is_stored_in_part(spark, tmp_path):
    """New rows, rows stored as they are but not audited, and a key of other values, beside an audited one."""
    paths = [f"{tmp_path}/{name}" for name in ("flights", "quarantine", "audit")]
    first = table(spark, "flights", [{"flight_id": 1, "flight_date": JUNE}])
    ingest_flights(first, *paths, changed_by="loader", changed_at=NOW)
    write_flights(table(spark, "flights", [{"flight_id": n, "flight_date": JULY} for n in (2, 3)]), paths[0])
    days = {1: JUNE, 2: JULY, 3: JUNE, 4: JULY}
    batch = table(spark, "flights", [{"flight_id": n, "flight_date": day} for n, day in days.items()])
    counted = ingest_flights(batch, *paths, changed_by="loader", changed_at=NOW)
    assert counted == {"given": 4, "stored": 1, "aside": 1, "audited": 2}
    assert sorted(rows(read_flights(spark, paths[0]), "flight_id")) == [(1,), (2,), (3,), (4,)]
