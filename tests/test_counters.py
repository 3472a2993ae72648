"""Counts taken by writes, sketches that add up, and reports called from SQL."""

import datetime as dt

import pytest
from frames import rows, table
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from slotwise.operators import sketches
from slotwise.plans.catalog import register, register_reports
from slotwise.plans.jobs import ingest_flights
from slotwise.sources.counters import Counters
from slotwise.sources.layout import with_month, write_flights

NOW = dt.datetime(2023, 7, 1, 8)


def test_writes_count_their_rows_once(spark, tmp_path):
    counters = Counters()
    f = table(spark, "flights", [{"route_id": 1 + n % 7} for n in range(500)])
    # the sample of the range layout does not count
    write_flights(f.repartition(8), f"{tmp_path}/flights", watch=lambda x: counters.watch("stored", x))
    write_flights(f.limit(0), f"{tmp_path}/none", watch=lambda x: counters.watch("none", x))
    assert counters.read("stored", "none", "never") == {"stored": 500, "none": 0, "never": 0}


def test_an_ingest_accounts_for_every_row(spark, tmp_path):
    paths = [f"{tmp_path}/{name}" for name in ("flights", "quarantine", "audit")]
    f = table(spark, "flights", [{}, {"arr_delay_mins": 5, "nas_delay": 50}, {"flight_date": dt.date(2023, 7, 4)}])
    first = ingest_flights(f, *paths, changed_by="loader", changed_at=NOW)
    assert first == {"given": 3, "stored": 2, "aside": 1, "audited": 2}
    again = ingest_flights(f, *paths, changed_by="loader", changed_at=NOW)
    assert again == {"given": 3, "stored": 0, "aside": 0, "audited": 0}
    assert set(ingest_flights(f.limit(0), *paths).values()) == {0}


def test_sketches_of_days_make_any_window(spark):
    day = dt.date(2023, 6, 1)
    given = [
        {"route_id": n % 900, "flight_date": day + dt.timedelta(days=n % 20), "arr_delay_mins": (n * 7) % 1000}
        for n in range(4000)
    ]
    given += [{"flight_date": dt.date(2023, 9, 1), "arr_delay_mins": None}, {"cancelled": 1}]
    f = table(spark, "flights", given)
    month = F.month("flight_date")
    whole = sketches.merged(sketches.daily_sketches(f), month.alias("month"))
    parts = [sketches.daily_sketches(f.filter(f"flight_id % 3 = {n}")) for n in range(3)]
    cut = sketches.merged(parts[0].union(parts[1]).union(parts[2]), month.alias("month"))
    exact = {r.month: r for r in sketches.exact_windows(f, month, "month").collect()}
    for windows in (whole, cut):
        got = {r.month: r for r in sketches.estimates(windows).collect()}
        assert {m: r.total_flights for m, r in got.items()} == {6: 4000, 9: 1}
        assert abs(got[6].routes_estimate - exact[6].routes) <= sketches.DISTINCT_ERROR * exact[6].routes
        assert abs(got[6].p90_estimate - exact[6].p90) <= 1000 * sketches.RANK_ERROR
        assert got[9].p50_estimate is None and exact[9].p50 is None
    assert sketches.merged(sketches.daily_sketches(f.limit(0)), month).count() == 0


def test_reports_take_typed_arguments_and_defaults(spark):
    day = dt.date(2023, 6, 1)
    f = with_month(table(spark, "flights", [
        {"arr_delay_mins": 20, "flight_date": day}, {"arr_delay_mins": 5, "flight_date": day},
        {"arr_delay_mins": 9, "flight_date": dt.date(2023, 8, 1)}, {"cancelled": 1, "flight_date": day},
    ]))
    r = table(spark, "routes", [{}])
    small = [table(spark, name, [{}]) for name in ("airlines", "airports", "sla_rules", "sla_breach_log")]
    register(f, r, *small)
    register_reports(spark)
    carrier = r.head().carrier_code

    def call(text):
        return rows(spark.sql(f"SELECT * FROM {text}"), "total_flights", "delayed_flights", "delay_rate_pct")

    june = "DATE'2023-06-01', DATE'2023-06-30'"
    assert call(f"carrier_delays({june})") == [(2, 1, 50.0)]
    assert call(f"carrier_delays({june}, '{carrier}', 5)") == [(2, 2, 100.0)]
    assert call(f"carrier_delays({june}, 'none such')") == []
    days = spark.sql("SELECT * FROM route_days(1, since => DATE'2023-07-01')")
    assert rows(days, "flight_date", "total_flights") == [(dt.date(2023, 8, 1), 1)]
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM carrier_delays(DATE'2023-06-01')")
