"""Sources, sinks, layout and the end-to-end jobs."""

import datetime as dt
import json
from contextlib import contextmanager
from pathlib import Path

import pytest
from frames import BASE, DAY, rows, table
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from slotwise.operators import carriers
from slotwise.operators.keys import number_rows
from slotwise.plans.catalog import register
from slotwise.plans.jobs import (
    ingest_flights,
    read_current_log,
    record_resolutions,
    run_daily_breaches,
    update_flights,
)
from slotwise.session import partitions_for
from slotwise.sources import ontime_csv, tables
from slotwise.sources.exports import export_reports
from slotwise.sources.layout import read_audit, read_flights, write_flights
from slotwise.sources.schemas import FLIGHTS, QUARANTINE_STORED, SLA_BREACH_LOG
from slotwise.sources.scratch import scratch_root

NOW = dt.datetime(2023, 7, 1, 8)


@contextmanager
def many_partitions(spark):
    """Eight shuffle partitions that stay apart, as those of a large table do."""
    wanted = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_daily_run_twice_adds_nothing(spark, tmp_path):
    log, audit = f"{tmp_path}/log", f"{tmp_path}/audit"
    f = table(spark, "flights", [{"arr_delay_mins": 20}, {"route_id": 2, "arr_delay_mins": 90}])
    r = table(spark, "routes", [{}, {"route_id": 2}])
    rules = table(spark, "sla_rules", [{}])
    args = (f, r, rules, log, audit, DAY, NOW)
    assert [run_daily_breaches(*args), run_daily_breaches(*args)] == [2, 0]
    logged = spark.read.schema(SLA_BREACH_LOG).parquet(log)
    key = (DAY - dt.date(1970, 1, 1)).days * 2**32
    found = sorted(rows(logged, "breach_id", "route_id", "created_at"))
    assert found == [(key + 1, 1, NOW), (key + 2, 2, NOW)]
    events = read_audit(spark, audit)
    assert sorted(rows(events, "record_id")) == [(key + 1,), (key + 2,)]
    assert {json.loads(e.new_values)["severity"] for e in events.collect()} == {"CRITICAL"}
    next_day = (f, r, rules, log, audit, DAY + dt.timedelta(days=1), NOW)
    assert run_daily_breaches(*next_day) == 2
    later = rows(spark.read.parquet(log), "breach_id")
    assert sorted(later) == [(key + 1,), (key + 2,), (key + 2**32 + 1,), (key + 2**32 + 2,)]


def test_lost_alerts_are_sent_by_the_next_run(spark, tmp_path):
    log, audit = f"{tmp_path}/log", f"{tmp_path}/audit"
    f = table(spark, "flights", [{"arr_delay_mins": 20}])
    args = (f, table(spark, "routes", [{}]), table(spark, "sla_rules", [{}]), log)
    run_daily_breaches(*args, f"{tmp_path}/elsewhere", DAY, NOW)
    assert run_daily_breaches(*args, audit, DAY, NOW) == 0
    assert spark.read.parquet(audit).count() == 1
    # nor does it matter how long ago that was
    assert run_daily_breaches(*args, f"{tmp_path}/late", DAY + dt.timedelta(days=400), NOW) == 0
    assert spark.read.parquet(f"{tmp_path}/late").count() == 1


def test_resolutions_are_events(spark, tmp_path):
    log, events = f"{tmp_path}/log", f"{tmp_path}/events"
    table(spark, "sla_breach_log", [{}, {"route_id": 2}]).write.parquet(log)

    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "breach_id bigint")

    with pytest.raises(LookupError):
        record_resolutions(ids(1, 999), log, events, NOW)
    assert rows(read_current_log(spark, log, events), "resolved") == [(0,), (0,)]
    for _ in range(2):
        status = record_resolutions(ids(2), log, events, NOW)
        assert rows(status, "status") == [("Breach #2 marked as resolved.",)]
        current = read_current_log(spark, log, events)
        assert sorted(rows(current, "breach_id", "resolved")) == [(1, 0), (2, 1)]


def test_ingest_splits_audits_and_repeats_safely(spark, tmp_path):
    paths = [f"{tmp_path}/{name}" for name in ("flights", "quarantine", "audit")]
    f = table(
        spark,
        "flights",
        [{}, {"arr_delay_mins": 5, "nas_delay": 50}, {"flight_date": dt.date(2023, 7, 4)}],
    )
    for _ in range(2):
        ingest_flights(f, *paths, changed_by="loader", changed_at=NOW)
        stored = read_flights(spark, paths[0])
        assert sorted(rows(stored, "flight_id", "flight_month")) == [(1, 202306), (3, 202307)]
        assert rows(spark.read.parquet(paths[1]), "flight_id") == [(2,)]
        audited = read_audit(spark, paths[2])
        assert sorted(rows(audited, "record_id", "changed_at")) == [(1, NOW), (3, NOW)]


def test_ingest_keeps_every_row_and_one_of_a_key(spark, tmp_path):
    paths = [f"{tmp_path}/{name}" for name in ("flights", "quarantine", "audit")]
    january, june = dt.date(2023, 1, 5), dt.date(2023, 6, 5)
    schema = table(spark, "flights", [{}]).schema
    loose = StructType([StructField(x.name, x.dataType) for x in schema])

    def batch(*changes):
        base = rows(table(spark, "flights", [{"flight_date": january}]))[0]
        made = [{**dict(zip(loose.names, base, strict=True)), **c} for c in changes]
        return spark.createDataFrame([tuple(m[n] for n in loose.names) for m in made], loose)

    first = batch({}, {}, {"flight_number": "AA9"}, {"flight_id": 2, "flight_date": None})
    later = batch({"flight_date": june}, {"flight_id": None, "flight_date": None})
    for given in (first, later, first, later):
        ingest_flights(given, *paths, changed_by="loader", changed_at=NOW)
        assert len(rows(read_flights(spark, paths[0]), "flight_id")) == 1
    aside = spark.read.schema(QUARANTINE_STORED).parquet(paths[1])
    assert sorted(rows(aside.groupBy("reject_reason").count())) == [
        ("key is stored already", 1), ("missing flight_date", 1), ("missing flight_id", 1),
        ("second row of a key", 2),
    ]
    assert read_audit(spark, paths[2]).count() == 1


def test_updates_are_stored_and_audited_once(spark, tmp_path):
    facts, audit = f"{tmp_path}/flights", f"{tmp_path}/audit"
    old = [{}, {"flight_date": dt.date(2023, 7, 4)}, {"flight_date": dt.date(2023, 8, 4)}]
    write_flights(table(spark, "flights", old), facts)
    changed = table(spark, "flights", [{"arr_delay_mins": 44}, {"flight_id": 9}])
    for _ in range(2):
        unknown = update_flights(changed, facts, audit, changed_by="desk", changed_at=NOW)
        assert rows(unknown, "flight_id") == [(9,)]
        stored = read_flights(spark, facts)
        assert sorted(rows(stored, "flight_id", "arr_delay_mins")) == [(1, 44), (2, 0), (3, 0)]
        assert rows(read_audit(spark, audit), "record_id", "period") == [(1, 202306)]


def test_a_route_is_in_few_files(spark, tmp_path):
    """Files hold ranges of routes, so one route's rows lie in a fraction of them."""
    many = table(spark, "flights", [{"route_id": n % 40 + 1} for n in range(400)])
    with many_partitions(spark):
        write_flights(many, f"{tmp_path}/f")
    files = read_flights(spark, f"{tmp_path}/f").withColumn("file", F.input_file_name())
    assert files.select("file").distinct().count() >= 7
    assert files.filter("route_id = 17").select("file").distinct().count() <= 2


def test_a_full_month_is_cut_into_several_files(spark, tmp_path):
    """One month holds nearly all rows; the write still spreads it over tasks."""
    constant = [
        F.lit(BASE["flights"].get(field.name)).cast(field.dataType).alias(field.name)
        for field in FLIGHTS
        if field.name not in ("flight_id", "flight_date")
    ]
    many = spark.range(0, 60000, numPartitions=8).select(
        F.xxhash64("id").alias("flight_id"),
        F.when(F.col("id") % 100 == 0, dt.date(2023, 2, 1)).otherwise(DAY).alias("flight_date"),
        *constant,
    )
    with many_partitions(spark):
        write_flights(many, f"{tmp_path}/f")
    full = list(Path(tmp_path, "f", "flight_month=202306").glob("*.parquet"))
    assert len(full) > 1
    assert read_flights(spark, f"{tmp_path}/f").count() == 60000


def test_insert_if_absent_takes_the_first_of_each_new_key(spark):
    target = table(spark, "airlines", [{}])
    incoming = table(
        spark,
        "airlines",
        [
            {"carrier_name": "Again"},
            {"carrier_code": "BB", "carrier_name": "Second"},
            {"carrier_code": "BB", "carrier_name": "First"},
        ],
    )
    got = tables.insert_if_absent(target, incoming, ["carrier_code"], ["carrier_name"])
    assert rows(got, "carrier_code", "carrier_name") == [("BB", "First")]
    assert got.columns == incoming.columns


def test_codes_are_normalised_on_load(spark, tmp_path):
    table(spark, "airlines", [{"carrier_code": " aa "}]).write.parquet(f"{tmp_path}/a")
    assert rows(tables.load(spark, "airlines", f"{tmp_path}/a"), "carrier_code") == [("AA",)]


def test_defaults(spark):
    f = table(spark, "flights", [{"arr_delay_mins": None, "cancelled": None}])
    assert rows(tables.fill_defaults(f, "flights"), "arr_delay_mins", "cancelled") == [(0, 0)]
    bare = spark.createDataFrame([(1, "AA")], "rule_id int, carrier_code string")
    filled = tables.fill_defaults(bare, "sla_rules")
    assert [str(v) for v in rows(filled)[0]] == ["1", "AA", "15.00", "100", "30"]


def test_rule_changes_are_stamped(spark):
    rules = table(spark, "sla_rules", [{}, {"rule_id": 2}])
    change = table(spark, "sla_rules", [{"rule_id": 2, "max_delay_rate_pct": 20.0}])
    got = tables.upsert_rules(rules, change, "ops", NOW)
    assert sorted(rows(got, "rule_id", "updated_by", "updated_at"), key=lambda r: r[0]) == [
        (1, None, None),
        (2, "ops", NOW),
    ]


def test_csv_export_and_named_parameters(spark, tmp_path):
    a = table(spark, "airlines", [{}, {"carrier_code": "BB", "carrier_name": "Beta, Inc"}])
    tables.export_csv(a, f"{tmp_path}/csv", ["carrier_code", "carrier_name"], one_file=True)
    (part,) = Path(tmp_path, "csv").glob("*.csv")
    assert part.read_text().splitlines() == [
        "carrier_code,carrier_name", "AA,Alpha", 'BB,"Beta, Inc"',
    ]
    got = tables.run_sql(
        spark, "SELECT carrier_name FROM {a} WHERE carrier_code = :code", {"code": "AA"}, a=a
    )
    assert rows(got) == [("Alpha",)]


def test_numbering_is_dense_over_groups(spark):
    df = spark.createDataFrame([(g, o) for g in (3, 1, 2) for o in range(g, 0, -1)], "g int, o int")
    got = number_rows(df, ["g"], ["o"], "n")
    assert sorted(rows(got, "n", "g", "o")) == [
        (1, 1, 1), (2, 2, 1), (3, 2, 2), (4, 3, 1), (5, 3, 2), (6, 3, 3),
    ]


def test_ontime_csv(spark, tmp_path):
    header = list(ontime_csv.COLUMNS.values()) + ["EXTRA"]
    line = {
        "FL_DATE": "2023-01-05", "OP_UNIQUE_CARRIER": "aa", "OP_CARRIER_FL_NUM": "12",
        "ORIGIN": "JFK", "DEST": "LAX", "CRS_DEP_TIME": "0900", "CRS_ARR_TIME": "1200",
        "DEP_DELAY": "-3.00", "ARR_DELAY": "16.00", "CANCELLED": "0.00", "DIVERTED": "0.00",
        "CRS_ELAPSED_TIME": "360.00", "DISTANCE": "2475.00", "CARRIER_DELAY": "16.00",
    }
    lines = [
        line,
        {**line, "OP_CARRIER_FL_NUM": "14", "CRS_ELAPSED_TIME": "370", "ARR_DELAY": "",
         "CANCELLED": "1.00"},
        {**line, "DEST": "BOS"},
        {**line, "OP_CARRIER_FL_NUM": "16", "ARR_DELAY": "", "CRS_ELAPSED_TIME": "365"},
        {**line, "FL_DATE": "not a date"},
        {**line, "ARR_DELAY": "4O"},
        {**line, "DEP_DELAY": "7.9"},
        {**line, "CANCELLED": "yes"},
    ]
    text = "\n".join([",".join(header)] + [",".join(r.get(c, "") for c in header) for r in lines])
    (tmp_path / "ontime.csv").write_text(text + "\n")
    keyed, bad = ontime_csv.read_ontime(spark, str(tmp_path / "ontime.csv"))
    assert (keyed.count(), bad.count()) == (4, 4)
    r = ontime_csv.ontime_routes(keyed)
    assert sorted(rows(r)) == [(1, "AA", "JFK", "BOS", 360), (2, "AA", "JFK", "LAX", 365)]
    f = ontime_csv.ontime_flights(keyed, r)
    got = rows(
        f.orderBy("route_id", "flight_number"),
        "route_id", "flight_date", "flight_number", "scheduled_dep", "dep_delay_mins",
        "arr_delay_mins", "cancelled", "carrier_delay", "weather_delay",
    )
    day = dt.date(2023, 1, 5)
    assert got == [
        (1, day, "12", 900, -3, 16, 0, 16, None),
        (2, day, "12", 900, -3, 16, 0, 16, None),
        (2, day, "14", 900, -3, 0, 1, 16, None),
        (2, day, "16", 900, -3, None, 0, 16, None),
    ]
    assert f.select("flight_id").distinct().count() == 4


def test_exports_and_views(spark, tmp_path):
    a, ap = table(spark, "airlines", [{}]), table(spark, "airports", [{}, {"airport_code": "Y"}])
    r, f = table(spark, "routes", [{}]), table(spark, "flights", [{"carrier_delay": 9}])
    export_reports({"root_cause": carriers.root_cause(f, r, a)}, str(tmp_path))
    (part,) = Path(tmp_path, "root_cause").glob("*.csv")
    assert part.read_text().splitlines() == [
        "Carrier,Carrier,Weather,NAS,Security,Late Aircraft", "Alpha,100.0,0.0,0.0,0.0,0.0",
    ]
    register(f, r, a, ap, table(spark, "sla_rules", [{}]), table(spark, "sla_breach_log", [{}]))
    sql = "SELECT carrier_name, total_flights FROM vw_carrier_monthly_scorecard WHERE yr = 2023"
    assert rows(spark.sql(sql)) == [("Alpha", 1)]
    assert rows(spark.sql("SELECT route_label FROM vw_route_performance")) == [("X → Y",)]
    assert rows(spark.sql("SELECT is_early, origin_city FROM vw_flight_details")) == [(0, "X City")]


def test_shuffle_sizing():
    assert partitions_for(1) == 200
    assert partitions_for(10**14) == 745059


def test_scratch_follows_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark)
    assert spark.conf.get("spark.app.id") in root or named is None
    if named:
        assert root.startswith(named.rstrip("/"))


@pytest.mark.parametrize("name", ["airlines", "routes", "flights"])
def test_missing_table_is_an_error(spark, tmp_path, name):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load(spark, name, f"{tmp_path}/none")


def test_an_update_loses_no_change_and_no_stored_copy(spark, tmp_path):
    """Two changes of a key, and a key that is stored twice; run twice, as after a failure."""
    facts, audit, aside = (f"{tmp_path}/{x}" for x in ("facts", "audit", "aside"))
    old = [{"flight_id": 1}, {"flight_id": 2}, {"flight_id": 2, "arr_delay_mins": 5}, {"flight_id": 3}]
    write_flights(table(spark, "flights", old), facts)
    new = [{"flight_id": n, "arr_delay_mins": d} for n, d in ((1, 10), (1, 11), (2, 20))]
    for _ in range(2):
        update_flights(
            table(spark, "flights", new), facts, audit, changed_at=NOW, quarantine_path=aside
        )
        kept = dict(rows(read_flights(spark, facts), "flight_id", "arr_delay_mins"))
        assert kept in ({1: 10, 2: 20, 3: 0}, {1: 11, 2: 20, 3: 0})
        held = spark.read.schema(QUARANTINE_STORED).parquet(aside)
        assert sorted(rows(held, "flight_id", "arr_delay_mins", "reject_reason")) == [
            (1, 21 - kept[1], "second row of a key"),
            (2, 0, "key is stored more than once"),
            (2, 5, "key is stored more than once"),
        ]
