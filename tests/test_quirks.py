"""One literal case per rule that is easy to get wrong."""

import datetime as dt
import json

import pytest
from frames import DAY, rows, table
from pyspark.sql import functions as F

from slotwise.functions import bands
from slotwise.functions.filters import calendar_month, date_range, months_before
from slotwise.operators import (
    airports,
    audit,
    breaches,
    carriers,
    diagnostics,
    flagging,
    quality,
    scorecard,
    selection,
    views,
)


def days(n):
    return DAY - dt.timedelta(days=n)


@pytest.fixture(scope="module")
def two(spark):
    """Two carriers with one route each."""
    return {
        "airlines": table(
            spark, "airlines", [{}, {"carrier_code": "BB", "carrier_name": "Beta"}]
        ),
        "airports": table(
            spark,
            "airports",
            [{}, {"airport_code": "Y", "airport_name": "Y Field", "city": "Y City"}],
        ),
        "routes": table(
            spark, "routes", [{}, {"route_id": 2, "carrier_code": "BB", "scheduled_mins": 200}]
        ),
    }


def banded(spark, values, kind, fn):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_delay_flags(spark):
    values = [14, 15, 59, 60, -1, 0, None]
    late = banded(spark, values, "int", lambda c: bands.flag(bands.is_late(c, 15)))
    severe = banded(spark, values, "int", lambda c: bands.flag(bands.is_late(c, 60)))
    early = banded(spark, values, "int", lambda c: bands.flag(c < 0))
    assert late == [0, 1, 1, 1, 0, 0, 0]
    assert severe == [0, 0, 0, 1, 0, 0, 0]
    assert early == [0, 0, 0, 0, 1, 0, 0]


def test_time_slots(spark):
    values = [0, 559, 560, 600, 959, 1000, 1400, 1759, 1800, None]
    night, morning, midday, afternoon, evening = bands.SLOTS
    assert banded(spark, values, "int", bands.time_slot) == [
        night, night, evening, morning, morning, midday, afternoon, afternoon, evening, evening,
    ]


def test_bands(spark):
    assert banded(spark, [30.0, 29.99, 20.0, 19.99], "double", bands.severity) == [
        "CRITICAL", "HIGH", "HIGH", "MEDIUM",
    ]
    assert banded(spark, [6, 5, 3, 2], "int", bands.pattern) == [
        "CHRONIC", "RECURRING", "RECURRING", "INTERMITTENT",
    ]
    assert banded(spark, [90.0, 89.9, 75.0, 74.9], "double", bands.sla_status) == [
        "Meets SLA", "At Risk", "At Risk", "SLA Breach",
    ]
    assert banded(spark, [-1, 0, 14, 15, 45, 46, 120, 121, None], "int", bands.delay_band) == [
        "early", "on_time", "on_time", "minor", "minor", "moderate", "moderate", "severe", None,
    ]


def test_month_arithmetic():
    assert months_before(dt.date(2024, 3, 31), 1) == dt.date(2024, 2, 29)
    assert months_before(dt.date(2023, 12, 31), 12) == dt.date(2022, 12, 31)
    assert calendar_month(2023, 12) == (dt.date(2023, 12, 1), dt.date(2023, 12, 31))
    for year, month in ((None, 3), (2023, None)):
        with pytest.raises(ValueError):
            calendar_month(year, month)


def test_reversed_range_is_swapped(spark):
    f = table(spark, "flights", [{"flight_date": days(n)} for n in (0, 5, 20)])
    assert date_range(f, DAY, days(10)).count() == 2


def test_ranking_counts_no_cancelled_rows_and_ties_share_a_rank(spark, two):
    f = table(
        spark,
        "flights",
        [
            {"arr_delay_mins": 20},
            {},
            {"route_id": 2, "arr_delay_mins": 70},
            {"route_id": 2},
            {"cancelled": 1},
        ],
    )
    got = carriers.carrier_ranking(f, two["routes"], two["airlines"])
    assert rows(
        got, "carrier_code", "on_time_rank", "total_flights", "delayed", "severe_delays",
        "avg_arr_delay_mins", "avg_delay_when_late", "delay_rate_pct", "cancel_rate_pct",
        "percentile_rank",
    ) == [
        ("AA", 1, 2, 1, 0, 10.0, 20.0, 50.0, 0.0, 0.0),
        ("BB", 1, 2, 1, 1, 35.0, 70.0, 50.0, 0.0, 0.0),
    ]


def test_mean_when_late_is_null_without_late_rows(spark, two):
    f = table(spark, "flights", [{}])
    got = carriers.carrier_ranking(f, two["routes"], two["airlines"])
    assert rows(got, "avg_delay_when_late", "delay_rate_pct") == [(None, 0.0)]


def test_first_month_has_no_change_and_is_flat(spark, two):
    f = table(
        spark,
        "flights",
        [
            {"flight_date": dt.date(2023, 1, 5)},
            {"flight_date": dt.date(2023, 3, 5), "arr_delay_mins": 30},
            {"flight_date": dt.date(2023, 4, 5)},
        ],
    )
    got = carriers.monthly_trend(f, two["routes"], two["airlines"])
    assert rows(got, "month_label", "prev_month_rate", "mom_change_pct", "trend") == [
        ("2023-01", None, None, "Flat"),
        ("2023-03", 0.0, 100.0, "Worsening"),
        ("2023-04", 100.0, -100.0, "Improving"),
    ]


def test_root_cause_without_minutes_has_no_shares(spark, two):
    f = table(spark, "flights", [{}])
    got = carriers.root_cause(f, two["routes"], two["airlines"])
    assert rows(got, "grand_total_delay_mins", "pct_carrier", "pct_security") == [(0, None, None)]


def test_unknown_cause_drops_its_row_from_the_grand_total(spark, two):
    f = table(
        spark,
        "flights",
        [{"carrier_delay": 10}, {"carrier_delay": 30, "weather_delay": None}],
    )
    got = carriers.root_cause(f, two["routes"], two["airlines"])
    assert rows(got, "total_carrier_mins", "grand_total_delay_mins") == [(40, 10)]


def test_rows_without_route_count_nowhere(spark, two):
    f = table(spark, "flights", [{}, {"route_id": 99, "arr_delay_mins": 500}])
    assert rows(carriers.carrier_ranking(f, two["routes"], two["airlines"]), "total_flights") == [
        (1,)
    ]
    assert views.flight_details(f, two["routes"], two["airlines"], two["airports"]).count() == 1


def test_bottleneck_rank_is_dense_and_volume_filtered(spark, two):
    f = table(
        spark,
        "flights",
        [{"dep_delay_mins": 61}, {"dep_delay_mins": 61}, {"route_id": 2, "dep_delay_mins": 5}],
    )
    r = table(spark, "routes", [{}, {"route_id": 2, "origin": "Y", "destination": "X"}])
    ap = two["airports"]
    got = airports.departure_bottlenecks(f, r, ap, min_n=1)
    assert rows(got, "delay_rank", "airport_code", "worst_dep_delay", "extreme_delays") == [
        (1, "X", 61, 2),
        (2, "Y", 5, 0),
    ]
    assert airports.departure_bottlenecks(f, r, ap, min_n=2).count() == 1


def test_od_buffer_weighs_routes_by_flights(spark, two):
    f = table(spark, "flights", [{"arr_delay_mins": 30}, {"route_id": 2}, {"route_id": 2}])
    got = airports.od_matrix(f, two["routes"], two["airports"], min_n=1)
    # mean delay 10, mean scheduled (100 + 200 + 200) / 3
    assert rows(got, "flights", "avg_arr_delay", "delay_beyond_buffer") == [(3, 10.0, 1.7)]


def test_propagation_ratio(spark, two):
    f = table(
        spark,
        "flights",
        [{"arr_delay_mins": 40, "late_aircraft_delay": 10}, {"arr_delay_mins": 999}],
    )
    got = airports.delay_propagation(f, two["routes"], two["airports"], min_n=1)
    assert rows(got, "flights_affected", "propagation_ratio_pct") == [(1, 25.0)]


COUNTERS = "route_id int, flight_date date, total_flights long, delayed_flights long"


def flagged(spark, f, rules=({},), log=None, as_of=DAY, **options):
    r = table(spark, "routes", [{}, {"route_id": 2, "carrier_code": "BB"}])
    return flagging.flag_breaches(
        table(spark, "flights", f), r, table(spark, "sla_rules", rules), log, as_of, **options
    )


@pytest.mark.parametrize(
    "late, total, breach", [(3001, 20007, False), (3, 20, False), (3002, 20000, True)]
)
def test_threshold_is_strict_after_rounding(spark, two, late, total, breach):
    # 14.9998 % and 15.00 % are no breach, 15.01 % is
    counters = spark.createDataFrame([(1, DAY, total, late)], COUNTERS)
    ruled, windows = flagging.ruled_routes(two["routes"], table(spark, "sla_rules", [{}]))
    assert (flagging.trailing_breaches(counters, ruled, windows, [DAY]).count() == 1) is breach


def test_rate_just_over_the_threshold_rounds_down(spark, two):
    # 15.004 % rounds to 15.00 %
    counters = spark.createDataFrame([(1, DAY, 25000, 3751)], COUNTERS)
    ruled, windows = flagging.ruled_routes(two["routes"], table(spark, "sla_rules", [{}]))
    assert flagging.trailing_breaches(counters, ruled, windows, [DAY]).count() == 0


def test_window_is_closed_at_both_ends(spark):
    late = {"arr_delay_mins": 20}
    f = [{**late, "flight_date": days(n)} for n in (30, 31, 0, -1)]
    assert rows(flagged(spark, f), "total_flights") == [(2,)]
    assert rows(flagged(spark, f, per_carrier_rules=True), "total_flights") == [(2,)]


def test_minimum_volume_and_cancelled_rows(spark):
    f = [{"arr_delay_mins": 20}, {"arr_delay_mins": 20, "cancelled": 1}]
    assert flagged(spark, f, [{"min_flights_window": 1}]).count() == 1
    assert flagged(spark, f, [{"min_flights_window": 2}]).count() == 0


def test_second_run_adds_nothing_whatever_the_rule(spark):
    f = [{"arr_delay_mins": 20}]
    log = table(spark, "sla_breach_log", [{"rule_id": 77}])
    assert flagged(spark, f, log=log).count() == 0
    older = table(spark, "sla_breach_log", [{"breach_date": days(1)}])
    assert flagged(spark, f, log=older).count() == 1


def test_only_the_first_global_rule_counts(spark):
    f = [{"arr_delay_mins": 20}, {}]
    own = {"rule_id": 5, "carrier_code": "AA", "max_delay_rate_pct": 60.0}
    assert rows(flagged(spark, f, [{"rule_id": 3}, {"rule_id": 2}, own]), "rule_id") == [(2,)]
    assert flagged(spark, f, [{}, own], per_carrier_rules=True).count() == 0
    assert flagged(spark, f, [own]).count() == 0
    low = {**own, "max_delay_rate_pct": 10.0}
    assert rows(flagged(spark, f, [low], per_carrier_rules=True), "rule_id") == [(5,)]


def test_backfill_equals_single_runs(spark):
    f = [
        {"flight_date": days(n), "arr_delay_mins": 20 if n % 3 == 0 else 0, "route_id": n % 2 + 1}
        for n in range(60)
    ]
    r = table(spark, "routes", [{}, {"route_id": 2, "carrier_code": "BB"}])
    rules = table(spark, "sla_rules", [{"min_flights_window": 3}])
    dates = [days(n) for n in (0, 7, 14, 40)]
    many = flagging.backfill_breaches(table(spark, "flights", f), r, rules, dates)
    single = [flagged(spark, f, [{"min_flights_window": 3}], as_of=d) for d in dates]
    assert sorted(rows(many)) == sorted(x for df in single for x in rows(df))


def test_backfill_with_windows_of_their_own(spark):
    f = [{"flight_date": days(n), "arr_delay_mins": 20, "route_id": n % 2 + 1} for n in range(40)]
    r = table(spark, "routes", [{}, {"route_id": 2, "carrier_code": "BB"}])
    rules = [{}, {"rule_id": 2, "carrier_code": "BB", "window_days": 4}]
    dates = [days(0), days(9)]
    many = flagging.backfill_breaches(
        table(spark, "flights", f), r, table(spark, "sla_rules", rules), dates, None, True
    )
    single = [flagged(spark, f, rules, as_of=d, per_carrier_rules=True) for d in dates]
    assert sorted(rows(many)) == sorted(x for df in single for x in rows(df))
    assert sorted(rows(many, "route_id", "total_flights")) == [(1, 15), (1, 16), (2, 2), (2, 3)]


def test_unknown_breach_id_resolves_nothing(spark):
    log = table(spark, "sla_breach_log", [{}, {}])
    with pytest.raises(LookupError, match="not found"):
        flagging.resolve_breaches(log, spark.createDataFrame([(1,), (999,)], "breach_id int"))
    twice = spark.createDataFrame([(2,), (2,)], "breach_id int")
    now, status = flagging.resolve_breaches(log, twice)
    assert sorted(rows(now, "breach_id", "resolved")) == [(1, 0), (2, 1)]
    assert rows(status, "status") == [("Breach #2 marked as resolved.",)]


def test_active_breaches_by_rule_and_by_bound_threshold(spark, two):
    log = table(
        spark,
        "sla_breach_log",
        [{}, {"resolved": 1}, {"delay_rate_pct": 30.5, "route_id": 2, "breach_date": days(9)}],
    )
    rules = table(spark, "sla_rules", [{}])
    args = (log, two["routes"], two["airlines"], rules, DAY)
    assert rows(
        breaches.active_breaches(*args),
        "breach_id", "overage_pct", "severity", "days_open", "route",
    ) == [(3, 15.5, "CRITICAL", 9, "X → Y"), (1, 10.0, "HIGH", 0, "X → Y")]
    bound = breaches.active_breaches(*args, threshold=30)
    assert rows(bound, "breach_id", "sla_threshold_pct", "overage_pct", "carrier_code") == [
        (3, 30.0, 0.5, "BB")
    ]
    assert breaches.active_breaches(*args, threshold=30, carrier="AA").count() == 0


def test_chronic_offenders(spark, two):
    log = table(
        spark,
        "sla_breach_log",
        [{"breach_date": days(n), "delay_rate_pct": 20.0 + n} for n in (0, 10, 90, 91)],
    )
    got = breaches.chronic_offenders(log, two["routes"], two["airlines"], DAY)
    assert rows(
        got, "breach_count", "avg_delay_rate", "peak_delay_rate", "breach_span_days", "pattern"
    ) == [(3, 53.33, 110.0, 90, "RECURRING")]
    few = breaches.chronic_offenders(log, two["routes"], two["airlines"], DAY, 5, 1)
    assert rows(few, "breach_count", "pattern") == [(1, "INTERMITTENT")]


def test_compliance_filter_in_the_join_keeps_every_carrier(spark, two):
    log = table(spark, "sla_breach_log", [{}, {"route_id": 2, "resolved": 1}])
    args = (log, two["routes"], two["airlines"], DAY)
    columns = ("carrier_name", "sla_compliance_pct")
    assert sorted(rows(breaches.sla_compliance(*args), *columns)) == [("Alpha", 0.0), ("Beta", 0.0)]
    matched = breaches.sla_compliance(*args, threshold=15, match_carrier="AA")
    assert sorted(rows(matched, *columns)) == [("Alpha", 0.0), ("Beta", 100.0)]
    assert rows(breaches.sla_compliance(*args, carrier="BB"), *columns) == [("Beta", 0.0)]


def test_recent_breaches(spark):
    noon = dt.datetime(2023, 6, 30, 12)
    log = table(
        spark,
        "sla_breach_log",
        [
            {"created_at": noon - dt.timedelta(hours=24)},
            {"created_at": noon - dt.timedelta(hours=25)},
            {"created_at": noon, "resolved": 1},
        ],
    )
    assert rows(breaches.recent_breaches(log, noon)) == [(1,)]


def test_scorecard_rank_of_one_carrier(spark):
    codes = ["AA", "BB", "CC", "DD", "EE"]
    a = table(spark, "airlines", [{"carrier_code": c, "carrier_name": c} for c in codes])
    r = table(
        spark, "routes", [{"route_id": n, "carrier_code": c} for n, c in enumerate(codes, 1)]
    )
    ap = table(spark, "airports", [{}, {"airport_code": "Y"}])
    f = table(
        spark,
        "flights",
        [
            {"route_id": route, "arr_delay_mins": 20 if n < route else 0}
            for route in range(1, 6)
            for n in range(6)
        ],
    )
    columns = ("on_time_rank", "total_carriers_evaluated")
    args = (f, r, a, ap, 2023, 6)
    assert rows(scorecard.monthly_scorecard(*args, "CC"), *columns) == [(1, 1)]
    ranked = scorecard.monthly_scorecard(*args, "CC", rank_before_filter=True)
    assert rows(ranked, *columns) == [(3, 5)]
    assert scorecard.monthly_scorecard(f, r, a, ap, 2023, 5).count() == 0
    with pytest.raises(ValueError):
        scorecard.monthly_scorecard(f, r, a, ap, None, 5)


def test_scorecard_includes_cancelled_rows(spark, two):
    f = table(spark, "flights", [{"arr_delay_mins": 20}, {"cancelled": 1}])
    card = views.carrier_monthly_scorecard(f, two["routes"], two["airlines"], two["airports"])
    columns = ("total_flights", "cancelled_flights", "delay_rate_pct", "cancel_rate_pct")
    assert rows(card, *columns) == [(2, 1, 50.0, 50.0)]
    perf = views.route_performance(f, two["routes"])
    assert rows(perf, "total_flights", "avg_arr_delay", "worst_delay", "best_time") == [
        (2, 10.0, 20, 0)
    ]


@pytest.mark.parametrize(
    "causes, label",
    [
        ({"security_delay": 90, "nas_delay": 5}, "National Air System"),
        ({"carrier_delay": 7, "weather_delay": 7}, "Carrier Operations"),
        ({"weather_delay": 7, "nas_delay": 7}, "Weather"),
        ({"carrier_delay": 7, "weather_delay": None}, "Late Aircraft"),
    ],
)
def test_dominant_cause(spark, two, causes, label):
    f = table(spark, "flights", [causes])
    got = scorecard.dominant_cause(f, two["routes"], two["airlines"], 2023, 6)
    assert rows(got, "dominant_delay_cause") == [(label,)]


@pytest.mark.parametrize(
    "row, reason",
    [
        ({"nas_delay": 25, "arr_delay_mins": 15}, None),
        ({"nas_delay": 26, "arr_delay_mins": 15}, quality.CAUSES_TOO_LARGE),
        ({"arr_delay_mins": -10}, None),
        ({"arr_delay_mins": -11}, quality.CAUSES_TOO_LARGE),
        ({"arr_delay_mins": None, "nas_delay": 500}, None),
        ({"nas_delay": None, "arr_delay_mins": 0}, None),
        ({"cancelled": 1}, quality.CANCELLED_DEPARTED),
        ({"cancelled": 1, "actual_dep": None}, None),
    ],
)
def test_validation(spark, row, reason):
    checked = quality.validate(table(spark, "flights", [row]))
    assert rows(checked, "reject_reason") == [(reason,)]
    assert quality.accepted(checked).count() == (1 if reason is None else 0)
    assert quality.rejected(checked).count() == (0 if reason is None else 1)


def test_early_arrivals_can_be_clamped(spark):
    f = table(spark, "flights", [{"arr_delay_mins": -11}])
    assert rows(quality.validate(f, clamp_early=True), "reject_reason") == [(None,)]


@pytest.mark.parametrize(
    "old, new, audited, null_safe",
    [
        ({"distance_miles": 1}, {"distance_miles": 2}, 0, 0),
        ({"arr_delay_mins": 5}, {"arr_delay_mins": 6}, 1, 1),
        ({"arr_delay_mins": None}, {"arr_delay_mins": 6}, 0, 1),
        ({"arr_delay_mins": None}, {"arr_delay_mins": None}, 0, 0),
        ({"arr_delay_mins": None, "diverted": 0}, {"arr_delay_mins": None, "diverted": 1}, 1, 1),
    ],
)
def test_update_audit(spark, old, new, audited, null_safe):
    before, after = table(spark, "flights", [old]), table(spark, "flights", [new])
    assert audit.audit_updates(after, before).count() == audited
    assert audit.audit_updates(after, before, null_safe=True).count() == null_safe


def test_repeated_old_keys_are_reported_not_paired(spark):
    old = table(
        spark, "flights",
        [{"flight_id": 1, "arr_delay_mins": n} for n in (7, 3, 5)] + [{"flight_id": 2}],
    )
    new = table(spark, "flights", [{"flight_id": n, "arr_delay_mins": 9} for n in (1, 2)])
    assert rows(audit.audit_updates(new, old), "record_id") == [(2,)]
    assert rows(audit.repeated_old_keys(new, old)) == [(1, 3)]


def test_audit_ids_do_not_depend_on_the_clock(spark):
    new = table(spark, "flights", [{}, {}])
    ids = [
        sorted(rows(audit.with_audit_ids(audit.audit_new(new, changed_at=when)), "audit_id"))
        for when in (None, dt.datetime(2020, 1, 1))
    ]
    assert ids[0] == ids[1]
    assert len(set(ids[0])) == 2


def test_pivots_name_the_values_in_use(spark):
    by_slot = spark.createDataFrame(
        [("X", slot, 1.0) for slot in ("6PM-12AM (Evening)", "12AM-6AM (Red-eye)")],
        "airport_code string, time_slot string, avg_dep_delay double",
    )
    assert airports.tod_pivot(by_slot).columns == [
        "airport_code", "12AM-6AM (Red-eye)", "6PM-12AM (Evening)",
    ]
    matrix = spark.createDataFrame(
        [("A", "B", 1.0), ("A", "C", 2.0)], "origin string, destination string, delay_rate_pct double"
    )
    assert rows(airports.od_pivot(matrix)) == [("A", 1.0, 2.0)]
    with pytest.raises(Exception, match="outside the given columns: C"):
        airports.od_pivot(matrix, ["B"]).collect()


def test_every_unknown_id_is_reported(spark):
    log = table(spark, "sla_breach_log", [{}])
    ids = spark.createDataFrame([(n,) for n in range(100, 120)], "breach_id int")
    with pytest.raises(LookupError, match="20 of") as raised:
        flagging.resolve_breaches(log, ids)
    assert raised.value.ids.count() == raised.value.count == 20


def test_audit_images_keep_nulls(spark):
    old = table(spark, "flights", [{}])
    new = table(spark, "flights", [{}, {"arr_delay_mins": None}])
    (row,) = audit.audit_inserts(new, old, changed_by="loader").collect()
    assert (row.table_name, row.operation, row.record_id, row.changed_by) == (
        "flights", "INSERT", 2, "loader",
    )
    assert json.loads(row.new_values) == {
        "flight_date": "2023-06-30",
        "flight_number": "AA100",
        "route_id": 1,
        "dep_delay": 0,
        "arr_delay": None,
        "cancelled": 0,
    }


def test_breach_alert(spark):
    (row,) = audit.breach_alerts(table(spark, "sla_breach_log", [{}])).collect()
    assert row.changed_by
    assert json.loads(row.new_values) == {
        "event": "SLA_BREACH_DETECTED",
        "route_id": 1,
        "breach_date": "2023-06-30",
        "delay_rate_pct": 25.0,
        "total_flights": 4,
        "delayed_flights": 1,
        "severity": "HIGH",
    }


def test_orphans_and_duplicates(spark, two):
    f = table(spark, "flights", [{}, {"route_id": 9}, {"route_id": 9}, {"flight_id": 1}])
    rules = table(spark, "sla_rules", [{}, {"rule_id": 2, "carrier_code": "ZZ"}])
    got = quality.orphans({**two, "flights": f, "sla_rules": rules})
    assert sorted(rows(got, "child_table", "child_column", "missing_key", "row_count")) == [
        ("flights", "route_id", "9", 2),
        ("sla_rules", "carrier_code", "ZZ", 1),
    ]
    assert rows(quality.duplicate_keys(f, ["flight_id"])) == [(1, 2)]


def test_declared_constraints(spark):
    r = table(spark, "routes", [{}, {"route_id": 2}, {"route_id": 3, "origin": None}])
    assert rows(quality.declared_counts(r, "routes").filter("row_count > 0")) == [
        ("routes", "origin", "missing", 1)
    ]
    assert rows(quality.declared_duplicates(r, "routes"), "key_columns", "row_count") == [
        ("carrier_code, origin, destination", 2)
    ]
    log = table(spark, "sla_breach_log", [{"resolved": 5}])
    assert rows(quality.declared_counts(log, "sla_breach_log").filter("row_count > 0")) == [
        ("sla_breach_log", "resolved", "outside domain", 1)
    ]


def test_null_and_domain_counts(spark):
    odd = [{}, {"cancelled": 7, "flight_number": "LONGNUMBER"}, {"cancelled": None}]
    f = table(spark, "flights", odd)
    got = quality.null_domain_counts(
        f, "flights", ["cancelled"], {"cancelled": [0, 1]}, {"flight_number": 8}
    )
    assert rows(got, "problem", "row_count") == [
        ("missing", 1), ("outside domain", 1), ("too long", 1),
    ]


def test_above_mean_uses_all_dates(spark):
    f = table(
        spark,
        "flights",
        [
            {"arr_delay_mins": 100, "flight_date": days(50)},
            {"arr_delay_mins": 40},
            {"arr_delay_mins": 60},
            {"arr_delay_mins": None},
            {"route_id": 2, "arr_delay_mins": 5},
            {"route_id": 2, "arr_delay_mins": 9},
        ],
    )
    for fn in (selection.above_route_avg_join, selection.above_route_avg_corr):
        assert rows(fn(f, days(10))) == [(6, 9)]


def test_drift_and_reconciliation(spark):
    f = table(
        spark,
        "flights",
        [
            {"arr_delay_mins": 10, "dep_delay_mins": 12, "carrier_delay": 10},
            {"arr_delay_mins": 10, "dep_delay_mins": 5, "carrier_delay": 7},
            {"arr_delay_mins": -5, "dep_delay_mins": 0, "cancelled": 1},
        ],
    )
    assert rows(diagnostics.dep_arr_drift(f)) == [(-5, 2, -1.5)]
    assert rows(diagnostics.cause_reconciliation(f)) == [(2, 1, -3)]
