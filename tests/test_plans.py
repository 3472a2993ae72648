"""What the physical plans must look like whatever the size of the tables."""

import contextlib
import io
import re

import pytest

from slotwise.plans import registry as q
from slotwise.sources.star import open_star

SMALL = "/root/testdata/sf0.001"

REDUCED_FIRST = [
    "carrier_ranking",
    "monthly_trend",
    "root_cause",
    "departure_bottlenecks",
    "delay_propagation",
    "od_matrix",
    "time_of_day",
    "carrier_monthly_scorecard",
    "route_performance",
    "monthly_scorecard",
    "dominant_cause",
    "flag_breaches",
    "flag_breaches_carrier_rules",
    "breach_backfill",
    "carriers_with_severe_in",
    "carriers_with_severe_exists",
    "orphans",
    "delay_bands",
]


@pytest.fixture(scope="module")
def star(spark):
    loaded = open_star(spark, SMALL)
    assert loaded.breach_log.count()
    return loaded


@contextlib.contextmanager
def setting(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().splitlines()


def depth(line):
    return len(re.match(r"[ :+\-]*", line).group())


def operators_above(lines, index):
    """Operator names from a line up to the root."""
    level = depth(lines[index])
    for line in reversed(lines[:index]):
        if line.strip() and depth(line) < level:
            level = depth(line)
            yield line.strip(" :+-")


def fact_scans(lines):
    """Lines that scan the facts, known by their partition column."""
    return [n for n, line in enumerate(lines) if "FileScan" in line and "flight_month" in line]


@pytest.mark.parametrize("name", REDUCED_FIRST)
def test_facts_are_aggregated_before_any_exchange(spark, star, name):
    """With every broadcast forbidden, as when no table is small, facts still do not move."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        lines = plan(getattr(q, name)(star))
    scans = fact_scans(lines)
    assert scans
    for n in scans:
        for operator in operators_above(lines, n):
            if operator.startswith("HashAggregate"):
                break
            assert not operator.startswith(("Exchange", "SortMergeJoin", "BroadcastExchange"))
        else:
            raise AssertionError("no aggregation above the facts")


@pytest.mark.parametrize("name", list(q._QUERIES))
def test_no_cartesian_product_and_no_broadcast_of_unsized_input(spark, star, name):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        text = "\n".join(plan(q._QUERIES[name](star)))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BroadcastExchange" not in text
    assert "Python" not in text


def formatted_scan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    blocks = out.getvalue().split("\n\n")
    return next(b for b in blocks if "Scan parquet" in b and "/flights" in b and "Location" in b)


def test_date_range_prunes_months_and_columns(spark, star):
    scan = formatted_scan(q.date_range_summary(star))
    assert re.search(r"PartitionFilters: \[.*flight_month.*>= 202301.*<= 202303", scan)
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(flight_date,2023-01-01\)", scan)
    assert "ReadSchema: struct<flight_date:date,arr_delay_mins:int>" in scan


def test_breach_window_prunes_months(spark, star):
    scan = formatted_scan(q.flag_breaches(star))
    assert re.search(r"PartitionFilters: \[.*flight_month.*>= 202307", scan)
    assert "EqualTo(cancelled,0)" in scan


def test_month_of_a_scorecard_is_one_partition(spark, star):
    scan = formatted_scan(q.monthly_scorecard(star))
    assert re.search(r"flight_month.*>= 202303.*flight_month.*<= 202303", scan)


def test_route_slice_reads_three_columns(spark, star):
    scan = formatted_scan(q.route_slice(star))
    assert "ReadSchema: struct<route_id:int,flight_date:date,arr_delay_mins:int>" in scan
    assert "EqualTo(route_id,42)" in scan


@pytest.mark.parametrize("name", ["departure_bottlenecks", "delay_propagation", "od_matrix"])
def test_top_k_is_not_a_full_sort(spark, star, name):
    text = "\n".join(plan(getattr(q, name)(star)))
    assert "TakeOrderedAndProject" in text


def test_details_leave_the_facts_in_place(spark, star):
    lines = plan(q.flight_details(star))
    n = fact_scans(lines)[0]
    assert not any(op.startswith("Exchange") for op in operators_above(lines, n))


def test_group_means_are_broadcast_by_their_real_size(spark, star):
    lines = plan(q.above_route_avg_join(star))
    n = fact_scans(lines)[0]
    assert not any("Exchange" in op for op in operators_above(lines, n))


def test_correlated_mean_is_aggregated_over_the_facts(spark, star):
    lines = plan(q.above_route_avg_corr(star))
    first, second = fact_scans(lines)
    above = [list(operators_above(lines, n)) for n in (first, second)]
    assert any(op.startswith("HashAggregate") and "avg" in op for op in above[1])
    assert any("Join" in op for op in above[0])


@pytest.mark.parametrize("name", ["audit_updates", "insert_if_absent"])
def test_keyed_tables_are_not_sorted_to_be_aggregated(spark, star, name):
    assert "SortAggregate" not in "\n".join(plan(getattr(q, name)(star)))


def test_first_of_a_key_is_limited_before_the_shuffle(spark, star):
    lines = plan(q.insert_if_absent(star))
    assert any("WindowGroupLimit" in line and "Partial" in line for line in lines)


def test_backfill_copies_no_counter_into_windows(spark, star):
    """Rows before the running totals: one for a route and day, and one for each evaluation."""
    text = "\n".join(plan(q.breach_backfill_daily(star)))
    assert "RangeFrame" in text
    counted = star.flights.select("route_id", "flight_date").distinct().count()
    marks = star.flights.select("route_id").distinct().count() * len(q.DAILY)
    assert q.breach_backfill_daily(star).count() <= counted + marks
