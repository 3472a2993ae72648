"""Every query against its SQL, and the published figures of the test mapping."""

import compare
import pytest
from frames import rows
from pyspark.sql import functions as F

import __spark_entry__ as driver
from slotwise.plans import registry as q
from slotwise.sources.star import open_star

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ORACLE = driver.oracle_sql()
QUERIES = q.all_queries()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SMALL)


@pytest.fixture(scope="module")
def star(spark):
    return open_star(spark, MEDIUM)


def test_every_query_has_its_sql():
    assert QUERIES.keys() <= driver.queries().keys()
    assert QUERIES.keys() <= ORACLE.keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SMALL)
    assert compare.difference(got, con, ORACLE[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 6


def test_adapter_figures(star):
    figures = star.flights.join(star.routes, "route_id").agg(
        F.count(F.lit(1)),
        *[F.sum(c) for c in ("arr_delay_mins", "dep_delay_mins", "cancelled", "scheduled_dep",
                             "late_aircraft_delay", "route_id", "scheduled_mins", "actual_dep")],
        F.count_if(F.col("arr_delay_mins") >= 15),
        F.count_if(F.col("arr_delay_mins") >= 60),
        F.count_distinct("flight_id"),
    )
    assert rows(figures) == [
        (60000, 1480283, 1730300, 1247, 77892200, 446481, 112491382, 15589332, 77994900,
         16186, 6617, 60000)
    ]


def test_breach_figures(star):
    rate = F.col("delay_rate_pct")
    figures = star.breach_log.agg(
        F.count(F.lit(1)), F.count_if(rate >= 30), F.count_if((rate >= 20) & (rate < 30))
    )
    assert rows(figures) == [(56893, 29960, 20522)]
    patterns = dict(rows(q.chronic_offenders(star).groupBy("pattern").count()))
    assert patterns == {"CHRONIC": 2217, "RECURRING": 260}


def test_both_forms_of_a_selection_agree(star):
    join, corr = q.above_route_avg_join(star), q.above_route_avg_corr(star)
    assert join.count() == 9657
    assert join.exceptAll(corr).count() == corr.exceptAll(join).count() == 0
    assert sorted(rows(q.carriers_with_severe_in(star))) == sorted(
        rows(q.carriers_with_severe_exists(star))
    )


def test_cause_shares_add_up(star):
    shares = q.root_cause_long(star).groupBy("carrier_name").agg(F.sum("percentage"))
    assert all(abs(total - 100) <= 0.3 for _, total in rows(shares))


def test_streams_equal_batches(star):
    daily = q.stream_daily_counts(star).drop("closed")
    assert sorted(rows(q.stream_counters(star))) == sorted(rows(daily))
