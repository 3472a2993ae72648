"""Times the headline queries and prints one JSON line.

The star is loaded first and timed on its own, as is the first run of the breach log. Each
query then runs once cold and twice warm with its whole result produced and thrown away;
its figure is the median of the three.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from slotwise.plans.registry import all_queries
from slotwise.session import SETTINGS
from slotwise.sources.star import open_star

HEADLINE = [
    "carrier_ranking",
    "monthly_trend",
    "root_cause",
    "departure_bottlenecks",
    "delay_propagation",
    "od_matrix",
    "time_of_day",
    "active_breaches",
    "chronic_offenders",
    "sla_compliance",
    "flight_details",
    "carrier_monthly_scorecard",
    "route_performance",
    "monthly_scorecard",
    "dominant_cause",
    "flag_breaches",
    "breach_backfill",
    "date_range_summary",
    "route_slice",
    "carriers_with_severe_exists",
    "above_route_avg_join",
    "above_route_avg_corr",
    "audit_inserts",
    "audit_updates",
    "reject_cause_sum",
    "delay_bands",
    "append_facts",
    "stream_counters",
]
RUNS = 3


def produce(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    begin = time.perf_counter()
    action()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("slotwise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    loading = timed(lambda: open_star(spark, sf_dir).flights.count())
    logging = timed(lambda: open_star(spark, sf_dir).breach_log.count())
    cold, median = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        runs = [timed(lambda: produce(queries[name](spark, sf_dir))) for _ in range(RUNS)]
        cold[name], median[name] = round(runs[0], 3), round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians of 3",
                "value": round(sum(median.values()), 3),
                "unit": "sec",
                "queries": median,
                "cold": cold,
                "load_sec": round(loading, 3),
                "breach_log_sec": round(logging, 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
