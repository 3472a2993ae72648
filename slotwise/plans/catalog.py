"""The star under its table and view names, for queries written in SQL."""

from pyspark.sql import DataFrame, SparkSession

from slotwise.operators import views


def register(
    f: DataFrame,
    r: DataFrame,
    a: DataFrame,
    ap: DataFrame,
    rules: DataFrame,
    breach_log: DataFrame,
    audit_log: DataFrame | None = None,
) -> None:
    """Temporary views of the tables and of the three projections over them.

    Nothing is computed here: each query over a view is optimised as a whole.
    """
    tables = {
        "flights": f,
        "routes": r,
        "airlines": a,
        "airports": ap,
        "sla_rules": rules,
        "sla_breach_log": breach_log,
        "audit_log": audit_log,
        "vw_flight_details": views.flight_details(f, r, a, ap),
        "vw_carrier_monthly_scorecard": views.carrier_monthly_scorecard(f, r, a, ap),
        "vw_route_performance": views.route_performance(f, r),
    }
    for name, df in tables.items():
        if df is not None:
            df.createOrReplaceTempView(name)


def register_reports(spark: SparkSession) -> None:
    """Reports as table functions over the views of :func:`register`, for users who write SQL only.

    Arguments are typed and the last ones may be left out. ``flights`` must carry its month.
    """
    for name, (takes, gives, text) in REPORTS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {text}"
        )


#: What each function takes, gives and selects. Facts come down to routes before they meet a dimension.
REPORTS = {
    "carrier_delays": (
        "first_day DATE, last_day DATE, only_carrier STRING DEFAULT NULL, late_mins INT DEFAULT 15",
        "carrier_code STRING, total_flights BIGINT, delayed_flights BIGINT, delay_rate_pct DOUBLE",
        """SELECT carrier_code, sum(n), sum(late),
                  CAST(round(CAST(100.0D * sum(late) / sum(n) AS DECIMAL(18, 6)), 2) AS DOUBLE)
           FROM (SELECT route_id, count(*) AS n, sum(is_late) AS late
                 FROM (SELECT route_id, CASE WHEN arr_delay_mins >= late_mins THEN 1 ELSE 0 END AS is_late
                       FROM flights
                       WHERE cancelled = 0 AND flight_date BETWEEN first_day AND last_day
                         AND flight_month BETWEEN year(first_day) * 100 + month(first_day)
                                              AND year(last_day) * 100 + month(last_day))
                 GROUP BY route_id)
           JOIN routes USING (route_id)
           WHERE only_carrier IS NULL OR carrier_code = only_carrier
           GROUP BY carrier_code""",
    ),
    "route_days": (
        "which INT, since DATE DEFAULT DATE'1970-01-01'",
        "flight_date DATE, total_flights BIGINT, arr_delay_mins BIGINT",
        """SELECT flight_date, count(*), sum(arr_delay_mins) FROM flights
           WHERE route_id = which AND flight_date >= since
             AND flight_month >= year(since) * 100 + month(since)
           GROUP BY flight_date""",
    ),
}
