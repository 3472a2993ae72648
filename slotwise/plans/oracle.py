"""The same results as plain SQL over the given tables, for an independent engine.

The text shares nothing with the operators but the fixed values: it joins first and aggregates
once, and finds breaches with a range join over the facts.
"""

from slotwise.config import CAUSES
from slotwise.plans import registry as q
from slotwise.sources.exports import DISPLAY, RENAMED
from slotwise.sources.schemas import DOMAINS, LENGTHS, TABLES
from slotwise.sources.star import AS_OF, RULE_CHANGES, RULES, WEEKLY


def fixed(value: str, digits: int) -> str:
    return f"round(({value})::DOUBLE::DECIMAL(18,6), {digits})::DOUBLE"


def div(part: str, whole: str) -> str:
    return f"(({part})::DOUBLE / nullif({whole}, 0)::DOUBLE)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return fixed(div(f"100 * ({part})", whole), digits)


def avg(column: str, digits: int = 2) -> str:
    return fixed(div(f"sum({column})", f"count({column})"), digits)


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def day(value) -> str:
    return f"DATE '{value}'"


_STAR = """
moved AS MATERIALIZED (
    SELECT p_type AS carrier_code, s_nationkey AS o, c_nationkey AS d,
           l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln,
           l_quantity::INTEGER AS qty, l_shipdate::DATE AS shipped,
           abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS lag,
           (7 * l_orderkey + 3 * l_partkey + 11 * l_linenumber) % 100 AS h,
           CASE WHEN (l_orderkey + l_partkey) % 50 = 0 THEN 1 ELSE 0 END AS gone
    FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey
    JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey
    JOIN customer ON c_custkey = o_custkey
),
routes AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY carrier_code, o, d))::INTEGER AS route_id, carrier_code,
           o::VARCHAR AS origin, d::VARCHAR AS destination, o, d,
           (50 + ((o * 25 + d) * 7) % 420)::INTEGER AS scheduled_mins
    FROM (SELECT DISTINCT carrier_code, o, d FROM moved)
),
arrived AS (
    SELECT *, (CASE WHEN gone = 1 THEN 0
                    WHEN h < 30 THEN -1 - lag % 20
                    WHEN h < 72 THEN lag % 15
                    WHEN h < 87 THEN 15 + lag % 31
                    WHEN h < 95 THEN 46 + lag % 75
                    ELSE 121 + lag % 360 END)::INTEGER AS arr,
           (100 * (6 + (pk + sk) % 15))::INTEGER AS sched
    FROM moved
),
causes AS (
    SELECT *, greatest(arr, 0) AS late,
           (CASE WHEN gone = 1 THEN 0 ELSE arr + qty % 16 - 3 END)::INTEGER AS dep
    FROM arrived
),
flights AS MATERIALIZED (
    SELECT ((((ok * 1000003 + pk) % 9007199254740881) * 1009 + sk) % 9007199254740881) * 8 + ln
               AS flight_id,
           route_id,
           DATE '2023-01-01' + (date_diff('day', DATE '1995-01-01', shipped) % 365)::INTEGER
               AS flight_date,
           'M' || (ok % 900 + 100)::VARCHAR AS flight_number,
           sched AS scheduled_dep,
           CASE WHEN gone = 0 THEN sched + dep END AS actual_dep,
           CASE WHEN gone = 0 THEN sched + 120 + arr END AS actual_arr,
           dep AS dep_delay_mins, arr AS arr_delay_mins, gone AS cancelled, 0 AS diverted,
           (late * 35) // 100 AS carrier_delay, (late * 20) // 100 AS weather_delay,
           (late * 20) // 100 AS nas_delay, (late * 2) // 100 AS security_delay,
           late - (late * 35) // 100 - 2 * ((late * 20) // 100) - (late * 2) // 100
               AS late_aircraft_delay,
           (300 + (pk * 7 + sk) % 2501)::INTEGER AS distance_miles
    FROM causes JOIN routes USING (carrier_code, o, d)
),
airlines AS (
    SELECT DISTINCT p_type AS carrier_code, p_type AS carrier_name FROM part
),
airports AS (
    SELECT n_nationkey::VARCHAR AS airport_code, n_name AS airport_name, n_name AS city,
           r_name AS state, (n_nationkey + 25)::DOUBLE AS latitude,
           (-70 - 2 * n_nationkey)::DOUBLE AS longitude
    FROM nation JOIN region ON r_regionkey = n_regionkey
),
f AS (
    SELECT * FROM flights JOIN routes USING (route_id) JOIN airlines USING (carrier_code)
),
flown AS (SELECT * FROM f WHERE cancelled = 0)"""

_RULES = "rules(rule_id, carrier_code, max_rate, min_flights, window_days) AS (VALUES {})".format(
    ", ".join(
        "({}, {}, {}, {}, {})".format(
            r["rule_id"],
            f"'{r['carrier_code']}'" if r["carrier_code"] else "NULL",
            r["max_delay_rate_pct"],
            r["min_flights_window"],
            r["window_days"],
        )
        for r in RULES
    )
)

_VERSIONS = (
    "changes(rule_id, carrier_code, max_rate, min_flights, window_days, updated_at, updated_by) AS (VALUES "
    + ", ".join(
        "({}, {}, {}, {}, {}, TIMESTAMP '{}', '{}')".format(
            r["rule_id"],
            f"'{r['carrier_code']}'" if r["carrier_code"] else "NULL",
            r["max_delay_rate_pct"],
            r["min_flights_window"],
            r["window_days"],
            r["updated_at"],
            r["updated_by"],
        )
        for r in RULE_CHANGES
    )
    + """),
versions AS MATERIALIZED (
    SELECT *, (row_number() OVER h)::INTEGER AS version, lead(valid_from) OVER h - 1 AS valid_to
    FROM (SELECT *, updated_at::DATE AS valid_from FROM changes
          QUALIFY row_number() OVER (PARTITION BY rule_id, updated_at::DATE ORDER BY updated_at DESC) = 1)
    WINDOW h AS (PARTITION BY rule_id ORDER BY valid_from))"""
)

_DATES = "dates(breach_date) AS (VALUES {})".format(", ".join(f"({day(d)})" for d in WEEKLY))


def _evaluated(dates: str, rule_join: str) -> str:
    """Rows and late rows per route, date and rule, straight from the facts."""
    return f"""
    SELECT route_id, breach_date, rule_id, max_rate,
           {pct(n_if("arr_delay_mins >= 15"), "count(*)")} AS delay_rate_pct,
           count(*) AS total_flights,
           {n_if("arr_delay_mins >= 15")} AS delayed_flights
    FROM flown JOIN {dates} ON flight_date <= breach_date
    JOIN rules ON {rule_join} AND flight_date >= breach_date - window_days::INTEGER
    GROUP BY route_id, breach_date, rule_id, max_rate, min_flights
    HAVING count(*) >= min_flights"""


_BREACHES = f"""
found AS MATERIALIZED (
    SELECT * FROM ({_evaluated("dates", "rule_id = 1")}) WHERE delay_rate_pct > max_rate
),
breach_log AS MATERIALIZED (
    SELECT n AS breach_id, route_id, breach_date, delay_rate_pct, total_flights, delayed_flights,
           rule_id, CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS resolved,
           breach_date::TIMESTAMP + to_hours(n % 24) AS created_at
    FROM (SELECT *, row_number() OVER (ORDER BY breach_date, route_id) AS n FROM found)
),
logged AS (
    SELECT * FROM breach_log JOIN routes USING (route_id) JOIN airlines USING (carrier_code)
)"""

_BREACH_COLUMNS = "route_id, breach_date, delay_rate_pct, total_flights, delayed_flights, rule_id"


def sql(body: str, *ctes: str) -> str:
    parts = [_STAR, _RULES, _DATES]
    text = body + "".join(ctes)
    if "breach_log" in text or "logged" in text or "found" in text:
        parts.append(_BREACHES)
    return "WITH " + ",\n".join([*parts, *ctes]) + "\n" + body


_SHARE = fixed(div("delayed", "total_flights"), 4)


def _ranking(where: str) -> str:
    return f"""ranking AS (
    SELECT (rank() OVER (ORDER BY {_SHARE}))::INTEGER AS on_time_rank,
           * EXCLUDE (gone),
           {pct("delayed", "total_flights")} AS delay_rate_pct,
           {pct("gone", "total_flights")} AS cancel_rate_pct,
           {fixed(f"100 * percent_rank() OVER (ORDER BY {_SHARE})", 1)} AS percentile_rank
    FROM (SELECT carrier_code, carrier_name, count(*) AS total_flights,
                 {n_if("arr_delay_mins >= 15")} AS delayed,
                 {n_if("arr_delay_mins >= 60")} AS severe_delays,
                 sum(cancelled)::BIGINT AS gone,
                 {avg("arr_delay_mins")} AS avg_arr_delay_mins,
                 {avg("CASE WHEN arr_delay_mins >= 15 THEN arr_delay_mins END")}
                     AS avg_delay_when_late
          FROM flown WHERE {where} GROUP BY ALL)
)"""


_ALL_YEAR = _ranking(f"flight_date >= {day(AS_OF)} - INTERVAL 12 MONTH")

_ROW_CAUSES = " + ".join(f"{c}_delay" for c in CAUSES)
_SHARES = ", ".join(
    pct(f"total_{c}_mins", "grand_total_delay_mins", 1) + f" AS pct_{c}" for c in CAUSES
)
_ROOT = f"""root AS (
    SELECT *, {_SHARES}
    FROM (SELECT carrier_code, carrier_name,
                 {", ".join(f"sum({c}_delay)::BIGINT AS total_{c}_mins" for c in CAUSES)},
                 sum({_ROW_CAUSES})::BIGINT AS grand_total_delay_mins
          FROM flown GROUP BY ALL)
)"""
_ROOT_LONG = "long AS ({})".format(
    " UNION ALL ".join(
        f"SELECT carrier_name, '{label}' AS cause, pct_{c} AS percentage FROM root"
        for c, label in CAUSES.items()
    )
)

_WORST = f"""worst AS (
    SELECT (dense_rank() OVER (ORDER BY avg_dep_delay DESC))::INTEGER AS delay_rank, *
    FROM (SELECT airport_code, airport_name, city, state, latitude, longitude,
                 count(*) AS total_departures, {avg("dep_delay_mins")} AS avg_dep_delay,
                 {pct(n_if("dep_delay_mins >= 15"), "count(*)")} AS dep_delay_rate_pct,
                 max(dep_delay_mins) AS worst_dep_delay,
                 {n_if("dep_delay_mins >= 60")} AS extreme_delays
          FROM flown JOIN airports ON airport_code = origin
          GROUP BY ALL HAVING count(*) >= 50)
    ORDER BY avg_dep_delay DESC, airport_code LIMIT 20
)"""

_PAIRS = f"""pairs AS (
    SELECT origin, b.city AS origin_city, destination, e.city AS dest_city, count(*) AS flights,
           {avg("arr_delay_mins", 1)} AS avg_arr_delay,
           {pct(n_if("arr_delay_mins >= 15"), "count(*)", 1)} AS delay_rate_pct,
           {fixed(div("sum(arr_delay_mins)", "count(arr_delay_mins)")
                  + " - " + div("sum(scheduled_mins)", "count(*)") + " * 0.05::DOUBLE", 1)}
               AS delay_beyond_buffer
    FROM flown JOIN airports b ON b.airport_code = origin
    JOIN airports e ON e.airport_code = destination
    GROUP BY ALL HAVING count(*) >= 20
    ORDER BY avg_arr_delay DESC, origin, destination LIMIT 25
)"""

_SLOTS = f"""slots AS (
    SELECT origin AS airport_code,
           CASE WHEN scheduled_dep BETWEEN 0 AND 559 THEN '12AM-6AM'
                WHEN scheduled_dep BETWEEN 600 AND 959 THEN '6AM-10AM'
                WHEN scheduled_dep BETWEEN 1000 AND 1359 THEN '10AM-2PM'
                WHEN scheduled_dep BETWEEN 1400 AND 1759 THEN '2PM-6PM'
                ELSE '6PM-12AM' END AS time_slot,
           count(*) AS flights, {avg("dep_delay_mins")} AS avg_dep_delay,
           {pct(n_if("dep_delay_mins >= 15"), "count(*)")} AS delay_rate_pct
    FROM flown GROUP BY ALL
)"""


def _active(limit: str, where: str, codes: str = "") -> str:
    return f"""active AS (
    SELECT breach_id, breach_date, origin || ' → ' || destination AS route, carrier_name, {codes}
           total_flights, delayed_flights, delay_rate_pct, {limit} AS sla_threshold_pct,
           {fixed(f"delay_rate_pct - {limit}", 2)} AS overage_pct,
           CASE WHEN delay_rate_pct >= 30 THEN 'CRITICAL'
                WHEN delay_rate_pct >= 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
           date_diff('day', breach_date, {day(AS_OF)})::INTEGER AS days_open
    FROM logged JOIN (SELECT rule_id, max_rate FROM rules) USING (rule_id)
    WHERE resolved = 0 AND {where}
)"""


_ACTIVE = _active("max_rate::DOUBLE", "true")


def _compliance(breach_filter: str, join_filter: str, codes: str, status: str) -> str:
    return f"""
    SELECT *, {pct("compliant_routes", "total_routes", 1)} AS sla_compliance_pct {status}
    FROM (SELECT carrier_name, {codes} count(route_id) AS total_routes,
                 count(hit) AS breached_routes,
                 count(route_id) - count(hit) AS compliant_routes
          FROM routes JOIN airlines USING (carrier_code)
          LEFT JOIN (SELECT DISTINCT route_id AS hit FROM breach_log
                     WHERE breach_date >= {day(AS_OF)} - 30 AND {breach_filter})
            ON hit = route_id AND {join_filter}
          GROUP BY ALL)"""


_CARD = f"""card AS (
    SELECT carrier_code, carrier_name, year(flight_date)::INTEGER AS yr,
           month(flight_date)::INTEGER AS mo, count(*) AS total_flights,
           sum(cancelled)::BIGINT AS cancelled_flights,
           {n_if("arr_delay_mins >= 15")} AS delayed_flights,
           {n_if("arr_delay_mins >= 60")} AS severe_delays,
           {avg("arr_delay_mins")} AS avg_arr_delay,
           {avg("CASE WHEN arr_delay_mins >= 15 THEN arr_delay_mins END")} AS avg_delay_when_late,
           {pct(n_if("arr_delay_mins >= 15"), "count(*)")} AS delay_rate_pct,
           {pct("sum(cancelled)", "count(*)")} AS cancel_rate_pct,
           {pct(n_if("arr_delay_mins < 0"), "count(*)")} AS early_rate_pct
    FROM f GROUP BY ALL
)"""
_CARD_RANKED = """ranked AS (
    SELECT * EXCLUDE (severe_delays, avg_delay_when_late),
           (rank() OVER (PARTITION BY yr, mo ORDER BY delay_rate_pct))::INTEGER AS on_time_rank,
           count(*) OVER (PARTITION BY yr, mo) AS total_carriers_evaluated
    FROM card WHERE yr = 2023 AND mo = 3 {}
)"""

_OLD = """earlier AS (
    SELECT * REPLACE (arr_delay_mins - CASE WHEN scheduled_dep >= 1800 THEN 5 ELSE 0 END
                      AS arr_delay_mins)
    FROM flights WHERE flight_date < DATE '2023-12-01'
)"""
_INSERT_JSON = """json_object('flight_date', flight_date::VARCHAR, 'flight_number', flight_number,
    'route_id', route_id, 'dep_delay', dep_delay_mins, 'arr_delay', arr_delay_mins,
    'cancelled', cancelled)::VARCHAR"""


def _update_json(alias: str) -> str:
    members = {"arr_delay": "arr_delay_mins", "dep_delay": "dep_delay_mins",
               "cancelled": "cancelled", "diverted": "diverted"}
    return "json_object({})::VARCHAR".format(
        ", ".join(f"'{name}', {alias}.{column}" for name, column in members.items())
    )


def _audit(table: str, operation: str, record: str, old: str, new: str, source: str) -> str:
    return f"""
    SELECT '{table}' AS table_name, '{operation}' AS operation, {record}::BIGINT AS record_id,
           {old} AS old_values, {new} AS new_values FROM {source}"""


_LATE_AIRCRAFT = {c: div(f"sum({c}_delay)", f"count({c}_delay)") for c in CAUSES}
_CONTENDERS = "greatest({})".format(
    ", ".join(f"m_{c}" for c in ("carrier", "weather", "nas", "late_aircraft"))
)
_REJECT = f"{_ROW_CAUSES} > arr_delay_mins + 10"


def _orphan(child: str, column: str, parent: str, key: str) -> str:
    return f"""
    SELECT '{child}' AS child_table, '{column}' AS child_column, '{parent}' AS parent_table,
           {column}::VARCHAR AS missing_key, count(*) AS row_count
    FROM {child.replace("sla_breach_log", "breach_log").replace("sla_rules", "rules")} c
    WHERE {column} IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM {parent.replace("sla_rules", "rules").replace("airports", "elsewhere")} p
        WHERE p.{key} = c.{column})
    GROUP BY {column}"""


def _null_counts() -> str:
    required = ["flight_id", "route_id", "flight_date", "flight_number", "scheduled_dep",
                "actual_dep", "actual_arr"]
    checks = [(c, "missing", f"{c} IS NULL") for c in required]
    checks.append(("scheduled_arr", "missing", "scheduled_dep IS NULL"))
    checks += [
        ("cancelled", "outside domain", "cancelled NOT IN (0, 1)"),
        ("diverted", "outside domain", "diverted NOT IN (0, 1)"),
        ("scheduled_dep", "outside domain",
         f"scheduled_dep NOT IN ({', '.join(str(t) for t in range(600, 1900, 100))})"),
        ("flight_number", "too long", "length(flight_number) > 8"),
    ]
    return " UNION ALL ".join(
        f"SELECT 'flights' AS table_name, '{c}' AS column_name, '{p}' AS problem, "
        f"{n_if(test)} AS row_count FROM flights"
        for c, p, test in checks
    )


_COUNTERS = f"""
    SELECT route_id, flight_date, count(*) AS total_flights,
           {n_if("arr_delay_mins >= 15")} AS delayed_flights
    FROM flown GROUP BY route_id, flight_date"""


_GOOD = f"good AS (SELECT * FROM flights WHERE NOT ({_REJECT}))"
_INGESTED = f"""SELECT 'facts' AS outcome, count(DISTINCT flight_id) AS row_count FROM good
        UNION ALL SELECT 'audit', count(DISTINCT flight_id) FROM good
        UNION ALL SELECT 'missing flight_number', count(*) FROM flights
            WHERE flight_id % 90 = 1 HAVING count(*) > 0
        UNION ALL SELECT 'missing flight_date', count(*) FROM flights
            WHERE flight_id % 110 = 2 HAVING count(*) > 0
        UNION ALL SELECT 'second row of a key', sum(n)::BIGINT FROM (
            SELECT count(*) - count(DISTINCT flight_id)
                   + count(*) FILTER (WHERE flight_id % 50 = 0) AS n FROM good
            UNION ALL SELECT count(*) - count(DISTINCT flight_id) FROM good
            WHERE flight_id % 70 = 3) HAVING sum(n) > 0
        UNION ALL SELECT 'key is stored already', count(DISTINCT flight_id) FROM good
            WHERE flight_id % 70 = 3 HAVING count(*) > 0
        UNION ALL SELECT 'cause minutes exceed arrival delay', sum(1
            + (flight_id % 50 = 0)::INTEGER + (flight_id % 70 = 3)::INTEGER)::BIGINT
            FROM flights WHERE {_REJECT} HAVING count(*) > 0"""


def all_sql() -> dict[str, str]:
    today = f"(SELECT {day(AS_OF)} AS breach_date)"
    found = {
        "carrier_ranking": sql("SELECT * FROM ranking", _ALL_YEAR),
        "carrier_ranking_one_carrier": sql(
            "SELECT * FROM ranking",
            _ranking(
                f"flight_date BETWEEN {day(q.SINCE)} AND {day(AS_OF)} "
                f"AND carrier_code = '{q.CARRIER}'"
            ),
        ),
        "carrier_kpis": sql(
            f"""SELECT sum(total_flights)::BIGINT AS total_flights,
                       {avg("delay_rate_pct", 1)} AS avg_delay_rate_pct,
                       sum(severe_delays)::BIGINT AS severe_delays FROM ranking""",
            _ALL_YEAR,
        ),
        "monthly_trend": sql(
            f"""SELECT *, {fixed("delay_rate_pct - prev_month_rate", 2)} AS mom_change_pct,
                       CASE WHEN delay_rate_pct > prev_month_rate THEN 'Worsening'
                            WHEN delay_rate_pct < prev_month_rate THEN 'Improving'
                            ELSE 'Flat' END AS trend
                FROM (SELECT *, lag(delay_rate_pct) OVER (PARTITION BY carrier_code
                                                          ORDER BY month_label) AS prev_month_rate
                      FROM (SELECT carrier_code, carrier_name,
                                   strftime(flight_date, '%Y-%m') AS month_label,
                                   {pct(n_if("arr_delay_mins >= 15"), "count(*)")} AS delay_rate_pct
                            FROM flown GROUP BY ALL))"""
        ),
        "root_cause": sql("SELECT * FROM root", _ROOT),
        "root_cause_long": sql("SELECT * FROM long", _ROOT, _ROOT_LONG),
        "cause_mix": sql(
            f"SELECT cause, {fixed('sum(percentage)', 1)} AS percentage FROM long GROUP BY cause",
            _ROOT,
            _ROOT_LONG,
        ),
        "departure_bottlenecks": sql("SELECT * FROM worst", _WORST),
        "top10_by_rate_of_worst": sql(
            """SELECT airport_code, avg_dep_delay, dep_delay_rate_pct FROM worst
               ORDER BY avg_dep_delay DESC, airport_code LIMIT 10""",
            _WORST,
        ),
        "delay_propagation": sql(
            f"""SELECT airport_code, city, count(*) AS flights_affected,
                       {avg("late_aircraft_delay")} AS avg_late_aircraft_delay,
                       {avg("carrier_delay")} AS avg_carrier_delay,
                       {avg("nas_delay")} AS avg_nas_delay,
                       {fixed(div(div("sum(late_aircraft_delay)", "count(late_aircraft_delay)"),
                                  div("sum(arr_delay_mins)", "count(arr_delay_mins)")) + " * 100", 1)}
                           AS propagation_ratio_pct
                FROM flown JOIN airports ON airport_code = origin
                WHERE late_aircraft_delay > 0
                GROUP BY ALL HAVING count(*) >= 30
                ORDER BY propagation_ratio_pct DESC, airport_code LIMIT 15"""
        ),
        "od_matrix": sql("SELECT * FROM pairs", _PAIRS),
        "od_pivot": sql(
            "SELECT origin, "
            + ", ".join(
                f"max(delay_rate_pct) FILTER (WHERE destination = '{d}') AS \"{d}\"" for d in q.NATIONS
            )
            + " FROM pairs GROUP BY origin",
            _PAIRS,
        ),
        "time_of_day": sql("SELECT * FROM slots", _SLOTS),
        "tod_pivot": sql(
            "SELECT airport_code, "
            + ", ".join(
                f"max(avg_dep_delay) FILTER (WHERE time_slot = '{slot}') AS \"{slot}\""
                for slot in ("6AM-10AM", "10AM-2PM", "2PM-6PM", "6PM-12AM")
            )
            + " FROM slots GROUP BY airport_code",
            _SLOTS,
        ),
        "active_breaches": sql("SELECT * FROM active", _ACTIVE),
        "active_breaches_threshold": sql(
            "SELECT * FROM active",
            _active(
                f"{q.THRESHOLD}::DOUBLE",
                f"delay_rate_pct > {q.THRESHOLD} AND carrier_code = '{q.CARRIER}'",
                "carrier_code,",
            ),
        ),
        "breach_kpis": sql(
            f"""SELECT count(*) AS active_breaches, {n_if("severity = 'CRITICAL'")} AS critical,
                       {fixed(div("sum(overage_pct::DECIMAL(18,2))", "count(*)"), 1)} AS avg_overage_pct
                FROM active""",
            _ACTIVE,
        ),
        "severity_distribution": sql(
            "SELECT severity, count(*) AS \"count\" FROM active GROUP BY severity", _ACTIVE
        ),
        "chronic_offenders": sql(
            f"""SELECT breach_count, route, carrier_name, carrier_code, avg_delay_rate,
                       peak_delay_rate, first_breach, latest_breach,
                       date_diff('day', first_breach, latest_breach)::INTEGER AS breach_span_days,
                       CASE WHEN breach_count >= 6 THEN 'CHRONIC'
                            WHEN breach_count >= 3 THEN 'RECURRING'
                            ELSE 'INTERMITTENT' END AS pattern
                FROM (SELECT route_id, origin || ' → ' || destination AS route, carrier_name,
                             carrier_code, count(*) AS breach_count,
                             {fixed(div("sum(delay_rate_pct::DECIMAL(18,2))", "count(*)"), 2)} AS avg_delay_rate,
                             max(delay_rate_pct) AS peak_delay_rate,
                             min(breach_date) AS first_breach, max(breach_date) AS latest_breach
                      FROM logged WHERE breach_date >= {day(AS_OF)} - 90
                      GROUP BY ALL HAVING count(*) >= 3)"""
        ),
        "sla_compliance": sql(
            _compliance(
                "true",
                "true",
                "",
                f""", CASE WHEN {pct("compliant_routes", "total_routes", 1)} >= 90 THEN 'Meets SLA'
                           WHEN {pct("compliant_routes", "total_routes", 1)} >= 75 THEN 'At Risk'
                           ELSE 'SLA Breach' END AS sla_status""",
            )
        ),
        "sla_compliance_threshold": sql(
            _compliance(
                f"delay_rate_pct > {q.THRESHOLD}",
                f"carrier_code = '{q.CARRIER}'",
                "carrier_code,",
                "",
            )
        ),
        "recent_breaches": sql(
            f"""SELECT count(*) AS cnt FROM breach_log
                WHERE resolved = 0 AND created_at >= TIMESTAMP '{q.NOW}' - INTERVAL 24 HOUR"""
        ),
        "flight_details": sql(
            f"""SELECT flight_id, flight_date, flight_number, carrier_code, carrier_name, origin,
                       b.city AS origin_city, b.state AS origin_state, destination,
                       e.city AS dest_city, e.state AS dest_state, dep_delay_mins, arr_delay_mins,
                       cancelled, diverted, {", ".join(f"{c}_delay" for c in CAUSES)},
                       distance_miles,
                       CASE WHEN arr_delay_mins >= 15 THEN 1 ELSE 0 END AS is_delayed,
                       CASE WHEN arr_delay_mins >= 60 THEN 1 ELSE 0 END AS is_severely_delayed,
                       CASE WHEN arr_delay_mins < 0 THEN 1 ELSE 0 END AS is_early
                FROM f JOIN airports b ON b.airport_code = origin
                JOIN airports e ON e.airport_code = destination"""
        ),
        "carrier_monthly_scorecard": sql("SELECT * FROM card", _CARD),
        "route_performance": sql(
            f"""SELECT route_id, carrier_code, origin, destination,
                       origin || ' → ' || destination AS route_label, count(*) AS total_flights,
                       {avg("arr_delay_mins")} AS avg_arr_delay,
                       {pct(n_if("arr_delay_mins >= 15"), "count(*)")} AS delay_rate_pct,
                       {pct("sum(cancelled)", "count(*)")} AS cancel_rate_pct,
                       max(arr_delay_mins) AS worst_delay, min(arr_delay_mins) AS best_time
                FROM f GROUP BY ALL"""
        ),
        "monthly_scorecard": sql("SELECT * FROM ranked", _CARD, _CARD_RANKED.format("")),
        "monthly_scorecard_one_carrier": sql(
            "SELECT * FROM ranked",
            _CARD,
            _CARD_RANKED.format(f"AND carrier_code = '{q.CARRIER}'"),
        ),
        "monthly_scorecard_ranked_among_all": sql(
            f"SELECT * FROM ranked WHERE carrier_code = '{q.CARRIER}'",
            _CARD,
            _CARD_RANKED.format(""),
        ),
        "dominant_cause": sql(
            f"""SELECT carrier_code, carrier_name,
                       {", ".join(f"{fixed(f'm_{c}', 2)} AS avg_{c}_delay" for c in CAUSES)},
                       CASE {_CONTENDERS} WHEN m_carrier THEN 'Carrier Operations'
                            WHEN m_weather THEN 'Weather' WHEN m_nas THEN 'National Air System'
                            ELSE 'Late Aircraft' END AS dominant_delay_cause
                FROM (SELECT carrier_code, carrier_name,
                             {", ".join(f"{m} AS m_{c}" for c, m in _LATE_AIRCRAFT.items())}
                      FROM flown WHERE year(flight_date) = 2023 AND month(flight_date) = 3
                      GROUP BY ALL)"""
        ),
        "flag_breaches": sql(
            f"""SELECT {_BREACH_COLUMNS} FROM ({_evaluated(today, "rule_id = 1")}) e
                WHERE delay_rate_pct > max_rate AND NOT EXISTS (
                    SELECT 1 FROM breach_log l WHERE l.route_id = e.route_id
                    AND l.breach_date = e.breach_date AND l.breach_date < {day(AS_OF)})"""
        ),
        "flag_breaches_rerun": sql(
            f"""SELECT count(*) AS new_breaches FROM ({_evaluated(today, "rule_id = 1")}) e
                WHERE delay_rate_pct > max_rate AND NOT EXISTS (
                    SELECT 1 FROM breach_log l WHERE l.route_id = e.route_id
                    AND l.breach_date = e.breach_date)"""
        ),
        "flag_breaches_carrier_rules": sql(
            f"""SELECT {_BREACH_COLUMNS} FROM ({_evaluated(
                    today,
                    "rules.rule_id = CASE WHEN flown.carrier_code IN (SELECT carrier_code FROM rules "
                    "WHERE carrier_code IS NOT NULL) THEN 2 ELSE 1 END",
                )}) WHERE delay_rate_pct > max_rate"""
        ),
        "breach_backfill": sql(f"SELECT {_BREACH_COLUMNS} FROM found"),
        "resolve_breaches": sql(
            f"""SELECT breach_id, route_id, breach_date,
                       CASE WHEN breach_date = {day(AS_OF)} AND delay_rate_pct >= 30 THEN 1
                            ELSE resolved END AS resolved FROM breach_log"""
        ),
        "date_range_summary": sql(
            f"""SELECT count(*) AS total_flights, {avg("arr_delay_mins")} AS avg_arr_delay
                FROM flights WHERE flight_date BETWEEN {day(q.QUARTER[0])} AND {day(q.QUARTER[1])}"""
        ),
        "route_slice": sql(
            f"""SELECT route_id, flight_date, arr_delay_mins FROM flights
                WHERE route_id = {q.ROUTE_ID} AND flight_date >= DATE '2023-01-01'"""
        ),
        "carriers_with_severe_in": sql(
            """SELECT carrier_code, carrier_name FROM airlines WHERE carrier_code IN (
                   SELECT carrier_code FROM f WHERE arr_delay_mins >= 478)"""
        ),
        "carriers_with_severe_exists": sql(
            """SELECT carrier_code, carrier_name FROM airlines a WHERE EXISTS (
                   SELECT 1 FROM f WHERE f.carrier_code = a.carrier_code AND arr_delay_mins >= 478)"""
        ),
        **{
            name: sql(
                f"""SELECT flight_id, arr_delay_mins FROM flights JOIN (
                        SELECT route_id, sum(arr_delay_mins)::DOUBLE / count(arr_delay_mins) AS m
                        FROM flights GROUP BY route_id) USING (route_id)
                    WHERE arr_delay_mins > m AND flight_date >= {day(q.SINCE)}"""
            )
            for name in ("above_route_avg_join", "above_route_avg_corr")
        },
        "audit_inserts": sql(
            _audit("flights", "INSERT", "flight_id", "NULL::VARCHAR", _INSERT_JSON,
                   "flights WHERE flight_id NOT IN (SELECT flight_id FROM earlier)"),
            _OLD,
        ),
        "audit_updates": sql(
            _audit("flights", "UPDATE", "n.flight_id", _update_json("e"), _update_json("n"),
                   """flights n JOIN former e ON e.flight_id = n.flight_id
                      WHERE n.arr_delay_mins <> e.arr_delay_mins
                      OR n.dep_delay_mins <> e.dep_delay_mins OR n.cancelled <> e.cancelled"""),
            _OLD,
            "former AS (SELECT * FROM earlier QUALIFY count(*) OVER (PARTITION BY flight_id) = 1)",
        ),
        "breach_alerts": sql(
            _audit(
                "sla_breach_log", "INSERT", "breach_id", "NULL::VARCHAR",
                """json_object('event', 'SLA_BREACH_DETECTED', 'route_id', route_id,
                       'breach_date', breach_date::VARCHAR, 'delay_rate_pct', delay_rate_pct,
                       'total_flights', total_flights, 'delayed_flights', delayed_flights,
                       'severity', CASE WHEN delay_rate_pct >= 30 THEN 'CRITICAL'
                           WHEN delay_rate_pct >= 20 THEN 'HIGH' ELSE 'MEDIUM' END)::VARCHAR""",
                "breach_log",
            )
        ),
        "reject_cause_sum": sql(
            f"""SELECT flight_id, arr_delay_mins, 'cause minutes exceed arrival delay'
                       AS reject_reason FROM flights WHERE {_REJECT}"""
        ),
        "reject_cancelled_departed": sql(
            f"""SELECT flight_id, coalesce(actual_dep, scheduled_dep) AS actual_dep,
                       'cancelled with departure time' AS reject_reason
                FROM flights WHERE cancelled = 1 AND NOT ({_REJECT})"""
        ),
        "orphans": sql(
            " UNION ALL ".join(
                _orphan(*fk)
                for fk in (
                    ("routes", "carrier_code", "airlines", "carrier_code"),
                    ("routes", "origin", "airports", "airport_code"),
                    ("routes", "destination", "airports", "airport_code"),
                    ("flights", "route_id", "routes", "route_id"),
                    ("sla_rules", "carrier_code", "airlines", "carrier_code"),
                    ("sla_breach_log", "route_id", "routes", "route_id"),
                    ("sla_breach_log", "rule_id", "sla_rules", "rule_id"),
                )
            ),
            "elsewhere AS (SELECT * FROM airports WHERE state <> 'ASIA')",
        ),
        "duplicate_keys": """SELECT l_orderkey, l_linenumber, count(*) AS row_count
            FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "null_domain_counts": sql(_null_counts()),
        "delay_bands": sql(
            f"""SELECT *, {pct("flights", "sum(flights) OVER (PARTITION BY month_label)")} AS share_pct
                FROM (SELECT strftime(flight_date, '%Y-%m') AS month_label,
                             CASE WHEN arr_delay_mins < 0 THEN 'early'
                                  WHEN arr_delay_mins BETWEEN 0 AND 14 THEN 'on_time'
                                  WHEN arr_delay_mins BETWEEN 15 AND 45 THEN 'minor'
                                  WHEN arr_delay_mins BETWEEN 46 AND 120 THEN 'moderate'
                                  ELSE 'severe' END AS delay_band, count(*) AS flights
                      FROM flown GROUP BY ALL)"""
        ),
        "seasonality_index": sql(
            f"""SELECT month(flight_date)::INTEGER AS mo, count(*) AS flights,
                       {pct(n_if("arr_delay_mins >= 15"), "count(*)")} AS delay_rate_pct,
                       {fixed(div(div(n_if("arr_delay_mins >= 15"), "count(*)"),
                                  "(SELECT " + div(n_if("arr_delay_mins >= 15"), "count(*)")
                                  + " FROM flown)"), 3)} AS seasonality_index
                FROM flown GROUP BY 1"""
        ),
        "cause_reconciliation": sql(
            f"""SELECT count(*) AS late_flights,
                       {n_if(f"{_ROW_CAUSES} <> arr_delay_mins")} AS mismatches,
                       sum({_ROW_CAUSES} - arr_delay_mins)::BIGINT AS net_difference_mins
                FROM flights WHERE arr_delay_mins > 0"""
        ),
        "dep_arr_drift": sql(
            f"""SELECT min(dep_delay_mins - arr_delay_mins) AS min_drift_mins,
                       max(dep_delay_mins - arr_delay_mins) AS max_drift_mins,
                       {avg("dep_delay_mins - arr_delay_mins")} AS avg_drift_mins FROM flown"""
        ),
        "route_dimension": sql(
            "SELECT route_id, carrier_code, origin, destination, scheduled_mins FROM routes"
        ),
        "load_counts": sql(
            """SELECT 'airlines' AS table_name, count(*) AS row_count FROM airlines
               UNION ALL SELECT 'airports', count(*) FROM airports
               UNION ALL SELECT 'routes', count(*) FROM routes
               UNION ALL SELECT 'flights', count(*) FROM flights
               UNION ALL SELECT 'sla_rules', count(*) FROM rules
               UNION ALL SELECT 'sla_breach_log', count(*) FROM breach_log
               UNION ALL SELECT 'audit_log', (SELECT count(*) FROM flights)
                                           + (SELECT count(*) FROM breach_log)"""
        ),
        "append_facts": sql(
            """SELECT (year(flight_date) * 100 + month(flight_date))::INTEGER AS flight_month,
                      count(*) AS row_count, sum(arr_delay_mins)::BIGINT AS arr_delay_mins
               FROM flights GROUP BY 1"""
        ),
        "insert_if_absent": sql(
            """SELECT DISTINCT ON (route_id, flight_number)
                      route_id, flight_number, flight_date, flight_id
               FROM flights x WHERE NOT EXISTS (
                   SELECT 1 FROM flown u WHERE u.route_id = x.route_id
                   AND u.flight_number = x.flight_number AND u.flight_date < DATE '2023-07-01')
               ORDER BY route_id, flight_number, flight_date, flight_id"""
        ),
        "export_roundtrip": sql(f"SELECT {', '.join(DISPLAY['carrier_rankings'])} FROM ranking", _ALL_YEAR),
        "stream_validate": sql(
            f"""SELECT CASE WHEN {_REJECT} THEN 'rejected' ELSE 'accepted' END AS outcome,
                       CASE WHEN {_REJECT} THEN 'cause minutes exceed arrival delay' END
                           AS reject_reason,
                       count(*) AS row_count, sum(arr_delay_mins)::BIGINT AS arr_delay_mins
                FROM flights GROUP BY ALL"""
        ),
        "stream_audit": sql(
            """SELECT md5(json_object('table_name', table_name, 'operation', operation,
                       'record_id', record_id, 'new_values', new_values, 'col6', '')::VARCHAR)
                       AS audit_id, *
               FROM events""",
            "events AS ({})".format(
                _audit("flights", "INSERT", "flight_id", "NULL::VARCHAR", _INSERT_JSON, "flights")
            ),
        ),
        "stream_audit_once": sql(
            """SELECT DISTINCT md5(json_object('table_name', table_name, 'operation', operation,
                       'record_id', record_id, 'new_values', new_values, 'col6', '')::VARCHAR)
                       AS audit_id, *
               FROM events""",
            "events AS ({})".format(
                _audit("flights", "INSERT", "flight_id", "NULL::VARCHAR", _INSERT_JSON, "flights")
            ),
        ),
        "stream_daily_counts": sql(
            f"""SELECT *, flight_date < (SELECT max(flight_date) FROM flown) - 3 AS closed
                FROM ({_COUNTERS})"""
        ),
        "stream_counters": sql(_COUNTERS),
        "stream_windowed_counts": sql(
            f"""SELECT flight_date - (date_diff('day', DATE '1970-01-01', flight_date) % 7)::INTEGER
                       AS window_start, route_id, sum(total_flights)::BIGINT AS total_flights,
                       sum(delayed_flights)::BIGINT AS delayed_flights
                FROM ({_COUNTERS}) GROUP BY ALL"""
        ),
        "stream_breaches": sql(
            f"""SELECT date_diff('day', DATE '1970-01-01', breach_date) * 4294967296 + route_id
                       AS breach_id, {_BREACH_COLUMNS}, 0 AS resolved
                FROM ({_evaluated("every_day", "rule_id = 1")}) WHERE delay_rate_pct > max_rate""",
            """every_day AS (SELECT unnest(generate_series(min(flight_date), max(flight_date),
                   INTERVAL 1 DAY))::DATE AS breach_date FROM flown)""",
        ),
        "breach_backfill_daily": sql(
            f"""SELECT {_BREACH_COLUMNS} FROM ({_evaluated("last_quarter", "rule_id = 1")})
                WHERE delay_rate_pct > max_rate""",
            """last_quarter AS (SELECT unnest(generate_series(DATE '2023-10-01',
                   DATE '2023-12-31', INTERVAL 1 DAY))::DATE AS breach_date)""",
        ),
        "key_lookup": sql(
            """SELECT flight_id, flight_date, flight_number, route_id, arr_delay_mins, cancelled FROM flights
               WHERE flight_id IN (SELECT flight_id FROM flown WHERE arr_delay_mins >= 60)"""
        ),
        "indexed_ingest_outcomes": sql(
            f"""{_INGESTED} UNION ALL SELECT 'indexed', count(DISTINCT flight_id) FROM good""", _GOOD
        ),
        "ingest_outcomes": sql(_INGESTED, _GOOD),
        "job_counters": sql(
            """SELECT batch, counter, CASE
                       WHEN counter = 'given' THEN CASE WHEN batch = 2 THEN moved ELSE given END
                       WHEN counter = 'aside' THEN CASE batch WHEN 1 THEN given - kept WHEN 2 THEN moved ELSE 0 END
                       WHEN batch = 1 THEN kept ELSE 0 END AS row_count
               FROM totals, (VALUES (1), (2), (3)) AS b(batch),
                    (VALUES ('given'), ('stored'), ('aside'), ('audited')) AS c(counter)""",
            f"""totals AS (SELECT
                   count(*) + count(*) FILTER (WHERE flight_id % 50 = 0) + count(*) FILTER (WHERE flight_id % 90 = 1)
                       + count(*) FILTER (WHERE flight_id % 110 = 2) AS given,
                   count(*) FILTER (WHERE flight_id % 70 = 3) AS moved,
                   count(DISTINCT flight_id) FILTER (WHERE NOT ({_REJECT})) AS kept FROM flights)""",
        ),
        "daily_run_outcomes": sql(
            f"""SELECT route_id, breach_date, delay_rate_pct, total_flights, delayed_flights,
                       1::BIGINT AS alerts
                FROM breach_log WHERE breach_date IN ({", ".join(day(d) for d in q.RUNS)})"""
        ),
        "window_sketches": sql(
            """SELECT (year(flight_date) * 100 + month(flight_date))::INTEGER AS month,
                      count(*) AS total_flights, count(DISTINCT route_id) AS routes,
                      quantile_cont(arr_delay_mins, 0.5)::DOUBLE AS p50,
                      quantile_cont(arr_delay_mins, 0.9)::DOUBLE AS p90,
                      true AS routes_agree, true AS p50_agrees, true AS p90_agrees
               FROM flown GROUP BY 1"""
        ),
        "sql_carrier_delays": sql(
            f"""SELECT carrier_code, count(*) AS total_flights,
                       {n_if("arr_delay_mins >= 15")} AS delayed_flights,
                       {pct(n_if("arr_delay_mins >= 15"), "count(*)")} AS delay_rate_pct
                FROM flown WHERE flight_date BETWEEN {day(q.QUARTER[0])} AND {day(q.QUARTER[1])}
                GROUP BY carrier_code"""
        ),
        "sql_route_days": sql(
            f"""SELECT flight_date, count(*) AS total_flights, sum(arr_delay_mins)::BIGINT AS arr_delay_mins
                FROM flights WHERE route_id = {q.ROUTE_ID} GROUP BY flight_date"""
        ),
        "update_outcomes": sql(
            """SELECT 'facts' AS outcome, count(*) AS row_count, sum(arr)::BIGINT AS arr_delay_mins
               FROM (SELECT CASE WHEN any_value(n) = 1 THEN any_value(arr_delay_mins) END AS arr FROM keyed
                     WHERE flight_date < DATE '2023-12-01' GROUP BY flight_id
                     UNION ALL SELECT CASE WHEN any_value(n) = 1 THEN any_value(arr_delay_mins
                         - CASE WHEN scheduled_dep >= 1800 THEN 5 ELSE 0 END) END
                     FROM keyed WHERE flight_date < DATE '2023-12-01' AND flight_id % 400 = 7
                     GROUP BY flight_id)
               UNION ALL SELECT 'left in the month they moved from', 0::BIGINT, NULL::BIGINT
               UNION ALL SELECT 'audit', count(*), NULL::BIGINT FROM flights
                   WHERE flight_date < DATE '2023-12-01' AND scheduled_dep >= 1800
               UNION ALL SELECT 'unknown', count(*), NULL::BIGINT FROM flights
                   WHERE flight_date >= DATE '2023-12-01'
               UNION ALL SELECT 'second row of a key', count(*) + count(*) FILTER (WHERE flight_id % 50 = 0)
                   - count(DISTINCT flight_id), NULL::BIGINT FROM flights
                   HAVING count(*) FILTER (WHERE flight_id % 50 = 0) > 0 OR count(*) > count(DISTINCT flight_id)
               UNION ALL SELECT 'key is stored more than once', sum(n)::BIGINT, NULL::BIGINT
                   FROM (SELECT count(*) * CASE WHEN flight_id % 70 = 3 THEN 2 ELSE 1 END AS n FROM flights
                         WHERE flight_date < DATE '2023-12-01' GROUP BY flight_id HAVING n > 1) HAVING sum(n) > 0
               UNION ALL SELECT 'missing flight_number', count(*), NULL::BIGINT FROM flights
                   WHERE flight_id % 90 = 1 HAVING count(*) > 0
               UNION ALL SELECT 'missing flight_date', count(*), NULL::BIGINT FROM flights
                   WHERE flight_id % 110 = 2 HAVING count(*) > 0""",
            "keyed AS (SELECT *, count(*) OVER (PARTITION BY flight_id) AS n FROM flights)",
        ),
        "ontime_roundtrip": sql(
            """SELECT 'kept' AS outcome, count(*) AS row_count,
                      count(*) FILTER (WHERE flight_id % 40 <> 1 OR cancelled = 1) AS known_delays,
                      sum(arr_delay_mins) FILTER (WHERE flight_id % 40 <> 1)::BIGINT
                          AS arr_delay_mins
               FROM flights WHERE flight_id % 40 NOT IN (0, 2, 3, 4)
               UNION ALL SELECT 'refused', count(*), NULL::BIGINT, NULL::BIGINT FROM flights
               WHERE flight_id % 40 IN (0, 2, 3, 4)"""
        ),
        "delay_percentiles": sql(
            """SELECT flight_id, arr_delay_mins, rank() OVER o AS delay_rank,
                      dense_rank() OVER o AS delay_dense_rank,
                      percent_rank() OVER o AS delay_percent_rank
               FROM flown WHERE arr_delay_mins IS NOT NULL WINDOW o AS (ORDER BY arr_delay_mins)"""
        ),
        "rule_history_versions": sql(
            """SELECT rule_id, version, carrier_code, max_rate::DOUBLE AS max_delay_rate_pct, window_days,
                      updated_by, valid_from, valid_to FROM versions""",
            _VERSIONS,
        ),
        "rules_in_force": sql(
            """SELECT rule_id, carrier_code, max_rate::DOUBLE AS max_delay_rate_pct,
                      min_flights AS min_flights_window, window_days, updated_by
               FROM versions WHERE DATE '2023-09-30' BETWEEN valid_from
                   AND coalesce(valid_to, DATE '9999-12-31')""",
            _VERSIONS,
        ),
        "breaches_by_rule_version": sql(
            f"""SELECT * EXCLUDE (max_rate, min_flights) FROM (
                SELECT route_id, breach_date, rule_id, version, max_rate, min_flights,
                       {pct(n_if("arr_delay_mins >= 15"), "count(*)")} AS delay_rate_pct,
                       count(*) AS total_flights, {n_if("arr_delay_mins >= 15")} AS delayed_flights
                FROM flown JOIN in_force ON flight_date BETWEEN breach_date - window_days::INTEGER
                    AND breach_date
                GROUP BY ALL)
                WHERE total_flights >= min_flights AND delay_rate_pct > max_rate""",
            _VERSIONS
            + """, in_force AS (SELECT d.breach_date, v.* FROM dates d
                   ASOF JOIN (SELECT * FROM versions WHERE rule_id = 1) v ON d.breach_date >= v.valid_from)""",
        ),
        "facts_in_rule_windows": sql(
            f"""SELECT rule_id, version, f.carrier_code, count(*) AS total_flights,
                       {n_if("arr_delay_mins >= 15")} AS delayed_flights
                FROM flown f JOIN versions v ON flight_date >= valid_from
                    AND (valid_to IS NULL OR flight_date <= valid_to)
                    AND (v.carrier_code IS NULL OR v.carrier_code = f.carrier_code)
                GROUP BY ALL""",
            _VERSIONS,
        ),
        "facts_as_of": sql(
            """SELECT flight_id, flight_date, flight_number, route_id, dep_delay_mins, arr_delay_mins,
                      cancelled, CASE WHEN scheduled_dep >= 1800 THEN diverted END AS diverted
               FROM flights WHERE flight_date < DATE '2023-12-01'
               AND flight_id IN (SELECT flight_id FROM flights GROUP BY 1 HAVING count(*) = 1)"""
        ),
        "stream_unresolved": sql(
            f"""SELECT breach_id, route_id, breach_date FROM breach_log
                WHERE NOT (breach_id % 3 = 0 AND (breach_id * 37) % 720 + 1 <= {q.WITHIN_HOURS})"""
        ),
        "declared_duplicates": sql(_declared_duplicates()),
        "declared_counts": sql(_declared_counts()),
    }
    for name, report in q.REPORTS.items():
        found[f"export_{name}"] = _exported(name, found[report.__name__])
    return found


def _exported(name: str, text: str) -> str:
    shown = DISPLAY[name]
    if shown is None:
        return text
    labels = RENAMED.get(name, {})
    names = [labels.get(c, c) for c in shown]
    alone = [n if names.index(n) == i else f"{n} {i + 1}" for i, n in enumerate(names)]
    columns = ", ".join(f'{c} AS "{n}"' for c, n in zip(shown, alone, strict=True))
    return f"SELECT {columns} FROM ({text})"


def _declared_duplicates() -> str:
    rows = [
        ("airlines", "carrier_code", f"airlines WHERE carrier_code = '{q.CARRIER}'"),
        ("airports", "airport_code", "airports WHERE state = 'ASIA'"),
        ("routes", "route_id", "routes WHERE route_id % 100 = 7"),
        ("routes", "carrier_code, origin, destination", "routes WHERE route_id % 100 = 7"),
        ("sla_rules", "rule_id", "rules WHERE rule_id = 1"),
        ("sla_breach_log", "breach_id", "breach_log WHERE breach_id % 500 = 13"),
        ("sla_breach_log", "route_id, breach_date, rule_id",
         "breach_log WHERE breach_id % 500 = 13"),
        ("audit_log", "audit_id",
         "(SELECT flight_id AS id FROM flights UNION ALL SELECT breach_id FROM breach_log) "
         "WHERE id % 500 = 11"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{key}' AS key_columns, count(*) AS keys, "
        f"sum(n)::BIGINT AS row_count FROM ({source}) HAVING count(*) > 0"
        for table, key, source in (
            (table, key, f"SELECT 2 AS n FROM {source}") for table, key, source in rows
        )
    ) + """ UNION ALL SELECT 'flights', 'flight_id', count(*), sum(n)::BIGINT FROM (
        SELECT sum(CASE WHEN flight_id % 500 = 11 THEN 2 ELSE 1 END) AS n FROM flights
        GROUP BY flight_id HAVING n > 1) HAVING count(*) > 0"""


def _declared_counts() -> str:
    """Nothing is missing but what the query removes, and no value is outside its domain."""
    gone = {
        "airlines": ("carrier_name", f"airlines WHERE carrier_code = '{q.CARRIER}'"),
        "airports": ("city", "airports WHERE state = 'ASIA'"),
        "routes": ("scheduled_mins", "routes WHERE route_id % 100 = 7"),
        "flights": ("flight_number", "flights WHERE flight_id % 500 = 11"),
        "sla_rules": ("window_days", "rules WHERE rule_id = 1"),
        "sla_breach_log": ("rule_id", "breach_log WHERE breach_id % 500 = 13"),
        "audit_log": (
            "operation",
            "(SELECT flight_id AS id FROM flights UNION ALL SELECT breach_id FROM breach_log) "
            "WHERE id % 500 = 11",
        ),
    }
    lines = []
    for table, schema in TABLES.items():
        checks = [(f.name, "missing") for f in schema if not f.nullable]
        checks += [(c, "outside domain") for c in DOMAINS.get(table, {})]
        checks += [(c, "too long") for c in LENGTHS.get(table, {})]
        for column, problem in checks:
            hit = (column, problem) == (gone[table][0], "missing")
            count = f"(SELECT count(*) FROM {gone[table][1]})" if hit else "0::BIGINT"
            lines.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
                f"'{problem}' AS problem, {count} AS row_count"
            )
    return " UNION ALL ".join(lines)
