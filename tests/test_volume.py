"""Work that must not be done twice, or row by row where a plainer form does."""

from pyspark.sql import functions as F

from slotwise.sources import ontime_csv


def plan(df):
    return df._jdf.queryExecution().toString()


def test_on_time_files_are_parsed_once(spark, tmp_path):
    header = list(ontime_csv.COLUMNS.values())
    good = ["2023-01-02", "AA", "12", "JFK", "LAX", "900", "905", "5", "1100", "1107", "7", "0", "0", "120", "300"]
    lines = [[*good, "1", "2.0", " ", "", "4"], [*good, "1.5", "", "", "", ""], [*good, "x", "", "", "", ""]]
    (tmp_path / "a.csv").write_text("\n".join(",".join(line) for line in [header, *lines]) + "\n")
    keyed, bad = ontime_csv.read_ontime(spark, str(tmp_path))
    for df in (keyed, bad, ontime_csv.ontime_flights(keyed, ontime_csv.ontime_routes(keyed))):
        assert "FileScan csv" not in plan(df)
    found = keyed.select("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay")
    assert [tuple(r) for r in found.collect()] == [(1, 2, None, None, 4)]
    assert bad.agg(F.count(F.lit(1))).head()[0] == 2
