"""What jobs read back or derive again of what they have just stored."""

import datetime as dt

import pytest
from frames import table

from slotwise.plans import jobs as batch_jobs
from slotwise.sources.layout import read_audit, write_flights
from slotwise.streaming import jobs


def flights(spark, first, last):
    day = dt.date(2023, 1, 1)
    return table(spark, "flights", [{"flight_id": n, "flight_date": day} for n in range(first, last)])


@pytest.fixture
def looked_up(monkeypatch):
    seen = []
    plain = batch_jobs.audited_records.__globals__["insert_events"]

    def told(events, *args, **named):
        seen.append(events)
        return plain(events, *args, **named)

    monkeypatch.setattr(jobs, "insert_events", told)
    return seen


def run(spark, path):
    stream = jobs.flight_stream(spark, f"{path}/feed", max_files_per_trigger=1)
    jobs.audit_stream(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return sorted(row.record_id for row in read_audit(spark, f"{path}/out").collect())


def test_an_audit_stream_reads_back_for_the_first_batch_of_a_restart_only(spark, tmp_path, looked_up):
    for n in range(3):
        write_flights(flights(spark, 10 * n, 10 * n + 5).coalesce(1), f"{tmp_path}/feed")
    assert run(spark, tmp_path) == [*range(5), *range(10, 15), *range(20, 25)]
    assert looked_up == []
    for n in range(3, 6):
        write_flights(flights(spark, 10 * n, 10 * n + 5).coalesce(1), f"{tmp_path}/feed")
    assert len(run(spark, tmp_path)) == 30
    assert len(looked_up) == 1
