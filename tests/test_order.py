"""The sorts themselves: rows come back in the stated order, ties by position."""

import pytest

from tidewatch.operators import applications as A
from tidewatch.operators import metrics as M
from tidewatch.operators import views as VW
from tidewatch.plans import inputs as I

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("by,key", [
    ("last_seen", lambda r: (-r.last_seen.timestamp(), r.entity_seq)),
    ("oldest", lambda r: (r.first_seen, r.entity_seq)),
])
def test_jobs_are_sorted(spark, by, key):
    rows = VW.sort_jobs(I.customer_jobs(spark, SF), by).collect()
    assert len(rows) > 100 and rows == sorted(rows, key=key)


@pytest.mark.parametrize("by,column", [("company", "company_name"), ("title", "title")])
def test_jobs_are_sorted_by_text(spark, by, column):
    rows = VW.sort_jobs(I.customer_jobs(spark, SF), by).collect()
    values = [(r[column].lower(), r.entity_seq) for r in rows]
    assert [v for v, _ in values] == sorted(v for v, _ in values)
    assert all(a[1] < b[1] for a, b in zip(values, values[1:]) if a[0] == b[0])


def test_applications_are_sorted(spark):
    rows = A.sort_by_applied(I.applications(spark, SF)).collect()
    days = [r.applied_date for r in rows]
    assert days == sorted(days) or days == sorted(days, reverse=True)


def test_failed_companies_count_once(spark):
    s = spark.createDataFrame([("a", 3, 3), ("b", 2, 1)], "company_id string, jobs_fetched bigint, jobs_classified bigint")
    f = spark.createDataFrame([("b",), ("c",), ("c",)], "company_id string")
    assert tuple(M.run_totals(s, f).first()) == (3, 1, 2, 5, 4)
    assert tuple(M.run_totals(s).first()) == (2, 2, 0, 5, 4)


def test_hot_entity_gaps_and_sessions_by_buckets(spark):
    """One entity holds most of the log: buckets of any length give the plain result, and no window
    partition of the gap scan holds more than a bucket."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(4)
    begin = datetime(2024, 1, 1)
    rows = [(1 if rng.random() < 0.8 else rng.randint(2, 6), begin + timedelta(hours=rng.choice([rng.randint(0, 2000), rng.randint(0, 40) * 72])), k) for k in range(900)]
    rows += [(None, begin, 9001), (None, begin + timedelta(days=30), 9002), (1, rows[0][1], 9003)]
    log = spark.createDataFrame(rows, "entity_id bigint, ts timestamp_ntz, event_id bigint")
    gaps, sessions, by = {}, [], {}
    for e, t, k in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2])):
        before = by.get(e)
        gaps[k] = None if before is None else (t - before).total_seconds()
        if before is None or t > before + timedelta(days=3):
            sessions.append([e, t, t, 0])
        last = sessions[-1]
        last[2], last[3], by[e] = t + timedelta(days=3), last[3] + 1, t
    for bucket in ("7 days", "1 day", "400 days"):
        assert {r.event_id: r.gap_seconds for r in M.gap_since_previous(log, bucket=bucket).collect()} == gaps
        got = sorted(map(list, M.presence_sessions(log, "3 days", bucket=bucket).collect()), key=repr)
        assert got == sorted(sessions, key=repr)
