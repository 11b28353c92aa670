"""Versioned state: write/read, snapshots list/rotate/restore/cleanup, archive."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.plans import inputs as I
from tidewatch.sources import state as ST

SF = "/root/testdata/sf0.001"


def test_snapshot_lifecycle(spark):
    root = tempfile.mkdtemp(prefix="tw-state-")
    e = I.entities0(spark, SF)
    n = e.count()
    t = datetime(2024, 1, 1)
    names = [ST.write_state(e, root, t + timedelta(minutes=i)) for i in range(5)]
    assert ST.current_snapshot(spark, root) == names[-1]
    snaps = ST.list_snapshots(spark, root).collect()
    assert [s.snapshot_ts for s in snaps] == sorted(names, reverse=True)
    assert all(s.job_count == n for s in snaps)
    assert ST.rotate_snapshots(spark, root, max_versions=3) == 2
    assert ST.list_snapshots(spark, root).count() == 3
    assert ST.read_state(spark, root).count() == n
    # restore an older version: becomes current as a new version
    assert ST.restore_snapshot(spark, root, names[2], t + timedelta(hours=1))
    assert not ST.restore_snapshot(spark, root, "19990101-000000-000000", t + timedelta(hours=2))
    assert ST.read_state(spark, root).count() == n
    # a corrupt version is removed
    bad = os.path.join(root, "entities", "snapshot_ts=20000101-000000-000000")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "wb") as fh:
        fh.write(b"not parquet")
    assert ST.cleanup_corrupted(spark, root) == 1


def test_read_state_quarantines_invalid_rows(spark):
    root = tempfile.mkdtemp(prefix="tw-state-")
    e = I.entities0(spark, SF)
    bad = e.withColumn("status", F.when(F.col("entity_seq") % 9 == 0, F.lit("bogus")).otherwise(F.col("status")))
    ST.write_state(bad, root, datetime(2024, 1, 1))
    valid, quarantine = ST.read_state(spark, root, quarantine=True)
    nbad = bad.where("status = 'bogus'").count()
    assert quarantine.count() == nbad and valid.count() == e.count() - nbad


def test_archive_old(spark):
    root = tempfile.mkdtemp(prefix="tw-state-")
    e = I.customer_jobs(spark, SF)
    now = datetime(2024, 2, 1)
    remaining = ST.archive_old(e, root, now, retention_days=30)
    assert ST.archive_old(e, root, now, retention_days=30).count() == remaining.count()  # a retry
    archived = ST.read_archive(spark, root)
    assert spark.read.parquet(f"{root}/archive").count() == archived.count()
    expect = e.where((F.col("status") == "closed") & (F.col("last_seen") < F.lit("2024-01-02").cast("timestamp_ntz"))).count()
    assert archived.count() == expect
    assert remaining.count() == e.count() - expect
    assert set(r.archive_month for r in archived.select("archive_month").distinct().collect()) <= {"2023-12", "2024-01"}


def test_uncommitted_version_is_never_current(spark):
    import pytest

    root = tempfile.mkdtemp(prefix="tw-state-")
    e = I.entities0(spark, SF)
    assert ST.current_snapshot(spark, root) is None
    e.limit(3).write.parquet(f"{root}/entities/snapshot_ts=20240101-000000-000000")  # a crash before the commit
    with pytest.raises(RuntimeError):
        ST.current_snapshot(spark, root)
    name = ST.write_state(e, root, datetime(2023, 1, 1))
    assert ST.current_snapshot(spark, root) == name
    assert ST.read_state(spark, root).count() == e.count()


def test_read_json_collections(spark):
    import json

    root = tempfile.mkdtemp(prefix="tw-state-")
    job = {"id": "1", "company_id": "acme", "company_name": "Acme", "title": "T", "location": "L", "url": "https://x.org/1", "signature": "acme|t|l",
           "classification": "new", "classification_reasoning": "r", "status": "active", "first_seen": "2024-01-01T00:00:00", "last_seen": "2024-01-02T00:00:00",
           "source_identifier": "A", "observations": [{"timestamp": "2024-01-01T00:00:00", "url": "u"}], "created_at": "2024-01-01T00:00:00", "updated_at": "2024-01-02T00:00:00"}
    docs = {"a.json": {"version": "1.0.0", "generated_at": "2024-01-03", "jobs": [job, {**job, "id": "2", "status": "bogus"}, {**job, "title": "later"}, {**job, "id": "3"}]},
            "b.json": {"version": "0.9.0", "generated_at": "2024-01-03", "jobs": [job]}, "c.json": {"version": "1.0.0", "jobs": []}}
    for name, doc in docs.items():
        with open(os.path.join(root, name), "w") as fh:
            json.dump(doc, fh, indent=2)
    with open(os.path.join(root, "d.json"), "w") as fh:
        fh.write("{broken")
    valid, bad, about = ST.read_collection(spark, root)
    got = sorted((os.path.basename(r.collection), r.id, r.title, r.entity_seq, str(r.last_seen)) for r in valid.collect())
    assert got == [("a.json", "1", "later", 0, "2024-01-02 00:00:00"), ("a.json", "3", "T", 3, "2024-01-02 00:00:00"), ("b.json", "1", "T", 0, "2024-01-02 00:00:00")]
    assert [(r.id, r.violations) for r in bad.collect()] == [("2", ["status is not one of the allowed values"])]
    docs = {os.path.basename(r.collection): (r.readable, r.version_ok, r.jobs) for r in about.collect()}
    assert docs == {"a.json": (True, True, 4), "b.json": (True, False, 1), "c.json": (True, True, 0), "d.json": (False, False, 0)}


def test_list_snapshots_shows_committed_versions_only(spark):
    root = tempfile.mkdtemp(prefix="tw-state-")
    assert ST.list_snapshots(spark, root).count() == 0
    e = I.customer_jobs(spark, SF).limit(20)
    ST.write_state(e, root, datetime(2024, 1, 1))
    spark.read.parquet(f"{root}/entities/snapshot_ts=20240101-000000-000000").write.parquet(f"{root}/entities/snapshot_ts=20240102-000000-000000")
    assert [(r.snapshot_ts, r.job_count) for r in ST.list_snapshots(spark, root).collect()] == [("20240101-000000-000000", 20)]


def test_folded_statistics_equal_the_batch_form(spark, tmp_path):
    """Late, repeated and empty runs, a null entity, and a fold that stopped before its marker."""
    from tidewatch.operators.metrics import observation_stats
    from tidewatch.sources import state as ST

    root = f"{tmp_path}/stats"
    schema = "entity_id string, ts timestamp_ntz"
    runs = {"b": [("x", datetime(2024, 1, 5)), ("y", datetime(2024, 1, 5)), ("x", datetime(2024, 1, 5))],
            "a": [("x", datetime(2024, 1, 1)), (None, datetime(2024, 1, 2))], "c": [], "d": [("y", datetime(2024, 2, 1)), (None, None)]}
    frames = {k: spark.createDataFrame(v, schema) for k, v in runs.items()}
    with pytest.raises(FileNotFoundError):
        ST.read_observation_stats(spark, root)
    for run in ["b", "a", "b", "c"]:
        ST.fold_observation_stats(frames[run], root, run)
    frames["d"].write.parquet(f"{root}/stats/version={4:012d}")   # what a lost driver leaves behind
    ST.fold_observation_stats(frames["d"], root, "d")
    whole = observation_stats(frames["a"].unionByName(frames["b"]).unionByName(frames["d"]))
    key = lambda df: sorted(map(str, df.select("entity_id", "first_seen", "last_seen", "observation_count").collect()))
    assert key(ST.read_observation_stats(spark, root)) == key(whole)
