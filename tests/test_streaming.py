"""Structured Streaming forms (R1-R5) on small landed inputs."""

import os
import tempfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import stream as SS

SF = "/root/testdata/sf0.001"


def test_window_counts_stream_equals_batch_up_to_the_watermark(spark):
    from tidewatch.plans.registry import QUERIES

    s = QUERIES["r3_run_window_counts_stream"](spark, SF)
    wm = spark.read.parquet(f"{SF}/events.parquet").agg(F.max("ts").cast("timestamp_ntz")).first()[0] - pd.Timedelta("1 day")
    b = QUERIES["r3_run_window_counts"](spark, SF).select(*s.columns).where(F.col("window_end") <= F.lit(str(wm)).cast("timestamp_ntz"))
    assert s.count() and sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_entity_lifecycle_transitions(spark):
    """Active, missing, closed and reopened; the same for one file, a file per day, and files out
    of order within the watermark."""
    days = {"a": [1, 2, 20, 21], "b": [1, 5], "c": [1], "z": [40]}
    rows = pd.DataFrame([(e, pd.Timestamp("2024-01-01") + pd.Timedelta(days=d - 1)) for e, ds in days.items() for d in ds], columns=["entity_id", "ts"])
    want = {("a", "active", 1, 1), ("a", "missing", 5, 2), ("a", "closed", 9, 2), ("a", "reopened", 20, 3), ("a", "missing", 24, 4), ("a", "closed", 28, 4),
            ("b", "active", 1, 1), ("b", "missing", 4, 1), ("b", "active", 5, 2), ("b", "missing", 8, 2), ("b", "closed", 12, 2),
            ("c", "active", 1, 1), ("c", "missing", 4, 1), ("c", "closed", 8, 1)}
    daily = [g for _, g in rows.groupby("ts")]
    for layout in ([rows], daily, [pd.concat(daily[:2]), *daily[2:]]):
        d = tempfile.mkdtemp(prefix="tw-r2-")
        for i, part in enumerate(layout):
            spark.createDataFrame(part).coalesce(1).write.parquet(f"{d}/in/{i}")
            src = spark.readStream.schema("entity_id string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{d}/in")
            out = SS.run_available(SS.entity_lifecycle(src, "3 days", "7 days", watermark="1 day"), f"{d}/out", f"{d}/ck")
        got = {(r.entity_id, r.status, (r["at"] - datetime(2024, 1, 1)).days + 1, r.sightings) for r in out.collect()}
        assert got == want


def test_lifecycle_stream_equals_sql(spark):
    import duckdb

    from tidewatch.plans.oracles import oracle_sql
    from tidewatch.plans.registry import QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    cur = con.execute(oracle_sql()["r2_entity_lifecycle_stream"])
    cols = [c[0] for c in cur.description]
    got = QUERIES["r2_entity_lifecycle_stream"](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(map(tuple, cur.fetchall()))


RUN_SCHEMA = ("batch_seq bigint, company_id string, company_name string, title string, location string, url string, "
              "source_identifier string, department string, description string, observed_at timestamp_ntz")


def _land(spark, landing, run, day, rows, files=1, whole=True):
    """A run's rows as one Parquet file each ``files``; its _SUCCESS last."""
    data = [(i + 1, c, c.upper(), t, "Remote", f"u{i}", sid, None, None, datetime(2024, 1, day)) for i, (c, t, sid) in enumerate(rows)]
    folder = os.path.join(landing, f"run_id={run}")
    for k in range(files):
        spark.createDataFrame(data[k::files], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        os.remove(os.path.join(folder, "_SUCCESS"))
    if whole:
        open(os.path.join(folder, "_SUCCESS"), "w").close()


def _ingest(spark, root):
    q = SS.start_ingestion(spark, f"{root}/landing", RUN_SCHEMA + ", run_id string", f"{root}/state", f"{root}/ck")
    q.awaitTermination()
    assert q.exception() is None


def _status(spark, root):
    from tidewatch.sources.state import read_state

    return {r.source_identifier: (r.status, r.classification) for r in read_state(spark, f"{root}/state").collect()}


RUN1 = [("acme", "Data Engineer", "A1"), ("acme", "Analyst", "A2"), ("globex", "Welder", "G1")]
RUN2 = [("acme", "Data Engineer", "A1"), ("acme", "Data Engineers", "A3"), ("globex", "Welder", "G1")]


@pytest.mark.parametrize("files", [1, 3])
def test_ingestion_runs_the_cycle_once_per_run(spark, files):
    """The same state whether a run lands as one file or several; other companies' files do not
    make a company missing."""
    root = tempfile.mkdtemp(prefix="tw-r1-")
    _land(spark, f"{root}/landing", "r1", 1, RUN1, files)
    _ingest(spark, root)
    assert _status(spark, root) == {"A1": ("active", "new"), "A2": ("active", "new"), "G1": ("active", "new")}
    _land(spark, f"{root}/landing", "r2", 2, RUN2, files, whole=False)
    _ingest(spark, root)
    assert _status(spark, root)["A2"] == ("active", "new")  # r2 is not complete yet
    open(f"{root}/landing/run_id=r2/_SUCCESS", "w").close()
    done = SS.landed_whole(f"{root}/landing")
    assert SS.commit_complete_runs(spark, f"{root}/state", done) == ["r2"]
    want = {"A1": ("active", "new"), "A2": ("missing", "new"), "A3": ("active", "repost"), "G1": ("active", "new")}
    assert _status(spark, root) == want
    assert spark.read.parquet(f"{root}/state/decisions").count() == 6
    # a crash before the commit: the run is done again, with the same outputs
    os.remove(f"{root}/state/_committed/r2")
    assert SS.commit_complete_runs(spark, f"{root}/state", done) == ["r2"]
    assert _status(spark, root) == want
    assert spark.read.parquet(f"{root}/state/decisions").count() == 6
    assert spark.read.parquet(f"{root}/state/observations").count() == 6
    # rows that come after the commit are kept aside
    handler = SS.cycle_batch_handler(f"{root}/state", done)
    late = spark.read.parquet(f"{root}/landing").limit(1).withColumn("run_id", F.lit("r1"))
    handler(late, 77), handler(late, 77)
    assert _status(spark, root) == want
    handler(late.withColumn("run_id", F.lit(None).cast("string")), 78)
    assert _status(spark, root) == want
    staged = spark.read.parquet(f"{root}/state/staged")
    # folders of committed runs are gone, so a batch reads no earlier run again
    assert staged.where("_late = 1").count() == 2 and staged.where("_late = 0").count() == 0
    assert SS._staged_runs(spark, f"{root}/state") == {}


def test_late_sink_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="tw-r5-")
    sink = SS.late_aware_sink(f"{root}/main", f"{root}/late")
    b0 = spark.createDataFrame([(1, datetime(2024, 1, 10))], "k int, ts timestamp")
    b1 = spark.createDataFrame([(2, datetime(2024, 1, 11)), (3, datetime(2024, 1, 2))], "k int, ts timestamp")
    for batch, n in ((b0, 0), (b1, 1), (b1, 1), (b0, 0)):
        sink(batch, n)
    assert sorted(r.k for r in spark.read.parquet(f"{root}/main/rows").collect()) == [1, 2]
    assert [r.k for r in spark.read.parquet(f"{root}/late").collect()] == [3]


def test_split_late(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 5))], "k int, ts timestamp")
    on_time, late = SS.split_late(df, datetime(2024, 1, 3))
    assert [r.k for r in on_time.collect()] == [2] and [r.k for r in late.collect()] == [1]


def test_presence_sessions_stream(spark):
    d = tempfile.mkdtemp(prefix="tw-r4-")
    rows = pd.DataFrame({
        "entity_id": ["a", "a", "a", "b"],
        "ts": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-10", "2024-01-20"]),
    })
    spark.createDataFrame(rows).write.parquet(f"{d}/in")
    src = spark.readStream.schema("entity_id string, ts timestamp").parquet(f"{d}/in")
    out = SS.run_available(SS.presence_sessions(src, "3 days", watermark="1 day"), f"{d}/out", f"{d}/ck")
    got = sorted((r.entity_id, r.observations, str(r.session_start)[:10]) for r in out.collect())
    # sessions closed by the watermark (Jan 19) are emitted; b's open session is not
    assert got == [("a", 1, "2024-01-10"), ("a", 2, "2024-01-01")]
