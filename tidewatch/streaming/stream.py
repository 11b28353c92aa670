"""Structured Streaming forms of the cycle.

* R1 ``start_ingestion``: postings landing in a directory are staged through ``foreachBatch``;
  each complete run drives ``run_cycle`` once and is committed with one marker.
* R2 ``entity_lifecycle``: per-entity state machine with event-time timers
  (``applyInPandasWithState``): active, missing, closed, reopened up to the watermark; what is
  not final yet waits as presence intervals.
* R3 ``run_window_counts``: tumbling windows with a watermark.
* R4 ``presence_sessions``: session windows with a watermark.
* R5 ``split_late``: rows older than the running watermark go to a side table instead of
  being dropped silently.

Sinks write to the shared checkpoint dir (``spark.checkpoint.dir``) or a caller path; nothing
is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.classify import run_cycle
from tidewatch.sources import state as ST

# --- R1 -----------------------------------------------------------------------------------------

_EMPTY_STATE = ("id string, entity_seq bigint, company_id string, company_name string, title string, "
                "location string, url string, classification string, classification_reasoning string, "
                "status string, first_seen timestamp_ntz, last_seen timestamp_ntz, source_identifier string, "
                "department string, description string, created_at timestamp_ntz, updated_at timestamp_ntz")


def _known(spark: SparkSession, state_root: str) -> tuple[DataFrame, DataFrame | None]:
    """(valid records of the last committed run, its quarantine)."""
    if ST.current_snapshot(spark, state_root) is None:
        from tidewatch.functions.normalize import with_signature
        from tidewatch.operators.classify import ENTITY_COLUMNS

        return with_signature(spark.createDataFrame([], _EMPTY_STATE)).select(*ENTITY_COLUMNS), None
    return ST.read_state(spark, state_root, quarantine=True)


def landed_whole(landing_dir: str, run_col: str = "run_id"):
    """A run is complete once its folder ``run_id=<run>`` has the ``_SUCCESS`` file of its writer."""
    def done(spark: SparkSession, run: str) -> bool:
        fs, p = ST._fs(spark, f"{landing_dir}/{run_col}={run}/_SUCCESS")
        return fs.exists(p)

    return done


def _staged_runs(spark: SparkSession, state_root: str) -> dict[str, list[str]]:
    """Staged folders of each run, by folder names only: ``staged/_batch=<n>/_late=0/_run=run-<run>``."""
    fs, p = ST._fs(spark, f"{state_root}/staged/_batch=*/_late=0/_run=*")
    runs: dict[str, list[str]] = {}
    for st in fs.globStatus(p) or []:
        path = st.getPath()
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(path.getName())
        runs.setdefault(name.removeprefix("_run=run-"), []).append(path.toString())
    return runs


def _drop_staged(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        fs, p = ST._fs(spark, folder)
        fs.delete(p, True)


def commit_complete_runs(spark: SparkSession, state_root: str, is_complete, clock_col: str = "observed_at",
                         run_col: str = "run_id", **cycle_kw) -> list[str]:
    """Run the cycle once for each staged run that is complete and not committed, in the order of
    run ids (as strings, so numbers need leading zeros). Only the folders of that run are read;
    those of committed runs go with the next call. A run is classified as a whole, so what it did
    not see is missing whatever the number of its files; its clock is the latest ``clock_col`` of its rows. All outputs of a run go to
    paths of its own and one marker commits them, so a retry after any write gives the same state.
    A run older than the last committed one is an error."""
    staged, done, out = _staged_runs(spark, state_root), ST.committed(spark, state_root), []
    for run in sorted(staged):
        if run in done:
            _drop_staged(spark, staged[run])
            continue
        if not is_complete(spark, run):
            break  # later runs wait for it
        if done and run < done[-1]:
            raise ValueError(f"run {run} is older than the committed run {done[-1]}")
        rows = spark.read.parquet(*staged[run])
        now = rows.agg(F.max(clock_col)).first()[0]
        known, bad = _known(spark, state_root)
        res = run_cycle(known, rows.drop(clock_col, run_col), now, run_id=run, **cycle_kw)
        (res.entities.withColumn("schema_version", F.lit(ST.SCHEMA_VERSION))
         .write.mode("overwrite").parquet(f"{state_root}/entities/snapshot_ts={run}"))
        res.observations.write.mode("overwrite").parquet(f"{state_root}/observations/run={run}")
        res.decisions.write.mode("overwrite").parquet(f"{state_root}/decisions/run={run}")
        if bad is not None:
            bad.write.mode("overwrite").parquet(f"{state_root}/quarantine/run={run}")
        ST.mark_committed(spark, state_root, run)
        done.append(run)
        out.append(run)
    return out


def cycle_batch_handler(state_root: str, is_complete, clock_col: str = "observed_at", run_col: str = "run_id", **cycle_kw):
    """foreachBatch function: stage the micro-batch under its number, a folder a run (a replay writes
    the same files), then commit the runs that are complete. Rows that arrive for a run already committed,
    or without a run, are kept under ``_late=1`` and change nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        late = F.col(run_col).isin(ST.committed(spark, state_root))
        fs, p = ST._fs(spark, f"{state_root}/staged/_batch={batch_id}")
        if not fs.exists(p):  # the first try decided what is late
            path = f"{state_root}/staging/{batch_id}"
            # 'run-' keeps the folder's value a string, whatever the run is called; rows without a run are kept aside too
            aside = F.coalesce(late, F.lit(False)) | F.col(run_col).isNull()
            (batch.withColumns({"_late": aside.cast("int"), "_run": F.concat(F.lit("run-"), F.col(run_col).cast("string"))})
             .write.mode("overwrite").partitionBy("_late", "_run").parquet(path))
            fs.mkdirs(p.getParent())
            fs.rename(ST._fs(spark, path)[1], p)
        commit_complete_runs(spark, state_root, is_complete, clock_col, run_col, **cycle_kw)

    return handle


def start_ingestion(spark: SparkSession, landing_dir: str, schema: str, state_root: str, checkpoint: str,
                    file_format: str = "parquet", available_now: bool = True, is_complete=None, run_col: str = "run_id", **cycle_kw):
    """Stream posting files from ``landing_dir/run_id=<run>/`` through the cycle, one cycle for
    each run, however many files and micro-batches it comes in."""
    stream = spark.readStream.format(file_format).schema(schema).load(landing_dir)
    handler = cycle_batch_handler(state_root, is_complete or landed_whole(landing_dir, run_col), run_col=run_col, **cycle_kw)
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


# --- R2 -----------------------------------------------------------------------------------------

LIFECYCLE_OUTPUT = "entity_id string, status string, at timestamp, sightings long"
LIFECYCLE_STATE = ("status string, last_us long, sightings long, "
                   "begins array<long>, ends array<long>, counts array<long>, firsts array<long>")


def merge_presence(open_: list[tuple], times, gap_us: int) -> list[tuple]:
    """Presence intervals (begin, end, sightings, sightings at begin), in order, after adding the
    sighting times; intervals no more than ``gap_us`` apart are one."""
    import numpy as np

    t = np.sort(np.asarray(times, dtype=np.int64))
    cut = np.flatnonzero(np.diff(t) > gap_us) + 1
    starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
    new = [(int(t[s]), int(t[e - 1]), int(e - s), int(np.searchsorted(t, t[s], "right") - s)) for s, e in zip(starts, stops)] if len(t) else []
    out: list[tuple] = []
    for b, e, n, first in sorted(open_ + new):
        if out and b - out[-1][1] <= gap_us:
            pb, pe, pn, pf = out[-1]
            out[-1] = (pb, max(pe, e), pn + n, pf + (first if b == pb else 0))
        else:
            out.append((b, e, n, first))
    return out


def _lifecycle_fn(missing_us: int, close_us: int):
    """Only what the watermark has passed is final, so transitions are emitted up to the watermark
    and the rest waits in the state as presence intervals: the result does not depend on how the
    sightings were cut into files or micro-batches."""

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last, total, open_ = None, 0, 0, []
        if state.exists:
            status, last, total, *lists = state.get
            open_ = list(zip(*map(list, lists)))
        if not state.hasTimedOut:
            for pdf in pdfs:
                open_ = merge_presence(open_, pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy(), missing_us)
        wm = state.getCurrentWatermarkMs()
        out = []

        def passed(us: int) -> bool:
            return us < wm * 1000

        due = None
        while due is None:
            if status == "active":
                b, e, n, _ = open_[0]
                if not passed(e + missing_us):
                    due = e + missing_us
                    break
                open_.pop(0)
                status, last, total = "missing", e, total + n
                out.append(("missing", e + missing_us, total))
            elif status == "missing" and (not open_ or open_[0][0] > last + close_us):
                if not passed(last + close_us):
                    due = last + close_us
                    break
                status = "closed"
                out.append(("closed", last + close_us, total))
            elif open_:
                b, e, n, first = open_[0]
                if not passed(b):
                    due = b
                    break
                out.append(("reopened" if status == "closed" else "active", b, total + first))
                status = "active"
            else:
                break
        state.update((status, last, total, *([x[k] for x in open_] for k in range(4))))
        if due is not None:
            state.setTimeoutTimestamp(max(due // 1000, wm + 1))
        if out:
            yield pd.DataFrame({
                "entity_id": [key[0]] * len(out), "status": [x[0] for x in out],
                "at": pd.to_datetime([x[1] for x in out], unit="us"), "sightings": [x[2] for x in out]})

    return fn


def entity_lifecycle(sightings: DataFrame, missing_after: str = "3 days", close_after: str = "14 days",
                     watermark: str = "1 day", entity: str = "entity_id", ts: str = "ts") -> DataFrame:
    """R2: the transitions of each entity up to the watermark: ``active`` at a first sighting or one
    after being missing, ``missing`` once it has not been seen for more than ``missing_after``,
    ``closed`` for more than ``close_after`` (both from the last sighting), ``reopened`` at a
    sighting after that. ``at`` is when the transition is due, ``sightings`` those up to then."""
    def us(interval: str) -> int:
        return int(pd.Timedelta(interval).total_seconds() * 1_000_000)

    s = sightings.select(F.col(entity).alias("entity_id"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return s.groupBy("entity_id").applyInPandasWithState(
        _lifecycle_fn(us(missing_after), us(close_after)), LIFECYCLE_OUTPUT, LIFECYCLE_STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )


# --- R3 / R4 --------------------------------------------------------------------------------------


def run_window_counts(sightings: DataFrame, key: str, every: str = "6 hours", watermark: str = "1 day",
                      ts: str = "ts") -> DataFrame:
    """Per run window and key, the number of sightings (append after the watermark)."""
    return (sightings.withWatermark(ts, watermark)
            .groupBy(F.window(ts, every).alias("w"), key).agg(F.count(F.lit(1)).alias("observations"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "observations"))


def presence_sessions(sightings: DataFrame, gap: str = "3 days", watermark: str = "1 day",
                      entity: str = "entity_id", ts: str = "ts") -> DataFrame:
    """Presence sessions per entity (session windows)."""
    return (sightings.withWatermark(ts, watermark)
            .groupBy(entity, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("observations"))
            .select(entity, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "observations"))


# --- R5 -------------------------------------------------------------------------------------------


def split_late(batch: DataFrame, watermark_ts, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(on-time rows, late rows) of a micro-batch given the running watermark; late rows are
    kept in a side table rather than dropped."""
    wm = F.lit(str(watermark_ts)).cast("timestamp")
    late = F.col(ts).cast("timestamp") < wm if watermark_ts is not None else F.lit(False)
    return batch.where(~late), batch.where(late)


def late_aware_sink(main_path: str, late_path: str, lateness: str = "1 day", ts: str = "ts"):
    """foreachBatch function for R5: rows older than (latest event time of earlier batches -
    lateness) go to ``late_path``. Each batch writes paths of its own, its latest event time among
    them, so a replay of a batch writes the same again."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{main_path}/_max_event_time"
        fs, p = ST._fs(spark, marks)
        seen = spark.read.parquet(marks).where(F.col("batch_id") < batch_id).agg(F.max("m")).first()[0] if fs.exists(p) else None
        wm = None if seen is None else (pd.Timestamp(seen) - pd.Timedelta(lateness)).to_pydatetime()
        on_time, late = split_late(batch, wm, ts)
        on_time.write.mode("overwrite").parquet(f"{main_path}/rows/batch_id={batch_id}")
        late.write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        batch.agg(F.max(F.col(ts).cast("timestamp")).alias("m")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    return handle


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available (``availableNow``) into a Parquet
    table and return that table as a batch DataFrame. In ``complete`` mode every micro-batch
    rewrites the table (foreachBatch overwrite)."""
    spark = df.sparkSession
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        q = w.outputMode("complete").foreachBatch(
            lambda b, i: b.write.mode("overwrite").parquet(sink)).start()
    else:
        q = w.outputMode("append").format("parquet").option("path", sink).start()
    q.awaitTermination()
    return spark.read.parquet(sink)


def sightings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table of a driver directory (one file or a folder of part files) as a stream of
    sightings."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    fs, p = ST._fs(spark, f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(schema)
    raw = (reader.parquet(f"{sf_dir}/events.parquet") if fs.getFileStatus(p).isDirectory()
           else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir))  # a stream reads folders
    return raw.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("entity_id"),
                      "ts", "event_id", "event_type")
