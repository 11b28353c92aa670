"""Versioned entity state.

Layout under a state root (any Hadoop-compatible path):

* ``entities/snapshot_ts=<yyyyMMdd-HHmmss-ffffff>/`` - one full Parquet version per cycle;
  a snapshot *is* a version, so creating one costs nothing extra;
* ``observations/`` - the append-only observation log (Parquet, partitioned by run);
* ``_current/`` - a one-line text table naming the current version.

A version is never overwritten in place: a write goes to a new partition and the pointer
flips afterwards, so readers of the previous version are never disturbed and a failed
write leaves the previous version current.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.metrics import observation_stats
from tidewatch.operators.validate import SCHEMA_VERSION, dedupe_last_wins, record_violations, split_valid

SNAPSHOT_FORMAT = "%Y%m%d-%H%M%S-%f"
DEFAULT_MAX_VERSIONS = 30
DEFAULT_RETENTION_DAYS = 180

# Archive columns.
ARCHIVE_COLUMNS = ["id", "company_id", "company_name", "title", "location", "signature", "classification",
                   "first_seen", "last_seen"]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def snapshot_name(ts: datetime) -> str:
    return ts.strftime(SNAPSHOT_FORMAT)


def write_state(entities: DataFrame, root: str, ts: datetime, observations: DataFrame | None = None) -> str:
    """S7 + S12: write a new version, then commit it with a marker of its own. The newest
    committed version is the current one; nothing that readers use is ever overwritten, and a
    version without marker does not exist for them. Returns the snapshot name."""
    spark = entities.sparkSession
    name = snapshot_name(ts)
    (entities.withColumn("schema_version", F.lit(SCHEMA_VERSION))
     .write.mode("overwrite").parquet(f"{root}/entities/snapshot_ts={name}"))
    if observations is not None:
        observations.write.mode("overwrite").parquet(f"{root}/observations/run={name}")
    mark_committed(spark, root, name)
    return name


def mark_committed(spark: SparkSession, root: str, name: str) -> None:
    fs, p = _fs(spark, f"{root}/_committed/{name}")
    fs.create(p, True).close()


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed versions, oldest first (file names only)."""
    fs, p = _fs(spark, f"{root}/_committed")
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """The newest committed version; None for a new root. Versions without any commit are an
    error, not an empty state."""
    names = committed(spark, root)
    fs, p = _fs(spark, f"{root}/entities")
    if not names and fs.exists(p) and fs.listStatus(p):
        raise RuntimeError(f"{root} has versions but none is committed")
    return names[-1] if names else None


def read_state(spark: SparkSession, root: str, snapshot: str | None = None,
               quarantine: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Read a version, validate each row (F6), de-duplicate ids (last wins, first
    position kept). Returns valid rows (and the quarantine when asked)."""
    name = snapshot or current_snapshot(spark, root)
    if name is None:
        raise FileNotFoundError(f"no state at {root}")
    df = spark.read.parquet(f"{root}/entities/snapshot_ts={name}").drop("schema_version")
    valid, bad = split_valid(df, record_violations(df))
    valid = dedupe_last_wins(valid).select(*df.columns)
    return (valid, bad) if quarantine else valid


COLLECTION_SCHEMA = (
    "version string, generated_at string, job_count bigint, jobs array<struct<id: string, company_id: string, company_name: string, "
    "title: string, location: string, url: string, signature: string, classification: string, classification_reasoning: string, "
    "status: string, first_seen: string, last_seen: string, source_identifier: string, department: string, description: string, "
    "observations: array<struct<timestamp: string, source_identifier: string, url: string, note: string>>, created_at: string, updated_at: string>>"
)


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S6 on JSON collections (one ``{version, generated_at, jobs[]}`` document per file):
    (valid records, quarantine with ``violations``, documents). A document says whether it could
    be read and whether its version is the expected one; another version is still read. Duplicate
    ids of a document: the last wins, the first position is kept."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("collection"), F.try_parse_json("value").isNotNull().alias("readable"),
        F.from_json("value", COLLECTION_SCHEMA).alias("d"))
    about = docs.select(
        "collection", "readable", "d.version", (F.coalesce("d.version", F.lit("unknown")) == SCHEMA_VERSION).alias("version_ok"),
        "d.generated_at", F.coalesce(F.size("d.jobs"), F.lit(0)).cast("bigint").alias("jobs"))
    rows = docs.where("readable").select("collection", F.posexplode("d.jobs").alias("entity_seq", "j")).select(
        "collection", F.col("entity_seq").cast("bigint"), "j.*")
    rows = rows.withColumns({c: F.try_to_timestamp(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen", "created_at", "updated_at")})
    valid, bad = split_valid(rows, record_violations(rows))
    keyed = valid.withColumn("_key", F.struct("collection", "id"))
    once = dedupe_last_wins(keyed, "_key").select(*rows.columns)
    return once, bad, about


def write_collection(entities: DataFrame, path: str, generated_at: str) -> None:
    """S7 on JSON: one record a line below an envelope table, as S11 does for applications."""
    entities.write.mode("overwrite").json(f"{path}/jobs")
    entities.agg(F.count(F.lit(1)).alias("job_count")).select(
        F.lit(SCHEMA_VERSION).alias("version"), F.lit(generated_at).alias("generated_at"), "job_count").coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Name, job_count, size in bytes, version of the committed versions; newest first. Only
    their folders are read; sizes come from file metadata, the counts read the version column."""
    names = committed(spark, root)
    if not names:
        return spark.createDataFrame([], "snapshot_ts string, job_count bigint, version string, size_bytes bigint")
    df = spark.read.option("basePath", f"{root}/entities").parquet(*[f"{root}/entities/snapshot_ts={n}" for n in names]).withColumn(
        "snapshot_ts", F.col("snapshot_ts").cast("string"))
    files = df.select("snapshot_ts", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("sz"))
    sizes = files.distinct().groupBy("snapshot_ts").agg(F.sum("sz").alias("size_bytes"))
    counts = df.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("job_count"), F.max("schema_version").alias("version"))
    return counts.join(sizes, "snapshot_ts").orderBy(F.col("snapshot_ts").desc())


def snapshots_to_rotate(snapshots: DataFrame, max_versions: int = DEFAULT_MAX_VERSIONS, key: str = "snapshot_ts") -> DataFrame:
    """S14 plan: the snapshots beyond the newest ``max_versions``. Input is the *distinct*
    snapshot list (one row per version), so the global ranking is over a tiny table."""
    w = Window.orderBy(F.col(key).desc())
    return snapshots.select(key).distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > max_versions).drop("_rn")


def rotate_snapshots(spark: SparkSession, root: str, max_versions: int = DEFAULT_MAX_VERSIONS) -> int:
    """Delete the versions beyond the newest N (never the current one), each marker first."""
    names = committed(spark, root)
    old = names[:-max_versions] if max_versions > 0 else names[:-1]
    for n in old:
        for path in (f"{root}/_committed/{n}", f"{root}/entities/snapshot_ts={n}"):
            fs, p = _fs(spark, path)
            fs.delete(p, True)
    return len(old)


def restore_snapshot(spark: SparkSession, root: str, name: str, ts: datetime) -> bool:
    """The named version becomes current as a *new* version (the version being
    replaced stays as its own snapshot, which is the backup). False if absent."""
    fs, p = _fs(spark, f"{root}/entities/snapshot_ts={name}")
    if not fs.exists(p):
        return False
    df = spark.read.parquet(f"{root}/entities/snapshot_ts={name}").drop("schema_version")
    write_state(df, root, ts)
    return True


#: What Spark says of a file that is no Parquet file; other errors say nothing about the data.
CORRUPT = ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "Could not read footer")


def cleanup_corrupted(spark: SparkSession, root: str) -> int:
    """Drop versions whose files are no Parquet files. The current version is never
    dropped, and any other error (permissions, network) is raised."""
    fs, base = _fs(spark, f"{root}/entities")
    current, cleaned = current_snapshot(spark, root), 0
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if not name.startswith("snapshot_ts=") or name == f"snapshot_ts={current}":
            continue
        try:
            spark.read.parquet(st.getPath().toString()).count()
        except Exception as error:
            if not any(text in str(error) for text in CORRUPT):
                raise
            marker_fs, marker = _fs(spark, f"{root}/_committed/{name.removeprefix('snapshot_ts=')}")
            marker_fs.delete(marker, False)
            fs.delete(st.getPath(), True)
            cleaned += 1
    return cleaned


def archive_split(entities: DataFrame, now, retention_days: int = DEFAULT_RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """S17 plan: (archive rows with ``archive_month`` and ``archived_at``, remaining rows):
    ``closed`` and last_seen strictly before now - retention."""
    now_c = F.lit(str(now)).cast("timestamp_ntz")
    cond = (F.col("status") == "closed") & (F.col("last_seen") < now_c - F.make_dt_interval(F.lit(retention_days)))
    tagged = entities.withColumn("_arch", F.coalesce(cond, F.lit(False)))
    archived = tagged.where("_arch").select(
        *ARCHIVE_COLUMNS, now_c.alias("archived_at"), F.date_format("last_seen", "yyyy-MM").alias("archive_month")
    )
    return archived, tagged.where(~F.col("_arch")).drop("_arch")


def archive_old(entities: DataFrame, root: str, now, retention_days: int = DEFAULT_RETENTION_DAYS, run: str | None = None) -> DataFrame:
    """Write the archive rows to ``archive/run=<run>/archive_month=YYYY-MM`` and return the
    remaining state (to be written as the next version). The run (by default the clock) has a folder
    of its own, so a repeated call writes the same rows over again."""
    archived, remaining = archive_split(entities, now, retention_days)
    run = run or re.sub("[^0-9]", "", str(now))
    archived.write.mode("overwrite").partitionBy("archive_month").parquet(f"{root}/archive/run={run}")
    return remaining


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """The archive rows of all runs, each id once: the run that archived it last."""
    rows = spark.read.parquet(f"{root}/archive")
    w = Window.partitionBy("id").orderBy(F.col("archived_at").desc(), F.col("run").cast("string").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "run")


# Schema migrations, a registry of DataFrame -> DataFrame functions keyed (from, to).
MIGRATIONS: dict[tuple[str, str], callable] = {}


def register_migration(src: str, dst: str):
    def deco(fn):
        MIGRATIONS[(src, dst)] = fn
        return fn
    return deco


def migrate(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Apply the registered migration and stamp the version; unknown pair -> error."""
    fn = MIGRATIONS.get((src, dst))
    if fn is None:
        raise KeyError(f"no migration registered from {src} to {dst}")
    return fn(df).withColumn("schema_version", F.lit(dst))


def validate_migration(df: DataFrame, expected: str) -> DataFrame:
    return df.agg(F.bool_and(F.col("schema_version") == expected).alias("ok"))


# A5 kept up to date: a table of per-entity statistics into which runs of the log are folded.


def fold_observation_stats(log_of_run: DataFrame, root: str, run: str) -> None:
    """Fold one run's observations into the statistics under ``root``. Only the run's rows and the
    statistics so far are read, never the log; minimum, maximum and count can be merged in any order, so late
    runs are welcome, and a run that was folded before is left as it is. Each fold writes a version
    of its own, which counts once its marker is there."""
    spark = log_of_run.sparkSession
    names = committed(spark, root)
    part = observation_stats(log_of_run)
    runs = spark.createDataFrame([(run,)], "run string")
    if names:
        done = spark.read.parquet(f"{root}/runs/version={names[-1]}")
        if not done.where(F.col("run") == run).isEmpty():
            return
        runs = runs.unionByName(done)
        part = part.unionByName(spark.read.parquet(f"{root}/stats/version={names[-1]}")).groupBy("entity_id").agg(
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("observation_count").alias("observation_count"))
    name = f"{int(names[-1]) + 1 if names else 1:012d}"
    part.write.mode("overwrite").parquet(f"{root}/stats/version={name}")
    runs.write.mode("overwrite").parquet(f"{root}/runs/version={name}")
    mark_committed(spark, root, name)


def read_observation_stats(spark: SparkSession, root: str) -> DataFrame:
    """The statistics over all folded runs: entity_id, first_seen, last_seen, observation_count."""
    names = committed(spark, root)
    if not names:
        raise FileNotFoundError(f"{root} has no folded run")
    return spark.read.parquet(f"{root}/stats/version={names[-1]}")
