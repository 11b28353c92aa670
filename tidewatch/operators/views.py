"""View queries over the entity state.

All are declarative filters/joins/sorts, so Catalyst pushes the filters into the scan and
prunes columns; sorts are distributed range sorts (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DESCRIPTION_LIMIT = 500
SORT_KEYS = ("last_seen", "first_seen", "oldest", "company", "title")


def filter_jobs(df: DataFrame, company: str | None = None, status: str | None = None,
                search: str | None = None) -> DataFrame:
    """Equality on company / status (skipped when empty); case-insensitive substring
    search over title OR company_name OR location."""
    if company:
        df = df.where(F.col("company_id") == company)
    if status:
        df = df.where(F.col("status") == status)
    if search:
        s = F.lit(search.lower())
        df = df.where(
            F.lower("title").contains(s) | F.lower("company_name").contains(s) | F.lower("location").contains(s)
        )
    return df


def filter_extra(df: DataFrame, classification: str | None = None, first_seen_from=None, first_seen_to=None,
                 last_seen_from=None, last_seen_to=None) -> DataFrame:
    """classification equality and inclusive date ranges on first_seen / last_seen."""
    if classification:
        df = df.where(F.col("classification") == classification)
    for col, lo, hi in (("first_seen", first_seen_from, first_seen_to), ("last_seen", last_seen_from, last_seen_to)):
        if lo is not None:
            df = df.where(F.col(col) >= F.lit(lo).cast("timestamp_ntz"))
        if hi is not None:
            df = df.where(F.col(col) <= F.lit(hi).cast("timestamp_ntz"))
    return df


def sort_jobs(df: DataFrame, sort_by: str | None, seq: str = "entity_seq") -> DataFrame:
    """O1/O2: newest first for last_seen / first_seen; locale-aware ascending for company /
    title (UNICODE collation); stable on insertion order; unknown keys keep the order."""
    if sort_by in ("last_seen", "first_seen"):
        return df.orderBy(F.col(sort_by).desc(), F.col(seq))
    if sort_by in ("oldest", "first_seen_asc"):
        return df.orderBy(F.col("first_seen"), F.col(seq))
    if sort_by == "company":
        return df.orderBy(F.collate(F.col("company_name"), "UNICODE"), F.col(seq))
    if sort_by == "title":
        return df.orderBy(F.collate(F.col("title"), "UNICODE"), F.col(seq))
    return df.orderBy(F.col(seq))


def lookup_by_id(df: DataFrame, entity_id: str, seq: str = "entity_seq") -> DataFrame:
    """the first record with the id (by insertion order)."""
    return df.where(F.col("id") == entity_id).orderBy(seq).limit(1)


def has_application(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Adds ``has_application`` via a left join to the distinct applied job ids."""
    applied = applications.select(F.col("job_id").alias("id")).distinct().withColumn("has_application", F.lit(True))
    return jobs.join(applied, "id", "left").withColumn("has_application", F.coalesce("has_application", F.lit(False)))


def active_unapplied(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """open (not closed) records without an application (anti-join)."""
    return jobs.where(F.col("status") != "closed").join(
        applications.select(F.col("job_id").alias("id")), "id", "left_anti"
    )


def needs_follow_up_flag(next_follow_up: Column, as_of: str) -> Column:
    """F9 flag: next_follow_up set and on/before the as-of date."""
    return next_follow_up.isNotNull() & (next_follow_up <= F.to_date(F.lit(as_of)))


def application_cards(applications: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Inner join application -> job (orphans vanish) with the follow-up flag."""
    j = jobs.select(F.col("id").alias("job_id"), "title", "company_name", "url")
    return applications.join(j, "job_id", "inner").withColumn(
        "needs_follow_up", needs_follow_up_flag(F.col("next_follow_up"), as_of)
    )


def truncate_description(desc: Column, limit: int = DESCRIPTION_LIMIT) -> Column:
    return F.when(F.length(desc) > limit, F.concat(F.substring(desc, 1, limit), F.lit("..."))).otherwise(desc)


def job_detail(jobs: DataFrame, observations: DataFrame, applications: DataFrame, last_n: int = 3,
               entity_key: str = "entity_id", ts: str = "timestamp") -> DataFrame:
    """Observation count (0 when none), the newest ``last_n`` observation timestamps
    (newest first), description cut to 500 chars + '...', has_application flag.

    The observation log is pre-aggregated per entity before it meets the job table: the count
    by partial aggregation, the newest ``last_n`` by ``row_number() <= n`` as a plain filter,
    which Spark plans as a window group limit (a partial top-n before the shuffle), so even an
    entity with a huge log ships at most n rows per input partition."""
    counts = observations.groupBy(entity_key).agg(F.count(F.lit(1)).alias("observation_count"))
    w = Window.partitionBy(entity_key).orderBy(F.col(ts).desc())
    top = observations.select(entity_key, ts).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last_n)
    recent = top.groupBy(entity_key).agg(F.sort_array(F.collect_list(F.struct(F.col("_rn"), F.col(ts)))).alias("_recent"))
    stats = counts.join(recent, entity_key, "left")
    out = (
        jobs.join(stats.withColumnRenamed(entity_key, "id"), "id", "left")
        .withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
        .withColumn("recent_observations", F.transform(F.coalesce("_recent", F.array()), lambda s: s[ts]))
        .withColumn("description_short", truncate_description(F.col("description")))
        .drop("_recent")
    )
    return has_application(out, applications)


def distinct_companies(jobs: DataFrame, seq: str = "entity_seq") -> DataFrame:
    """A4: one row per company: the last-seen name (by insertion order) and the position of
    first appearance (partial aggregation; no window)."""
    return jobs.groupBy("company_id").agg(
        F.max_by("company_name", seq).alias("company_name"), F.min(seq).alias("first_position")
    )


DIFF_COLUMNS = ["company_id", "company_name", "title", "location", "url", "status", "classification",
                "first_seen", "last_seen", "source_identifier"]


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "id", columns=DIFF_COLUMNS) -> DataFrame:
    """Full outer join of two snapshots on the key; NULL-safe comparison per column.
    Returns key, change (added/removed/changed/unchanged) and the list of changed columns."""
    b = before.select(key, *[F.col(c).alias("b_" + c) for c in columns]).withColumn("_b", F.lit(True))
    a = after.select(key, *[F.col(c).alias("a_" + c) for c in columns]).withColumn("_a", F.lit(True))
    j = b.join(a, key, "full_outer")
    changed = F.filter(
        F.array(*[F.when(~F.col("b_" + c).eqNullSafe(F.col("a_" + c)), F.lit(c)) for c in columns]),
        lambda x: x.isNotNull(),
    )
    return j.select(
        key,
        F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
        .when(F.size(changed) > 0, "changed").otherwise("unchanged").alias("change"),
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), changed).otherwise(F.array().cast("array<string>"))
        .alias("changed_columns"),
    )
