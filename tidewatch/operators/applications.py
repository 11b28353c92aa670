"""Application tracking as table merges.

The browser-side mutations become change feeds applied with joins and aggregations:
adds are unions with defaults, updates are last-writer-wins per field, deletes are
anti-joins against tombstones, follow-ups live in a long table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.views import needs_follow_up_flag

DEFAULT_STAGE = "applied"
DEFAULT_FOLLOW_UP_TYPE = "follow-up"
UPDATABLE = ["applied_date", "stage", "notes", "contact_person", "referral_source", "salary_info", "next_follow_up"]


def add_applications(adds: DataFrame, today: str) -> DataFrame:
    """Defaults applied_date = today, stage = 'applied', notes = '', optional fields NULL
    when empty; ``follow_up_count`` starts at 0."""
    def opt(c):
        return F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c))

    return adds.select(
        "id", "job_id",
        F.coalesce(F.col("applied_date"), F.to_date(F.lit(today))).alias("applied_date"),
        F.coalesce(F.when(F.col("stage") == "", None).otherwise(F.col("stage")), F.lit(DEFAULT_STAGE)).alias("stage"),
        F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
        opt("contact_person").alias("contact_person"),
        opt("referral_source").alias("referral_source"),
        opt("salary_info").alias("salary_info"),
        "next_follow_up", "created_at", "updated_at",
    )


def apply_updates(apps: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` = (id, op_seq, op_ts, <field columns, NULL = not given>). Per id and
    field the latest given value wins (``max_by`` over non-null values, partial
    aggregation); ``updated_at`` = latest op_ts. Updates of unknown ids are ignored."""
    fields = [c for c in UPDATABLE if c in updates.columns]
    agg = updates.groupBy("id").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("op_seq"))).alias("u_" + c) for c in fields],
        F.max("op_ts").alias("u_updated_at"),
    )
    j = apps.join(agg, "id", "left")
    return j.select(
        *[F.coalesce(F.col("u_" + c), F.col(c)).alias(c) if c in fields else F.col(c) for c in apps.columns if c != "updated_at"],
        F.coalesce(F.col("u_updated_at"), F.col("updated_at")).alias("updated_at"),
    ).select(*apps.columns)


def add_follow_ups(apps: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """Keep follow-ups of existing applications only (semi-join), default type and notes."""
    return follow_ups.join(apps.select(F.col("id").alias("application_id")), "application_id", "left_semi").select(
        "application_id", "seq", "timestamp",
        F.coalesce(F.col("type"), F.lit(DEFAULT_FOLLOW_UP_TYPE)).alias("type"),
        F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
    )


def delete_applications(apps: DataFrame, tombstones: DataFrame) -> DataFrame:
    """T4: remove by id (anti-join against the distinct tombstone ids)."""
    return apps.join(tombstones.select("id").distinct(), "id", "left_anti")


def application_by_job(apps: DataFrame, order: str = "created_at") -> DataFrame:
    """T5: the first application per job (``min_by`` on creation order, then id)."""
    return apps.groupBy("job_id").agg(
        F.min_by("id", F.struct(F.col(order), F.col("id"))).alias("application_id"), F.count(F.lit(1)).alias("applications")
    )


def next_reminder(apps: DataFrame, follow_ups: DataFrame, days: int = 7) -> DataFrame:
    """Next due date = later of the last follow-up date and the applied date, + N days."""
    last = follow_ups.groupBy("application_id").agg(F.max("timestamp").alias("last_follow_up"))
    j = apps.join(last.withColumnRenamed("application_id", "id"), "id", "left")
    base = F.greatest(F.to_date("last_follow_up"), F.col("applied_date"))
    return j.select("id", "job_id", "applied_date", "last_follow_up", F.date_add(base, days).alias("next_due"))


def needs_follow_up(apps: DataFrame, as_of: str) -> DataFrame:
    """F9 as a filter."""
    return apps.where(needs_follow_up_flag(F.col("next_follow_up"), as_of))


def filter_stage(apps: DataFrame, stage: str | None) -> DataFrame:
    """F4 (applications): stage equality, skipped when empty."""
    return apps.where(F.col("stage") == stage) if stage else apps


def sort_by_applied(apps: DataFrame) -> DataFrame:
    """O3 (applications): by applied date, oldest first, then id."""
    return apps.orderBy(F.col("applied_date"), F.col("id"))
