"""Exports (S8-S11) and the application/company inputs.

Projections are plain ``select``s; writers use Spark's distributed CSV/JSON sinks (one file
per partition), never a driver-side collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.validate import VALID_ADAPTERS, validate_company_id

# Export headers.
CSV_COLUMNS = ["id", "company_id", "company_name", "title", "location", "department", "url", "classification",
               "status", "first_seen", "last_seen", "signature"]
VIEW_HEADERS = ["Company", "Title", "Location", "Status", "Classification", "First Seen", "Last Seen", "URL"]

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _iso(c):
    # Python isoformat(): microseconds only when non-zero
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, ISO))


def csv_rows(entities: DataFrame) -> DataFrame:
    """S8 projection: 12 columns, department NULL -> '', timestamps ISO text."""
    return entities.select(
        "id", "company_id", "company_name", "title", "location",
        F.coalesce(F.col("department"), F.lit("")).alias("department"),
        "url", "classification", "status",
        _iso(F.col("first_seen")).alias("first_seen"), _iso(F.col("last_seen")).alias("last_seen"), "signature",
    )


def export_csv(entities: DataFrame, path: str) -> bool:
    """Header + rows; nothing written (False) when there are no rows."""
    rows = csv_rows(entities)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def view_rows(view: DataFrame) -> DataFrame:
    """S9 projection: the 8 view columns (dates as ISO dates instead of a browser locale)."""
    return view.select(
        F.col("company_name").alias("Company"), F.col("title").alias("Title"), F.col("location").alias("Location"),
        F.col("status").alias("Status"), F.col("classification").alias("Classification"),
        F.date_format("first_seen", "yyyy-MM-dd").alias("First Seen"),
        F.date_format("last_seen", "yyyy-MM-dd").alias("Last Seen"), F.col("url").alias("URL"),
    )


def export_view_csv(view: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled."""
    (view_rows(view).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))


def export_view_json(view: DataFrame, path: str) -> None:
    """Full rows as JSON lines."""
    view.write.mode("overwrite").json(path)


def export_applications(apps: DataFrame, path: str, exported_at: str, version: str = "1.0.0") -> None:
    """Rows as JSON lines plus a one-row envelope table (version, exported_at, count),
    instead of one document holding every application."""
    apps.write.mode("overwrite").json(f"{path}/applications")
    apps.agg(F.count(F.lit(1)).alias("application_count")).select(
        F.lit(version).alias("version"), F.lit(exported_at).alias("exported_at"), "application_count"
    ).coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


APPLICATIONS_SCHEMA = (
    "version string, applications array<struct<id: string, job_id: string, applied_date: string, stage: string, "
    "notes: string, contact_person: string, referral_source: string, salary_info: string, "
    "follow_ups: array<struct<timestamp: string, type: string, notes: string>>, next_follow_up: string, "
    "created_at: string, updated_at: string>>"
)


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    """``{version, applications[]}`` documents -> rows; unreadable -> no rows."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", APPLICATIONS_SCHEMA).alias("d"))
    return docs.select(F.explode(F.coalesce(F.col("d.applications"), F.array())).alias("a")).select("a.*")


def company_problems(companies: DataFrame) -> DataFrame:
    """Watchlist rows with the first configuration problem (NULL = valid): required
    id/name/adapter/source url, adapter in the allowed set, id format (F7)."""
    cid = validate_company_id(F.col("id"))
    problem = (
        F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("invalid 'id' (must be non-empty string)"))
        .when(F.col("name").isNull(), F.lit("missing required field: name"))
        .when(F.col("adapter").isNull() | ~F.col("adapter").isin(*VALID_ADAPTERS), F.lit("invalid adapter"))
        .when(F.col("source_url").isNull() | (F.col("source_url") == ""), F.lit("must have at least one source"))
    )
    return companies.select("*", problem.alias("problem"), cid["is_valid"].alias("id_format_valid"), cid["error"].alias("id_format_error"))
