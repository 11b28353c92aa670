"""Aggregations and ranking over decisions, state and the observation log (A1-A8, W2, R3/R4
in batch form). All are partial (map-side) aggregations except the per-entity gap, which is
a window partitioned by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_summary(decisions: DataFrame, entities: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A1: per company: jobs fetched / classified and counts by the *stored* classification
    of the record each posting resolved to (what the reference counts), plus the decision
    counts. ``sources`` (company_id, source_url) gives sources_processed."""
    d = decisions.join(entities.select(F.col("id").alias("entity_id"), "classification"), "entity_id", "left")
    out = d.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("jobs_fetched"),
        F.count("entity_id").alias("jobs_classified"),
        F.count_if(F.col("classification") == "new").alias("new_jobs"),
        F.count_if(F.col("classification") == "repost").alias("repost_jobs"),
        F.count_if(F.col("classification") == "existing").alias("existing_jobs"),
        F.count_if(F.col("decision") == "existing").alias("decided_existing"),
        F.count_if(F.col("decision") == "repost").alias("decided_repost"),
        F.count_if(F.col("decision") == "reopened").alias("decided_reopened"),
        F.count_if(F.col("decision") == "new").alias("decided_new"),
    )
    if sources is not None:
        out = out.join(sources.groupBy("company_id").agg(F.count(F.lit(1)).alias("sources_processed")), "company_id", "left")
    return out


def run_totals(summary: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """A2: totals over the per-company summary. ``failed`` has a row (company_id) for each company
    whose sources or configuration failed, as often as they did; such a company counts once, and as
    failed even if another of its sources gave postings."""
    ok = summary.select("company_id", "jobs_fetched", "jobs_classified", F.lit(0).alias("bad"))
    rows = ok if failed is None else ok.unionByName(failed.select(
        "company_id", F.lit(0).cast("bigint").alias("jobs_fetched"), F.lit(0).cast("bigint").alias("jobs_classified"), F.lit(1).alias("bad")))
    each = rows.groupBy("company_id").agg(
        F.sum("jobs_fetched").alias("jobs_fetched"), F.sum("jobs_classified").alias("jobs_classified"), F.max("bad").alias("bad"))
    return each.agg(
        F.count(F.lit(1)).alias("companies_processed"),
        F.count_if(F.col("bad") == 0).alias("companies_succeeded"),
        F.count_if(F.col("bad") == 1).cast("int").alias("companies_failed"),
        F.sum("jobs_fetched").alias("jobs_fetched"),
        F.sum("jobs_classified").alias("jobs_classified"),
    )


def run_report(decisions: DataFrame, entities: DataFrame, started, finished, failed: DataFrame | None = None) -> DataFrame:
    """A1 + A2 in one pass: a row for each company (level ``company``) and one for the run (level
    ``run``, without company id) from one ROLLUP. ``failed`` has a row (company_id) for each failure;
    a company counts once, and as failed even if another of its sources gave postings.
    ``duration_seconds`` is that of the run on every row."""
    d = decisions.join(entities.select(F.col("id").alias("entity_id"), "classification"), "entity_id", "left").select(
        "company_id", "entity_id", "classification", "decision", F.lit(False).alias("bad"))
    if failed is not None:
        none = F.lit(None).cast("string")
        d = d.unionByName(failed.select("company_id", none.alias("entity_id"), none.alias("classification"), none.alias("decision"), F.lit(True).alias("bad")))
    seconds = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{started}', TIMESTAMP_NTZ '{finished}') / 1000000.0D")
    counts = [F.count_if(F.col(c) == x).alias(n) for n, c, x in (
        *((f"{x}_jobs", "classification", x) for x in ("new", "repost", "existing")),
        *((f"decided_{x}", "decision", x) for x in ("existing", "repost", "reopened", "new")))]
    rolled = d.rollup("company_id").agg(
        F.grouping_id().alias("gid"), F.countDistinct("company_id").alias("companies_processed"),
        F.countDistinct(F.when(F.col("bad"), F.col("company_id"))).alias("companies_failed"),
        F.count_if(~F.col("bad")).alias("jobs_fetched"), F.count("entity_id").alias("jobs_classified"), *counts)
    return rolled.select(
        F.when(F.col("gid") == 1, "run").otherwise("company").alias("level"), *[c for c in rolled.columns if c != "gid"], seconds.alias("duration_seconds"))


def lifecycle_counts(lifecycle: DataFrame) -> DataFrame:
    """A3: records marked missing / closed by the lifecycle step."""
    return lifecycle.agg(
        F.count_if((F.col("status_before") == "active") & (F.col("status_after").isin("missing", "closed"))).alias("marked_missing"),
        F.count_if((F.col("status_before") != "closed") & (F.col("status_after") == "closed")).alias("closed"),
    )


def observation_stats(log: DataFrame, entity: str = "entity_id", ts: str = "ts") -> DataFrame:
    """A5: first_seen / last_seen / observation_count per entity from the log."""
    return log.groupBy(entity).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("observation_count")
    )


#: Length of a time bucket in which an entity's observations are ordered together.
BUCKET = "7 days"


def _bucketed(log: DataFrame, ts: str, bucket: str) -> DataFrame:
    return log.withColumn("_bucket", F.window(F.col(ts).cast("timestamp"), bucket)["start"])


def gap_since_previous(log: DataFrame, entity: str = "entity_id", ts: str = "ts", tiebreak: str = "event_id", bucket: str = BUCKET) -> DataFrame:
    """Seconds since the entity's previous observation (NULL for the first). A segmented scan:
    lag inside (entity, time bucket), and the first observation of a bucket takes the last of the
    entity's bucket before, so no task orders more than a bucket of one entity."""
    rows = _bucketed(log, ts, bucket).select(entity, ts, tiebreak, "_bucket")
    w = Window.partitionBy(entity, "_bucket").orderBy(ts, tiebreak)
    inside = rows.withColumn("_prev", F.lag(ts).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = rows.groupBy(entity, "_bucket").agg(F.max(ts).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(entity).orderBy("_bucket"))).drop("_last")
    # null-safe: an observation without entity or time has a bucket of its own kind
    same = F.col("i._bucket").eqNullSafe(F.col("b._bucket")) & F.col(f"i.{entity}").eqNullSafe(F.col(f"b.{entity}"))
    told = inside.alias("i").join(before.alias("b"), same, "left").select(
        F.col(f"i.{entity}").alias(entity), F.col(f"i.{ts}").alias(ts), F.col(f"i.{tiebreak}").alias(tiebreak),
        F.when(F.col("i._first"), F.col("b._before")).otherwise(F.col("i._prev")).alias("_prev"))
    return told.select(entity, ts, tiebreak, (F.expr(f"timestampdiff(MICROSECOND, _prev, {ts})") / F.lit(1000000.0)).alias("gap_seconds"))


def presence_sessions(log: DataFrame, gap: str = "3 days", entity: str = "entity_id", ts: str = "ts", bucket: str = BUCKET) -> DataFrame:
    """R4 (batch): presence sessions per entity, a new session after a silence longer than ``gap``,
    as ``session_window`` cuts them on a stream. Sessions are made inside time buckets first; then
    those of neighbouring buckets that touch are joined, a few rows for each bucket of an entity."""
    parts = _bucketed(log, ts, bucket).groupBy(entity, "_bucket", F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(
        entity, F.col("s.start").alias("_start"), F.col("s.end").alias("_end"), "n")
    w = Window.partitionBy(entity).orderBy("_start", "_end")
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("_start") > reach).cast("int"), F.lit(1))
    numbered = parts.withColumn("_apart", apart).withColumn("_session", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(entity, "_session").agg(
        F.min("_start").alias("session_start"), F.max("_end").alias("session_end"), F.sum("n").alias("observations")).drop("_session")


def run_window_counts(log: DataFrame, key: str, every: str = "6 hours", ts: str = "ts") -> DataFrame:
    """R3 (batch): observation counts per tumbling run window."""
    return log.groupBy(F.window(ts, every).alias("w"), key).agg(F.count(F.lit(1)).alias("observations")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "observations"
    )


def evaluate(labelled: DataFrame, truth: str = "expected", pred: str = "predicted") -> DataFrame:
    """Confusion counts and rates over labelled pairs (truth/prediction booleans)."""
    t, p = F.col(truth).cast("boolean"), F.col(pred).cast("boolean")
    agg = labelled.agg(
        F.count_if(t & p).alias("true_positives"),
        F.count_if(~t & p).alias("false_positives"),
        F.count_if(t & ~p).alias("missed"),
        F.count_if(~t & ~p).alias("true_negatives"),
        F.count_if(t).alias("expected_positive"),
        F.count_if(~t).alias("expected_negative"),
    )
    return agg.select(
        "*",
        F.when(F.col("expected_positive") > 0, F.col("true_positives") / F.col("expected_positive")).otherwise(0.0).alias("detection_rate"),
        F.when(F.col("expected_negative") > 0, F.col("false_positives") / F.col("expected_negative")).otherwise(0.0).alias("false_positive_rate"),
        F.when(F.col("expected_negative") > 0, F.col("true_negatives") / F.col("expected_negative")).otherwise(0.0).alias("new_accuracy"),
    )


def classification_stability(log: DataFrame, entity: str = "entity_id", ts: str = "ts") -> DataFrame:
    """Entities first seen per run (day): the growth of 'new' per run."""
    first = log.groupBy(entity).agg(F.min(ts).alias("first_ts"))
    return first.groupBy(F.to_date("first_ts").alias("run_date")).agg(F.count(F.lit(1)).alias("new_entities"))


def decisions_per_run(log: DataFrame, entity: str = "entity_id", ts: str = "ts") -> DataFrame:
    """Per run (day) how many of the entities it saw are new and how many existing: with stable
    ids the share of new ones falls."""
    seen = log.groupBy(F.col(entity).alias("e"), F.to_date(ts).alias("run_date")).agg(F.count(F.lit(1)).alias("n"))
    first = seen.groupBy("e").agg(F.min("run_date").alias("first_run"))
    return seen.join(first, "e").groupBy("run_date").agg(
        F.count_if(F.col("run_date") == F.col("first_run")).alias("decided_new"),
        F.count_if(F.col("run_date") > F.col("first_run")).alias("decided_existing"))


def volume_alert(df: DataFrame, key: str = "company_id", threshold: int = 10) -> DataFrame:
    """Per key row count and whether it falls below the alert threshold."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("job_count")).withColumn(
        "alert", F.col("job_count") < F.lit(threshold)
    )
