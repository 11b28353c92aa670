"""Domain-shaped inputs derived from the driver tables (see FIXTURES.md section 2).

Each function reads whole tables and derives rows with joins/projections only, so the work
of every query grows with the tables. The same derivations exist as DuckDB SQL in
``tidewatch.plans.oracles`` for the correctness gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.normalize import with_signature

# Fixed run clock of the fixtures (naive UTC).
FIXTURE_NOW = "2024-02-01 00:00:00"
FIXTURE_AS_OF = "1996-01-01"


def now_col(ts: str = FIXTURE_NOW):
    return F.lit(ts).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key``. A file is read by as many tasks as it has row groups, often one or
    two; normalising a title costs many times its reading."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def postings(spark: SparkSession, sf_dir: str, location: str = "region") -> DataFrame:
    """Raw postings: one per part; company = brand, title = name + type, location = region
    (or nation with ``location='nation'``); source id = part key; batch order = part key."""
    part = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    df = part.join(nation, F.pmod(part.p_size, F.lit(25)) == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    company_id = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")))
    return df.select(
        F.col("p_partkey").cast("bigint").alias("batch_seq"),
        company_id.alias("company_id"),
        F.col("p_brand").alias("company_name"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        (F.col("r_name") if location == "region" else F.col("n_name")).alias("location"),
        F.concat(F.lit("https://jobs.example.com/"), company_id, F.lit("/"), F.col("p_partkey")).alias("url"),
        F.col("p_partkey").cast("string").alias("source_identifier"),
        F.col("n_name").alias("department"),
        F.lit(None).cast("string").alias("description"),
    )


def _status_by_key(k):
    m = F.pmod(k, F.lit(7))
    return (
        F.when(m == 0, "closed").when(m == 1, "missing").when(m == 2, "reopened").otherwise("active")
    )


def entities0(spark: SparkSession, sf_dir: str, now: str = FIXTURE_NOW) -> DataFrame:
    """Known set before the cycle: postings with ``part key % 3 == 0`` (a split of the whole
    table, not a sample); status and last_seen derived from the key."""
    p = postings(spark, sf_dir).where(F.pmod("batch_seq", F.lit(3)) == 0)
    last_seen = now_col(now) - F.make_dt_interval(F.pmod("batch_seq", F.lit(60)))
    first_seen = now_col(now) - F.make_dt_interval(F.pmod("batch_seq", F.lit(30)) + F.lit(60))
    df = p.select(
        F.concat(F.lit("e-"), F.col("batch_seq")).alias("id"),
        F.col("batch_seq").alias("entity_seq"),
        "company_id", "company_name", "title", "location", "url",
        F.lit("new").alias("classification"),
        F.lit("New job posting (no previous match found)").alias("classification_reasoning"),
        _status_by_key(F.col("batch_seq")).alias("status"),
        first_seen.alias("first_seen"),
        last_seen.alias("last_seen"),
        "source_identifier", "department", "description",
        first_seen.alias("created_at"),
        last_seen.alias("updated_at"),
    )
    return with_signature(df)


def observations0(spark: SparkSession, sf_dir: str, now: str = FIXTURE_NOW) -> DataFrame:
    """Observation log of ``entities0``: the first sighting of each."""
    e = entities0(spark, sf_dir, now)
    return e.select(
        F.col("id").alias("entity_id"),
        F.col("first_seen").alias("timestamp"),
        F.lit(-1).cast("bigint").alias("batch_seq"),
        "source_identifier", "url",
        F.lit(None).cast("string").alias("note"),
    )


def batch1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of one cycle: every posting not in the known set (``part key % 3 != 0``)
    plus the known postings with an even key observed again under their own id; postings
    with ``part key % 11 == 0`` arrive without a source id."""
    p = postings(spark, sf_dir)
    k = F.col("batch_seq")
    keep = (F.pmod(k, F.lit(3)) != 0) | (F.pmod(k, F.lit(2)) == 0)
    sid = F.when(F.pmod(k, F.lit(11)) == 0, F.lit(None).cast("string")).otherwise(F.col("source_identifier"))
    return p.where(keep).withColumn("source_identifier", sid)


def customer_jobs(spark: SparkSession, sf_dir: str, now: str = FIXTURE_NOW) -> DataFrame:
    """A state table for the view operators: one tracked entity per customer."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    df = c.join(n, c.c_nationkey == n.n_nationkey)
    key = F.col("c_custkey")
    last_seen = now_col(now) - F.make_dt_interval(F.pmod(key, F.lit(45)), F.pmod(key, F.lit(24)))
    first_seen = last_seen - F.make_dt_interval(F.pmod(key, F.lit(17)))
    company_id = F.lower(F.col("c_mktsegment"))
    cls = F.pmod(key, F.lit(3))
    st = F.pmod(key, F.lit(4))
    out = df.select(
        F.concat(F.lit("c-"), key).alias("id"),
        key.cast("bigint").alias("entity_seq"),
        company_id.alias("company_id"),
        F.col("c_mktsegment").alias("company_name"),
        F.col("c_name").alias("title"),
        F.col("n_name").alias("location"),
        F.concat(F.lit("https://jobs.example.com/c/"), key).alias("url"),
        F.when(cls == 0, "new").when(cls == 1, "repost").otherwise("existing").alias("classification"),
        F.lit("New job posting (no previous match found)").alias("classification_reasoning"),
        F.when(st == 0, "active").when(st == 1, "missing").when(st == 2, "closed").otherwise("reopened").alias("status"),
        first_seen.alias("first_seen"),
        last_seen.alias("last_seen"),
        key.cast("string").alias("source_identifier"),
        F.when(F.pmod(key, F.lit(5)) == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("department"),
        F.expr("repeat(concat(c_name, ' '), cast(pmod(c_custkey, 40) as int))").alias("description"),
        first_seen.alias("created_at"),
        last_seen.alias("updated_at"),
    )
    return with_signature(out)


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application records: one per order; job = the customer's tracked entity."""
    o = table(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    applied = F.to_date("o_orderdate")
    nxt = (
        F.when(pr.isin("1-URGENT", "2-HIGH"), F.date_add(applied, 7))
        .when(pr == "5-LOW", F.lit(None).cast("date"))
        .otherwise(F.date_add(applied, 14))
    )
    return o.select(
        F.concat(F.lit("app-"), F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("c-"), F.col("o_custkey")).alias("job_id"),
        applied.alias("applied_date"),
        F.when(F.col("o_orderstatus") == "O", "applied")
        .when(F.col("o_orderstatus") == "P", "interview")
        .otherwise("rejected").alias("stage"),
        pr.alias("notes"),
        F.lit(None).cast("string").alias("contact_person"),
        F.lit(None).cast("string").alias("referral_source"),
        F.lit(None).cast("string").alias("salary_info"),
        nxt.alias("next_follow_up"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up log: one row per conversation turn; application = conversation id."""
    c = table(spark, sf_dir, "conversations")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("turn"))
    return c.select(
        F.concat(F.lit("app-"), F.col("conv_id")).alias("application_id"),
        F.col("turn").alias("seq"),
        ts.alias("timestamp"),
        F.when(F.col("role") == "user", "application").otherwise("follow-up").alias("type"),
        F.col("text").alias("notes"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchlist rows from suppliers: id, name, adapter, one board source url."""
    s = table(spark, sf_dir, "supplier")
    cid = F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-")))
    m = F.pmod("s_suppkey", F.lit(3))
    adapter = F.when(m == 0, "greenhouse").when(m == 1, "lever").otherwise("workday")
    url = (
        F.when(m == 0, F.concat(F.lit("https://boards.greenhouse.io/"), cid))
        .when(m == 1, F.concat(F.lit("https://jobs.lever.co/"), cid))
        .otherwise(F.concat(F.lit("https://"), cid, F.lit(".wd1.myworkdayjobs.com/en-US/External")))
    )
    return s.select(
        F.col("s_suppkey").alias("company_seq"),
        cid.alias("id"), F.col("s_name").alias("name"), adapter.alias("adapter"), url.alias("source_url"),
        F.col("s_nationkey").alias("priority_key"),
    )


def observation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-entity sightings from the events table: entity = (event_type, user_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("entity_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "event_id",
    )
