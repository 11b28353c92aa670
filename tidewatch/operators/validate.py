"""Validation as column expressions (F5, F6, F7, F12): rows are split, never dropped silently.

Each check yields ``violations ARRAY<STRING>`` (empty = valid); ``split_valid`` returns the
valid rows and a quarantine with the reasons, in one pass over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
VALID_ADAPTERS = ["greenhouse", "lever", "workday"]
VALID_STATUS = ["active", "missing", "closed", "reopened"]
VALID_CLASSIFICATION = ["new", "repost", "existing"]
VALID_STAGE = ["applied", "screening", "interview", "rejected", "offer"]
VALID_FOLLOW_UP_TYPE = ["application", "follow-up"]
SCHEMA_VERSION = "1.0.0"

URL_EMPTY = "URL must be a non-empty string"
URL_NO_SCHEME = "URL must include a scheme (http:// or https://)"
URL_NO_DOMAIN = "URL must include a domain"
URL_BAD_SCHEME = "URL scheme must be http or https"

CID_EMPTY = "Company ID must be a non-empty string"
CID_CHARS = "Company ID must be lowercase alphanumeric with hyphens only"
CID_EDGE = "Company ID cannot start or end with a hyphen"
CID_DOUBLE = "Company ID cannot contain consecutive hyphens"

# URL split in the manner of the standard library: scheme = leading letter + scheme chars
# before the first ':'; authority = after '//' up to the next '/', '?' or '#'.
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY_RE = r"^//([^/?#]*)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME_RE, 1))


def url_authority(url: Column) -> Column:
    """Network location (host with port) of a URL; '' when absent."""
    scheme = F.regexp_extract(url, SCHEME_RE, 1)
    rest = F.when(scheme != "", F.substring(url, F.length(scheme) + 2, 1 << 30)).otherwise(url)
    return F.regexp_extract(rest, AUTHORITY_RE, 1)


def absolute_url(base: Column, path: Column) -> Column:
    """``scheme://host`` of ``base`` followed by ``path``; ``base`` when path is empty."""
    host = F.concat(url_scheme(base), F.lit("://"), url_authority(base))
    return F.when(path.isNull() | (path == ""), base).otherwise(F.concat(host, path))


def validate_url(url: Column) -> Column:
    """struct(is_valid, error) with the first failing rule."""
    err = (
        F.when(url.isNull() | (url == ""), F.lit(URL_EMPTY))
        .when(url_scheme(url) == "", F.lit(URL_NO_SCHEME))
        .when(url_authority(url) == "", F.lit(URL_NO_DOMAIN))
        .when(~url_scheme(url).isin("http", "https"), F.lit(URL_BAD_SCHEME))
    )
    return F.struct(err.isNull().alias("is_valid"), err.alias("error"))


def validate_company_id(cid: Column) -> Column:
    """struct(is_valid, error)."""
    err = (
        F.when(cid.isNull() | (cid == ""), F.lit(CID_EMPTY))
        .when(~cid.rlike(r"^[a-z0-9-]+$"), F.lit(CID_CHARS))
        .when(cid.startswith("-") | cid.endswith("-"), F.lit(CID_EDGE))
        .when(cid.contains("--"), F.lit(CID_DOUBLE))
    )
    return F.struct(err.isNull().alias("is_valid"), err.alias("error"))


def validate_adapter(adapter: Column) -> Column:
    """struct(is_valid, error)."""
    err = F.when(
        adapter.isNull() | ~adapter.isin(*VALID_ADAPTERS),
        F.concat(F.lit("Invalid adapter '"), F.coalesce(adapter, F.lit("None")), F.lit("'. Valid: " + ", ".join(VALID_ADAPTERS))),
    )
    return F.struct(err.isNull().alias("is_valid"), err.alias("error"))


def _checks(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in pairs]), lambda x: x.isNotNull())


REQUIRED_ENTITY_FIELDS = ["id", "company_id", "company_name", "title", "location", "url", "signature",
                          "status", "classification", "first_seen", "last_seen"]


def record_violations(df: DataFrame) -> Column:
    """F6 on a state row: required fields present, enums valid, timestamps present,
    observation entries carrying a timestamp and url, stored created/updated not NULL."""
    checks = [(F.col(c).isNull(), f"'{c}' is a required property") for c in REQUIRED_ENTITY_FIELDS]
    checks += [
        (F.col("status").isNotNull() & ~F.col("status").isin(*VALID_STATUS), "status is not one of the allowed values"),
        (F.col("classification").isNotNull() & ~F.col("classification").isin(*VALID_CLASSIFICATION),
         "classification is not one of the allowed values"),
        (F.col("classification_reasoning").isNull(), "classification_reasoning is missing"),
        (F.col("created_at").isNull(), "created_at is not of type 'string'"),
        (F.col("updated_at").isNull(), "updated_at is not of type 'string'"),
    ]
    if "observations" in df.columns:
        checks += [
            (F.col("observations").isNull(), "observations is missing"),
            (~F.forall(F.coalesce(F.col("observations"), F.array()),
                       lambda o: o["timestamp"].isNotNull() & o["url"].isNotNull()),
             "observation lacks timestamp or url"),
        ]
    return _checks(checks)


def split_valid(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """Returns (valid rows, quarantine rows with ``violations``); the input is read once if
    the caller persists it, and no row is lost."""
    tagged = df.withColumn("violations", violations)
    return (tagged.where(F.size("violations") == 0).drop("violations"), tagged.where(F.size("violations") > 0))


def dedupe_last_wins(df: DataFrame, key: str = "id", order: str = "entity_seq") -> DataFrame:
    """Duplicate ids on load: the last record wins but keeps the first position."""
    agg = df.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in df.columns if c not in (key, order)]), order).alias("_r"),
        F.min(order).alias(order),
    )
    return agg.select(key, order, "_r.*")


def validate_collection(envelope: DataFrame, records: DataFrame) -> DataFrame:
    """envelope (version == 1.0.0, generated_at present) and every record valid; one
    row per collection. ``records`` carries ``collection_id``."""
    per = records.withColumn("_ok", F.size(record_violations(records)) == 0).groupBy("collection_id").agg(
        F.bool_and("_ok").alias("records_valid"), F.count(F.lit(1)).alias("job_count")
    )
    return envelope.join(per, "collection_id", "left").select(
        "collection_id",
        ((F.col("version") == SCHEMA_VERSION) & F.col("generated_at").isNotNull()
         & F.coalesce(F.col("records_valid"), F.lit(True))).alias("is_valid"),
        F.coalesce(F.col("job_count"), F.lit(0)).alias("job_count"),
    )
