"""Source payloads -> canonical raw postings.

Input of every flattener: a DataFrame of landed payload documents with columns
``company_id, company_name, source_ord, source_url, payload`` (one JSON document per row,
e.g. from ``read_payload_files``). Output: the raw-posting schema plus ``batch_seq`` built
from (company order, source order, position in the document), and a ``_problem`` column;
rows with a problem are quarantine, not errors.

Parsing is ``from_json`` with an explicit schema and ``posexplode``: native, per document,
no shuffle. Fields that arrive either as a string or as an object/list are declared as
STRING, which makes ``from_json`` keep the raw JSON text of non-string values; those are
then re-parsed with a second schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.validate import absolute_url, url_authority

# Fixed values.
UNKNOWN_LOCATION = "Unknown Location"
UNKNOWN_TITLE = "Unknown Title"

RAW_COLUMNS = ["batch_seq", "company_id", "company_name", "title", "location", "url", "source_identifier",
               "department", "description", "posted_date", "updated_date", "raw_data", "_problem"]

BOARD_OBJECT_SCHEMA = (
    "jobs array<struct<id: string, title: string, location: string, absolute_url: string, "
    "updated_at: string, departments: array<map<string, string>>, content: string>>"
)
BOARD_ARRAY_SCHEMA = (
    "array<struct<id: string, text: string, categories: struct<location: string, team: string>, "
    "hostedUrl: string, createdAt: bigint, descriptionPlain: string>>"
)
POSTINGS_SCHEMA = (
    "jobPostings string, jobs string"
)
POSTING_ITEM_SCHEMA = (
    "array<struct<title: string, locationsText: string, postedOn: string, externalPath: string, "
    "bulletFields: array<string>, jobReqId: string>>"
)

def number_rows(rows: DataFrame) -> DataFrame:
    """``batch_seq`` in the order (company, source, position). The strides come from the rows
    themselves (two numbers reach the driver), so no two rows share a number, however many
    postings a source or sources a company has."""
    top = rows.agg(F.max("_pos"), F.max("source_ord")).first()
    per_source, per_company = (top[0] or 0) + 1, (top[1] or 0) + 1
    seq = (F.col("company_ord").cast("bigint") * F.lit(per_company) + F.col("source_ord").cast("bigint")) * F.lit(per_source) + F.col("_pos").cast("bigint")
    return rows.withColumn("batch_seq", seq).select(*RAW_COLUMNS)


def split_postings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of flattened rows; the quarantine says why in ``_problem``."""
    return rows.where(F.col("_problem").isNull()), rows.where(F.col("_problem").isNotNull())


UNREADABLE = "unreadable document"


def _explode(parsed: DataFrame, items: Column, opens: str) -> DataFrame:
    """One row per item; a document that is no JSON, or does not open as its shape must, gives one
    row without item."""
    unreadable = F.try_parse_json("payload").isNull() | F.col("_d").isNull() | ~F.col("payload").rlike(rf"^\s*\{opens}")
    keep = [c for c in parsed.columns if c != "_d"]
    return parsed.withColumn("_bad", unreadable).select(
        *keep, "_bad", F.posexplode_outer(F.when(~F.col("_bad"), items)).alias("_pos", "j")).where("_bad OR j IS NOT NULL").withColumn(
        "_pos", F.coalesce("_pos", F.lit(0)))


def _problem(*rules: tuple[Column, str]) -> Column:
    out = F.when(F.col("_bad"), UNREADABLE)
    for when, what in rules:
        out = out.when(when, what)
    return out


def parse_iso(c: Column) -> Column:
    """ISO-8601 text (``Z`` or offset allowed) -> naive UTC timestamp; unparseable -> NULL."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def parse_epoch_ms(c: Column) -> Column:
    """D3: epoch milliseconds -> timestamp; 0/NULL -> NULL."""
    return F.when(c.isNull() | (c == 0), F.lit(None)).otherwise(F.timestamp_millis(c).cast("timestamp_ntz"))


_ORDER = ["company_ord", "source_ord", "_pos"]


def _finish(df: DataFrame) -> DataFrame:
    """The raw columns but ``batch_seq``, and the columns that order rows."""
    for c in RAW_COLUMNS[1:]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("timestamp_ntz" if c.endswith("_date") else "string"))
    return df.select(*_ORDER, *RAW_COLUMNS[1:])


def _raw() -> Column:
    return F.when(F.col("_bad"), F.col("payload")).otherwise(F.to_json(F.col("j"))).alias("raw_data")


def _board_object(docs: DataFrame) -> DataFrame:
    """``{"jobs": [...]}`` documents. location: object -> its ``name`` (missing key ->
    'Unknown Location', null -> NULL), string -> as is, anything else -> 'Unknown Location';
    first department name; a job without id/title/absolute_url is quarantined."""
    parsed = docs.withColumn("_d", F.from_json("payload", BOARD_OBJECT_SCHEMA))
    ex = _explode(parsed, F.col("_d.jobs"), "{")
    loc = F.col("j.location")
    loc_map = F.from_json(loc, "map<string, string>")
    location = (
        F.when(loc.isNull(), F.lit(UNKNOWN_LOCATION))
        .when(loc.startswith("{"), F.when(F.map_contains_key(loc_map, "name"), loc_map["name"]).otherwise(F.lit(UNKNOWN_LOCATION)))
        .when(loc.startswith("["), F.lit(UNKNOWN_LOCATION))
        .otherwise(loc)
    )
    problem = _problem(
        (F.col("j.id").isNull(), "missing id"), (F.col("j.title").isNull(), "missing title"),
        (F.col("j.absolute_url").isNull(), "missing absolute_url"))
    return _finish(ex.select(
        *_ORDER, "company_id", "company_name",
        F.col("j.title").alias("title"), location.alias("location"), F.col("j.absolute_url").alias("url"),
        F.col("j.id").alias("source_identifier"),
        F.try_element_at(F.col("j.departments"), F.lit(1))["name"].alias("department"),
        F.col("j.content").alias("description"),
        parse_iso(F.col("j.updated_at")).alias("updated_date"),
        _raw(),
        problem.alias("_problem"),
    ))


def _board_array(docs: DataFrame) -> DataFrame:
    """Top-level array documents. location = categories.location (falsy -> 'Unknown
    Location'); team -> department; createdAt epoch-ms (falsy -> NULL); ``categories: null``
    or a missing id/text/hostedUrl -> quarantine."""
    parsed = docs.withColumn("_d", F.from_json("payload", BOARD_ARRAY_SCHEMA))
    # the same items as maps tell an explicit ``"categories": null`` from an absent key
    parsed = parsed.withColumn("_maps", F.from_json("payload", "array<map<string, string>>"))
    ex = _explode(parsed, F.arrays_zip(F.col("_d").alias("j"), F.col("_maps").alias("m")), "[").drop("_maps")
    ex = ex.withColumns({"_m": F.col("j.m"), "j": F.col("j.j")})
    loc = F.col("j.categories.location")
    problem = _problem(
        (F.col("j.id").isNull(), "missing id"), (F.col("j.text").isNull(), "missing text"), (F.col("j.hostedUrl").isNull(), "missing hostedUrl"),
        (F.map_contains_key(F.col("_m"), "categories") & F.col("_m")["categories"].isNull(), "categories is null"))
    return _finish(ex.select(
        *_ORDER, "company_id", "company_name",
        F.col("j.text").alias("title"),
        F.when(loc.isNull() | (loc == ""), F.lit(UNKNOWN_LOCATION)).otherwise(loc).alias("location"),
        F.col("j.hostedUrl").alias("url"), F.col("j.id").alias("source_identifier"),
        F.col("j.categories.team").alias("department"),
        F.col("j.descriptionPlain").alias("description"),
        parse_epoch_ms(F.col("j.createdAt")).alias("posted_date"),
        _raw(),
        problem.alias("_problem"),
    ))


def _board_postings(docs: DataFrame) -> DataFrame:
    """S3: ``jobPostings`` if it is a list, else ``jobs`` if that is a list, else nothing.
    title default 'Unknown Title'; locationsText string, or list joined by ', ', else
    'Unknown Location'; url = scheme://host of the source + externalPath, or the source url;
    id = first bullet field, else jobReqId (NULL-safe); postedOn ISO."""
    parsed = docs.withColumn("_d", F.from_json("payload", POSTINGS_SCHEMA))
    jp, jb = F.col("_d.jobPostings"), F.col("_d.jobs")
    items_text = F.when(jp.startswith("["), jp).when(jb.startswith("["), jb)
    ex = _explode(parsed, F.from_json(items_text, POSTING_ITEM_SCHEMA), "{")
    lt = F.col("j.locationsText")
    lt_list = F.from_json(lt, "array<string>")
    location = (
        F.when(lt.isNull(), F.lit(UNKNOWN_LOCATION))
        .when(lt.startswith("["), F.when(F.size(lt_list) > 0, F.array_join(lt_list, ", ")).otherwise(F.lit(UNKNOWN_LOCATION)))
        .when(lt.startswith("{"), F.lit(UNKNOWN_LOCATION))
        .otherwise(lt)
    )
    first_bullet = F.try_element_at(F.col("j.bulletFields"), F.lit(1))
    sid = F.when(first_bullet.isNotNull() & (first_bullet != ""), first_bullet).otherwise(F.col("j.jobReqId"))
    return _finish(ex.select(
        *_ORDER, "company_id", "company_name",
        F.coalesce(F.col("j.title"), F.lit(UNKNOWN_TITLE)).alias("title"),
        location.alias("location"),
        absolute_url(F.col("source_url"), F.col("j.externalPath")).alias("url"),
        sid.alias("source_identifier"),
        parse_iso(F.col("j.postedOn")).alias("posted_date"),
        _raw(),
        _problem().alias("_problem"),
    ))


def flatten_board_object(docs: DataFrame) -> DataFrame:
    """S1, see ``_board_object``."""
    return number_rows(_board_object(docs))


def flatten_board_array(docs: DataFrame) -> DataFrame:
    """S2, see ``_board_array``."""
    return number_rows(_board_array(docs))


def flatten_board_postings(docs: DataFrame) -> DataFrame:
    """S3, see ``_board_postings``."""
    return number_rows(_board_postings(docs))


FLATTENERS = {
    "greenhouse": _board_object,
    "lever": _board_array,
    "workday": _board_postings,
}


def register_flattener(adapter: str, replace: bool = False):
    """Decorator: a user's source shape, used from then on by ``flatten_sources``, ``union_sources``
    and so by the quarantine of ``split_postings``.

    The function takes the documents of its adapter (``payload`` and the source columns) and returns a
    row per posting with company_ord, source_ord, ``_pos`` (place in its source, from 0), the raw columns that it
    fills and ``_problem``, null for a valid row; raw columns that it leaves out are null."""
    if not adapter:
        raise ValueError("A flattener needs the name of its adapter")
    if adapter in FLATTENERS and not replace:
        raise ValueError(f"Adapter {adapter!r} has a flattener already")

    def add(fn):
        FLATTENERS[adapter] = lambda docs: _finish(fn(docs))
        return fn

    return add


def unregister_flattener(adapter: str) -> None:
    FLATTENERS.pop(adapter, None)


def flatten_sources(docs: DataFrame) -> DataFrame:
    """All sources of all companies as numbered rows, faulty ones included; ``docs`` carries
    ``adapter``. Each shape is flattened from its own subset, then ``unionByName``."""
    parts = [fn(docs.where(F.col("adapter") == name)) for name, fn in FLATTENERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return number_rows(out)


def union_sources(docs: DataFrame) -> DataFrame:
    """The valid postings of all sources as one batch; ``split_postings(flatten_sources(docs))``
    also gives the others."""
    return split_postings(flatten_sources(docs))[0]


def read_payload_files(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Landed payload files (one JSON document per file) joined to the ``sources`` table on
    the file path. ``sources``: company_id, company_name, company_ord, source_ord, source_url,
    adapter, file_path."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("payload")
    )
    return files.join(sources, "file_path")


def source_to_endpoint(adapter: Column, url: Column) -> Column:
    """Board url -> API url per adapter; NULL when the url cannot be converted."""
    gh_slug = F.regexp_extract(url, r"boards\.greenhouse\.io/(.*)$", 1)
    gh = (
        F.when(url.contains("boards.greenhouse.io/"),
               F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), F.regexp_replace(gh_slug, "/+$", ""), F.lit("/jobs")))
        .when(url.contains("boards-api.greenhouse.io"), url)
    )
    lv = F.when(url.contains("?"), F.concat(url, F.when(url.endswith("?"), F.lit("")).otherwise(F.lit("&")), F.lit("mode=json"))) \
        .otherwise(F.concat(url, F.lit("?mode=json")))
    host = url_authority(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), lambda x: x != "")
    wd = F.when(
        F.size(parts) >= 2,
        F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), F.split(host, r"\.")[0], F.lit("/"),
                 F.element_at(parts, -1), F.lit("/jobs")),
    )
    return F.when(adapter == "greenhouse", gh).when(adapter == "lever", lv).when(adapter == "workday", wd)


# ---------------------------------------------------------------------------
# Builders: postings -> payload documents (pages of at most PAGE_SIZE postings per company),
# used to exercise the flatteners on data derived from the driver tables.
# ---------------------------------------------------------------------------

PAGE_SIZE = 100


def _pages(postings: DataFrame) -> DataFrame:
    return postings.withColumn("source_ord", F.floor(F.col("batch_seq") / PAGE_SIZE).cast("bigint"))


def _docs(postings: DataFrame, item: Column, wrap) -> DataFrame:
    return (
        _pages(postings)
        .groupBy("company_id", "company_name", "source_ord")
        .agg(F.collect_list(item).alias("_items"))
        .select("company_id", "company_name", "source_ord", wrap(F.col("_items")).alias("payload"))
    )


def build_board_object_docs(postings: DataFrame) -> DataFrame:
    item = F.struct(
        F.col("source_identifier").cast("bigint").alias("id"), F.col("title"),
        F.struct(F.col("location").alias("name")).alias("location"),
        F.col("url").alias("absolute_url"),
        F.lit("2024-01-10T12:34:56Z").alias("updated_at"),
        F.array(F.struct(F.lit(1).alias("id"), F.col("department").alias("name"))).alias("departments"),
    )
    return _docs(postings, item, lambda items: F.to_json(F.struct(items.alias("jobs"))))


def build_board_array_docs(postings: DataFrame) -> DataFrame:
    item = F.struct(
        F.col("source_identifier").alias("id"), F.col("title").alias("text"),
        F.struct(F.col("location").alias("location"), F.col("department").alias("team")).alias("categories"),
        F.col("url").alias("hostedUrl"), F.lit(1704897600000).alias("createdAt"),
    )
    return _docs(postings, item, lambda items: F.to_json(items))


def build_board_postings_docs(postings: DataFrame) -> DataFrame:
    item = F.struct(
        F.col("title"), F.array(F.col("location")).alias("locationsText"),
        F.lit("2024-01-10T00:00:00.000Z").alias("postedOn"),
        F.regexp_replace(F.col("url"), r"^https://[^/]+", "").alias("externalPath"),
        F.array().cast("array<string>").alias("bulletFields"),
        F.col("source_identifier").alias("jobReqId"),
    )
    return _docs(postings, item, lambda items: F.to_json(F.struct(F.lit(len("x")).alias("total"), items.alias("jobPostings"))))


def with_source_columns(docs: DataFrame, source_url: Column, company_ord: Column) -> DataFrame:
    return docs.withColumn("source_url", source_url).withColumn("company_ord", company_ord)
