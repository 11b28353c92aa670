"""Registered queries: one per operator id of the inventory, each ``(spark, sf_dir) -> DataFrame``
over the driver tables (through the derivations in ``inputs``). Oracles live in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import similarity as S
from tidewatch.functions.normalize import (
    create_signature, normalization_details, normalize_location, normalize_title, token_sort, with_signature,
)
from tidewatch.operators import applications as A
from tidewatch.operators import classify as C
from tidewatch.operators import linkage as J
from tidewatch.operators import metrics as M
from tidewatch.operators import validate as V
from tidewatch.operators import views as VW
from tidewatch.plans import inputs as I
from tidewatch.sources import exports as X
from tidewatch.sources import payloads as P
from tidewatch.sources import state as ST

NOW = datetime.fromisoformat(I.FIXTURE_NOW)
AS_OF = I.FIXTURE_AS_OF
THRESHOLD = S.DEFAULT_THRESHOLD
WINDOW_DAYS = C.DEFAULT_WINDOW_DAYS
TIMEOUT_DAYS = C.DEFAULT_CLOSE_TIMEOUT_DAYS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- normalisation / similarity -------------------------------------------------------------

@query("n1_normalize_title")
def n1(spark, sf):
    return I.postings(spark, sf).select("batch_seq", "title", normalize_title(F.col("title")).alias("title_norm"))


@query("n1_normalize_document_text")
def n1_docs(spark, sf):
    d = I.table(spark, sf, "documents")
    return d.select("doc_id", normalize_title(F.col("text")).alias("text_norm"))


@query("n2_normalize_location")
def n2(spark, sf):
    p = I.postings(spark, sf, location="nation")
    return p.select("batch_seq", "location", normalize_location(F.col("location")).alias("location_norm"))


@query("n3_create_signature")
def n3(spark, sf):
    p = I.postings(spark, sf)
    return p.select("batch_seq", create_signature(F.col("company_id"), F.col("title"), F.col("location")).alias("signature"))


@query("n4_normalization_details")
def n4(spark, sf):
    p = I.postings(spark, sf, location="nation")
    return p.select("batch_seq", normalization_details(F.col("title"), F.col("location")).alias("d")).select("batch_seq", "d.*")


@query("m2_token_sort")
def m2(spark, sf):
    p = I.postings(spark, sf)
    return p.select("batch_seq", token_sort(normalize_title(F.col("title"))).alias("title_sorted"))


def _region_vs_nation_pairs(spark, sf):
    a = with_signature(I.postings(spark, sf, "region"))
    b = with_signature(I.postings(spark, sf, "nation")).select(
        "batch_seq", F.col("title_sorted").alias("b_title"), F.col("location_norm").alias("b_loc"),
        F.col("signature").alias("b_signature"))
    pairs = a.join(b, "batch_seq")
    return S.with_score(pairs, ("company_id", "title_sorted", "location_norm", "signature"), ("company_id", "b_title", "b_loc", "b_signature"))


@query("m4_similarity")
def m4(spark, sf):
    return _region_vs_nation_pairs(spark, sf).select("batch_seq", "score")


@query("j6_is_match")
def j6(spark, sf):
    return _region_vs_nation_pairs(spark, sf).select("batch_seq", J.is_match(F.col("score"), THRESHOLD).alias("is_match"))


@query("m5_match_explanation")
def m5(spark, sf):
    p = _region_vs_nation_pairs(spark, sf)
    return p.select("batch_seq", J.match_explanation(F.col("signature"), F.col("b_signature"), F.col("score"), THRESHOLD).alias("x")).select(
        "batch_seq", F.col("x.similarity").alias("similarity"), F.col("x.is_match").alias("is_match"), F.col("x.reason").alias("reason"))


# --- linkage --------------------------------------------------------------------------------

def _batch_sig(spark, sf):
    return with_signature(I.batch1(spark, sf))


@query("j1_match_by_source_id")
def j1(spark, sf):
    b = I.batch1(spark, sf)
    return J.match_by_source_id(b, I.entities0(spark, sf)).select("batch_seq", "matched_id")


def _best(spark, sf, cand_filter):
    K = I.entities0(spark, sf)
    cut = I.now_col() - F.make_dt_interval(F.lit(WINDOW_DAYS))
    cands = K.where(cand_filter(cut))
    return J.find_best_match(_batch_sig(spark, sf), cands, THRESHOLD).select("batch_seq", "match_key", "match_score")


@query("j2_best_similar_recent")
def j2(spark, sf):
    return _best(spark, sf, lambda cut: (F.col("status") != "closed") & (F.col("last_seen") >= cut))


@query("j3_best_similar_closed")
def j3(spark, sf):
    return _best(spark, sf, lambda cut: F.col("status") == "closed")


@query("j4_find_best_match")
def j4(spark, sf):
    return _best(spark, sf, lambda cut: F.lit(True))


@query("j4_best_score_below_threshold")
def j4_score(spark, sf):
    return J.find_best_match(_batch_sig(spark, sf), I.entities0(spark, sf), THRESHOLD, with_best_score=True).select(
        "batch_seq", "match_key", "best_score")


@query("j5_find_all_matches")
def j5(spark, sf):
    K = I.entities0(spark, sf)
    return J.find_all_matches(_batch_sig(spark, sf), K, THRESHOLD, limit=3).select(
        "batch_seq", "match_key", "match_score", "match_rank")


# --- classification cycle (order-dependent: the oracle is a recursive walk in batch order) -------------------------------------------------------------------

def _cycle(spark, sf):
    return C.run_cycle(I.entities0(spark, sf), I.batch1(spark, sf), NOW, WINDOW_DAYS, THRESHOLD, TIMEOUT_DAYS, run_id="fixture")


@query("c1_c4_classify_batch")
def classify_q(spark, sf):
    return _cycle(spark, sf).decisions.select("batch_seq", "company_id", "decision", "entity_id", "target_id", "score")


@query("c6_cycle_state")
def cycle_state(spark, sf):
    return _cycle(spark, sf).entities.select("id", "status", "classification", "last_seen", "updated_at", "source_identifier")


@query("c7_observation_append")
def observations(spark, sf):
    return _cycle(spark, sf).observations.select("entity_id", "timestamp", "batch_seq", "source_identifier", "url", "note")


@query("t7_applications_survive_the_cycle")
def t7(spark, sf):
    """Applications to all known records, with the record's state after the cycle: ids are kept
    through missing, closed and reopened."""
    apps = I.entities0(spark, sf).select(F.col("id").alias("job_id"), F.col("status").alias("status_before"))
    after = _cycle(spark, sf).entities.select(F.col("id").alias("job_id"), F.col("status").alias("status_after"))
    return apps.join(after, "job_id", "left")


@query("a1_run_summary")
def a1(spark, sf):
    res = _cycle(spark, sf)
    return M.run_summary(res.decisions, res.entities)


@query("a2_run_totals")
def a2(spark, sf):
    res = _cycle(spark, sf)
    return M.run_totals(M.run_summary(res.decisions, res.entities))


@query("a2_run_totals_with_failures")
def a2_failed(spark, sf):
    """Postings per company, and the watchlist rows whose configuration is faulty as failures."""
    p = I.postings(spark, sf)
    summary = p.groupBy("company_id").agg(F.count(F.lit(1)).alias("jobs_fetched"), F.count("source_identifier").alias("jobs_classified"))
    failed = X.company_problems(_faulty_companies(spark, sf)).where("problem IS NOT NULL").select(F.col("id").alias("company_id"))
    return M.run_totals(summary, failed)


@query("a1_a2_run_report")
def run_report(spark, sf):
    """Company rows and the run's total of a cycle that also met the watchlist's faulty rows."""
    res = _cycle(spark, sf)
    failed = X.company_problems(_faulty_companies(spark, sf)).where("problem IS NOT NULL").select(F.col("id").alias("company_id"))
    return M.run_report(res.decisions, res.entities, "2024-02-01 00:00:00", "2024-02-01 00:01:30.5", failed)


@query("a3_lifecycle_counts")
def a3(spark, sf):
    return M.lifecycle_counts(_cycle(spark, sf).lifecycle)


def _observed_by_id(spark, sf):
    return J.match_by_source_id(I.batch1(spark, sf), I.entities0(spark, sf)).where(
        F.col("matched_id").isNotNull()).select("matched_id")


@query("j7_mark_missing")
def j7(spark, sf):
    e = C.mark_missing(I.entities0(spark, sf), _observed_by_id(spark, sf), NOW)
    return e.select("id", "status", "updated_at")


@query("c5_close_old_missing")
def c5(spark, sf):
    return C.close_old_missing(I.entities0(spark, sf), NOW, TIMEOUT_DAYS).select("id", "status", "updated_at")


# --- views ----------------------------------------------------------------------------------

VIEW_COLS = ["id", "company_id", "title", "location", "status", "classification"]


@query("f1_filter_company")
def f1(spark, sf):
    return VW.filter_jobs(I.customer_jobs(spark, sf), company="building").select(*VIEW_COLS)


@query("f2_filter_status")
def f2(spark, sf):
    return VW.filter_jobs(I.customer_jobs(spark, sf), status="reopened").select(*VIEW_COLS)


@query("f3_search")
def f3(spark, sf):
    return VW.filter_jobs(I.customer_jobs(spark, sf), company="machinery", status="active", search="Tion_1").select(*VIEW_COLS)


@query("f4_filter_classification_dates")
def f4(spark, sf):
    return VW.filter_extra(I.customer_jobs(spark, sf), classification="repost", first_seen_from="2023-12-20 00:00:00",
                           last_seen_to="2024-01-25 00:00:00").select(*VIEW_COLS, "first_seen", "last_seen")


def _urls(spark, sf):
    pages = I.table(spark, sf, "pages").select("url")
    bad = spark.createDataFrame([("",), (None,), ("example.com",), ("ftp://x",), ("http://",)], "url string")
    return pages.unionByName(bad)


@query("f5_validate_url")
def f5(spark, sf):
    return _urls(spark, sf).select("url", V.validate_url(F.col("url")).alias("v")).select("url", "v.is_valid", "v.error")


@query("u1_url_host")
def u1(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", V.url_authority(F.col("url")).alias("host"))


def _records_for_validation(spark, sf):
    j = I.customer_jobs(spark, sf)
    k = F.col("entity_seq")
    return (
        j.withColumn("status", F.when(F.pmod(k, F.lit(29)) == 0, F.lit("unknown")).otherwise(F.col("status")))
        .withColumn("created_at", F.when(F.pmod(k, F.lit(31)) == 0, F.lit(None)).otherwise(F.col("created_at")))
        .withColumn("title", F.when(F.pmod(k, F.lit(37)) == 0, F.lit(None)).otherwise(F.col("title")))
    )


@query("f6_validate_record")
def f6(spark, sf):
    r = _records_for_validation(spark, sf)
    v = V.record_violations(r)
    return r.select("id", F.size(v).alias("violation_count"), F.array_join(v, "; ").alias("violations"))


@query("f7_validate_company_id")
def f7(spark, sf):
    c = I.table(spark, sf, "customer")
    n = I.table(spark, sf, "nation")
    ids = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lower("c_mktsegment"), F.lit("-"), F.lower("n_name")).alias("company_id")).distinct()
    return ids.select("company_id", V.validate_company_id(F.col("company_id")).alias("v")).select(
        "company_id", "v.is_valid", "v.error")


@query("f9_needs_follow_up")
def f9(spark, sf):
    return A.needs_follow_up(I.applications(spark, sf), AS_OF).select("id", "job_id", "next_follow_up")


@query("f10_active_unapplied")
def f10(spark, sf):
    return VW.active_unapplied(I.customer_jobs(spark, sf), A.filter_stage(I.applications(spark, sf), "interview")).select("id", "status")


@query("f11_lookup_by_id")
def f11(spark, sf):
    return VW.lookup_by_id(I.customer_jobs(spark, sf), "c-42").select(*VIEW_COLS)


def _order_sightings(spark, sf):
    o = I.table(spark, sf, "orders")
    return o.select(F.concat(F.lit("c-"), F.col("o_custkey")).alias("entity_id"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"))


@query("p1_job_detail")
def p1(spark, sf):
    d = VW.job_detail(I.customer_jobs(spark, sf), _order_sightings(spark, sf), I.applications(spark, sf))
    return d.select(
        "id", "observation_count",
        F.array_join(F.transform("recent_observations", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ",").alias("recent_observations"),
        "description_short", "has_application")


@query("o1_sort_last_seen")
def o1(spark, sf):
    return VW.sort_jobs(I.customer_jobs(spark, sf), "last_seen").select("id", "last_seen", "entity_seq")


@query("o2_sort_company_title")
def o2(spark, sf):
    return VW.sort_jobs(I.customer_jobs(spark, sf), "company").select("id", "company_name", "entity_seq")


@query("a4_distinct_companies")
def a4(spark, sf):
    return VW.distinct_companies(I.customer_jobs(spark, sf))


@query("j8_application_cards")
def j8(spark, sf):
    return VW.application_cards(I.applications(spark, sf), I.customer_jobs(spark, sf), AS_OF).select(
        "id", "job_id", "title", "company_name", "stage", "needs_follow_up")


@query("j9_has_application")
def j9(spark, sf):
    return VW.has_application(I.customer_jobs(spark, sf), I.applications(spark, sf)).select("id", "has_application")


def _snapshot_after(spark, sf):
    k0 = I.entities0(spark, sf)
    life = C.close_old_missing(C.mark_missing(k0, _observed_by_id(spark, sf), NOW), NOW, TIMEOUT_DAYS)
    _, remaining = ST.archive_split(life, NOW, retention_days=40)
    b = I.batch1(spark, sf)
    added = b.join(k0.select(F.col("entity_seq").alias("batch_seq")), "batch_seq", "left_anti").select(
        F.concat(F.lit("e-"), F.col("batch_seq")).alias("id"), "company_id", "company_name", "title", "location", "url",
        F.lit("active").alias("status"), F.lit("new").alias("classification"),
        I.now_col().alias("first_seen"), I.now_col().alias("last_seen"), "source_identifier")
    return remaining.select(*["id"] + VW.DIFF_COLUMNS).unionByName(added)


@query("j10_snapshot_diff")
def j10(spark, sf):
    d = VW.snapshot_diff(I.entities0(spark, sf), _snapshot_after(spark, sf))
    return d.select("id", "change", F.array_join("changed_columns", ",").alias("changed_columns"))


# --- observation log / metrics ------------------------------------------------------------------

@query("a5_observation_stats")
def a5(spark, sf):
    return M.observation_stats(I.observation_log(spark, sf))


@query("a5_stats_folded_by_run")
def a5_folded(spark, sf):
    """The statistics of a5 without a pass over the whole log: runs folded as they come, one late and
    one delivered twice."""
    root, _ = _stream_dirs(spark, "a5")
    log = I.observation_log(spark, sf)
    for run in (1, 0, 2, 1):
        ST.fold_observation_stats(log.where(F.pmod("event_id", F.lit(3)) == run), root, f"run-{run}")
    return ST.read_observation_stats(spark, root)


@query("w2_gap_since_previous")
def w2(spark, sf):
    return M.gap_since_previous(I.observation_log(spark, sf)).select("entity_id", "event_id", "gap_seconds")


@query("r4_presence_sessions")
def r4(spark, sf):
    return M.presence_sessions(I.observation_log(spark, sf), "3 days")


@query("r3_run_window_counts")
def r3(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    return M.run_window_counts(e, "event_type", "6 hours")


@query("a6_evaluate_labels")
def a6(spark, sf):
    l = I.table(spark, sf, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("predicted"))
    return M.evaluate(l)


@query("a7_classification_stability")
def a7(spark, sf):
    return M.classification_stability(I.observation_log(spark, sf))


@query("a7_decisions_per_run")
def a7_runs(spark, sf):
    return M.decisions_per_run(I.observation_log(spark, sf))


@query("a8_volume_alert")
def a8(spark, sf):
    return M.volume_alert(I.postings(spark, sf), "company_id", 10)


# --- applications -----------------------------------------------------------------------------

@query("t1_add_application")
def t1(spark, sf):
    o = I.table(spark, sf, "orders")
    adds = o.select(
        F.concat(F.lit("app-"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("c-"), F.col("o_custkey")).alias("job_id"),
        F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")).alias("applied_date"),
        F.when(F.col("o_orderstatus") == "P", F.lit("interview")).otherwise(F.lit("")).alias("stage"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("notes"),
        F.lit("").alias("contact_person"), F.lit(None).cast("string").alias("referral_source"),
        F.lit(None).cast("string").alias("salary_info"), F.lit(None).cast("date").alias("next_follow_up"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return A.add_applications(adds, "1998-08-02").select("id", "job_id", "applied_date", "stage", "notes", "contact_person")


def _updates(spark, sf):
    l = I.table(spark, sf, "lineitem")
    return l.select(
        F.concat(F.lit("app-"), F.col("l_orderkey")).alias("id"),
        # total order of the change feed: line number, then ship date and part/supplier keys
        F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey").alias("op_seq"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("op_ts"),
        F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "screening").alias("stage"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("line "), F.col("l_linenumber"))).alias("notes"))


@query("t2_update_application")
def t2(spark, sf):
    return A.apply_updates(I.applications(spark, sf), _updates(spark, sf)).select("id", "stage", "notes", "updated_at")


@query("t3_add_follow_up")
def t3(spark, sf):
    return A.add_follow_ups(I.applications(spark, sf), I.follow_ups(spark, sf)).select(
        "application_id", "seq", "timestamp", "type", "notes")


@query("t4_delete_application")
def t4(spark, sf):
    l = I.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.concat(F.lit("app-"), F.col("l_orderkey")).alias("id"))
    return A.delete_applications(I.applications(spark, sf), l).select("id", "job_id")


@query("t5_application_by_job")
def t5(spark, sf):
    return A.application_by_job(I.applications(spark, sf))


@query("t6_next_reminder")
def t6(spark, sf):
    return A.next_reminder(I.applications(spark, sf), I.follow_ups(spark, sf), 7).select("id", "last_follow_up", "next_due")


# --- sources / storage ------------------------------------------------------------------------

def _adapter_of(company_id):
    m = F.pmod(F.substring(company_id, -1, 1).cast("int"), F.lit(3))
    return F.when(m == 0, "greenhouse").when(m == 1, "lever").otherwise("workday")


def _docs(spark, sf, builder):
    p = I.postings(spark, sf)
    d = builder(p)
    return P.with_source_columns(d, F.lit("https://jobs.example.com/board/External"),
                                 F.regexp_extract("company_id", r"(\d+)$", 1).cast("bigint"))


ROUND_TRIP_COLS = ["company_id", "title", "location", "url", "source_identifier", "department"]


@query("s1_flatten_board_object")
def s1(spark, sf):
    return P.flatten_board_object(_docs(spark, sf, P.build_board_object_docs)).select(*ROUND_TRIP_COLS)


@query("s2_flatten_board_array")
def s2(spark, sf):
    return P.flatten_board_array(_docs(spark, sf, P.build_board_array_docs)).select(*ROUND_TRIP_COLS)


@query("s3_flatten_board_postings")
def s3(spark, sf):
    return P.flatten_board_postings(_docs(spark, sf, P.build_board_postings_docs)).select(*ROUND_TRIP_COLS)


@query("s5_union_sources")
def s5(spark, sf):
    p = I.postings(spark, sf).withColumn("adapter", _adapter_of(F.col("company_id")))
    parts = []
    for name, builder in (("greenhouse", P.build_board_object_docs), ("lever", P.build_board_array_docs),
                          ("workday", P.build_board_postings_docs)):
        d = builder(p.where(F.col("adapter") == name)).withColumn("adapter", F.lit(name))
        parts.append(d)
    docs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    docs = P.with_source_columns(docs, F.lit("https://jobs.example.com/board/External"),
                                 F.regexp_extract("company_id", r"(\d+)$", 1).cast("bigint"))
    return P.union_sources(docs).select(*ROUND_TRIP_COLS)


@query("s4_source_to_endpoint")
def s4(spark, sf):
    c = I.companies(spark, sf)
    return c.select("id", "adapter", P.source_to_endpoint(F.col("adapter"), F.col("source_url")).alias("endpoint"))


@query("s8_export_csv_rows")
def s8(spark, sf):
    return X.csv_rows(I.customer_jobs(spark, sf))


@query("s9_export_view_rows")
def s9(spark, sf):
    v = VW.sort_jobs(VW.filter_jobs(I.customer_jobs(spark, sf), status="active"), "last_seen")
    return X.view_rows(v)


def _event_snapshots(spark, sf):
    return I.observation_log(spark, sf).withColumn("snapshot_ts", F.date_format("ts", "yyyyMMdd"))


@query("s13_list_snapshots")
def s13(spark, sf):
    return _event_snapshots(spark, sf).groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("job_count"))


def _feed(docs):
    """A source shape of a user's own: ``{"feed": {"entries": [{"ref", "name", "place", "link"}]}}``."""
    entries = F.from_json("payload", "feed struct<entries: array<struct<ref: string, name: string, place: string, link: string>>>")["feed"]["entries"]
    problem = F.when(F.col("e").isNull(), P.UNREADABLE).when(F.col("e.ref").isNull(), "missing ref")
    return docs.select("*", F.posexplode_outer(entries).alias("_pos", "e")).select(
        "company_ord", "source_ord", F.coalesce("_pos", F.lit(0)).alias("_pos"), "company_id", "company_name", F.col("e.name").alias("title"),
        F.col("e.place").alias("location"), F.col("e.link").alias("url"), F.col("e.ref").alias("source_identifier"), problem.alias("_problem"))


@query("s5_registered_shape")
def s5_registered(spark, sf):
    """Two shapes in one union: a board of the library and a feed that the user registers, a feed
    without ref going to the quarantine (told by ``problem``)."""
    p = I.postings(spark, sf).withColumn("adapter", _adapter_of(F.col("company_id")))
    boards = P.build_board_object_docs(p.where(F.col("adapter") == "greenhouse")).withColumn("adapter", F.lit("greenhouse"))
    page = F.floor(F.col("batch_seq") / F.lit(50))
    entry = F.struct(F.when(F.pmod("batch_seq", F.lit(10)) != 0, F.col("source_identifier")).alias("ref"), F.col("title").alias("name"),
                     F.col("location").alias("place"), F.col("url").alias("link"))
    feeds = p.where(F.col("adapter") != "greenhouse").groupBy("company_id", "company_name", page.alias("source_ord")).agg(
        F.to_json(F.struct(F.struct(F.collect_list(entry).alias("entries")).alias("feed"))).alias("payload")).withColumn("adapter", F.lit("feed"))
    docs = P.with_source_columns(
        boards.unionByName(feeds),
        F.lit("https://jobs.example.com/board/External"), F.regexp_extract("company_id", r"(\d+)$", 1).cast("bigint"))
    P.register_flattener("feed", replace=True)(_feed)
    try:
        rows = P.flatten_sources(docs)
    finally:
        P.unregister_flattener("feed")
    return rows.select("company_id", "title", "location", "url", "source_identifier", F.col("_problem").alias("problem"))


@query("s13_list_versions")
def s13_versions(spark, sf):
    """Committed versions as ``list_snapshots`` shows them: the known set, then what archiving the
    closed records that were last seen over 30 days before leaves of it, and an uncommitted version
    that is not listed."""
    root, _ = _stream_dirs(spark, "s13")
    known = I.entities0(spark, sf)
    ST.write_state(known, root, datetime(2024, 1, 1))
    left = ST.archive_old(known, root, NOW, retention_days=30)
    name = ST.write_state(left, root, datetime(2024, 1, 2))
    spark.read.parquet(f"{root}/entities/snapshot_ts={name}").write.mode("overwrite").parquet(f"{root}/entities/snapshot_ts=20240103-000000-000000")
    return ST.list_snapshots(spark, root).select("snapshot_ts", "job_count", "version")


@query("s17_archive_twice")
def s17_twice(spark, sf):
    """The archive after the same run has written it twice: each row once."""
    root, _ = _stream_dirs(spark, "s17")
    for _ in range(2):
        ST.archive_old(I.customer_jobs(spark, sf), root, NOW, retention_days=30)
    return ST.read_archive(spark, root).select("id", "company_id", "signature", "last_seen", F.col("archive_month").cast("string").alias("archive_month"))


def _add_archived(df):
    return df.withColumn("archived", F.col("status") == "closed")


@query("s18_migrate")
def s18(spark, sf):
    """The known set migrated to a version with an ``archived`` flag, and whether all of it was."""
    ST.register_migration("1.0.0", "1.1.0")(_add_archived)
    moved = ST.migrate(I.entities0(spark, sf).withColumn("schema_version", F.lit("1.0.0")), "1.0.0", "1.1.0")
    return moved.select("id", "archived", "schema_version")


@query("s14_rotate_snapshots")
def s14(spark, sf):
    return ST.snapshots_to_rotate(_event_snapshots(spark, sf).select("snapshot_ts"), max_versions=10)


@query("s17_archive_old")
def s17(spark, sf):
    archived, _ = ST.archive_split(I.customer_jobs(spark, sf), NOW, retention_days=30)
    return archived.select("id", "company_id", "signature", "last_seen", "archive_month")


def _faulty_companies(spark, sf):
    """The watchlist with some names, adapters, urls and ids spoilt by supplier number."""
    k = F.col("company_seq")
    spoilt = lambda n, c, value: F.when(F.pmod(k, F.lit(n)) == 0, value).otherwise(F.col(c))
    none = F.lit(None).cast("string")
    return I.companies(spark, sf).withColumns({
        "name": spoilt(5, "name", none), "adapter": spoilt(7, "adapter", F.lit("rss")), "source_url": spoilt(3, "source_url", F.lit("")),
        "id": spoilt(11, "id", F.concat(F.col("id"), F.lit("_x")))})


@query("s19_load_companies_faulty")
def s19_faulty(spark, sf):
    return X.company_problems(_faulty_companies(spark, sf)).select("company_seq", "id", "problem", "id_format_valid")


@query("s19_load_companies")
def s19(spark, sf):
    return X.company_problems(I.companies(spark, sf)).select("id", "adapter", "problem", "id_format_valid")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


# --- streaming (run over everything available, into a table under the checkpoint dir) ---------

def _stream_dirs(spark, name):
    import uuid

    from tidewatch.session import discard_at_exit, ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    fs, path = ST._fs(spark, base)
    fs.mkdirs(path)
    discard_at_exit(spark, base)
    return f"{base}/sink", f"{base}/checkpoint"


@query("r3_run_window_counts_stream")
def r3_stream(spark, sf):
    from tidewatch.streaming import stream as SS

    sink, ckpt = _stream_dirs(spark, "r3")
    out = SS.run_available(SS.run_window_counts(SS.sightings_stream(spark, sf), "event_type", "6 hours"), sink, ckpt)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "observations")


@query("r2_entity_lifecycle_stream")
def r2_stream(spark, sf):
    from tidewatch.streaming import stream as SS

    sink, ckpt = _stream_dirs(spark, "r2")
    out = SS.run_available(SS.entity_lifecycle(SS.sightings_stream(spark, sf), "3 days", "7 days"), sink, ckpt)
    return out.select("entity_id", "status", F.col("at").cast("timestamp_ntz").alias("at"), "sightings")


@query("r5_split_late")
def r5(spark, sf):
    """The whole log against a watermark ten days before its latest sighting: both parts."""
    from tidewatch.streaming import stream as SS

    log = I.observation_log(spark, sf)
    latest = log.agg(F.max("ts")).first()[0]
    on_time, late = SS.split_late(log, None if latest is None else latest - timedelta(days=10))
    return on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).select("entity_id", "event_id", "late")


@query("o3_sort_oldest_first")
def o3(spark, sf):
    return VW.sort_jobs(I.customer_jobs(spark, sf), "oldest").select("id", "first_seen", "entity_seq")


@query("o3_sort_applications_by_date")
def o3_apps(spark, sf):
    return A.sort_by_applied(A.filter_stage(I.applications(spark, sf), "interview")).select("id", "applied_date", "stage")


@query("f12_validate_collection")
def f12(spark, sf):
    """Collections = one per market segment of the customer state table; the envelope of
    collection 'household' carries a wrong version."""
    recs = _records_for_validation(spark, sf).withColumn("collection_id", F.col("company_id"))
    env = recs.select("collection_id").distinct().select(
        "collection_id",
        F.when(F.col("collection_id") == "household", F.lit("0.9.0")).otherwise(F.lit("1.0.0")).alias("version"),
        I.now_col().alias("generated_at"))
    return V.validate_collection(env, recs)
