"""Payload flatteners (S1-S4) on the edge rows of FIXTURES 1.4."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import payloads as P


def _docs(spark, payload, url="https://acme.wd1.myworkdayjobs.com/en-US/External"):
    return spark.createDataFrame([("acme", "Acme", 1, 0, url, json.dumps(payload))],
                                 "company_id string, company_name string, company_ord bigint, source_ord bigint, source_url string, payload string")


def test_board_object_edges(spark):
    jobs = [
        {"id": 4084045006, "title": "A", "location": {"name": "Austin"}, "absolute_url": "u1",
         "updated_at": "2026-01-10T12:34:56Z", "departments": [{"id": 1, "name": "Eng"}]},
        {"id": 2, "title": "B", "location": "Remote", "absolute_url": "u2", "departments": []},
        {"id": 3, "title": "C", "location": {"name": None}, "absolute_url": "u3", "updated_at": "garbage"},
        {"id": 4, "title": "D", "location": {"city": "x"}, "absolute_url": "u4"},
        {"id": 5, "title": "E", "location": None, "absolute_url": "u5"},
        {"id": 6, "location": "x", "absolute_url": "u6"},
    ]
    rows = {r.source_identifier: r for r in P.flatten_board_object(_docs(spark, {"jobs": jobs})).collect()}
    assert rows["4084045006"].location == "Austin" and rows["4084045006"].department == "Eng"
    assert str(rows["4084045006"].updated_date) == "2026-01-10 12:34:56"
    assert rows["2"].location == "Remote" and rows["2"].department is None
    assert rows["3"].location is None and rows["3"].updated_date is None
    assert rows["4"].location == "Unknown Location"
    assert rows["5"].location == "Unknown Location"
    assert rows["6"]._problem == "missing title"
    assert all(rows[k]._problem is None for k in ["4084045006", "2", "3", "4", "5"])


def test_board_array_edges(spark):
    items = [
        {"id": "u-1", "text": "A", "categories": {"location": "NYC", "team": "Eng"}, "hostedUrl": "h1", "createdAt": 1704897600000},
        {"id": "u-2", "text": "B", "categories": {"location": ""}, "hostedUrl": "h2", "createdAt": 0},
        {"id": "u-3", "text": "C", "categories": None, "hostedUrl": "h3"},
        {"id": "u-4", "text": "D", "hostedUrl": "h4"},
    ]
    rows = {r.source_identifier: r for r in P.flatten_board_array(_docs(spark, items)).collect()}
    assert rows["u-1"].location == "NYC" and rows["u-1"].department == "Eng"
    assert str(rows["u-1"].posted_date) == "2024-01-10 14:40:00"
    assert rows["u-2"].location == "Unknown Location" and rows["u-2"].posted_date is None
    assert rows["u-3"]._problem == "categories is null"
    assert rows["u-4"]._problem is None and rows["u-4"].location == "Unknown Location"


def test_board_postings_edges(spark):
    posts = [
        {"title": "A", "locationsText": "Austin, TX", "postedOn": "2026-01-10T00:00:00.000Z", "externalPath": "/job/a",
         "bulletFields": ["R1"], "jobReqId": "J1"},
        {"locationsText": ["Austin", "Remote"], "externalPath": "/job/b", "bulletFields": [], "jobReqId": "J2"},
        {"title": "C", "locationsText": [], "jobReqId": "J3"},
    ]
    rows = {r.source_identifier: r for r in P.flatten_board_postings(_docs(spark, {"total": 3, "jobPostings": posts})).collect()}
    assert rows["R1"].url == "https://acme.wd1.myworkdayjobs.com/job/a"
    assert rows["J2"].title == "Unknown Title" and rows["J2"].location == "Austin, Remote"
    assert rows["J3"].location == "Unknown Location" and rows["J3"].url == "https://acme.wd1.myworkdayjobs.com/en-US/External"
    # jobPostings not a list -> jobs
    alt = P.flatten_board_postings(_docs(spark, {"jobPostings": {"x": 1}, "jobs": [{"title": "Z", "jobReqId": "J9"}]})).collect()
    assert [r.source_identifier for r in alt] == ["J9"]
    assert P.flatten_board_postings(_docs(spark, {"total": 0})).count() == 0


def test_union_splits_faulty_rows(spark):
    rows = [("acme", "Acme", 1, 0, "u", "greenhouse", json.dumps({"jobs": [{"id": 1, "title": "A", "absolute_url": "u"}, {"id": 2, "title": "no url"}]})),
            ("acme", "Acme", 1, 1, "u", "lever", json.dumps([{"id": "x", "text": "B", "hostedUrl": "h"}])),
            ("acme", "Acme", 1, 2, "u", "lever", "{broken"), ("acme", "Acme", 1, 3, "u", "lever", json.dumps({"not": "a list"})),
            ("zeta", "Zeta", 2, 0, "u", "workday", json.dumps({"jobPostings": [{"title": "C", "jobReqId": "9"}]})), ("zeta", "Zeta", 2, 1, "u", "workday", "[")]
    docs = spark.createDataFrame(rows, "company_id string, company_name string, company_ord bigint, source_ord bigint, source_url string, adapter string, payload string")
    valid, bad = P.split_postings(P.flatten_sources(docs))
    assert [(r.company_id, r.title) for r in valid.orderBy("batch_seq").collect()] == [("acme", "A"), ("acme", "B"), ("zeta", "C")]
    assert sorted((r.company_id, r._problem) for r in bad.collect()) == [
        ("acme", "missing absolute_url"), ("acme", P.UNREADABLE), ("acme", P.UNREADABLE), ("zeta", P.UNREADABLE)]
    assert P.union_sources(docs).count() == 3


def test_numbers_do_not_collide(spark):
    """Large positions and many sources keep rows apart and in order."""
    rows = [(c, s, p) for c in (1, 2) for s in (0, 1, 1_000_000) for p in (0, 1, 2_000_000)]
    df = spark.createDataFrame(rows, "company_ord bigint, source_ord bigint, _pos int").selectExpr(
        "*", *[f"CAST(NULL AS string) AS {c}" for c in P.RAW_COLUMNS[1:-1]], "concat_ws(' ', company_ord, source_ord, _pos) AS _problem")
    got = [r._problem for r in P.number_rows(df).orderBy("batch_seq").collect()]
    assert got == [" ".join(map(str, r)) for r in sorted(rows)]
    assert P.number_rows(df).select("batch_seq").distinct().count() == len(rows)


def test_source_to_endpoint(spark):
    df = spark.createDataFrame([
        ("greenhouse", "https://boards.greenhouse.io/acme/"),
        ("greenhouse", "https://boards-api.greenhouse.io/v1/boards/acme/jobs"),
        ("greenhouse", "https://example.com/acme"),
        ("lever", "https://jobs.lever.co/acme"),
        ("lever", "https://jobs.lever.co/acme?team=x"),
        ("workday", "https://acme.wd1.myworkdayjobs.com/en-US/External"),
        ("workday", "https://acme.wd1.myworkdayjobs.com/"),
    ], "adapter string, url string")
    got = [r.e for r in df.select(P.source_to_endpoint(F.col("adapter"), F.col("url")).alias("e")).collect()]
    assert got == [
        "https://boards-api.greenhouse.io/v1/boards/acme/jobs",
        "https://boards-api.greenhouse.io/v1/boards/acme/jobs",
        None,
        "https://jobs.lever.co/acme?mode=json",
        "https://jobs.lever.co/acme?team=x&mode=json",
        "https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/External/jobs",
        None,
    ]


def test_registered_shape_joins_the_union_and_its_quarantine(spark):
    def lines(docs):
        return docs.select("*", F.posexplode(F.split("payload", "\n")).alias("_pos", "line")).select(
            "company_ord", "source_ord", "_pos", "company_id", F.col("line").alias("title"),
            F.when(F.col("line") == "", "empty line").alias("_problem"))

    docs = spark.createDataFrame([("acme", "Acme", 1, 0, "https://x", "Clerk\n\nAnalyst", "lines")],
                                 "company_id string, company_name string, company_ord bigint, source_ord bigint, source_url string, payload string, adapter string")
    assert P.flatten_sources(docs).count() == 0   # unknown shapes are not read
    with pytest.raises(ValueError):
        P.register_flattener("lever")
    P.register_flattener("lines")(lines)
    try:
        valid, faulty = P.split_postings(P.flatten_sources(docs))
        assert [(r.title, r.url) for r in valid.orderBy("batch_seq").collect()] == [("Clerk", None), ("Analyst", None)]
        assert [r._problem for r in faulty.collect()] == ["empty line"]
        with pytest.raises(ValueError):
            P.register_flattener("lines")
    finally:
        P.unregister_flattener("lines")
