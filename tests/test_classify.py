"""Classification branches (C1-C6, J7) with a fixed clock, and agreement with a row-by-row
replica of the rules on derived fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seq_oracle import classify_sequential
from tidewatch.functions.normalize import with_signature
from tidewatch.operators.classify import ENTITY_COLUMNS, close_old_missing, mark_missing, run_cycle

T0 = datetime(2024, 1, 1, 12, 0, 0)
ENTITY_SCHEMA = (
    "id string, entity_seq bigint, company_id string, company_name string, title string, location string, url string, "
    "classification string, classification_reasoning string, status string, first_seen timestamp_ntz, "
    "last_seen timestamp_ntz, source_identifier string, department string, description string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
BATCH_SCHEMA = (
    "batch_seq bigint, company_id string, company_name string, title string, location string, url string, "
    "source_identifier string, department string, description string"
)


def entity(i, company, title, location, status="active", last_seen=T0, sid=None, first_seen=None):
    fs = first_seen or last_seen
    return (f"e{i}", i, company, company.upper(), title, location, f"https://x/{i}", "new",
            "New job posting (no previous match found)", status, fs, last_seen, sid, None, None, fs, last_seen)


def posting(seq, company, title, location, sid):
    return (seq, company, company.upper(), title, location, f"https://x/b{seq}", sid, None, None)


def run(spark, entities, batch, now, **kw):
    K = with_signature(spark.createDataFrame(entities, ENTITY_SCHEMA)).select(*ENTITY_COLUMNS) if entities else \
        with_signature(spark.createDataFrame([], ENTITY_SCHEMA)).select(*ENTITY_COLUMNS)
    R = spark.createDataFrame(batch, BATCH_SCHEMA)
    res = run_cycle(K, R, now, run_id="t", **kw)
    dec = {r.batch_seq: r for r in res.decisions.collect()}
    ent = {r.id: r for r in res.entities.collect()}
    return dec, ent, res


def test_same_id_next_day_is_existing(spark):
    e = [entity(1, "acme", "Software Engineer", "San Francisco, CA", sid="A1")]
    dec, ent, res = run(spark, e, [posting(1, "acme", "Software Engineer", "San Francisco, CA", "A1")], T0 + timedelta(days=1))
    assert dec[1].decision == "existing" and dec[1].entity_id == "e1"
    assert ent["e1"].classification == "new"
    assert ent["e1"].last_seen == T0 + timedelta(days=1)
    obs = res.observations.where(F.col("entity_id") == "e1").count()
    assert obs == 1  # this cycle's observation (the first one lives in the stored log)


def test_variant_new_id_within_window_is_repost(spark):
    e = [entity(1, "acme", "Senior Software Engineer", "San Francisco, CA", sid="A1")]
    dec, ent, _ = run(spark, e, [posting(1, "acme", "Sr. Software Engineer", "SF, CA", "B2")], T0 + timedelta(days=10))
    assert dec[1].decision == "repost" and dec[1].target_id == "e1"
    new = ent[dec[1].entity_id]
    assert new.classification == "repost"
    assert new.classification_reasoning.startswith("Likely repost of job e1 (similarity: 1.00, first seen: 2024-01-01)")


def test_variant_outside_window_is_new(spark):
    e = [entity(1, "acme", "Senior Software Engineer", "San Francisco, CA", sid="A1")]
    dec, _, _ = run(spark, e, [posting(1, "acme", "Sr. Software Engineer", "SF, CA", "B2")], T0 + timedelta(days=40))
    assert dec[1].decision == "new"


def test_window_edge_inclusive(spark):
    e = [entity(1, "acme", "Data Analyst", "Remote", sid="A1")]
    dec, _, _ = run(spark, e, [posting(1, "acme", "Data Analyst", "Remote", "B2")], T0 + timedelta(days=30))
    assert dec[1].decision == "repost"


def test_closed_record_is_reopened(spark):
    e = [entity(1, "acme", "Product Manager", "Austin, TX", status="closed", sid="A1")]
    now = T0 + timedelta(days=60)
    dec, ent, res = run(spark, e, [posting(1, "acme", "Product Manager", "Austin, TX", "Z9")], now)
    assert dec[1].decision == "reopened" and dec[1].entity_id == "e1"
    r = ent["e1"]
    assert r.status == "reopened" and r.source_identifier == "Z9" and r.url == "https://x/b1"
    assert r.classification_reasoning == "Job reopened (was closed on 2024-03-01, originally first seen 2024-01-01)"
    note = res.observations.where(F.col("entity_id") == "e1").first().note
    assert note == "Job reopened"


def test_observe_two_of_three_marks_one_missing(spark):
    e = [entity(i, "acme", t, "Remote", sid=f"S{i}") for i, t in [(1, "Alpha Role"), (2, "Beta Role"), (3, "Gamma Role")]]
    batch = [posting(1, "acme", "Alpha Role", "Remote", "S1"), posting(2, "acme", "Beta Role", "Remote", "S2")]
    dec, ent, res = run(spark, e, batch, T0 + timedelta(days=1))
    assert ent["e3"].status == "missing"
    assert ent["e1"].status == "active" and ent["e2"].status == "active"


def test_mark_missing_twice(spark):
    K = with_signature(spark.createDataFrame([entity(1, "acme", "A", "Remote")], ENTITY_SCHEMA))
    empty = spark.createDataFrame([], "id string")
    once = mark_missing(K, empty, T0)
    assert once.where("status = 'missing'").count() == 1
    twice = mark_missing(once, empty, T0)
    assert twice.where("status = 'missing'").count() == 1  # nothing new flips


def test_missing_seen_again_becomes_active(spark):
    e = [entity(1, "acme", "Role", "Remote", status="missing", sid="A1")]
    dec, ent, _ = run(spark, e, [posting(1, "acme", "Role", "Remote", "A1")], T0 + timedelta(days=2))
    assert ent["e1"].status == "active"


def test_close_timeout_strict(spark):
    now = T0 + timedelta(days=30)
    rows = [entity(1, "acme", "A", "Remote", status="missing", last_seen=now - timedelta(days=8)),
            entity(2, "acme", "B", "Remote", status="missing", last_seen=now - timedelta(days=5)),
            entity(3, "acme", "C", "Remote", status="missing", last_seen=now - timedelta(days=7))]
    K = with_signature(spark.createDataFrame(rows, ENTITY_SCHEMA))
    out = {r.id: r.status for r in close_old_missing(K, now, 7).collect()}
    assert out == {"e1": "closed", "e2": "missing", "e3": "missing"}


def test_same_id_other_company_is_new(spark):
    e = [entity(1, "acme", "Engineer", "Remote", sid="X1")]
    dec, _, _ = run(spark, e, [posting(1, "globex", "Engineer", "Remote", "X1")], T0 + timedelta(days=1))
    assert dec[1].decision == "new"


def test_two_equal_postings_in_one_batch(spark):
    batch = [posting(1, "acme", "Engineer", "Remote", "A"), posting(2, "acme", "Engineer", "Remote", "B")]
    dec, _, _ = run(spark, [], batch, T0)
    assert dec[1].decision == "new" and dec[2].decision == "repost"
    assert dec[2].target_id == dec[1].entity_id


def test_same_id_twice_in_one_batch(spark):
    batch = [posting(1, "acme", "Engineer", "Remote", "A"), posting(2, "acme", "Engineer", "Remote", "A")]
    dec, _, _ = run(spark, [], batch, T0)
    assert dec[1].decision == "new" and dec[2].decision == "existing"
    assert dec[2].entity_id == dec[1].entity_id


def test_closed_record_seen_by_own_id_stays_closed(spark):
    e = [entity(1, "acme", "Role", "Remote", status="closed", sid="A1")]
    dec, ent, _ = run(spark, e, [posting(1, "acme", "Role", "Remote", "A1")], T0 + timedelta(days=3))
    assert dec[1].decision == "existing" and ent["e1"].status == "closed"


def test_reopened_unobserved_stays_reopened(spark):
    e = [entity(1, "acme", "Role", "Remote", status="reopened", sid="A1")]
    _, ent, _ = run(spark, e, [], T0 + timedelta(days=3))
    assert ent["e1"].status == "reopened"


def test_tie_goes_to_lowest_entity_seq(spark):
    e = [entity(5, "acme", "Engineer", "Remote", sid="A5"), entity(2, "acme", "Engineer", "Remote", sid="A2")]
    dec, _, _ = run(spark, e, [posting(1, "acme", "Engineer", "Remote", "N1")], T0 + timedelta(days=1))
    assert dec[1].decision == "repost" and dec[1].target_id == "e2"


def test_null_source_id_reposts_itself_next_cycle(spark):
    batch = [posting(1, "acme", "Engineer", "Remote", None)]
    dec, ent, res = run(spark, [], batch, T0)
    assert dec[1].decision == "new"
    K1 = res.entities
    R2 = spark.createDataFrame([posting(1, "acme", "Engineer", "Remote", None)], BATCH_SCHEMA)
    res2 = run_cycle(K1, R2, T0 + timedelta(days=1), run_id="t2")
    d2 = res2.decisions.first()
    assert d2.decision == "repost" and d2.target_id == dec[1].entity_id
    statuses = sorted(r.status for r in res2.entities.collect())
    assert statuses == ["active", "missing"]


def _compare_with_oracle(spark, K, R, now, **kw):
    res = run_cycle(K, R, now, run_id="r1", **kw)
    got = {r.batch_seq: (r.decision, r.entity_id, r.target_id) for r in res.decisions.collect()}
    Kp = [r.asDict() for r in K.collect()]
    Rp = [r.asDict() for r in with_signature(R).collect()]
    exp, _ = classify_sequential(Kp, Rp, now)
    import hashlib

    def rid(ref, company):
        if ref is None:
            return None
        if ref.startswith("K:"):
            return ref[2:]
        return hashlib.sha256(f"r1|{company}|{ref[2:]}".encode()).hexdigest()

    company = {r["batch_seq"]: r["company_id"] for r in Rp}
    bad = []
    for seq, (d, e, t) in exp.items():
        want = (d, rid(e, company[seq]), rid(t, company[seq]))
        if got[seq] != want:
            bad.append((seq, got[seq], want))
    assert not bad, bad[:5]
    return exp


def test_fixture_matches_row_by_row_replica(spark):
    from tidewatch.plans import inputs as I

    sf = "/root/testdata/sf0.001"
    exp = _compare_with_oracle(spark, I.entities0(spark, sf), I.batch1(spark, sf), datetime(2024, 2, 1))
    kinds = {v[0] for v in exp.values()}
    assert {"existing", "new"} <= kinds


def test_next_holder_of_an_id_answers_after_a_reopen(spark):
    """Two closed records share an id; posting 1 reopens the first under another id, so posting 2
    with the shared id belongs to the second."""
    e = [entity(1, "acme", "Data Engineer", "Remote", status="closed", sid="S"),
         entity(2, "acme", "Warehouse Clerk", "Austin, TX", status="closed", sid="S")]
    batch = [posting(1, "acme", "Data Engineer", "Remote", "Z"), posting(2, "acme", "Other Thing", "Nowhere", "S")]
    dec, _, _ = run(spark, e, batch, T0 + timedelta(days=60))
    assert (dec[1].decision, dec[1].entity_id) == ("reopened", "e1")
    assert (dec[2].decision, dec[2].entity_id) == ("existing", "e2")


def test_next_holder_of_an_id_outside_the_window(spark):
    e = [entity(1, "acme", "Data Engineer", "Remote", status="closed", sid="S"),
         entity(2, "acme", "Warehouse Clerk", "Austin, TX", status="active", last_seen=T0 - timedelta(days=90), sid="S")]
    batch = [posting(1, "acme", "Data Engineer", "Remote", "Z"), posting(2, "acme", "Other Thing", "Nowhere", "S")]
    dec, _, _ = run(spark, e, batch, T0 + timedelta(days=60))
    assert (dec[1].decision, dec[1].entity_id) == ("reopened", "e1")
    assert (dec[2].decision, dec[2].entity_id) == ("existing", "e2")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batches_match_row_by_row_replica(spark, seed):
    import random

    rng = random.Random(seed)
    titles = ["Data Engineer", "Senior Data Engineer", "Data Engineers", "Sr Data Engineer", "Analyst",
              "Data Analyst", "Product Manager", "Product Managers"]
    locs = ["Remote", "Austin, TX", "Austin TX", "NYC"]
    now = datetime(2024, 3, 1)
    ents = []
    for i in range(1, 25):
        ents.append(entity(i, rng.choice(["acme", "globex"]), rng.choice(titles), rng.choice(locs),
                           status=rng.choice(["active", "missing", "closed", "reopened"]),
                           last_seen=now - timedelta(days=rng.randint(0, 45)),
                           sid=rng.choice([None, "", f"S{rng.randint(1, 30 if seed < 3 else 8)}"])))
    batch = [posting(j, rng.choice(["acme", "globex"]), rng.choice(titles), rng.choice(locs),
                     rng.choice([None, f"S{rng.randint(1, 40 if seed < 3 else 12)}"])) for j in range(1, 40)]
    K = with_signature(spark.createDataFrame(ents, ENTITY_SCHEMA)).select(*ENTITY_COLUMNS)
    R = spark.createDataFrame(batch, BATCH_SCHEMA)
    _compare_with_oracle(spark, K, R, now)


def test_long_chain_of_reopens_matches_row_by_row_replica(spark):
    """Each posting reopens a record and takes its id over, which frees the id that the next posting
    carries: a chain of decisions as long as the batch."""
    words = ["alpha", "bravo", "carbon", "delta", "ether", "forest", "glacier", "harbor", "island", "jungle"]
    now = T0 + timedelta(days=60)
    ents, batch = [], []
    for i, w in enumerate(words):
        # the record's id is the one that posting i + 1 carries: free only once posting i took the record
        ents.append(entity(i + 1, "acme", f"{w} {w[::-1]} clerk", "Remote", status="closed", sid=f"S{i + 1}"))
        batch.append(posting(i + 1, "acme", f"{w} {w[::-1]} clerk", "Remote", f"S{i}"))
    batch.append(posting(20, "acme", "alpha ahpla clerk", "Remote", "S0"))
    K = with_signature(spark.createDataFrame(ents, ENTITY_SCHEMA)).select(*ENTITY_COLUMNS)
    exp = _compare_with_oracle(spark, K, spark.createDataFrame(batch, BATCH_SCHEMA), now)
    assert [exp[i][0] for i in range(1, 11)] == ["reopened"] * 10 and exp[20][0] == "existing"


def test_no_grouped_python_call_decides(spark):
    """The cascade is joins and aggregates: one signature and one id shared by a third of the rows."""
    from tidewatch.operators import classify as C

    rng = __import__("random").Random(5)
    now = datetime(2024, 3, 1)
    titles = [f"{a} {b} clerk" for a in ("alpha", "bravo", "carbon") for b in ("harbor", "island", "jungle")]
    pick = lambda hot, rest: hot if rng.random() < 0.34 else rng.choice(rest)
    ents = [entity(i, "acme", pick("alpha harbor clerk", titles), "Remote", status=rng.choice(["closed", "closed", "missing"]),
                   last_seen=now - timedelta(days=rng.randint(20, 90)), sid=pick("S0", [None] + [f"S{k}" for k in range(1, 20)])) for i in range(1, 60)]
    batch = [posting(j, "acme", pick("alpha harbor clerk", titles), "Remote", pick("S0", [None] + [f"S{k}" for k in range(1, 30)])) for j in range(1, 90)]
    K = with_signature(spark.createDataFrame(ents, ENTITY_SCHEMA)).select(*ENTITY_COLUMNS)
    exp = _compare_with_oracle(spark, K, spark.createDataFrame(batch, BATCH_SCHEMA), now)
    assert "reopened" in {v[0] for v in exp.values()}
    told = spark.createDataFrame([], "batch_seq bigint, company_id string, sid string, url string, sig string, decision string, ref string")
    known = spark.createDataFrame([], "ref string, company_id string, sig string, sid string, status string, closed boolean, in_window boolean, "
                                      "cand struct<kind: int, seq: bigint, ref: string>")
    plan = C._wave(told, C._steps(told, known), spark.createDataFrame([], "sig string, c_sig string, score double"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def _rounds(monkeypatch, asked):
    """Notes how many rows each round of a cascade asks."""
    from tidewatch.operators import classify as C

    wave = C._wave
    monkeypatch.setattr(C, "_wave", lambda told, steps, links: (asked.append(told.count()), wave(told, steps, links))[1])


def test_a_first_guess_that_holds_takes_one_round(spark, monkeypatch):
    """A repost guessed as new changes nothing for other rows, so no second round asks all rows again."""
    e = [entity(1, "acme", "Data Engineer", "Remote", status="closed", sid="S"), entity(2, "acme", "Warehouse Clerk", "Austin, TX", sid="T")]
    batch = [posting(1, "acme", "Data Engineer", "Remote", "Z"), posting(2, "acme", "Warehouse Clerk", "Austin, TX", "Y"),
             posting(3, "acme", "Other Thing", "Nowhere", "S1")]
    asked = []
    _rounds(monkeypatch, asked)
    dec, _, _ = run(spark, e, batch, T0 + timedelta(days=20))
    assert [dec[i].decision for i in (1, 2, 3)] == ["reopened", "repost", "new"]
    assert dec[2].target_id == "e2" and asked == [3]


def test_rounds_ask_only_rows_that_look_at_what_moved(spark, monkeypatch):
    """Posting 2 is first taken for the record that posting 1 reopens under another id; the 20 others
    look at neither that id nor those signatures."""
    e = [entity(1, "acme", "Data Engineer", "Remote", status="closed", sid="S"),
         entity(2, "acme", "Warehouse Clerk", "Austin, TX", status="closed", sid="S")]
    batch = [posting(1, "acme", "Data Engineer", "Remote", "Z"), posting(2, "acme", "Other Thing", "Nowhere", "S")]
    batch += [posting(10 + i, "acme", chr(97 + i) * 9 + " clerk", "Elsewhere", f"N{i}") for i in range(20)]
    asked = []
    _rounds(monkeypatch, asked)
    K = with_signature(spark.createDataFrame(e, ENTITY_SCHEMA)).select(*ENTITY_COLUMNS)
    exp = _compare_with_oracle(spark, K, spark.createDataFrame(batch, BATCH_SCHEMA), T0 + timedelta(days=60))
    assert [exp[i][:2] for i in (1, 2)] == [("reopened", "K:e1"), ("existing", "K:e2")] and exp[10][0] == "new"
    assert asked[0] == 22 and len(asked) == 2 and asked[1] <= 2


def test_hit_records_of_a_signature_do_not_multiply_its_matches(spark):
    """Many records of one signature, all out of the window and hit by the batch in their order: a
    similar posting is compared with the first of them only; if later ones are hit first, with the best."""
    now = T0 + timedelta(days=60)
    ents = [entity(i, "acme", "Data Engineer", "Remote", sid=f"S{i}") for i in range(1, 31)]
    batch = [posting(i, "acme", "Other", "Nowhere", f"S{31 - i if i > 15 else i}") for i in range(1, 31)]
    batch += [posting(j, "acme", "Data Engineers", "Remote", f"N{j}") for j in (40, 41)]
    K = with_signature(spark.createDataFrame(ents, ENTITY_SCHEMA)).select(*ENTITY_COLUMNS)
    exp = _compare_with_oracle(spark, K, spark.createDataFrame(batch, BATCH_SCHEMA), now)
    assert exp[40][0] == "repost" and exp[40][2] == "K:e1"


def test_postings_of_a_one_group_file_are_dealt_out(spark, tmp_path):
    """A file with one row group is read by one task: its rows are dealt out before titles are normalised."""
    from tidewatch.plans import inputs as I

    one = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    one([(i, f"p{i}", "Brand#1", "SMALL", i % 50) for i in range(3000)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", "part")
    one([(i, f"n{i}", i % 5) for i in range(25)], "n_nationkey bigint, n_name string, n_regionkey bigint", "nation")
    one([(i, f"r{i}") for i in range(5)], "r_regionkey bigint, r_name string", "region")
    for df in (I.postings(spark, str(tmp_path)), I.entities0(spark, str(tmp_path)), I.batch1(spark, str(tmp_path))):
        sizes = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) < 1500
