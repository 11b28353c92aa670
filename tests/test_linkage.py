"""Linkage plans: the salted tiling of heavy company blocks gives the same matches."""

from pyspark.sql import functions as F

from tidewatch.functions.normalize import with_signature
from tidewatch.operators import linkage as J
from tidewatch.plans import inputs as I

SF = "/root/testdata/sf0.001"


def _best(spark):
    K = I.entities0(spark, SF)
    R = with_signature(I.batch1(spark, SF))
    return sorted(map(tuple, J.find_best_match(R, K, 0.9).select("batch_seq", "match_key", "match_score").collect()),
                  key=lambda r: r[0])


def test_salted_tiles_give_same_matches(spark, monkeypatch):
    plain = _best(spark)
    monkeypatch.setattr(J, "PAIRS_PER_TILE", 5)   # every company block becomes many tiles
    tiled = _best(spark)
    assert tiled == plain
    assert any(r[1] is not None for r in plain)


def test_salted_join_covers_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS_PER_TILE", 3)
    left = spark.createDataFrame([("c", i) for i in range(20)] + [("d", 0)], "company_id string, l int")
    right = spark.createDataFrame([("c", i) for i in range(15)] + [("e", 1)], "company_id string, r int")
    out = J.salted_block_join(left, right, ["company_id"], F.col("l"), F.col("r"))
    pairs = [(row.l, row.r) for row in out.collect()]
    assert len(pairs) == 20 * 15 and len(set(pairs)) == 20 * 15


def test_matches_equal_pairwise_similarity(spark):
    """Random records, company ids with the separator among them, against every pair's score."""
    import random

    from tidewatch.functions.similarity import similarity

    rng = random.Random(8)
    words = ["data", "engineer", "engineers", "senior", "analyst", "platform", "lead", "ii"]
    rows = [(i, rng.choice(["acme", "globex", "a|b"]), " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.choice(["Remote", "Austin, TX", "Austin", "NYC"]))
            for i in range(120)]
    df = with_signature(spark.createDataFrame(rows, "n bigint, company_id string, title string, location string"))
    left, right = df.where("n % 2 = 0").withColumnRenamed("n", "batch_seq"), df.where("n % 2 = 1").withColumn("id", F.col("n").cast("string")).withColumnRenamed("n", "entity_seq")
    sigs = {r.n: (r.company_id, r.signature) for r in df.collect()}
    for t in (0.9, 0.7):
        got = {r.batch_seq: (r.match_key, r.match_score) for r in J.find_best_match(left, right, t).collect()}
        low = {r.batch_seq: (r.match_key, r.best_score) for r in J.find_best_match(left, right, t, with_best_score=True).collect()}
        for n in range(0, 120, 2):
            top = max([similarity(sigs[n][1], sigs[m][1]) for m in range(1, 120, 2) if sigs[m][0] == sigs[n][0]], default=0.0)
            assert low[n] == (got[n][0], top)
            scored = [(similarity(sigs[n][1], sigs[m][1]), -m) for m in range(1, 120, 2) if sigs[m][0] == sigs[n][0]]
            best = max([x for x in scored if x[0] >= t], default=None)
            assert got[n] == ((str(-best[1]), best[0]) if best else (None, None)), n


def test_a_hot_company_does_not_enumerate_signature_pairs(spark):
    """10,000 signatures of one company from 40 titles and 250 locations: what is scored are pairs of
    titles and of locations, not of signatures."""
    rows = [(f"title number {t:02d} of many", f"{place:03d} place {place * 7919 % 1000}") for t in range(40) for place in range(250)]
    df = spark.createDataFrame([("hot", a, b) for a, b in rows], "company_id string, title_sorted string, location_norm string")
    q = df.select("company_id", F.col("title_sorted").alias("q_title"), F.col("location_norm").alias("q_loc"))
    c = df.select("company_id", F.col("title_sorted").alias("c_title"), F.col("location_norm").alias("c_loc"))
    assert q.select("q_title").distinct().count() == 40
    text = J._score_parts(q, c, "company_id", 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in text
    sp = J.score_signature_pairs(df, df, 0.999)
    assert sp.where("q_title = c_title AND q_loc = c_loc").count() == 10000


def test_best_first_search_scores_few_pairs_at_low_bounds(spark, monkeypatch):
    """Signatures with a match at the threshold are not looked at again; the bound only falls for the
    others."""
    seen, plain = [], J.score_signature_pairs

    def counted(queries, candidates, threshold, block="company_id"):
        seen.append((threshold, queries.select("company_id", "title_sorted", "location_norm").distinct().count()))
        return plain(queries, candidates, threshold, block)

    monkeypatch.setattr(J, "score_signature_pairs", counted)
    rows = [(i, f"platform engineer team {i:03d}", "remote") for i in range(60)] + [(100, "chef", "rome"), (101, "platform engineer", "oslo")]
    q = with_signature(spark.createDataFrame(rows, "batch_seq bigint, title string, location string").withColumn("company_id", F.lit("acme")))
    c = with_signature(spark.createDataFrame([(f"k{i}", i, f"platform engineer team {i:03d}", "remote") for i in range(60)],
                                             "id string, entity_seq bigint, title string, location string").withColumn("company_id", F.lit("acme")))
    got = {r.batch_seq: r for r in J.find_best_match(q, c, 0.9, with_best_score=True).collect()}
    assert got[5].match_key == "k5" and got[5].best_score == 1.0
    assert got[100].match_key is None and 0 < got[100].best_score < 0.6
    assert seen[0] == (0.9, 62) and [t for t, _ in seen] == sorted((t for t, _ in seen), reverse=True)
    assert all(n <= 2 for _, n in seen[1:])
