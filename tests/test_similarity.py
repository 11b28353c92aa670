import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import similarity as S

GOLDENS = [
    ("test-co|software engineer|remote", "test-co|senior software engineer|remote", 0.8976),
    ("test-co|product manager|new york new york", "test-co|product manager|san francisco california", 0.8024),
    ("test-co|research engineer machine learning|palo alto california",
     "test-co|machine learning research engineer|palo alto california", 1.0),
    ("test-co|software engineer|boston massachusetts", "test-co|marketing manager|boston massachusetts", 0.6824),
    ("test-co|software engineer|austin texas", "test-co|software engineer infrastructure|austin texas", 0.8163),
    ("test-co|development operations engineer|chicago illinois",
     "test-co-labs|development operations engineer|chicago illinois", 0.9737),
    ("test-co|full stack engineer|hybrid seattle washington", "test-co|full stack engineer|seattle washington", 0.9512),
    ("acme|senior engineer|san francisco", "acme|senior software engineer|san francisco", 0.8615),
    ("acme|senior engineer|san francisco", "acme|junior engineer|san francisco", 0.92),
    ("acme|senior engineer|sf", "acme|senior engineer|san francisco", 0.78),
    ("acme|engineer|san francisco", "different|manager|new york", 0.4211),
]


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def test_lcs_matches_dp():
    rng = random.Random(7)
    for _ in range(500):
        a = "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 90)))
        b = "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 90)))
        assert S.lcs_length(a, b) == _lcs_dp(a, b)


def test_lanes_match_big_int_words(monkeypatch):
    rng = random.Random(9)
    for masks in (1 << 21, 50):  # one table, many small ones
        monkeypatch.setattr(S, "_MASKS", masks)
        sizes = lambda: rng.choice([0, 1, 5, 63, 64, 65, 130])
        left = ["".join(rng.choices("abcd é𝒳", k=sizes())) for _ in range(300)]
        right = ["".join(rng.choices("abcd é𝒳z", k=sizes())) for _ in range(300)]
        assert S.lcs_lengths(left, right).tolist() == [S.lcs_length(a, b) for a, b in zip(left, right)]
    assert S.lcs_lengths([], []).tolist() == [] and S.lcs_lengths(["", "x" * 64], ["a", "x" * 64]).tolist() == [0, 64]


@pytest.mark.parametrize("a,b,score", GOLDENS)
def test_python_goldens(a, b, score):
    assert round(S.similarity(a, b), 4) == score


def test_spark_goldens(spark):
    rows = [(a, b) for a, b, _ in GOLDENS]
    df = spark.createDataFrame(rows, "a string, b string")
    from tidewatch.functions.normalize import token_sort
    n = lambda c: F.size(F.split(c, r"\|")) != 3
    part = lambda c, i: F.get(F.split(c, r"\|"), i)
    df = df.select("a", "b", *[x.alias(f"{c}{k}") for c in ("a", "b") for k, x in enumerate((
        F.when(n(c), F.lit("x|y")).otherwise(part(c, 0)), F.coalesce(token_sort(part(c, 1)), F.lit("")), F.coalesce(part(c, 2), F.lit(""))))])
    got = S.with_score(df, ("a0", "a1", "a2", "a"), ("b0", "b1", "b2", "b"), "s").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == S.similarity(r.a, r.b), (r.a, r.b)


def test_bound_is_upper(spark):
    rng = random.Random(3)
    words = ["engineer", "senior", "data", "analyst", "sr", "lead", "ops", "manager"]
    rows = []
    for _ in range(300):
        t1 = " ".join(sorted(rng.sample(words, rng.randint(1, 4))))
        t2 = " ".join(sorted(rng.sample(words, rng.randint(1, 4))))
        l1, l2 = rng.choice(["remote", "new york", "austin texas"]), rng.choice(["remote", "new york"])
        rows.append((t1, t2, l1, l2))
    df = spark.createDataFrame(rows, "t1 string, t2 string, l1 string, l2 string")
    out = df.select(
        S.same_company_score(F.col("t1"), F.col("t2"), F.col("l1"), F.col("l2")).alias("s"),
        S.same_company_score_bound(F.col("t1"), F.col("t2"), F.col("l1"), F.col("l2")).alias("ub"),
    ).collect()
    assert all(r.s <= r.ub for r in out)


def test_threshold_guard():
    with pytest.raises(ValueError):
        S.check_threshold(1.5)


def test_count_bounds_are_upper(spark):
    """Both native title bounds (lengths; per-character counts) are >= the exact score with equal
    locations, bit for bit."""
    rng = random.Random(11)
    alphabet = "abcdeéxyz_09-"

    def title():
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 6))]
        return " ".join(sorted(words))  # already token-sorted, as linkage inputs are

    rows = []
    for _ in range(400):
        t1, t2 = title(), title()
        l1, l2 = rng.choice(["remote", "new york", "austin texas", ""]), rng.choice(["remote", "new york", ""])
        rows.append((t1, t2, l1, l2))
    df = spark.createDataFrame(rows, "qt string, ct string, ql string, cl string")
    df = df.selectExpr("*", *S.char_count_sql("qt", "_qh")).selectExpr("*", S.char_other_sql("qt", "_qh"))
    df = df.selectExpr("*", *S.char_count_sql("ct", "_ch")).selectExpr("*", S.char_other_sql("ct", "_ch"))
    lb, cb = S.title_bounds_sql("qt", "ct", "_qh", "_ch")
    out = df.selectExpr("qt", "ct", "ql", f"{lb} AS lb", f"{cb} AS cb").collect()
    for r in out:
        exact = S.similarity(f"c|{r.qt}|{r.ql}", f"c|{r.ct}|{r.ql}")
        assert exact <= r.cb <= r.lb, (r.qt, r.ct)


def test_token_set_fallback_for_separator_in_company(spark):
    pairs = [("a|b|engineer|remote", "a|b|senior engineer|remote"), ("x|y|data|nyc", "x|y|data|nyc"),
             ("p|q|alpha beta|remote", "p|q|gamma|remote")]
    assert S.similarity(*pairs[1]) == 1.0
    rng = random.Random(4)
    words = ["a|b", "x", "data", "engineer", "remote", "nyc", "senior"]
    pairs += [(" ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = S.with_token_set_ratio(df, "a", "b", "r").collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r.r == S.token_set_ratio(r.a, r.b), (r.a, r.b)


def test_sql_registered_functions(spark):
    from tidewatch.functions.sql import register_sql_functions

    register_sql_functions(spark)
    spark.createDataFrame([(a, b) for a, b, _ in GOLDENS if a.count("|") == 2 and b.count("|") == 2],
                          "a string, b string").createOrReplaceTempView("tw_pairs")
    got = spark.sql("""SELECT a, b, tw_similarity(split(a, '[|]')[0], split(a, '[|]')[1], split(a, '[|]')[2],
                                                  split(b, '[|]')[0], split(b, '[|]')[1], split(b, '[|]')[2]) AS s
                       FROM tw_pairs""").collect()
    for r in got:
        assert r.s == S.similarity(r.a, r.b), (r.a, r.b)
    sig = spark.sql("SELECT tw_signature('acme-corp', 'Sr. Software Engineer', 'San Francisco, CA') AS s").first().s
    assert sig == "acme-corp|senior software engineer|san francisco california"
