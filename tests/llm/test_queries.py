"""Registered queries against their DuckDB SQL, on a driver table and on edge rows."""

import os
import tempfile

import duckdb
import pytest

from tidewatch.llm import urlfilter
from tidewatch.llm.oracles import ORACLES
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "conversations", "labels")


def compare(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')" if os.path.isdir(f"{sf}/{t}.parquet")
                    else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(map(tuple, cur.fetchall()), key=repr)
    have = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    assert have == want, [(a, b) for a, b in zip(have, want) if a != b][:3]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, SF, name)


@pytest.fixture(scope="module")
def edges(spark):
    """Tables of edge rows, with columns the operators do not know."""
    d = tempfile.mkdtemp(prefix="tw-llm-")
    long = " ".join(f"word{i % 997}" for i in range(30000))
    docs = [(1, None), (2, ""), (3, "\n \t"), (4, long), (5, long), (6, "the of and to " * 20), (7, "A line here\nA line here\n\nA line here\nlast"),
            (8, "# * $ % & | < > " * 10), (9, "é ü ñ " * 30), (11, " ".join(f"u{i}" for i in range(60)) + " the of and"), (12, "x" * 9000)]
    docs += [(20 + i, " ".join(f"n{i}v{j}" for j in range(25)) + " of the shared tail " + " ".join(f"t{j}" for j in range(25))) for i in range(5)]
    spark.createDataFrame([(i, t, "en", None if i == 9 else f"s{i % 3}", 0, "extra") for i, t in docs],
                          "doc_id bigint, text string, lang string, source string, n_words bigint, verdict string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "word1 WORD2 word3"), (2, " ".join(f"t{j}" for j in range(20))), (3, None), (4, ""), (None, "the of"), (2, "u1 u2")],
                          "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "https://x.example.net/en/1", "https://x.example.net/EN/1",
            "http://EXAMPLE.com/de/1?q=/en/", "ftp://org/fr/x", "http://notorg/fr/x", "http://a.org/fr/", "http://example.com:80/de/1",
            "http://www.spam-farm.example.org/x", "http://spam-farm.example.net/en/", "http://a.example.com/free-download/now/setup.exe?x",
            "http://xxx", "mailto://x?://y.net/", "http://a.org#frag", "http://a.net/x", "http://a.net/x"]
    spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string").write.parquet(f"{d}/pages.parquet")
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", None)
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b, a], 6: [("user", "")], 7: [(None, "hi")], 8: [a, b, ("user", "")], 9: [a, a], 10: [c]}
    rows = [(i, k * (3 if i == 3 else 1), r, t, "extra") for i, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rows += [(2, 0, "user", "hi", "extra"), (None, 0, "user", "hi", "extra"), (11, None, "user", "x", "extra")]
    rows += [(12, k, "user", f"turn {k}", "extra") for k in range(600)]
    # conversations rebuilt from one another, turnless ones, a long one, equal ones, repeated rows
    rows += [(40, k, "user", f"shared {k}", "extra") for k in range(21)] + [(40, None, "user", "null turn", "extra"), (40, None, None, "", "extra")]
    rows += [(c, k, "user", f"own {k} of {c % 3}", "extra") for c in range(41, 60) for k in range(c % 7)] + [(61, 0, "user", "no base", "extra")] * 2
    rows += [(62, k, "user", f"turn {k}", "extra") for k in range(30)] + [(40, 3, "user", "shared 3", "extra")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part string").write.parquet(f"{d}/conversations.parquet")
    labels = [(i, 1, int(i % 5 == 0), "extra") for i in range(40)] + [(None, 1, 1, "extra"), (4, None, None, "extra"), (4, 1, 1, "extra")]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score string").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_edge_rows_equal_sql(spark, edges, name):
    compare(spark, edges, name)


#: Verdicts written by hand, not made from the module's lists.
VERDICTS = {
    "https://casino-win.example.com/en/1.html": "block",
    "http://m.spam-farm.example.com/fr/2": "block",
    "https://www.cheap-pills.example.com/en/3": "block",
    "http://blog.adult-x.example.com/en/4/": "block",
    "https://free-bets.example.com/en/5#top": "block",
    "http://m.FREE-BETS.example.org/en/6?utm_source=feed": "block",
    "https://www.ads-track.example.com/en/7": "block",
    "http://ads-track.example.org/8": "block",
    "http://example.com/ads/top/banner/9": "block",
    "http://ads-track.example.net/en/10": "allow",  # a host rule decides
    "http://org/fr/free-bets/": "allow",
    "http://example.com/free-betsy/11": "allow",
    "http://uploads-track.example.com/en/12": "allow",
    "http://example.com/free/bets/13": "allow",
    "http://example.com/ads/14": "allow",
    "http://thtion.example.com/en/15": "allow",
}


def test_url_verdicts(spark):
    pages = spark.createDataFrame(list(enumerate(VERDICTS)), "page_id bigint, url string")
    assert {r["url"]: r["verdict"] for r in urlfilter.judge(pages).collect()} == VERDICTS


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, edges, name):
    d = tempfile.mkdtemp(prefix="tw-llm-none-")
    for t in TABLES:
        spark.read.parquet(f"{edges}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    assert QUERIES[name](spark, d).count() == 0
