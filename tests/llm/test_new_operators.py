"""Prefix trie, toxicity and source divergence beside plain versions of the contracts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import divergence, prefix_trie, queries, toxicity
from tidewatch.llm.common import remainder

SF = "/root/testdata/sf0.01"


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = {k: m for k, m in nodes.items() if k[:len(key)] == key}
        kids = lambda k: sum(len(x) == len(k) + 1 and x[:len(k)] == k for x in below)
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), kids(key), sum(not kids(k) for k in below),
                    sum((len(m) - 1) * len(brute.words(k[-1][1])) for k, m in below.items() if k),
                    brute.sha(",".join(map(str, ends)).encode()), len(ends)))
    return out


def trie_of(spark, convs):
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    turns = prefix_trie.number_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    lengths = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id bigint, n bigint")
    return sorted(map(tuple, prefix_trie.trie(turns, lengths).collect()), key=repr)


def test_trie_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SUPER", 2)  # running values over several super-blocks
    rng = random.Random(3)
    convs = {}
    for c in range(90):
        stem = list(convs[rng.choice(list(convs))][:rng.randint(0, 40)]) if convs and rng.random() < 0.8 else []
        convs[c] = stem + [(rng.choice("ua"), " ".join(rng.choices("xyz", k=rng.randint(0, 3)))) for _ in range(rng.choice([0, 1, 2, 9, 30]))]
    assert trie_of(spark, convs) == sorted(plain_trie(convs), key=repr)


def test_hot_conversation_and_hot_prefix(spark):
    """One conversation holds a third of the turns, one text starts most others, many are equal."""
    convs = {0: [("u", f"turn {k}") for k in range(700)]}
    convs |= {c: [("u", "hi"), ("a", "hello there"), ("u", "same")] for c in range(1, 300)}
    convs |= {c: [("u", "hi"), ("a", f"answer {c}")] for c in range(300, 500)}
    got = {(r[0], r[1]): r for r in trie_of(spark, convs)}
    assert got[0, 700][4:7] == (0, 1, 0) and got[0, 0][3:6] == (500, 2, 202)
    top = got[1, 1]
    assert top[2:6] == (0, 499, 201, 201) and top[6] == 498 + 2 * 298 + 298
    assert got[1, 3][7] == hashlib.sha256(",".join(map(str, range(1, 300))).encode()).hexdigest()


def test_packed_digests(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK", 7)
    ends = [(k % 3, 5, 1, c) for c, k in enumerate(random.Random(1).choices([0, 0, 0, 1, 2], k=200))]
    df = spark.createDataFrame(ends, "k1 bigint, k2 bigint, depth bigint, conv_id bigint").repartition(5)
    got = {r["k1"]: r["ends_sha256"] for r in prefix_trie.digests(df).collect()}
    for k in range(3):
        assert got[k] == hashlib.sha256(",".join(str(c) for a, _, _, c in ends if a == k).encode()).hexdigest()


def plain_divergence(rows):
    terms = lambda t: re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts = collections.defaultdict(collections.Counter), collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    for lang, source, text in rows:
        lang, source, t = lang or "", source or "", terms(text)
        docs[lang].update(set(t))
        counts[lang][source].update(t)
    out = []
    for lang, sources in counts.items():
        kept = [w for w, n in docs[lang].items() if n >= 3]

        def prob(c):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10 ** 9 * (c[w] + 1) // total for w in kept}

        p, q = {s: prob(c) for s, c in sources.items()}, prob(sum(sources.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in sources.items():
            pairs = [(x, sum(f(p[s][w], p[x][w]) for w in kept)) for x in sources if x != s]
            more = [(w, f(p[s][w], q[w])) for w in kept if c[w] > 0 and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", more)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(ranked) if part == "pair" or k < 200]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_plain_version(spark, monkeypatch, small):
    if small:  # spills, several tiles and ranges of languages
        for name, value in (("HOLD", 500), ("STEP", 64), ("TILE", 3), ("HOLD_TILES", 2), ("BROADCAST", 5)):
            monkeypatch.setattr(divergence, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text")
    docs = docs.unionByName(spark.createDataFrame(
        [(None, None, "Ab ab é"), (None, "s", "ab É"), ("", "", "AB é x9y"), ("xx", "a", None), ("xx", "b", ""), ("yy", "lone", "one two")],
        docs.schema)).repartition(9)
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain_divergence(rows)


def test_scaled_is_exact():
    rng = random.Random(5)
    for _ in range(300):
        total = rng.randint(1, rng.choice([10, 10 ** 6, 10 ** 9, 9 * 10 ** 15 - 2]))
        count = rng.randint(0, total - 1)
        assert divergence.scaled(np.array([count]), np.array([total]))[0] == 1 + 10 ** 9 * (count + 1) // total


def test_fold():
    assert toxicity.fold("You 1D10T, stūp1d! $cum. іdіоt") == ["you", "idiot", "stupid", "scum", "idiot"]
    assert toxicity.fold("42 0x1 no. 7!") == ["oxi", "no"]
    assert toxicity.fold(None) == [] and toxicity.fold("ＩＤＩＯＴ") == ["idiot"]
    assert len(toxicity.fold("1" * 300_000 + " " + "x" * 300_000)) == 1


def test_matches_outside_exceptions():
    model = toxicity.Model(["bad", "mad"], np.array([[2.0, 3.0]] * 3), ["not bad at", "mad hatter", "bad"], 1.0, -1.0)
    model.exceptions.remove("bad")
    matcher = toxicity.Matcher(model)
    assert matcher.find("so bad bad mad".split()) == ([0, 0, 1], 0)
    assert matcher.find("not bad at all mad hatter mad".split()) == ([1], 2)
    assert matcher.find("badly nomad".split()) == ([], 0)
    assert matcher.weigh("a bad one".split()) == (2.0 / math.log(math.e + 3), 1, 0)


def test_learned_exceptions_and_held_out(spark):
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text, toxic = rng.choices(words, k=40), i % 6 == 0
        if toxic:
            text[5] = rng.choice(["vile", "foul"])
        elif i % 3 == 0:
            text[8:10] = ["foul", "play"]  # benign in this phrase
        if i % 2:
            text = ["v1le" if t == "vile" else t for t in text]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs.where(remainder("doc_id", 3) != 1), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert "vile" in model.words
    told = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in told if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(told[i] < toxicity.TOXIC for i in held if not labels[i][2])
    plain = [i for i in held if labels[i][2] and re.search("vile|v1le", rows[i][1])]
    assert plain and all(told[i] >= toxicity.TOXIC for i in plain)


def test_exception_phrase_is_learned(spark):
    rows = [(i, f"you fool number{chr(97 + i % 20)}") for i in range(60)] + [(100 + i, f"fool proof case{chr(97 + i % 20)} x{chr(97 + i)}") for i in range(4)]
    rows += [(200 + i, f"calm words only {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    rows[:60] = [(i, f"{t} z{chr(97 + i % 26)}{chr(97 + i // 26)}") for i, t in rows[:60]]
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    assert "fool" in model.words and "fool proof" in model.exceptions and "you fool" not in model.exceptions
    got = {r["row"]["doc_id"]: r for r in toxicity.score(spark.createDataFrame([(1, "a fool proof plan"), (2, "a f00l plan")], "doc_id bigint, text string"), model).collect()}
    assert got[1]["n_excepted"] == 1 and got[1]["score"] < toxicity.TOXIC and got[1]["score"] < got[2]["score"]


def test_toxicity_of_documents(spark):
    got = queries.op12_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    told = got.join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("caught")).collect()
    told = {r["toxic"]: r["caught"] for r in told}
    assert told[1] > 0.6 and told[0] < 0.02
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and got.count() == 1000


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (1, "a b")], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.0] * 4
