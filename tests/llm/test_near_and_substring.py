"""SimHash near-duplicates and substring dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from tidewatch.llm import simhash, substring

SCHEMA = "doc_id bigint, text string, source string, n_words string, print string"


def make(spark, docs):
    return spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in docs], SCHEMA)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ça"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += texts[:10]  # copies
    for t in texts[10:30]:  # near copies
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts += [texts[i] + "\n" + shared + "\t" + texts[i + 1] for i in range(12)]
    texts += ["", None, "  \n\t ", "one", "one two", "a " * 100, "a " * 101, "a b " * 60, "b a " * 60, shared, shared + " " + shared]
    texts += ["x" * 5000 + " " + "tail " * 30]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, shared + " end")]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = simhash.components(make(spark, docs)).select(F.col("id"), simhash.fingerprint_hex().alias("f"), "component_id")
    assert rows(got, "id", "f", "component_id") == sorted(brute.simhash(docs), key=repr)


def test_links_connect_random_prints(spark):
    """Prints around a few centres, in all tiles of a split anchor: same groups as all pairs."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(80):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print bigint")
    want = brute.groups(prints)
    for tile in (4096, 3):
        found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, tile=tile).collect()]
        assert all(0 < (a ^ b).bit_count() <= 3 for a, b in found)
        place = {p: i for i, p in enumerate(prints)}
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            x, y = find(place[a]), find(place[b])
            parent[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(prints))] == want


def test_keep_one_of_each_group(spark):
    docs = corpus()
    docs = docs + docs[:5]  # repeated rows
    kept = simhash.keep_one(make(spark, docs))
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    prints = [brute.fingerprint(t) for _, t in docs]
    of = brute.groups(prints)
    assert len(got) == len(set(of))
    least = {}
    for (doc, _), g in zip(docs, of):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    assert sorted(d for d, _ in got if d is not None) == sorted(least.values())


def test_empty_tables(spark):
    none = make(spark, [])
    assert simhash.components(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = substring.remove_repeats(make(spark, docs).repartition(5)).select(
        F.col("row.doc_id").alias("id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"))
    assert rows(got, "id", "n_words", "n_removed", "sha") == sorted(brute.substring(docs), key=repr)


def test_substring_tells_apart_texts_of_one_id(spark):
    """Thousands of texts of different lengths under the null id share passages: each gets its own
    ranges. The earliest windows are those with the smallest start (see the module)."""
    rng = random.Random(9)
    shared = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(8)]
    texts = []
    for i in range(5000):
        parts = [" ".join(f"u{i}x{j}" for j in range(rng.randint(1, 60)))]
        if i % 3:
            parts.insert(rng.randint(0, 1), rng.choice(shared))
        texts.append("\n".join(parts))
    first, want = {}, []
    for text in texts:
        w = text.split()
        for i in range(len(w) - 19):
            key = tuple(w[i:i + 20])
            first[key] = min(i, first.get(key, i))
    for text in texts:
        w = text.split()
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i:i + 20])] < i for j in range(i, i + 20)}
        want.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring.remove_repeats(make(spark, [(None, t) for t in texts]).repartition(5))
    assert rows(got, "n_words", "n_removed", "kept") == sorted(want, key=repr)


def test_substring_pieces_of_long_texts(spark, monkeypatch):
    docs = corpus(4)
    records = [r for block in (64, substring._BLOCK) for r in [[]]]
    for k, block in enumerate((64, substring._BLOCK)):
        monkeypatch.setattr(substring, "_BLOCK", block)
        for i, (_, text) in enumerate(docs):
            names = substring._word_names((text or "").encode(), substring._Names())
            pieces = list(substring._pieces(i, names, 20)) if len(names) >= 20 else []
            if pieces:
                anchor, stretch, row, start, n = substring._records(pieces, 20, 2)
                for a, r, s, m in zip(anchor.tolist(), row.tolist(), start.tolist(), n.tolist()):
                    records[k] += [(r, s + j, a) for j in range(m)]
    assert sorted(records[0]) == sorted(records[1])  # each window has one anchor, whatever the cut


def test_drop_repeats_leaves_clean_texts(spark):
    docs = corpus(2)
    out = {r["doc_id"]: r["text"] for r in substring.drop_repeats(make(spark, docs)).collect()}
    for (doc, w, gone), (_, text) in zip(brute.kept_words(docs), sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))):
        if not any(gone):
            assert out[doc] == text
        elif all(gone):
            assert doc not in out
        else:
            assert out[doc] == b" ".join(x for x, g in zip(w, gone) if not g).decode()


def test_repeated_rows_get_the_same_result(spark):
    text = " ".join(f"k{i}" for i in range(40))
    out = substring.remove_repeats(make(spark, [(1, text), (1, text), (2, text)])).select("row.doc_id", "n_removed").collect()
    assert sorted(map(tuple, out)) == [(1, 0), (1, 0), (2, 40)]
