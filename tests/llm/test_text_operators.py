"""Decontamination, token counts, language ID, language model, quality rules on small inputs."""

import glob
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tidewatch.llm import decontaminate, hmm, langid, mixing, quality, wordpiece
from tidewatch.llm.common import remainder
from tidewatch.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id bigint, text string, n_words string, row string")


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def contaminated_corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "l'été", "X9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(12)]
    items += [(50, items[0][1]), (51, ""), (52, None), (None, "w1 w2"), (None, "w3 w4 w5"), (None, items[4][1]), (53, items[3][1] + "! " + items[4][1]), (53, items[3][1])]
    docs = []
    for i in range(60):
        w = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200)))
        docs.append((i, w + " " + rng.choice(items[:12])[1].upper().replace(" ", " - ") + " " + w[:50]))
    docs += [(100, ""), (101, None), (102, "..."), (None, items[2][1]), (103, ", ".join(t for _, t in items if t)), (103, "again")]
    return docs, items


@pytest.mark.parametrize("shard", [decontaminate.SHARD_WORDS, 20])
def test_decontaminate_equals_brute_force(spark, shard):
    docs, items = contaminated_corpus()
    hit = decontaminate.match_items(frame(spark, docs), items_frame(spark, items), shard_words=shard)
    got = hit.select("row.doc_id", "n_words", decontaminate.n_hit(), F.size("items"),
                     F.sha2(F.array_join("items", ",").cast("binary"), 256), decontaminate.contaminated()).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.decontaminate(docs, items), key=repr)


def test_decontaminate_holds_one_shard_at_a_time(spark):
    """However many shards the items have, the plan has one stage with an automaton, and one
    scratch table stays."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    docs, items = contaminated_corpus()
    before = set(glob.glob(f"{folder}/scratch-spans-*"))
    hit = decontaminate.match_items(frame(spark, docs), items_frame(spark, items), shard_words=60)
    assert hit._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert len(set(glob.glob(f"{folder}/scratch-spans-*")) - before) == 1
    assert hit.count() == len(docs)


def test_decontaminate_long_text_in_runs(spark, monkeypatch):
    docs, items = contaminated_corpus()
    automaton = decontaminate.Automaton([(str(i), decontaminate._item_words(t.encode())) for i, t in items if i is not None and t], 13)
    long = " ".join(t for _, t in docs if t).encode().translate(decontaminate._TO_WORDS)
    whole = automaton.scan(long)
    runs = decontaminate.word_runs
    monkeypatch.setattr(decontaminate, "word_runs", lambda data: runs(data, 50))
    assert automaton.scan(long) == whole


def test_drop_contaminated_leaves_the_rest(spark):
    docs, items = contaminated_corpus()
    bad = {d for d, *_, flag in brute.decontaminate(docs, items) if flag}
    df = frame(spark, docs)
    out = decontaminate.drop_contaminated(df, items_frame(spark, items))
    assert out.columns == df.columns
    assert sorted(map(repr, (tuple(r)[:2] for r in out.collect()))) == sorted(repr((d, t)) for (d, t), f in zip(docs, brute.decontaminate(docs, items)) if not f[-1])
    assert bad
    none = decontaminate.drop_contaminated(df, items_frame(spark, []))
    assert none.count() == len(docs)
    assert decontaminate.drop_contaminated(frame(spark, []), items_frame(spark, items)).count() == 0


def test_remove_spans_cuts_hit_words(spark):
    item = " ".join(f"q{i}" for i in range(15))
    text = "lead " * 400 + item.upper() + ", tail" * 20
    out = decontaminate.remove_spans(frame(spark, [(1, text), (2, "clean text")]), items_frame(spark, [(1, item)])).collect()
    cut = {r["doc_id"]: r["text"] for r in out}
    assert cut[2] == "clean text"
    assert brute.item_words(cut[1]) == ["lead"] * 400 + ["tail"] * 20


def test_token_counts_equal_greedy_matching(spark):
    rng = random.Random(2)
    alphabet = b"abc"
    for _ in range(30):
        pieces = {bytes(rng.choices(alphabet, k=rng.randint(1, 5))) for _ in range(12)}
        pieces |= {b"\0" + p for p in list(pieces)[:6]}
        matcher = wordpiece.Matcher(b"\0", sorted(pieces))
        for _ in range(60):
            word = bytes(rng.choices(b"abcd", k=rng.randint(1, 12)))
            assert matcher.count(word) == brute.greedy_pieces(b"\0", pieces, word), (pieces, word)


def test_token_counts_of_documents(spark):
    docs = [(1, None), (2, ""), (3, "Hello wörld x\t\n!!"), (4, "x" * 3000), (4, "x" * 3000), (None, "the of")]
    mark, pieces = wordpiece.read_vocabulary(spark)
    got = wordpiece.token_counts(frame(spark, docs)).select("row.doc_id", "n_words", "n_tokens", "max_word_tokens").collect()
    have = set(pieces)
    want = []
    for doc, text in docs:
        each = [brute.greedy_pieces(mark, have, w) for w in brute.words(text)]
        want.append((doc, len(each), sum(each), max(each, default=0)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert wordpiece.token_counts(frame(spark, [])).count() == 0


def test_word_piece_list(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("un\n##aff\n##able\nable\n##a\n")
    out = wordpiece.token_counts(frame(spark, [(1, "unaffable able unable xyz")]), vocabulary=str(path)).first()
    assert out["n_tokens"] == 3 + 1 + 2 + 1


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(remainder("doc_id", 4) != 2))
    told = langid.predict(docs.where(remainder("doc_id", 4) == 2).select("doc_id", "lang", "text"), model)
    right = told.agg(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert told.where("score < 0 OR score > 1").count() == 0


def test_language_edge_cases(spark):
    rows = [(1, "le chat est là", "fr"), (2, "the cat is there", "en"), (3, None, "en"), (4, "123 ...", "fr"), (5, "text", None), (6, "", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert model[0] == ["de", "en", "fr"]
    docs = frame(spark, [(1, None), (2, ""), (3, "12 34"), (7, "x² + 1".replace("x", "1")), (4, "le chat"), (4, "le chat"), (5, "a"), (6, "le chat " * 60000)])
    got = {(r["row"]["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()}
    assert got >= {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (4, "fr"), (6, "fr")}
    kept = langid.drop_unidentified(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {4, 6}
    untrained = langid.train(df.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, untrained).collect()} == {"und"}


def test_texts_of_no_learned_language_go(spark):
    """Posteriors of long texts are near 1 whatever they hold; the fit tells."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = langid.train(docs.where(remainder("doc_id", 4) != 2))
    planted = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 5,
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem " * 5,
        "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα " * 5,
        "# $ % & | < > ~ { } " * 30 + "a", "4397110767823743 " * 30 + "a"]
    odd = spark.createDataFrame([(-1 - i, None, t) for i, t in enumerate(planted)], docs.schema)
    assert langid.predict(odd, model).where("score < 0.9").count() == 0
    short = [(-100, None, "der"), (-101, None, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" From the that of and this with')]
    kept = langid.drop_unidentified(docs.unionByName(odd).unionByName(spark.createDataFrame(short, docs.schema)), model)
    want = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")} | {-100, -101}
    assert {r["doc_id"] for r in kept.collect()} == want


def plain_grams(text):
    """Bucket of each pair and triple of characters, one at a time."""
    c, wrap = [ord(x) for x in text.lower()], 0xFFFFFFFF
    out = []
    for k in range(len(c) - 1):
        pair = (c[k] * 0x9E3779B1 + c[k + 1] * 0x85EBCA77) & wrap
        for h in (pair, *([pair ^ (c[k + 2] * 0xC2B2AE3D & wrap)] if k + 2 < len(c) else [])):
            out.append(((h ^ h >> 15) * 0x85EBCA77 & wrap) >> 16)
    return out


def test_language_equals_plain_naive_bayes(spark):
    """Every row, repeated ones and ties too, with columns named like the operator's own."""
    train = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").limit(60).collect()]
    train += [("kuku kaka", "xa"), ("kuku kaka", "xb"), (None, "xb"), ("kaka", None)]
    docs = [(i, r[0], "clash") for i, r in enumerate(train)] + [(90, "kuku", "clash"), (90, "kuku", "clash"), (91, "é", None), (92, "", None), (93, "12", "x"), (94, "A", "x")]
    counts, prior = {}, {}
    for text, lang in train:
        if text is not None and lang is not None:
            prior[lang] = prior.get(lang, 0) + 1
            of = counts.setdefault(lang, {})
            for g in plain_grams(text):
                of[g] = of.get(g, 0) + 1
    total = {x: sum(of.values()) for x, of in counts.items()}

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        sums = {x: math.log(prior[x] / sum(prior.values())) + sum(
            math.log((counts[x].get(g, 0) + langid.ALPHA) / (total[x] + langid.ALPHA * langid.BUCKETS)) for g in plain_grams(text)) for x in sorted(prior)}
        best = max(sums, key=lambda x: sums[x])
        return best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())

    model = langid.train(spark.createDataFrame(train, "text string, lang string"))
    got = langid.predict(spark.createDataFrame(docs, "doc_id bigint, text string, score string"), model).collect()
    assert len(got) == len(docs)
    texts = dict((i, t) for i, t, _ in docs)
    assert sorted(r["row"]["doc_id"] for r in got) == sorted(i for i, _, _ in docs)
    for r in got:
        lang, score = plain(texts[r["row"]["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=2e-3), r


def test_language_grams_do_not_depend_on_chunks(monkeypatch):
    text = "".join(random.Random(1).choices("abcdé ", k=5000))
    whole = np.sort(np.concatenate(list(langid._grams(text))))
    for size in (1000, 4999, 4998, 2500):
        monkeypatch.setattr(langid, "_CHUNK", size)
        assert (np.sort(np.concatenate(list(langid._grams(text)))) == whole).all()


def brute_forward(classes, model):
    """Sum over all paths, by the plain recursion in log space."""
    a = np.log(model.starts) + np.log(model.emits[classes[0]])
    for c in classes[1:]:
        a = np.logaddexp.reduce(a[:, None] + np.log(model.moves), axis=0) + np.log(model.emits[c])
    return float(np.logaddexp.reduce(a)) / math.log(10)


def test_hmm_equals_plain_recursion(spark, monkeypatch):
    monkeypatch.setattr(hmm, "OWN", 40)
    monkeypatch.setattr(hmm, "HEAD", 60)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (7001, ""), (7002, "never seen words zzz"), (7002, "never seen words zzz")], "doc_id bigint, text string")
    docs = docs.unionByName(extra)
    texts = docs.where(remainder("doc_id", 7) != 2).select(F.coalesce("text", F.lit("")).alias("text"))
    lex, tail = hmm.lexicon(texts)
    encoded = hmm.encode(docs, lex)
    model, likelihoods = hmm.train(encoded.where(remainder("row.doc_id", 7) != 2), lex, states=4, rounds=3)
    assert likelihoods == sorted(likelihoods)
    assert np.allclose(model.emits.sum(axis=0), 1) and np.allclose(model.moves.sum(axis=1), 1)
    got = hmm.score(encoded, lex, tail, model).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    counts = {}
    trained = [r["text"] or "" for r in rows if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    for t in trained:
        for w in t.encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(trained), len(counts) + 1
    assert (lex.n_tokens, lex.n_types) == (n, v)
    own = set(list(lex.place)[:lex.own])
    text_of = {}
    for r in rows:
        text_of.setdefault(r["doc_id"], r["text"])
    for r in got[::7] + got[-4:]:
        w = (text_of[r["row"]["doc_id"]] or "").encode().lower().split()
        base = sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w) + math.log10((len(trained) + 1) / (n + v + 1))
        assert r["n_tokens"] == len(w) + 1
        assert r["n_known"] == sum(x in counts for x in w) + 1
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        classes, within = [], 0.0
        for x in w:
            if x in own:
                classes.append(lex.place[x])
            else:
                b = zlib.crc32(x) % hmm.BUCKETS
                classes.append(lex.own + b)
                within += math.log10((counts.get(x, 0) + 1) / (lex.bucket_tokens[b] + lex.bucket_types[b] + 1))
        assert r["score"] == pytest.approx(brute_forward([*classes, lex.classes - 1], model) + within, abs=1e-6)


def plain_expected_counts(text, model):
    """Unscaled Baum-Welch counts of one text, and its likelihood."""
    k, n = len(model.starts), len(text)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        alpha[t] = (model.starts if t == 0 else alpha[t - 1] @ model.moves) * model.emits[text[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = model.moves @ (model.emits[text[t + 1]] * beta[t + 1])
    chance = alpha[-1].sum()
    emits, moves = np.zeros(model.emits.shape), np.zeros((k, k))
    for t in range(n):
        emits[text[t]] += alpha[t] * beta[t] / chance
        if t:
            moves += np.outer(alpha[t - 1], model.emits[text[t]] * beta[t]) * model.moves / chance
    return emits, moves, alpha[0] * beta[0] / chance, chance


@pytest.mark.parametrize("piece", [1000, 3, 1])
def test_hmm_expected_counts_equal_plain_version(monkeypatch, piece):
    monkeypatch.setattr(hmm, "PIECE", piece)
    rng = np.random.default_rng(1)
    k, c = 3, 11
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    texts = [rng.integers(0, c, n).astype(np.uint16) for n in (1, 5, 9, 2, 9, 40)]
    emits, moves, starts = np.zeros((c, k)), np.zeros((k, k)), np.zeros(k)
    if piece == 1000:
        likelihood = hmm.expected_counts(texts, model, emits, moves, starts)[0]
    else:
        likelihood = sum(hmm.expected_of_long(x, model, emits, moves, starts) for x in texts)
    plain = [plain_expected_counts(x, model) for x in texts]
    for got, n in ((emits, 0), (moves, 1), (starts, 2)):
        assert np.allclose(got, sum(p[n] for p in plain))
    assert likelihood == pytest.approx(sum(math.log(p[3]) for p in plain))


def test_hmm_without_training_texts(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    lex, tail = hmm.lexicon(docs.where("false").select("text"))
    encoded = hmm.encode(docs.select("doc_id", "text"), lex)
    model, _ = hmm.train(encoded.where("false"), lex, rounds=1)
    got = hmm.score(encoded, lex, tail, model).collect()
    assert all(math.isfinite(r["score"]) and r["base_score"] == 0 and r["n_known"] == 0 for r in got)


def test_quality_rules(spark):
    good = " ".join(["the", "cat", "of"] + [f"word{i} and" for i in range(60)])
    docs = [(1, None), (2, ""), (3, good), (4, "a b c " * 40), (5, good + " #" * 30), (6, (good + "\n") * 3), (7, "a a a a"), (8, "x y z x y z"), (3, good)]
    got = {r["row"]["doc_id"]: r for r in quality.judge(frame(spark, docs)).collect()}
    assert got[1]["n_words"] == 0 and not got[1]["kept"]
    assert got[3]["kept"] and got[3]["n_repeat_words"] == 0
    assert got[4]["n_repeat_words"] == 120 and not got[4]["kept"]
    assert got[5]["n_symbols"] == 30 and "symbols" in got[5]["broken"]
    assert got[6]["n_dup_lines"] == 2 and got[6]["n_lines"] == 3 and "repeated_lines" in got[6]["broken"]
    assert got[7]["n_repeat_words"] == 4
    assert got[8]["n_repeat_words"] == 6
    assert quality.judge(frame(spark, [])).count() == 0


def test_mix_meets_its_limits(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 10 else f"small{i % 3}") for i in range(3000)] + [(9000, None, "x"), (9001, "a b", None), (9002, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, block_tokens=500, entropy_ratio=0.8, max_repeat=5.0).collect()
    again = mixing.mix(docs.repartition(7), block_tokens=500, entropy_ratio=0.8, max_repeat=5.0).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    drawn, have, budget = {}, {}, {}
    for r in out:
        drawn[r["source"]] = drawn.get(r["source"], 0) + r["n_tokens"]
        budget[r["source"]] = r["source_budget"]
    for _, t, s in rows:
        have[s or ""] = have.get(s or "", 0) + len((t or "").split())
    for s, n in drawn.items():
        assert budget[s] - 7 < n <= budget[s]  # short of the budget by less than a document
        assert n <= 5 * have[s]
    assert drawn["big"] < have["big"] and drawn["small0"] > have["small0"]
    weights = np.array(list(budget.values())) / sum(budget.values())
    assert -(weights * np.log(weights)).sum() <= 0.8 * math.log(len(weights)) + 0.05
    assert mixing.mix(docs.where("false")).count() == 0
