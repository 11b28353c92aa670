"""Operators with a third and more of all rows on one key."""

import pytest

from tidewatch.llm import chat, mixing, substring


@pytest.fixture()
def many_ranges(spark):
    """Small shuffles stay apart, so that one conversation stands in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _conversations():
    hot = [(1, None if k % 2 else k // 40, "user", f"turn {k % 1500}") for k in range(3000)]
    others = [(c, k, "user", f"{c % 7} says {k}") for c in range(2, 60) for k in range(1 + c // 7)]
    return hot + others


def test_chat_hot_conversation_is_cut_into_runs(spark, many_ranges):
    turns = spark.createDataFrame(_conversations(), "conv_id bigint, turn bigint, role string, text string")
    rows = chat.prefixes(turns).collect()
    of_hot = [r for r in rows if r["conv_id"] == 1]
    distinct = {r[1:] for r in _conversations() if r[0] == 1}
    assert sorted(r["n"] for r in of_hot) == list(range(1, len(distinct) + 1))
    assert len({r["run"] for r in of_hot}) > 1
    assert [r["n"] for r in of_hot if r["whole"]] == [len(distinct)]
    out = chat.render(turns, part=100).where("conv_id = 1").collect()
    assert sorted(r["part"] for r in out) == list(range(-(-len(distinct) // 100)))
    assert all(r["rendered"].count("<|end|>") == 100 for r in out[:-1] if (r["part"] + 1) * 100 <= len(distinct))
    assert sum(r["rendered"].count("<|end|>") for r in out) == len(distinct)


def test_chat_does_not_depend_on_runs(spark, many_ranges):
    rows = _conversations() + [(90, k, "user", f"turn {k}") for k in range(700)] + [(91, k, "user", f"turn {k}") for k in range(650)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    apart = sorted(map(tuple, chat.render(turns).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert apart == sorted(map(tuple, chat.render(turns.coalesce(1)).collect()))
    kept = {r[0] for r in apart}
    assert 90 in kept and 91 not in kept
    # the smallest of the longest ones of each kind of talk, and the two others
    longest = {c % 7: c for c in range(59, 1, -1) if 1 + c // 7 == max(1 + d // 7 for d in range(2, 60) if d % 7 == c % 7)}
    assert kept == {1, 90, *longest.values()}


def test_mix_spreads_null_ids_and_equal_rows(spark):
    rows = [(None, f"text number {i}", "a") for i in range(2000)] + [(7, "the same row", "a")] * 2000 + [(100 + i, f"other {i}", "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, block_tokens=200, group_blocks=4)
    again = mixing.mix(docs.repartition(5), block_tokens=200, group_blocks=4)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    for which in ("doc_id IS NULL", "doc_id = 7", "doc_id >= 100"):
        sizes = [r["count"] for r in out.where(which).where("epoch = 0").groupBy("source", "block").count().collect()]
        assert len(sizes) > 60 and max(sizes) < 80, which
    # a whole epoch draws every row once, and its blocks lie end to end
    a = out.where("source = 'a'")
    full = a.groupBy("epoch").agg({"n_tokens": "sum", "*": "count"}).collect()
    assert any(r["count(1)"] == 4000 for r in full) or a.count() < 4000
    starts = sorted((r["epoch"], r["block_start"], r["size"]) for r in a.groupBy("epoch", "block", "block_start").agg({"n_tokens": "sum"})
                    .withColumnRenamed("sum(n_tokens)", "size").collect())
    for (_, at, size), (_, after, _) in zip(starts, starts[1:]):
        assert at + size <= after


def test_mix_numbers_more_equal_rows_than_a_chunk(spark):
    docs = spark.createDataFrame([(None, "a b", "x")], "doc_id bigint, text string, source string").crossJoin(spark.range(9000).select())
    out = mixing.mix(docs, block_tokens=100)
    assert out.count() == 9000 and max(r["count"] for r in out.groupBy("block").count().collect()) < 110


def test_substring_places_of_copies_stay_distinct(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(5, f"{passage} tail")] * 3000 + [(i, f"w{i} {passage} z{i}") for i in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
    got = substring.remove_repeats(docs).select("row.doc_id", "n_words", "n_removed").groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 32, 0, 1), (2, 32, 30, 1), (3, 32, 30, 1), (4, 32, 30, 1), *sorted(
        tuple(r) for r in got if r["doc_id"] == 5)]
    assert sum(r["count"] for r in got if r["doc_id"] == 5) == 3000
