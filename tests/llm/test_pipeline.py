"""The corpus pipeline: each stage against brute force on its own input."""

import brute
import corpus_pipeline
from tidewatch.llm.common import scratch_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = scratch_table(stage(spark, docs, SF), name)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language":
            assert {d for d, t in before if any(c.isalpha() for c in t or "")} == set(after)
        elif name == "near_duplicates":
            assert set(after) == {c for _, _, c in brute.simhash(before)}
        elif name == "repeated_passages":
            want = {}
            texts = dict(before)
            for doc, w, gone in brute.kept_words(before):
                if not any(gone):
                    want[doc] = texts[doc]
                elif not all(gone):
                    want[doc] = b" ".join(x for x, g in zip(w, gone) if not g).decode()
            assert after == want
        elif name == "benchmark":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {d for d, *_, flag in brute.decontaminate(before, items) if not flag}
        else:
            rows = docs.collect()
            n = {d: len(brute.words(t)) for d, t in before}
            assert rows and all(n[r["doc_id"]] == r["n_tokens"] for r in rows)


def test_run_gives_the_mix(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
