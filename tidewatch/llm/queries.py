"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    chat, decontaminate, divergence, hmm, langid, mixing, prefix_trie, quality, simhash, substring, toxicity, urlfilter, wordpiece)
from tidewatch.llm.common import remainder, scratch_table, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = decontaminate.match_items(docs, table(spark, sf_dir, "benchmark"))
    return hit.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return wordpiece.token_counts(docs).select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_words", "n_tokens", "max_word_tokens")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose id's crc32 is not 2 modulo 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = docs.where(remainder("doc_id", 7) != 2).select(F.coalesce("text", F.lit("")).alias("text"))
    lex, tail_counts = hmm.lexicon(texts)
    encoded = hmm.encode(docs, lex)
    model, _ = hmm.train(encoded.where(remainder("row.doc_id", 7) != 2), lex)
    told = hmm.score(encoded, lex, tail_counts, model)
    return told.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(remainder("row.doc_id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", F.lit(lex.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def langid_model(spark: SparkSession, sf_dir: str):
    """Trained on the labelled documents whose id's crc32 is not 2 modulo 4."""
    docs = table(spark, sf_dir, "documents")
    return langid.train(docs.where(remainder("doc_id", 4) != 2))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = langid.predict(docs, langid_model(spark, sf_dir))
    return told.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(remainder("row.doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                       "lang_pred", "score")


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.base_failed().alias("base_failed"), "kept", F.array_join("broken", ",").alias("broken"))


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, nth, a, b, words) and (conv_id, n): conversation c starts with the first h turns of
    c - c % 20 (h: crc32 of its decimal id, modulo 4) and goes on with its own after its first h."""
    turns = scratch_table(prefix_trie.number_turns(conversations), "numbered")
    own = turns.groupBy("conv_id").agg(F.max("nth").alias("own_n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "base": F.expr("conv_id - conv_id % 20")})
    bases = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("own_n").alias("base_n"))
    plan = own.join(bases, "base", "left").withColumn("taken", F.expr("least(h, coalesce(base_n, 0))"))
    lengths = plan.select("conv_id", F.expr("taken + greatest(own_n - h, 0)").alias("n"))
    first = turns.where("conv_id % 20 = 0 AND nth <= 3").withColumnRenamed("conv_id", "base")
    heads = own.select("conv_id", "base", "h").join(first, "base").where("nth <= h").select("conv_id", "nth", "a", "b", "words")
    tails = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).where("nth > h").join(
        plan.select("conv_id", "taken"), "conv_id").select("conv_id", F.expr("taken + nth - h").alias("nth"), "a", "b", "words")
    return heads.unionByName(tails), lengths


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = rebuilt_conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(turns, lengths)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents whose id's crc32 is not 1 modulo 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.where(remainder("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(remainder("row.doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"), "n_words", "n_matches", "n_excepted")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_chat_format, op2_temperature_mix, op3_decontaminate, op4_token_counts, op5_url_filter, op6_hmm_score,
        op7_language_id, op8_simhash_components, op9_substring_dedup, op10_quality_rules, op11_prefix_trie, op12_toxicity,
        op13_source_divergence)
}
