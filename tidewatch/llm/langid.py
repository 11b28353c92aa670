"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-grams are the character pairs and triples of the lower-cased text, hashed into ``BUCKETS``
buckets. Training counts buckets per language over all labelled rows (each task sums its rows into
one dense vector per language and sends the non-zero entries); the matrix of log probabilities,
BUCKETS x languages, is broadcast - its size does not depend on the corpus, and the number of
languages is checked. Scoring looks the n-grams of a batch of texts up in the matrix and sums the
rows of each text in numpy.

The score is the posterior probability of the predicted language. It says which language is the
likeliest, not that the text is in any of them, and comes near 1 after some dozen n-grams. Whether
a text fits its language is told by its mean log probability per n-gram: the language's own n-grams
reach ``mean`` on average, n-grams at random -log(BUCKETS), and a text fits if it is no further than
``REACH`` of the way from the first to the second, with ``ERRORS`` standard errors of its mean
allowed for its length. Words with digits (numbers, keys, addresses) are in no language: a text that
does not fit also counts as fitting if it does without them and keeps ``REST`` of its n-grams. Defined results: a null text or
one without a letter is ``und`` with score 0; rows without a label do not train; without any
training row every text is ``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import utf8_rows

BUCKETS = 1 << 16
ALPHA = 0.5
MAX_LANGUAGES = 1000
REACH, ERRORS, REST = 0.65, 2.0, 0.25
UNKNOWN = "und"
#: Characters that are looked up at a time.
_CHUNK = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
_WITH_DIGITS = re.compile(r"\S*\d\S*")
_K1, _K2, _K3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _grams(text: str):
    """Arrays of buckets of a text, for about ``_CHUNK`` characters at a time."""
    text = text.lower()
    for at in range(0, max(len(text) - 1, 1), _CHUNK):
        c = np.frombuffer(text[at:at + _CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        pairs = c[:-1] * _K1 + c[1:] * _K2
        triples = pairs[:-1] ^ (c[2:] * _K3)
        more = at + _CHUNK + 2 <= len(text)
        for h in (pairs[:_CHUNK] if more else pairs, triples[:_CHUNK] if more else triples):
            yield (h ^ (h >> np.uint32(15))) * _K2 >> np.uint32(16)


def _has_letter(text: str) -> bool:
    """Some characters that are neither digits nor letters, such as superscripts, count as word
    characters."""
    return any(found.group().isalpha() for found in _LETTER.finditer(text))


def _decode(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _count(batches):
    counts = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    for batch in batches:
        held = defaultdict(list)
        for lang, data in zip(batch.column(1).to_pylist(), utf8_rows(batch.column(0))):
            held[lang].extend(_grams(_decode(data)))
            if len(held[lang]) > 512:
                counts[lang] += np.bincount(np.concatenate(held.pop(lang)), minlength=BUCKETS)
        for lang, parts in held.items():
            if parts:
                counts[lang] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
    for lang, n in counts.items():
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(n[used])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log prior, log probabilities [BUCKETS, languages]) from rows with a label."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(prior) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(prior)
    sums = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    column = np.array([place[x] for x in sums.column("lang").to_pylist()], np.int64)
    counts[sums.column("bucket").to_numpy(), column] = sums.column("n").to_numpy()
    log_p = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * BUCKETS)) if langs else counts
    total = sum(prior.values())
    return langs, np.log(np.array([prior[x] / total for x in langs])) if langs else np.empty(0), log_p.astype(np.float32)


def _expected(log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the log probability of an n-gram of each language."""
    log_p = log_p.astype(np.float64)
    p = np.exp(log_p)
    mean = (p * log_p).sum(axis=0)
    return mean, np.sqrt(np.maximum((p * log_p ** 2).sum(axis=0) - mean ** 2, 0.0))


def _score(model, fit: bool = False):
    """``fit``: also tells whether a text fits its language."""
    def run(batches):
        langs, prior, log_p = model.value
        mean, spread = _expected(log_p) if fit and langs else (None, None)
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((n, len(langs)))
            heard, n_grams = np.zeros(n, bool), np.zeros(n, np.int64)
            held, sizes, rows = [], [], []

            def flush():
                if held:
                    seen = log_p[np.concatenate(held)]
                    starts = np.cumsum([0, *sizes[:-1]])
                    np.add.at(sums, rows, np.add.reduceat(seen, starts, axis=0, dtype=np.float64))
                    held.clear(), sizes.clear(), rows.clear()

            size = 0
            for i, data in enumerate(utf8_rows(batch.column(1))):
                text = _decode(data) if data else ""
                if not langs or not _has_letter(text):
                    continue
                heard[i] = True
                for grams in _grams(text):
                    if len(grams):
                        held.append(grams), sizes.append(len(grams)), rows.append(i)
                        size += len(grams)
                        n_grams[i] += len(grams)
                    if size > _CHUNK:
                        flush()
                        size = 0
            flush()
            pred, score, fits = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            if langs:
                likelihood = sums
                sums = sums + prior
                best = sums.argmax(axis=1)
                if fit:
                    some = np.maximum(n_grams, 1)
                    floor = mean - REACH * (mean + np.log(BUCKETS))
                    reached = likelihood[np.arange(n), best] / some
                    fits = heard & ((n_grams == 0) | (reached >= floor[best] - ERRORS * spread[best] / np.sqrt(some)))
                    again = np.flatnonzero(heard & ~fits)
                    for i, data in zip(again.tolist(), utf8_rows(batch.column(1).take(pa.array(again, pa.int64())))):
                        b, total, kept = best[i], 0.0, 0
                        for grams in _grams(_WITH_DIGITS.sub("", _decode(data))):
                            total += log_p[grams, b].sum(dtype=np.float64)
                            kept += len(grams)
                        fits[i] = kept >= REST * n_grams[i] and total >= (floor[b] - ERRORS * spread[b] / np.sqrt(kept)) * kept
                post = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), heard.tolist())]
                score = np.where(heard, post, 0.0)
            more = ([pa.array(fits)], ["fits"]) if fit else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), *more[0], *batch.columns[2:]],
                                             names=["row", "lang_pred", "score", *more[1], *batch.schema.names[2:]])
    return run


def predict(docs: DataFrame, model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(row, lang_pred, score[, fits, text]) of every row; ``row`` is a struct of the columns of
    ``docs`` but the text."""
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if not keep_text:
        score = _score(shared)
        return rows.mapInArrow(lambda it: score(it), f"row {kind}, lang_pred string, score double")
    score = _score(shared, fit=True)
    twice = rows.select("row", "text", F.col("text").alias("kept"))
    return twice.mapInArrow(lambda it: score(it), f"row {kind}, lang_pred string, score double, fits boolean, kept string")


def drop_unidentified(docs: DataFrame, model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` without texts that have no letter, whose best language scores below ``min_score``
    or that do not fit that language."""
    told = predict(docs, model, text_col, keep_text=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & F.col("fits"))
    return told.select(*[F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
