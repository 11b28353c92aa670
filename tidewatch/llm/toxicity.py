"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding undoes what hides a word: compatibility forms and marks (NFKD), letters of other scripts that
look Latin, and digits or signs that stand for letters inside a word. What is no letter then
separates words.

1. The labels of at most about ``SAMPLE`` documents are taken; their distinct texts teach. (The
   bound keeps the labels small enough to broadcast; beyond it a hash of the id chooses.)
2. Each word's weight is the log odds of the documents it is in, toxic against others, less one
   standard error; words from ``MIN_WEIGHT`` on, in ``MIN_DOCS`` toxic texts at least, are the lexicon.
3. Exception phrases: two-word phrases around a lexicon word that the texts which are not toxic hold
   as often as toxic ones do, and any given by the caller. A match inside an exception phrase does
   not count.
4. A text's weight is the sum over its matches, divided by ln(e + words). A logistic curve over it is
   fitted to the same texts, each one weighed with its own label's counts taken out of the lexicon.

Defined results: a null or empty text has no match and scores like any text without one; labels that
are null count for nothing, of several for one id the largest holds; rows that repeat are scored each;
without labels of both kinds the score is 0. Columns of the same names are kept apart in ``row``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import scratch_table

SAMPLE = 200_000
MIN_DOCS, MIN_WEIGHT = 3, 2.0
#: From this score on a text counts as toxic.
TOXIC = 0.7
#: Width of a step of text weights in the curve's histogram, its largest step, strength of its prior.
_STEP, _STEPS, _RIDGE = 0.05, 2000, 0.01

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = str.maketrans(
    "авезіјкмнорстухѕԁԛԝһαβγεικνορτυχωıł",
    "abe3ijkmhopctyxsdqwhabyeikvoptuxwil")
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")

_SIGNED = re.compile(r"(?<![a-z0-9@$!|])[a-z]*+[0-9@$!|][a-z0-9@$!|]*+")
_LETTER = re.compile("[a-z]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _unsign(m: re.Match) -> str:
    word = m[0].rstrip("!|")  # at the end they are punctuation
    return word.translate(SIGNS) if _LETTER.search(word) else " "


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    text = (text or "").lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c)).translate(LOOKALIKES)
    return _NOT_LETTERS.sub(" ", _SIGNED.sub(_unsign, text)).split()


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, 0)))  # [whole, a toxic text less, another text less], word
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    base: float = -math.inf


class Matcher:
    """Finds lexicon words and exception phrases between spaces in folded text."""

    def __init__(self, model: Model):
        self.weights = model.weights
        self.automaton = ahocorasick.Automaton()
        for i, word in enumerate(model.words):
            self.automaton.add_word(f" {word} ", (i, len(word) + 1))
        for phrase in model.exceptions:
            if f" {phrase} " not in self.automaton:
                self.automaton.add_word(f" {phrase} ", (-1, len(phrase) + 1))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def find(self, words: list[str]) -> tuple[list[int], int]:
        """Lexicon numbers of the matches that count, and the number of excepted ones."""
        if not self.any:
            return [], 0
        hits, covered = [], []
        for end, (i, size) in self.automaton.iter(f" {' '.join(words)} "):
            (hits if i >= 0 else covered).append((end - size, end, i))
        if not covered:
            return [i for _, _, i in hits], 0
        # phrases in order of their start; of those that start no later, the farthest end decides
        covered.sort()
        starts, ends = np.array([c[0] for c in covered]), np.maximum.accumulate([c[1] for c in covered])
        counted = []
        for begin, end, i in hits:
            k = int(np.searchsorted(starts, begin, side="right")) - 1
            if k < 0 or ends[k] < end:
                counted.append(i)
        return counted, len(hits) - len(counted)

    def weigh(self, words: list[str], left_out: int = 0) -> tuple[float, int, int]:
        """(weight by length, matches, excepted matches)."""
        hits, excepted = self.find(words)
        return float(self.weights[left_out, hits].sum()) / math.log(math.e + len(words)), len(hits), excepted


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log odds of a word in toxic texts against others, less a standard error."""
    toxic, clean = np.maximum(toxic, 0), np.maximum(clean, 0)
    return (np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)) - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


def _count(pick, hold=500_000):
    """Adds up ``pick(words)``, distinct for each text, by label: (key, toxic, clean)."""
    schema = pa.schema([("key", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        counts = (Counter(), Counter())  # clean, toxic

        def out():
            keys = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()),
                                                pa.array([counts[0][k] for k in keys], pa.int64())], schema=schema)
            counts[0].clear()
            counts[1].clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                counts[toxic].update(set(pick(fold(text.as_py()))))
                if len(counts[0]) + len(counts[1]) > hold:
                    yield out()
        yield out()
    return run


def _counted(texts: DataFrame, pick) -> DataFrame:
    return texts.mapInArrow(_count(pick), "key string, toxic bigint, clean bigint").groupBy("key").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the distinct labelled texts, as a scratch table."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > sample:  # the hash keeps about ``sample`` ids
        known = known.where(F.expr(f"pmod(xxhash64(doc_id), {1 << 30}) < {int((1 << 30) * sample / n)}"))
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return scratch_table(found.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")


def _steps(shared):
    schema = pa.schema([("step", pa.int64()), ("toxic", pa.int64()), ("n", pa.int64())])

    def run(batches):
        matcher, counts = Matcher(shared.value), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                weight, _, _ = matcher.weigh(fold(text.as_py()), 1 if toxic else 2)
                counts[min(int(weight / _STEP), _STEPS), toxic] += 1
        yield pa.RecordBatch.from_pylist([{"step": s, "toxic": t, "n": n} for (s, t), n in counts.items()], schema)
    return run


def fit(steps: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(slope, base) of a logistic curve over text weights, by Newton steps on a histogram."""
    x = np.stack([steps * _STEP, np.ones(len(steps))], axis=1)
    beta, ridge = np.zeros(2), np.array([_RIDGE, _RIDGE])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (toxic - p)) - ridge * beta
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        beta = beta + move * min(1.0, 4 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), sample: int = SAMPLE) -> Model:
    """The model of the documents (doc_id, text) that ``labels`` (doc_id, toxic) marks; ``exceptions``
    are further phrases in which a word does not count."""
    texts = labelled(docs, labels, sample)
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model()
    rough = "ln((toxic + 0.5) / {t}) - ln((clean + 0.5) / {c}) >= {w}".format(t=n[1] + 1, c=n[0] + 1, w=MIN_WEIGHT)
    found = sorted(_counted(texts, lambda words: words).where(f"toxic >= {MIN_DOCS}").where(rough).collect(), key=lambda r: r["key"])
    toxic, clean = np.array([r["toxic"] for r in found], float), np.array([r["clean"] for r in found], float)
    kept = np.flatnonzero(log_odds(toxic, clean, n[1], n[0]) >= MIN_WEIGHT)
    words, toxic, clean = [found[i]["key"] for i in kept], toxic[kept], clean[kept]
    weights = np.stack([log_odds(toxic, clean, n[1], n[0]), log_odds(toxic - 1, clean, n[1] - 1, n[0]), log_odds(toxic, clean - 1, n[1], n[0] - 1)])
    weights[(weights < MIN_WEIGHT) | (np.stack([toxic, toxic - 1, toxic]) < MIN_DOCS)] = 0
    lexicon = frozenset(words)

    def phrases(given):
        return [f"{a} {b}" for a, b in zip(given, given[1:]) if a in lexicon or b in lexicon]

    milder = _counted(texts, phrases).where(f"clean >= {MIN_DOCS}").where(f"clean * {n[1]} >= toxic * {n[0]}")
    model = Model(words, weights, sorted({*(" ".join(fold(e)) for e in exceptions), *(r["key"] for r in milder.collect())} - {""}))
    shared = texts.sparkSession.sparkContext.broadcast(model)
    steps = texts.mapInArrow(_steps(shared), "step bigint, toxic bigint, n bigint").groupBy("step", "toxic").agg(F.sum("n").alias("n")).collect()
    model.slope, model.base = fit(*(np.array([r[c] for r in steps], float) for c in ("step", "toxic", "n")))
    return model


def chance(odds: float) -> float:
    """The probability of given log odds."""
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def _score(shared):
    def run(batches):
        model = shared.value
        matcher = Matcher(model)
        for batch in batches:
            n_words, found, excepted, scores = [], [], [], []
            for text in batch.column("text"):
                words = fold(text.as_py())
                weight, hits, left = matcher.weigh(words)
                n_words.append(len(words))
                found.append(hits)
                excepted.append(left)
                scores.append(chance(model.slope * weight + model.base))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(scores, pa.float64()), pa.array(n_words, pa.int64()), pa.array(found, pa.int64()), pa.array(excepted, pa.int64())],
                names=["row", "score", "n_words", "n_matches", "n_excepted"])
    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score, n_words, n_matches, n_excepted) of every row: ``row`` is a struct of the columns
    of ``docs`` but the text."""
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), f"row {kind}, score double, n_words bigint, n_matches bigint, n_excepted bigint")
