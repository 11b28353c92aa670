"""Hidden Markov language model: Baum-Welch in passes over the corpus, exact scaled forward scores.

Words fall into classes: each of the ``OWN`` most frequent words has its own, the others share
``BUCKETS`` classes by hash, the end of a text has one. Latent states emit classes, and a word of a
shared class has probability (count + 1) / (tokens + types + 1 of its class), so the model covers
every word there is or will be, while the broadcast matrix (classes x states) keeps its size.

1. Word counts of all training texts: summed in each task, then by word.
2. Words that are more frequent than a threshold (at most ``HEAD`` of them) are broadcast; the
   threshold comes from a histogram of counts, so nothing is sorted whole.
3. Texts are encoded once, as two bytes of class a token, in a scratch table that all passes read.
4. Each Baum-Welch pass reads all training texts. A task runs forward-backward over many whole texts
   at once, one position a step, and adds up expected counts; these are summed by class over all
   tasks, and the driver gets one row for each class. A text of more than ``PIECE`` tokens keeps the
   forward state at the borders of its pieces and is gone through again from its end, piece by
   piece, so the counts are those of the whole text and memory is bounded.
5. Scoring runs the scaled forward recursion over whole texts. Words below the threshold are looked
   up by a join with all counts, distinct for each text. A word that is rare or unseen in training can
   be frequent elsewhere; the join is inner with one row a word on the other side, so Spark splits
   its partition (AQE).

Defined results: a null text is empty, its one token is the end; A-Z count as lower case; a null
id is neither trained on nor held out; without training texts every token has probability one in
the base. Rows that repeat are scored each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import scratch_table, utf8_rows, word_runs

STATES, ROUNDS = 8, 4
OWN, BUCKETS = 8192, 512
HEAD = 200_000
#: Tokens that a task holds for one step of texts; texts longer than LONG are held apart; tokens of a piece.
HOLD_TOKENS, LONG, PIECE = 400_000, 2048, 1 << 18
#: Strength of the unigram prior of each state's emissions, and of the uniform one of its moves.
PRIOR, MOVE_PRIOR = 200.0, 1.0
_SEED = 7


@dataclass
class Lexicon:
    """What every task needs to know of the words."""

    place: dict[bytes, int]  # head word -> row of the arrays below
    count: np.ndarray        # training count of the head words
    own: int                 # head words with a class of their own (the first ones)
    bucket_tokens: np.ndarray
    bucket_types: np.ndarray
    n_docs: int
    n_tokens: int
    n_types: int
    log_place: np.ndarray    # log10 of (count + 1)
    kind: np.ndarray         # class of the head words

    @property
    def classes(self) -> int:
        return self.own + len(self.bucket_tokens) + 1


@dataclass
class Model:
    starts: np.ndarray  # [state]
    moves: np.ndarray   # [state, state]
    emits: np.ndarray   # [class, state]


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def _count_words(batches):
    counts: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for data in utf8_rows(batch.column(0)):
            for words in word_runs((data or b"").lower()):
                counts.update(words)
            if len(counts) > 500_000:
                yield out()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over one text column."""
    return texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(texts: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon of the training texts, and the (word, n) table of the words below its head."""
    counts = scratch_table(word_counts(texts), "words")
    level = F.floor(F.log2(F.col("n").cast("double")) * 32).cast("bigint")
    n_docs = texts.count()
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect(), key=lambda r: -r["level"])
    least, held = 1 << 40, 0
    for r in levels:
        held += r["types"]
        if held > HEAD:
            break
        least = r["level"]
    top = counts.where(level >= least).toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order].astype(np.float64)
    own = min(OWN, len(words))
    tokens, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy((F.crc32("word") % BUCKETS).alias("bucket")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).collect():
        tokens[r["bucket"]], types[r["bucket"]] = r["tokens"], r["types"]
    for word, c in zip(words[:own], n):
        tokens[_bucket(word)] -= c
        types[_bucket(word)] -= 1
    found = Lexicon({w: i for i, w in enumerate(words)}, n, own, tokens, types, n_docs,
                    sum(r["tokens"] for r in levels) + n_docs, sum(r["types"] for r in levels) + (n_docs > 0), np.log10(n + 1),
                    np.array([i if i < own else own + _bucket(w) for i, w in enumerate(words)] + [0], np.int64))
    return found, counts.where(level < least)


def _classes(words: list[bytes], lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(row in the head or -1, class) of words."""
    at = np.array(list(map(lex.place.get, words, repeat(-1))), np.int64)
    kind = np.take(lex.kind, at, mode="wrap")
    for i in np.flatnonzero(at < 0).tolist():
        kind[i] = lex.own + _bucket(words[i])
    return at, kind


def start_model(lex: Lexicon, states: int = STATES) -> Model:
    """States that stay, each with the unigram distribution of classes times its own fixed noise."""
    noise = np.random.default_rng(_SEED).standard_normal((lex.classes, states))
    noise[-1] = 0
    emits = unigram(lex)[:, None] * np.exp(noise)
    moves = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    return Model(np.full(states, 1.0 / states), moves, emits / emits.sum(axis=0))


def unigram(lex: Lexicon) -> np.ndarray:
    weight = np.concatenate((lex.count[:lex.own] + 1, lex.bucket_tokens + lex.bucket_types + 1, [lex.n_docs + 1]))
    return weight / weight.sum()


def expected_counts(texts: list[np.ndarray], model: Model, emits: np.ndarray, moves: np.ndarray, starts: np.ndarray,
                    before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[float, np.ndarray | None]:
    """Forward-backward over class sequences: adds to the three arrays of expected counts and
    returns the log likelihood. For pieces of texts, ``before`` is the forward state [text, state]
    ahead of the first position and ``after`` the backward one at the last; then the backward state
    for the piece before comes back too."""
    lengths = np.array([len(x) for x in texts])
    order = np.argsort(-lengths, kind="stable")
    lengths, size, states = lengths[order], len(texts), len(model.moves)
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0])))  # texts longer than t
    at = np.concatenate(([0], np.cumsum(live)))                    # position t's rows, longest text first
    begin = np.cumsum(lengths) - lengths
    step = np.arange(at[-1]) - np.repeat(begin, lengths)
    seen = np.empty(at[-1], np.int64)
    seen[at[step] + np.repeat(np.arange(size), lengths)] = np.concatenate([texts[i] for i in order])
    # state-major, so that what is done for each state runs along the texts
    out = np.take(np.ascontiguousarray(model.emits.T), seen, axis=1)
    alpha, scale = np.empty((states, at[-1])), np.empty(at[-1])
    onward, bounds = np.ascontiguousarray(model.moves.T), at.tolist()
    for t, m in enumerate(live.tolist()):
        lo, hi = bounds[t], bounds[t + 1]
        if t:
            a = onward @ a[:, :m]
        else:
            a = np.repeat(model.starts[:, None], size, axis=1) if before is None else onward @ before[order].T
        a *= out[:, lo:hi]
        scale[lo:hi] = total = a.sum(axis=0)
        a /= total
        alpha[:, lo:hi] = a
    out /= scale
    beta = np.ones((states, size)) if after is None else np.ascontiguousarray(after[order].T)
    crossed = np.zeros((states, states))
    for t in range(len(live) - 1, -1, -1):
        lo, hi = bounds[t], bounds[t + 1]
        m = hi - lo
        ahead = out[:, lo:hi] * beta[:, :m]
        alpha[:, lo:hi] *= beta[:, :m]
        if t:
            crossed += alpha[:, bounds[t - 1]:bounds[t - 1] + m] @ ahead.T
            beta[:, :m] = model.moves @ ahead
    left = None
    if before is None:
        starts += alpha[:, :size].sum(axis=1)
    else:
        crossed += before[order].T @ ahead.T
        left = np.empty((size, states))
        left[order] = (model.moves @ ahead).T
    moves += model.moves * crossed
    for k in range(states):
        emits[:, k] += np.bincount(seen, weights=alpha[k], minlength=len(emits))
    return float(np.log(scale).sum()), left


def expected_of_long(text: np.ndarray, model: Model, emits: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> float:
    """``expected_counts`` of one text, in pieces."""
    pieces = [text[k:k + PIECE] for k in range(0, len(text), PIECE)]
    states, a = [], None  # forward state ahead of each piece
    for piece in pieces:
        states.append(a)
        for kind in piece[None].T.tolist():
            a = (model.starts if a is None else a @ model.moves) * model.emits[kind[0]]
            a = a / a.sum()
    likelihood, after = 0.0, None
    for piece, before in zip(pieces[::-1], states[::-1]):
        told, after = expected_counts([piece], model, emits, moves, starts, None if before is None else before[None], after)
        likelihood += told
    return likelihood


def _expect(shared):
    def run(batches):
        classes, model = shared.value
        states = len(model.moves)
        emits, moves, starts = np.zeros((classes, states)), np.zeros((states, states)), np.zeros(states)
        likelihood, held = 0.0, {False: [], True: []}
        tokens = dict.fromkeys(held, 0)
        for batch in batches:
            for data in utf8_rows(batch.column(0)):
                text = np.frombuffer(data, np.uint16)
                if len(text) > PIECE:
                    likelihood += expected_of_long(text, model, emits, moves, starts)
                    continue
                long = len(text) > LONG
                held[long].append(text)
                tokens[long] += len(text)
                if tokens[long] >= HOLD_TOKENS:
                    likelihood += expected_counts(held[long], model, emits, moves, starts)[0]
                    held[long], tokens[long] = [], 0
        for texts in held.values():
            if texts:
                likelihood += expected_counts(texts, model, emits, moves, starts)[0]
        rows = np.concatenate((emits, moves, starts[None], np.full((1, states), likelihood)))
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[used, k]) for k in range(states))],
                                         names=["key", *(f"v{k}" for k in range(states))])
    return run


def train(encoded: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over rows of ``encode``: the model and the log likelihood before each pass."""
    texts = encoded.select("classes")
    model, likelihoods, prior = start_model(lex, states), [], unigram(lex)
    context = texts.sparkSession.sparkContext
    schema = "key bigint, " + ", ".join(f"v{k} double" for k in range(states))
    for _ in range(rounds):
        shared = context.broadcast((lex.classes, model))
        summed = texts.mapInArrow(_expect(shared), schema).groupBy("key").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(states)]).toArrow()
        rows = np.zeros((lex.classes + states + 2, states))
        rows[summed.column("key").to_numpy()] = np.stack([summed.column(f"v{k}").to_numpy() for k in range(states)], axis=1)
        emits, moves, starts = rows[:lex.classes], rows[lex.classes:lex.classes + states], rows[-2]
        likelihoods.append(float(rows[-1, 0]))
        emits = emits + PRIOR * prior[:, None]
        moves, starts = moves + MOVE_PRIOR, starts + MOVE_PRIOR
        model = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return model, likelihoods


def forward(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 likelihood of whole class sequences, many texts a step."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([texts[i] for i in order])
    lengths = lengths[order]
    begin = np.cumsum(lengths) - lengths
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0])))
    total, emits, onward = np.zeros(len(texts)), np.ascontiguousarray(model.emits.T), np.ascontiguousarray(model.moves.T)
    a = np.repeat(model.starts[:, None], len(texts), axis=1)
    for t, m in enumerate(live.tolist()):
        if t:
            a = onward @ a[:, :m]
        a *= np.take(emits, flat[begin[:m] + t], axis=1)
        scale = a.sum(axis=0)
        a /= scale
        total[:m] += np.log10(scale)
    back = np.empty(len(texts))
    back[order] = total
    return back


def _encode(shared):
    def run(batches):
        lex = shared.value
        log_bucket = np.log10(lex.bucket_tokens + lex.bucket_types + 1)
        end = np.array([lex.classes - 1], np.uint16).tobytes()
        for batch in batches:
            n_tokens, n_known, base, inside, texts = [], [], [], [], []
            tail_words, tail_counts, tail_ends = [], [], [0]
            for data in utf8_rows(batch.column("text")):
                tail: Counter = Counter()
                parts, tokens, known, own, shared_head, within = [], 0, 0, 0.0, 0.0, 0.0
                for words in word_runs((data or b"").lower()):
                    at, kind = _classes(words, lex)
                    parts.append(kind.astype(np.uint16).tobytes())
                    head = at[at >= 0]
                    tokens += len(words)
                    known += len(head)
                    own += float(lex.log_place[head[head < lex.own]].sum())
                    shared_head += float(lex.log_place[head[head >= lex.own]].sum())
                    within += float(log_bucket[kind[kind >= lex.own] - lex.own].sum())
                    tail.update([words[i] for i in np.flatnonzero(at < 0).tolist()])
                texts.append(b"".join([*parts, end]))
                n_tokens.append(tokens + 1)
                n_known.append(known + (lex.n_docs > 0))
                base.append(own + shared_head + float(np.log10(lex.n_docs + 1)))
                inside.append(shared_head - within)
                tail_words += tail
                tail_counts += tail.values()
                tail_ends.append(len(tail_words))
            if texts:
                words = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()), pa.array(tail_counts, pa.int64())], ["word", "n"])
                tails = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                     pa.array(inside, pa.float64()), tails, pa.array(texts, pa.binary())],
                    names=["row", "n_tokens", "n_known", "base", "inside", "tail", "classes"])
    return run


def encode(docs: DataFrame, lex: Lexicon, text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``, in a scratch table: ``row``, a struct of its columns but the
    text; the text's classes, two bytes each; its counts and sums over the words of the head; and
    ``tail``, its other words."""
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    told = rows.mapInArrow(_encode(shared), f"row {kind}, n_tokens bigint, n_known bigint, base double, inside double, "
                           "tail array<struct<word: binary, n: bigint>>, classes binary")
    return scratch_table(told.withColumn("nth", F.monotonically_increasing_id()), "encoded")


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            if len(batch):
                told = forward([np.frombuffer(x, np.uint16) for x in utf8_rows(batch.column("classes"))], model)
                columns = batch.schema.names
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns if c != "classes"), pa.array(told)],
                                                 names=[*(c for c in columns if c != "classes"), "forward"])
    return run


def score(encoded: DataFrame, lex: Lexicon, tail_counts: DataFrame, model: Model) -> DataFrame:
    """(row, n_tokens, n_known, base_score, score) of every row of ``encode``: base_score is the
    add-one unigram log10 probability, score the model's."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kind = encoded.schema["row"].dataType.simpleString()
    told = encoded.drop("tail").select("row", "n_tokens", "n_known", "base", "inside", "nth", "classes").mapInArrow(
        _score(shared), f"row {kind}, n_tokens bigint, n_known bigint, base double, inside double, nth bigint, forward double")
    rare = encoded.select("nth", F.explode("tail").alias("t")).select("nth", "t.word", F.col("t.n").alias("times")).join(tail_counts, "word").groupBy("nth").agg(
        F.sum("times").alias("seen"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"))
    log_all = float(np.log10(lex.n_tokens + lex.n_types + 1))
    seen, log = F.coalesce("seen", F.lit(0)), F.coalesce("log", F.lit(0.0))
    return told.join(rare, "nth", "left").select(
        "row", "n_tokens", (F.col("n_known") + seen).alias("n_known"), (F.col("base") + log - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("inside") + F.col("forward") + log).alias("score"))
