"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. The
automaton is built over the words of all items; reading a document word by word it keeps the
length of the longest stretch of item text that ends there. Where that length reaches ``window``
words (or a whole item that is shorter), the words of the window are hit, and the state names the
items that hold the window.

The items are the bounded side: they are dealt into shards of at most ``SHARD_WORDS`` words, each
shard's automaton is built once per Python worker from broadcast words, and documents stream
through it row by row, with no shuffle. With several shards the documents pass them one after
another, over a scratch table that replaces the one before, and a shard's broadcast goes before the
next is made: however many words the items have, the driver and each worker hold one shard at a
time. Stretches of a document in
which some adjacent pair of words occurs in no item cannot hold a window across that pair; they
are skipped with a vectorised look-up, and only the rest is read by the automaton.

Defined results: null and word-less texts have 0 words, 0 hits and are not contaminated; an item
without words holds no window; an item without id hits words but is not among a text's items;
repeated item rows count once; rows stay as they are,
repeated or not.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import scratch_table, utf8_rows, word_runs

WINDOW = 13
#: A document is contaminated if hit words make up at least one part in so many.
COVERAGE = 20
#: Words of items in one automaton: bounds what is broadcast and what a worker holds.
SHARD_WORDS = 1_000_000

#: Bytes that are no part of a word become spaces, A-Z become a-z; bytes of characters beyond
#: ASCII stay.
_TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _item_words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_TO_WORDS).split()


class Automaton:
    """Suffix automaton over the word numbers of several items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(item, [self.number.setdefault(w, len(self.number)) for w in words]) for item, words in items if words]
        pairs = set()
        for _, text in texts:
            state = 0
            for w in text:
                state = self._extend(state, w)
            pairs.update(zip(text, text[1:]))
        size = len(self.number) + 1
        self.size = size
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), np.int64)
        self.shortest = min([window, *(len(t) for _, t in texts)])
        # the state that stands for the last `window` words of a match in a state
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.window_state = [-1] * len(self.next)
        for v in order[1:]:
            if self.length[v] >= window:
                self.window_state[v] = v if self.length[self.link[v]] < window else self.window_state[self.link[v]]
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for item, text in texts:
            state = 0
            for i, w in enumerate(text):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items.setdefault(self.window_state[state], set()).add(item)
            if len(text) < window:
                self.whole.setdefault(state, []).append((len(text), item))
        # the nearest state on the way to the root, itself included, where a short item ends
        self.short_state = [-1] * len(self.next)
        for v in order[1:]:
            self.short_state[v] = v if v in self.whole else self.short_state[self.link[v]]

    def _extend(self, last: int, w: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if w in nexts[last]:
            q = nexts[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nexts)
        nexts.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def read(self, numbers: list[int], at: int, ends: list[tuple[int, int]], found: set[str]) -> None:
        """Stream words (all known); ``ends`` gets (start, end) of hit windows, ``at`` is the
        position of the first word."""
        nexts, link, length = self.next, self.link, self.length
        state = match = 0
        for i, w in enumerate(numbers, at):
            while state and w not in nexts[state]:
                state = link[state]
                match = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                match += 1
            if match >= self.window:
                ends.append((i - self.window + 1, i + 1))
                found.update(self.items[self.window_state[state]])
            short = self.short_state[state]
            while short > 0:
                for size, item in self.whole[short]:
                    if size <= match:
                        ends.append((i - size + 1, i + 1))
                        found.add(item)
                short = self.short_state[link[short]]

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, merged hit spans, items) of one text."""
        ends: list[tuple[int, int]] = []
        found: set[str] = set()
        get, count, tail = self.number.get, 0, np.empty(0, np.int64)
        for words in word_runs(data):
            numbers = np.concatenate((tail, np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))))
            base = count - len(tail)
            count += len(words)
            # stretches of known words whose adjacent pairs all occur in items
            known = numbers >= 0
            codes = numbers[:-1] * self.size + numbers[1:]
            at = np.minimum(np.searchsorted(self.pairs, codes), max(len(self.pairs) - 1, 0))
            joined = known[:-1] & known[1:] & (self.pairs[at] == codes if len(self.pairs) else False)
            cut = np.flatnonzero(~joined) + 1
            begin = np.concatenate(([0], cut)) if len(numbers) else cut
            stop = np.concatenate((cut, [len(numbers)])) if len(numbers) else cut
            use = (stop - begin >= self.shortest) & known[np.minimum(begin, max(len(numbers) - 1, 0))] if len(numbers) else []
            for s, e in zip(begin[use].tolist(), stop[use].tolist()):
                self.read(numbers[s:e].tolist(), base + s, ends, found)
            # words that a window over the next run may still need
            tail = numbers[max(0, len(numbers) - self.window + 1):]
        return count, merge(ends), found


def merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_BUILT: dict = {}


def _automaton(shared, window: int) -> Automaton:
    """The automaton of one broadcast shard, one at a time in each worker."""
    if _BUILT.get("of") != (shared.value[0], window):
        _BUILT.clear()
        _BUILT.update(of=(shared.value[0], window), automaton=Automaton(shared.value[1], window))
    return _BUILT["automaton"]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(shared, window: int):
    def run(batches):
        automaton = _automaton(shared, window)
        for batch in batches:
            n_words, spans, items = [], [], []
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for i, data in enumerate(utf8_rows(batch.column("text"))):
                count, hit, found = automaton.scan(data.translate(_TO_WORDS)) if data else (0, [], set())
                n_words.append(count)
                spans.append([{"start": s, "end": e} for s, e in merge(hit + [(x["start"], x["end"]) for x in old_spans[i]])])
                items.append(sorted(found.union(old_items[i]) - {None}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text"), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), batch.column("row")],
                names=["text", "n_words", "spans", "items", "row"])
    return run


def _shards(items: DataFrame, id_col: str, text_col: str, shard_words: int):
    """Items in lists of at most ``shard_words`` words (or one item), as they stream to the
    driver."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where(
        "text IS NOT NULL").distinct().orderBy("item", "text")
    shard, held = [], 0
    for row in rows.toLocalIterator():
        words = _item_words(row["text"].encode())
        if words and shard and held + len(words) > shard_words:
            yield shard
            shard, held = [], 0
        if words:
            shard.append((row["item"], words))
            held += len(words)
    yield shard


def match_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(text, n_words, spans, items, row) of every row: ``spans`` are the hit word ranges [start,
    end), merged; ``items`` the ids (as text, sorted) of items with a window in the text; ``row`` a
    struct of the columns of ``docs`` but the text."""
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    out = docs.select(F.col(text_col).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                      F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)").alias("spans"),
                      F.expr("CAST(array() AS array<string>)").alias("items"), F.struct(*rest).alias("row"))
    kind = out.schema["row"].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    shared, replaces = None, []
    for shard in _shards(items, item_col, item_text_col, shard_words):
        if shared is not None:
            out = scratch_table(out, "spans", replaces)
            shared.destroy()
        key = hashlib.sha256(repr(shard).encode()).hexdigest()
        shared = context.broadcast((key, shard))
        out = out.mapInArrow(
            _scan(shared, window),
            f"text string, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>, row {kind}")
    return out


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(coverage: int = COVERAGE) -> Column:
    return (n_hit() > 0) & (n_hit() * coverage >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", coverage: int = COVERAGE, **kw) -> DataFrame:
    """``docs`` without contaminated documents; the others stay as they are."""
    return match_items(docs, items, text_col, **kw).where(~contaminated(coverage)).select(
        *[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def _cut(min_words: int):
    def run(batches):
        for batch in batches:
            spans, out = batch.column("spans").to_pylist(), []
            for i, data in enumerate(utf8_rows(batch.column("text"))):
                cut = [(x["start"], x["end"]) for x in spans[i] if x["end"] - x["start"] >= min_words]
                if not cut:
                    out.append(data)
                    continue
                drop = {k for s, e in cut for k in range(s, e)}
                flat, at, words, parts, upto = data.translate(_TO_WORDS), 0, 0, [], 0
                for run_ in word_runs(flat):
                    for w in run_:
                        at = flat.index(w, at)
                        if words in drop:
                            parts.append(data[upto:at])
                            upto = at + len(w)
                        at += len(w)
                        words += 1
                out.append(b"".join([*parts, data[upto:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), batch.column("row")], names=["cut", "row"])
    return run


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", min_words: int = WINDOW,
                 coverage: int = COVERAGE, **kw) -> DataFrame:
    """``docs`` with the words of hit spans of at least ``min_words`` words cut from texts below
    the coverage limit; texts that reach the limit go whole."""
    hit = match_items(docs, items, text_col, **kw).where(~contaminated(coverage))
    kind = hit.schema["row"].dataType.simpleString()
    return hit.select("text", "spans", "row").mapInArrow(_cut(min_words), f"cut string, row {kind}").select(
        *[F.col("cut").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
