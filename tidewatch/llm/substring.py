"""Removal of repeated passages by recompression.

A word's name is a 64-bit hash. In each round, pairs of adjacent names and runs of one name get a
new name made from what they hold, so equal stretches of text get equal symbols away from their
borders: a run of one name is named by that name and its length, then each adjacent pair whose
left name falls into the left half of the alphabet and right name into the right half is named by
both. As a name is a function of its content alone, it is the same in every partition without an
exchange; Spark's rounds then bring equal high-level symbols together and verify what they reveal.

Each symbol carries its context: the words that alone decide that it is formed. A window of
``window`` words owns the symbols whose context it holds, which are the same wherever that window
stands. After two rounds it picks the one whose context has the smallest hash as its anchor
(windows that own none stand for themselves). Neighbouring windows share anchors, so a text gives
about one record for five words: (hash of the anchor's context, hash of all words of the windows
that picked it, place, hash of the text, which tells apart rows that share an id).

Rounds:
1. Records meet by anchor. Equal records are equal stretches: all but the earliest are repeats.
   Each task first merges the equal records of its Arrow batch, so a group of copies sends one
   record for each batch, and no key holds more than that.
2. Anchors with several different stretches (the borders of repeats) send the windows of the
   earliest record of each stretch, which are compared as wholes.
3. All ranges of a text meet the text, and the words they cover go.

Defined results: a null text has no words; a null id sorts after all others; rows that share id
and text get the same result, and windows at the same start of rows that share an id are both
"earliest". Texts shorter than the window lose nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import NULL_ID, scratch_table, utf8_rows, word_runs

WINDOW, ROUNDS = 20, 2
#: Words that are parsed at a time; longer texts are cut into overlapping pieces.
_BLOCK = 1 << 17
_U = np.uint64
#: Odd multipliers of the rolling hashes and the finishing mix (public 64-bit mixing constants).
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_MIX1, _MIX2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _MIX1
    x = (x ^ (x >> _U(33))) * _MIX2
    return x ^ (x >> _U(33))


class _Names(dict):
    """Word -> 64-bit name, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        name = self[word] = xxhash.xxh64_intdigest(word)
        return name


def _word_names(data: bytes | None, names: _Names) -> np.ndarray:
    if not data:
        return np.empty(0, _U)
    runs = [np.fromiter(map(names.__getitem__, words), _U, len(words)) for words in word_runs(data)]
    return runs[0] if len(runs) == 1 else np.concatenate(runs)


class _Rolling:
    """Hashes of stretches of a block of names, from prefix sums modulo 2^64."""

    _up: dict = {}

    @classmethod
    def powers(cls, family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        up = cls._up.get(family)
        if up is None or len(up[0]) < n:
            base = int(_BASES[family])
            size = max(n, _BLOCK * 2)
            up = cls._up[family] = tuple(
                np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, _U(b), _U))), dtype=_U)
                for b in (base, pow(base, -1, 1 << 64)))
        return up

    def __init__(self, names: np.ndarray, family: int):
        up, self.down = self.powers(family, len(names) + 1)
        self.sums = np.concatenate(([_U(0)], np.cumsum(_mix(names + _BASES[1 - family]) * up[:len(names)], dtype=_U)))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start] + _mix(np.asarray(length).astype(_U)))


def _symbols(names: np.ndarray, stop: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts [lo, hi] of the symbols after ``rounds`` rounds. ``stop`` marks separators,
    which are never merged."""
    lo = hi = np.arange(len(names))
    for r in range(rounds):
        salt, half = (_U((2 * r + 1) * int(m) & 0xFFFFFFFFFFFFFFFF) for m in (_MIX1, _MIX2))
        # runs: a symbol is a whole run only if both neighbours differ, so it depends on both
        first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | stop[1:] | stop[:-1])))
        last = np.concatenate((first[1:], [len(names)])) - 1
        count = last - first + 1
        name = np.where(count > 1, _mix(names[first] + _mix(count.astype(_U) + salt)), names[first])
        stop = stop[first]
        lo, hi = lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(names) - 1)]
        # pairs: left names take right names that follow
        left = (_mix(name ^ half) & _U(1)).astype(bool)
        right = ~left & ~stop
        left &= ~stop
        joins = np.concatenate((left[:-1] & right[1:], [False]))
        second = np.concatenate(([False], joins[:-1]))
        at = np.flatnonzero(~second)
        after = np.minimum(at + 1, len(name) - 1)
        before = np.maximum(at - 1, 0)
        names = np.where(joins[at], _mix(name[at] * _MIX1 + _mix(name[after] + salt)), name[at])
        # a left name alone depends on what follows, a right name alone on what precedes
        lo = np.where(right[at], lo[before], lo[at])
        hi = np.where(left[at], hi[after], hi[at])
        stop = stop[at]
    keep = ~stop
    return lo[keep], hi[keep]


def _records(pieces: list[tuple[int, int, np.ndarray]], window: int, rounds: int):
    """Records of pieces (row, start of the piece in its text, names): arrays anchor, stretch, row,
    start, number of windows."""
    names, stop, offset, row_of, shift = [np.zeros(1, _U)], [np.ones(1, bool)], 1, [], []
    begins, counts = [], []
    for row, start, part in pieces:
        names += [part, np.zeros(1, _U)]
        stop += [np.zeros(len(part), bool), np.ones(1, bool)]
        begins.append(offset), counts.append(len(part) - window + 1)
        row_of.append(row), shift.append(start - offset)
        offset += len(part) + 1
    names, stop = np.concatenate(names), np.concatenate(stop)
    counts = np.array(counts)
    piece = np.repeat(np.arange(len(pieces)), counts)
    starts = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.array(begins), counts)
    one, two = _Rolling(names, 0), _Rolling(names, 1)
    lo, hi = _symbols(names, stop, rounds)
    fits = hi - lo < window
    lo, hi = lo[fits], hi[fits]
    rank = one.of(lo, hi - lo + 1)
    # paint windows in falling order of rank, so that the smallest (then leftmost) is on top
    order = (len(rank) - 1 - np.argsort(~rank[::-1], kind="stable"))
    low = np.maximum(hi[order] - window + 1, 0)
    width = lo[order] - low + 1
    cells = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    best = np.full(len(names), -1, np.int64)
    best[cells] = np.repeat(order, width)
    best = best[starts]
    new = np.concatenate(([True], (best[1:] != best[:-1]) | (best[1:] < 0) | (piece[1:] != piece[:-1]) | (starts[1:] != starts[:-1] + 1)))
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate((at, [len(starts)])))
    s, b = starts[at], best[at]
    alone = b < 0
    stretch = two.of(s, n + window - 1)
    anchor = np.where(alone, one.of(s, np.full(len(s), window)), rank[b] if len(rank) else _U(0))
    if len(lo):  # equal stretches also have their anchor at the same place
        stretch = np.where(alone, stretch, _mix(stretch + _mix((lo[b] - s + (n << 8)).astype(_U))))
    who = piece[at]
    return anchor, stretch, np.array(row_of)[who], s + np.array(shift)[who], n


#: A place in one number: start << 6 | windows << 1 | repeat known.
def _place(start, n, known):
    return start << 6 | n << 1 | known


def _pieces(row: int, names: np.ndarray, window: int):
    for start in range(0, len(names) - window + 1, _BLOCK):
        yield row, start, names[start:start + _BLOCK + window - 1]


_ROW = ["anchor", "stretch", "id", "place", "hash"]


def _batch(anchor, stretch, ids, place, hashes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x).astype(_U).view(np.int64)) for x in (anchor, stretch)] + [pa.array(np.asarray(x, np.int64)) for x in (ids, place, hashes)], names=_ROW)


def _text_hash(data: bytes) -> int:
    """64 bits as a signed number."""
    x = xxhash.xxh64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def _sort_known(anchor, stretch, ids, place, hashes) -> pa.RecordBatch:
    """Merge equal records of a batch: the earliest goes on, the others are known repeats (their
    anchor is set to scattered values, as they need no meeting). Rows that repeat a row go."""
    order = np.lexsort((hashes, place, ids, stretch, anchor))
    anchor, stretch, ids, place, hashes = (x[order] for x in (anchor, stretch, ids, place, hashes))
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = ~new & np.concatenate(([False], (ids[1:] == ids[:-1]) & (place[1:] == place[:-1]) & (hashes[1:] == hashes[:-1])))
    known = (ids != ids[first]) | (place >> 6 != place[first] >> 6)
    keep = ~again
    spread = np.where(known, _mix((ids.astype(_U) + (place.astype(_U) << _U(7))) ^ hashes.astype(_U)), anchor)
    return _batch(spread[keep], stretch[keep], ids[keep], (place | known)[keep], hashes[keep])


def _parse(window: int, rounds: int):
    def run(batches):
        names = _Names()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes = np.zeros(batch.num_rows, np.int64)
            out, pieces, held = [], [], 0
            for i, data in enumerate(utf8_rows(batch.column(1))):
                part = _word_names(data, names)
                if len(part) < window:
                    continue
                hashes[i] = _text_hash(data)
                for piece in _pieces(i, part, window):
                    pieces.append(piece)
                    held += len(piece[2])
                    if held >= _BLOCK:
                        out.append(_records(pieces, window, rounds))
                        pieces, held = [], 0
            if pieces:
                out.append(_records(pieces, window, rounds))
            if out:
                anchor, stretch, row, start, n = (np.concatenate(x) for x in zip(*out))
                yield _sort_known(anchor, stretch, ids[row], _place(start, n, 0), hashes[row])
    return run


def _resolve(batches):
    """Over rows sorted by _ROW: (id, place, hash, open) of repeats (open false) and of the earliest records of stretches whose anchor has others 
    (open true)."""
    last = None  # (anchor, stretch, first id, first start)
    held = [np.empty(0, t) for t in (_U, _U, np.int64, np.int64, np.int64)]  # earliest records of the last anchor
    several = None  # anchor that has several stretches
    for batch in batches:
        anchor, stretch = (batch.column(i).to_numpy(zero_copy_only=False).view(_U) for i in (0, 1))
        ids, place, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        known = (place & 1).astype(bool)
        out = [(ids[known], place[known], hashes[known])]
        anchor, stretch, ids, place, hashes = (x[~known] for x in (anchor, stretch, ids, place, hashes))
        opened = (np.empty(0, np.int64),) * 3
        if len(anchor):
            new = np.concatenate(([last is None or (anchor[0], stretch[0]) != last[:2]],
                                  (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            start = place >> 6
            carried = last[2:] if last else (0, 0)
            first_id = np.where(first < 0, carried[0], ids[first])
            first_start = np.where(first < 0, carried[1], start[first])
            repeat = (ids != first_id) | (start != first_start)
            out.append((ids[repeat], place[repeat], hashes[repeat]))
            last = (anchor[-1], stretch[-1], int(first_id[-1]), int(first_start[-1]))
            a, b, c, d, e = (np.concatenate((h, x[~repeat])) for h, x in zip(held, (anchor, stretch, ids, place, hashes)))
            if len(a):
                edge = np.concatenate(([True], a[1:] != a[:-1]))
                group = np.cumsum(edge) - 1
                kinds = np.bincount(group, weights=np.concatenate(([True], (b[1:] != b[:-1]) | (a[1:] != a[:-1]))))
                many = kinds > 1
                if several is not None:
                    many |= a[edge] == several
                tail = group == group[-1]
                show = many[group]
                opened = (c[show], d[show], e[show])
                several = a[-1] if many[-1] else None
                held = [x[tail & ~show] for x in (a, b, c, d, e)]
        ids, place, hashes = (np.concatenate([o[k] for o in out] + [opened[k]]) for k in (0, 1, 2))
        flag = np.zeros(len(ids), bool)
        flag[len(ids) - len(opened[0]):] = True
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place), pa.array(hashes), pa.array(flag)], names=["id", "place", "hash", "open"])


def _meet(records: DataFrame) -> DataFrame:
    return records.repartition("anchor").sortWithinPartitions(*_ROW).mapInArrow(_resolve, "id bigint, place bigint, hash bigint, open boolean")


def _windows(window: int):
    """The windows of given ranges of a text, each as a record of its own."""
    def run(batches):
        names = _Names()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = batch.column("id").to_pylist()
            hashes, places = batch.column("hash").to_pylist(), batch.column("places").to_pylist()
            out = []
            for i, data in enumerate(batch.column("packed").to_pylist()):
                part = _word_names(unpack(data), names)
                ranges = np.unique(np.array(places[i], np.int64))
                n = ranges >> 1 & 31
                s = np.repeat(ranges >> 6, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                for at in range(0, len(part) - window + 1, _BLOCK):  # sums over pieces, as in parsing
                    here = s[(s >= at) & (s < at + _BLOCK)] - at
                    if len(here):
                        piece = part[at:at + _BLOCK + window - 1]
                        length = np.full(len(here), window)
                        out.append((_Rolling(piece, 0).of(here, length), _Rolling(piece, 1).of(here, length),
                                    np.full(len(here), ids[i], np.int64), _place(here + at, 1, 0), np.full(len(here), hashes[i], np.int64)))
            if out:
                yield _sort_known(*(np.concatenate(x) for x in zip(*out)))
    return run


def _pack(batches):
    """(id, hash, packed text, other columns): texts cross the network compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        hashes, packed = [], []
        for data in utf8_rows(batch.column(1)):
            hashes.append(_text_hash(data or b""))
            packed.append(None if data is None else pack(data))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hashes, pa.int64()), pa.array(packed, pa.binary()), *batch.columns[2:]],
            names=["id", "hash", "packed", *batch.schema.names[2:]])


def _strip(window: int, verbatim: bool):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            places = batch.column("places").to_pylist()
            n_words, n_removed, kept = [], [], []
            for i, data in enumerate(batch.column("packed")):
                data = data.as_py()
                text = b"" if data is None else unpack(data)
                marks = None
                if places[i]:
                    ranges = np.array(places[i], np.int64)
                    size = sum(map(len, word_runs(text)))
                    edges = np.zeros(size + 1, np.int64)
                    np.add.at(edges, ranges >> 6, 1)
                    np.add.at(edges, (ranges >> 6) + (ranges >> 1 & 31) + window - 1, -1)
                    marks = np.cumsum(edges)[:-1] > 0
                count, parts = 0, []
                for words in word_runs(text):
                    if words:
                        if marks is not None:
                            stay = np.flatnonzero(~marks[count:count + len(words)]).tolist()
                            count += len(words)
                            words = [words[k] for k in stay]
                        else:
                            count += len(words)
                        if words:
                            parts.append(b" ".join(words))
                n_words.append(count)
                n_removed.append(0 if marks is None else int(marks.sum()))
                kept.append((None if data is None else text) if verbatim and not n_removed[-1] else b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("row")],
                names=["n_words", "n_removed", "kept", "row"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, rounds: int = ROUNDS, verbatim: bool = False) -> DataFrame:
    """(n_words, n_removed, kept, row) of every row: words in it, words removed since a window
    that covers them also starts earlier, the words left joined by one space (``verbatim``: texts
    that lose none stay as they are), and ``row``, a struct of the columns of ``docs`` but the
    text. Ids are bigint."""
    if not 2 <= window <= 31:
        raise ValueError("a window has 2 to 31 words")
    key = F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("id")
    text = F.col(text_col).cast("string").alias("text")
    row = F.struct(F.col(id_col), *[F.col(c) for c in docs.columns if c not in (id_col, text_col)]).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    schema = ", ".join(f"{c} bigint" for c in _ROW)
    found = scratch_table(_meet(docs.select(key, text).mapInArrow(_parse(window, rounds), schema)), "repeats")

    def of_text(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id", "hash").agg(F.collect_set("place").alias("places"))

    packed = docs.select(key, text).mapInArrow(_pack, "id bigint, hash bigint, packed binary")
    opened = packed.join(of_text(found.where("open")), ["id", "hash"])
    windows = _meet(opened.mapInArrow(_windows(window), schema))
    repeats = of_text(found.where("NOT open").unionByName(windows.where("NOT open")))
    whole = docs.select(key, text, row).mapInArrow(_pack, f"id bigint, hash bigint, packed binary, row {kind}")
    return whole.join(repeats, ["id", "hash"], "left").select("packed", "row", "places").mapInArrow(
        _strip(window, verbatim), f"n_words bigint, n_removed bigint, kept string, row {kind}")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without repeated passages: texts that lose words become their remaining words
    joined by one space, texts that lose none stay as they are, texts that lose all go."""
    left = remove_repeats(docs, id_col, text_col, verbatim=True, **kw).where("n_removed = 0 OR n_removed < n_words")
    return left.select(*[F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
