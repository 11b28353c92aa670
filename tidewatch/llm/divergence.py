"""Source divergence audit: how far each source's terms of a language lie from every other source's.

1. Each task folds whole documents into stripes, one for each language and term: the number of
   documents that hold the term, and its count in each source. When they grow past ``HOLD`` entries
   they are spilled as rows, so memory is bounded and a frequent term is one row a spill, not one an
   occurrence.
2. Stripes meet by language and term and are merged; terms in at least ``MIN_DOCS`` documents of
   their language are kept.
3. Totals follow from the kept stripes. Each merged stripe then emits its divergences directly: its
   share of every pair of sources of the language, added up in the task over tiles of ``TILE``
   x ``TILE`` sources, and the terms that a source uses more than its language does.

Probabilities are add-one in integers: p = 1 + floor(10^9 (count + 1) / (N + V)), with N the count
over the V kept terms; a divergence is floor((p - q)^2 / q). Everything is exact in 64 bits as long
as N + V < 9 * 10^15.

The work on a term grows with the square of the sources of its language, as the report does, which
holds a row for every pair of them.

Defined results: null text, language or source is empty; each row is a document, repeated ones too;
a group without kept terms is reported with divergence 0 from the others if its language has no kept
term. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import scratch_table, utf8_rows, word_runs

MIN_DOCS, TOP = 3, 200
#: Stripe entries that a task holds before it spills them; terms of one step; sources a side of a
#: tile, and tiles that a task holds; groups whose totals may be broadcast (beyond: a join).
HOLD, STEP, TILE, HOLD_TILES, BROADCAST = 600_000, 2048, 64, 256, 100_000
SCALE = 10 ** 9

#: Terms are runs of ASCII letters, lower-cased, and of bytes beyond ASCII; all else separates.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_STRIPE = ["lang", "term", "docs", "sources"]


def _fold(batches):
    docs: dict[str, Counter] = {}                # language -> term -> documents
    counts: dict[str, dict[str, Counter]] = {}   # language -> source -> term -> occurrences
    held = 0

    def out():
        for lang, of in docs.items():
            terms, place = list(of), {term: i for i, term in enumerate(of)}
            names, found = list(counts[lang]), list(counts[lang].values())
            row = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64)
            n = np.fromiter(chain.from_iterable(c.values() for c in found), np.int64)
            source = np.repeat(np.arange(len(names)), [len(c) for c in found])
            order = np.argsort(row, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(terms)))))
            cells = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(source[order])), pa.array(n[order])], ["source", "n"])
            stripes = pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(of.values(), pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), cells)], names=_STRIPE)
            for at in range(0, len(terms), 20_000):
                yield stripes.slice(at, 20_000)
        docs.clear()
        counts.clear()

    for batch in batches:
        for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8_rows(batch.column("text"))):
            counter, seen = counts.setdefault(lang, {}).setdefault(source, Counter()), set()
            before = len(counter)
            for terms in word_runs((data or b"").translate(_LETTERS)):
                counter.update(terms)
                seen.update(terms)
            docs.setdefault(lang, Counter()).update(seen)
            held += len(counter) - before
            if held > HOLD:
                yield from out()
                held = 0
    yield from out()


def stripes(docs: DataFrame) -> DataFrame:
    """(lang, term, sources): the merged stripes of the terms to keep, in a scratch table. Stripes
    meet by language and term once; there those of rare terms go before the others' sources are
    added up, so a merged stripe holds each source of its language once at most."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    folded = texts.mapInArrow(_fold, "lang string, term string, docs bigint, sources array<struct<source: string, n: bigint>>")
    frequent = folded.withColumn("all_docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(f"all_docs >= {MIN_DOCS}")
    cells = frequent.select("lang", "term", F.inline("sources")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return scratch_table(cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("sources")), "stripes")


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exactly: three digits a step."""
    whole, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_EMITTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _rows(lang, source, part, item, value) -> pa.RecordBatch:
    n = len(item)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()),
         pa.array(value, pa.int64())], schema=_EMITTED)


@dataclass
class Totals:
    """A language's sources in order, N + V of each, and of the language."""

    names: list[str]
    of: np.ndarray
    whole: int

    @classmethod
    def from_rows(cls, rows: list) -> Totals:
        rows = sorted(rows, key=lambda r: r["source"].encode())
        v = rows[0]["v"]
        return cls([r["source"] for r in rows], np.array([r["n"] + v for r in rows], np.int64), sum(r["n"] for r in rows) + v)


def _emit(shared):
    def run(batches):
        totals: dict[str, Totals] = shared.value
        tiles: dict[tuple[str, int, int], np.ndarray] = {}
        best: dict[tuple[str, int], np.ndarray] = {}  # the TOP largest values of a group so far, ascending

        def sums():
            for (lang, i, j), found in tiles.items():
                left, right = (totals[lang].names[k * TILE:(k + 1) * TILE] for k in (i, j))
                pairs = [(a, b) for a in range(len(left)) for b in range(len(right)) if i != j or a != b]
                yield _rows(lang, [left[a] for a, _ in pairs], "pair", [right[b] for _, b in pairs], [int(found[a, b]) for a, b in pairs])
            tiles.clear()

        def step(lang, terms, cells):
            known = totals[lang]
            row = np.repeat(np.arange(len(terms)), pc.list_value_length(cells).to_numpy())
            flat = cells.flatten()
            at = pc.index_in(flat.field("source"), pa.array(known.names, pa.string())).to_numpy().astype(np.int64)
            n = flat.field("n").to_numpy()
            for i in range(0, len(known.names), TILE):
                p = _dense(row, at, n, i, len(terms), known.of)
                for j in range(0, len(known.names), TILE):
                    q = p if i == j else _dense(row, at, n, j, len(terms), known.of)
                    found = tiles.setdefault((lang, i // TILE, j // TILE), np.zeros((p.shape[1], q.shape[1]), np.int64))
                    for k in range(p.shape[1]):
                        found[k] += divergence(p[:, k, None], q).sum(axis=0)
                    if len(tiles) >= HOLD_TILES:
                        yield from sums()
            all_n = np.zeros(len(terms), np.int64)
            np.add.at(all_n, row, n)
            p, q = scaled(n, known.of[at]), scaled(all_n, np.int64(known.whole))[row]
            value = divergence(p, q)
            order = np.flatnonzero(p > q)
            order = order[np.lexsort((-value[order], at[order]))]
            for mine in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                group = (lang, int(at[mine[0]]))
                best[group] = top = np.sort(np.concatenate((best.get(group, value[:0]), value[mine[:TOP]])))[-TOP:]
                if len(top) == TOP:
                    mine = mine[value[mine] >= top[0]]
                yield _rows(lang, [known.names[group[1]]] * len(mine), "term", terms.take(pa.array(row[mine])), value[mine])

        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                mine = batch.filter(pc.equal(batch.column("lang"), lang))
                for k in range(0, len(mine), STEP):
                    some = mine.slice(k, STEP)
                    yield from step(lang, some.column("term"), some.column("sources"))
        yield from sums()
    return run


def _dense(row, at, n, begin, terms, of) -> np.ndarray:
    """p of every term in each of the sources of a tile, those without the term included."""
    of = of[begin:begin + TILE]
    counts = np.zeros((terms, len(of)), np.int64)
    mine = (at >= begin) & (at < begin + TILE)
    counts[row[mine], at[mine] - begin] = n[mine]
    return scaled(counts, of[None, :])


def _emitted(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of all stripes. The totals go to the tasks a range of
    languages at a time, of BROADCAST groups at most or one language, whose report has the square
    of its groups in rows."""
    context, ranges, held = sizes.sparkSession.sparkContext, [], 0
    for r in sorted(sizes.groupBy("lang").count().collect(), key=lambda r: r["lang"].encode()):
        if not ranges or held + r["count"] > BROADCAST:
            ranges, held = [*ranges, [r["lang"], r["lang"]]], 0
        ranges[-1][1], held = r["lang"], held + r["count"]
    told = []
    for first, last in ranges or [["", ""]]:
        of: dict[str, list] = {}
        for r in sizes.where(F.col("lang").between(first, last)).collect():
            of.setdefault(r["lang"], []).append(r)
        shared = context.broadcast({lang: Totals.from_rows(rows) for lang, rows in of.items()})
        told.append(kept.where(F.col("lang").between(first, last)).mapInArrow(_emit(shared), "lang string, source string, part string, item string, value bigint"))
    return reduce(DataFrame.unionByName, told)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of (lang, source, text): part ``pair`` has every
    other source of the language, by divergence; part ``term`` the TOP terms that the group uses
    more than its language."""
    kept = stripes(docs)
    groups = scratch_table(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct(), "groups")
    counts = kept.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sizes = groups.join(counts, ["lang", "source"], "left").join(F.broadcast(terms), "lang", "left").selectExpr(
        "lang", "source", "coalesce(n, 0L) AS n", "coalesce(v, 0L) AS v")
    emitted = scratch_table(_emitted(kept, scratch_table(sizes, "sizes")), "emitted")
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").join(
        emitted.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value")).withColumn("rank", rank)
    return pairs.unionByName(emitted.where("part = 'term'").withColumn("rank", rank).where(f"rank <= {TOP}"))
