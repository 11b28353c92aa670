"""SimHash near-duplicates by anchor-point covering.

Fingerprints (64 bits, majority of the XXH64 values of the word shingles) that differ in at most
three bits agree in all but one bit of at least one 32-bit half. The anchors of a half are the
words of a covering code of radius 1: the perfect Hamming code of length 31, times one free bit
(2^27 anchors). A fingerprint's home is the anchor nearest to its half. If two halves differ in
at most one bit, the home of the one lies within radius + 1 = 2 bits of the other; so each
fingerprint is replicated to all anchors within two bits (17 at most per half) and compared there
with the fingerprints whose home the anchor is. No pair within three bits is missed, and only
pairs that share an anchor are ever compared.

Replication runs over distinct fingerprints, so groups of copies cost one row. An anchor with more
than ``TILE`` homes is dealt out over several tiles (its homes are split, its replicas go to each
tile); all of it is still compared. A tile returns links that connect its linked fingerprints,
not all pairs, so dense groups give a number of links in proportion to their rows.

Defined results: null and word-less texts have fingerprint zero and are linked like any other;
fewer words than a shingle form one shingle; a null id has no say in the component id (null if no
id is reachable); repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import NULL_ID, utf8_rows, word_runs
from tidewatch.llm.components import connected_components
from tidewatch.session import ensure_checkpoint_dir

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Homes of one anchor that one task compares; more are split over several tiles.
TILE = 4096
_FLUSH = 1 << 18
#: text_hash equals Spark's xxhash64(text), which has this seed (and gives it for null).
_SPARK_SEED = 42


def _shingle_hashes(data: bytes, k: int, seed: int):
    """Lists of shingle hashes of one text, shingles as bytes of the words joined by a space."""
    hash_of, carry, seen = xxhash.xxh64_intdigest, [], 0
    for words in word_runs(data):
        words = carry + words
        seen += len(words) - len(carry)
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            yield [hash_of(joined[a:b], seed) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]
            carry = words[len(words) - k + 1:]
        else:
            carry = words
    if 0 < seen < k:
        yield [hash_of(b" ".join(carry), seed)]


def _fingerprints(k: int, seed: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
            flat, rows, starts = [], [], []

            def flush():
                if flat:
                    bits = np.unpackbits(np.array(flat, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64)
                    np.add.at(ones, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
                    flat.clear(), rows.clear(), starts.clear()

            text_hash = np.full(n, _SPARK_SEED, np.uint64)
            for i, data in enumerate(utf8_rows(batch.column(1))):
                if data is None:
                    continue
                text_hash[i] = xxhash.xxh64_intdigest(data, _SPARK_SEED)
                for hashes in _shingle_hashes(data.lower(), k, seed):
                    rows.append(i), starts.append(len(flat))
                    flat.extend(hashes)
                    total[i] += len(hashes)
                    if len(flat) >= _FLUSH:
                        flush()
            flush()
            bits = (2 * ones > total[:, None]).astype(np.uint8)
            prints = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text_hash.view(np.int64)), pa.array(prints.view(np.int64))],
                names=["id", "text_hash", "print"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, text_hash, print) of every row; A-Z count as lower case."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprints(shingle, seed), f"id {kind}, text_hash bigint, print bigint")


def _half(print_col: Column, half: int) -> Column:
    return F.shiftrightunsigned(print_col, 32) if half else print_col.bitwiseAND(F.lit(0xFFFFFFFF))


def _anchors(value: Column) -> tuple[Column, Column]:
    """(home, all anchors within two bits) of a 32-bit value. Bits 0-30 stand at positions 1-31 of
    the Hamming code, bit 31 is free; the syndrome names the position that is off the code."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    syndrome = reduce(lambda a, b: a.bitwiseOR(b), [
        F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(m))).cast("bigint").bitwiseAND(F.lit(1)), k) for k, m in enumerate(masks)])
    flip = lambda p: F.expr("0L") if p is None else F.call_function("shiftleft", F.lit(1).cast("bigint"), (p - 1).cast("int"))
    home = F.when(syndrome == 0, value).otherwise(value.bitwiseXOR(flip(syndrome)))
    free = F.lit(1 << 31)
    pairs = F.when(syndrome == 0, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(31).cast("bigint")),
                 lambda i: i.bitwiseXOR(syndrome) > i),
        lambda i: value.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(syndrome)))))
    return home, F.concat(F.array(home, home.bitwiseXOR(free)), pairs)


def _replicas(prints: DataFrame) -> DataFrame:
    """One row for each (half, anchor within two bits, print), ``home`` set on the home anchor."""
    halves = []
    for h in (0, 1):
        home, near = _anchors(F.col("value"))
        halves.append(
            prints.select("print", _half(F.col("print"), h).alias("value"))
            .select("print", home.alias("own"), near.alias("near"))
            .select("print", "own", F.explode("near").alias("anchor"))
            .select(F.lit(h).cast("bigint").alias("half"), "anchor", "print", (F.col("anchor") == F.col("own")).alias("home")))
    return halves[0].unionByName(halves[1])


def _compare(max_bits: int):
    """Over rows sorted by (half, anchor, tile, role, print), homes (role 0) before replicas."""
    def run(batches):
        key, homes, group = None, np.empty(0, np.uint64), None
        for batch in batches:
            half, anchor, tile, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            prints = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.flatnonzero((half[1:] != half[:-1]) | (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])) + 1
            a_out, b_out = [], []
            for s, e in zip(np.concatenate(([0], new)).tolist(), np.concatenate((new, [len(half)])).tolist()):
                if s == e:
                    continue
                here = (half[s], anchor[s], tile[s])
                if here != key:
                    key, homes, group = here, np.empty(0, np.uint64), None
                split = s + int(np.searchsorted(role[s:e], 1))
                if split > s:
                    homes = np.concatenate((homes, prints[s:split]))
                    group = np.arange(len(homes))
                if not len(homes):
                    continue
                step = max(1, (1 << 20) // len(homes))
                for at in range(split, e, step):
                    block = prints[at:min(e, at + step)]
                    apart = np.bitwise_count(block[:, None] ^ homes[None, :])
                    near = (apart <= max_bits) & (apart > 0)
                    for i in np.flatnonzero(near.any(axis=1)).tolist():
                        linked = np.flatnonzero(near[i])
                        groups, first = np.unique(group[linked], return_index=True)
                        for j in linked[first].tolist():  # one link into each part of the tile
                            a_out.append(block[i]), b_out.append(homes[j])
                        if len(groups) > 1:
                            group[np.isin(group, groups)] = groups[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a_out, b_out)], names=["a", "b"])
    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct prints at 1..max_bits (3 at most) differing bits that connect
    all prints connected by such links; ``prints`` has distinct values in column print."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves cover up to three differing bits")
    replicas = _replicas(prints)
    homes = replicas.where("home").groupBy("half", "anchor").agg(F.count(F.lit(1)).alias("n_home"))
    met = replicas.join(homes, ["half", "anchor"]).withColumn(
        "tiles", F.ceil(F.col("n_home") / F.lit(tile)).cast("bigint"))
    roles = met.select("half", "anchor", "print", F.explode(F.expr(
        "concat(transform(sequence(0L, tiles - 1), t -> struct(t AS tile, 1 AS role)),"
        " CASE WHEN home THEN array(struct(pmod(xxhash64(print), tiles) AS tile, 0 AS role))"
        " ELSE array() END)")).alias("r"))
    rows = roles.select("half", "anchor", "r.tile", "r.role", "print")
    dealt = rows.repartition("half", "anchor", "tile").sortWithinPartitions("half", "anchor", "tile", "role", "print")
    return dealt.mapInArrow(_compare(max_bits), "a bigint, b bigint").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, text_hash, print, component_id, keep_id, keep_hash) of every row. component_id is the
    smallest id reachable over links; (keep_id, keep_hash) names the one text a group keeps."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col, shingle, seed).checkpoint()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("hash")))
    classes = rows.groupBy("print").agg(first.alias("first")).checkpoint()
    labels = connected_components(links(classes.select("print"), max_bits), "a", "b")
    of_class = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", F.coalesce("comp", "print").alias("component"))
    best = of_class.groupBy("component").agg(F.min("first").alias("best"))
    named = of_class.join(best, "component").select("print", "best")
    return rows.join(named, "print").select(
        "id", "text_hash", "print", F.col("best.id").alias("component_id"),
        F.col("best.id").alias("keep_id"), F.col("best.hash").alias("keep_hash"))


def fingerprint_hex(col: str = "print") -> Column:
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id's (of rows that repeat
    an id, one). Columns are those of ``docs``."""
    kept = components(docs, id_col, text_col, **kw).where(
        F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))).select(
        F.coalesce("id", F.lit(NULL_ID)).alias("__key"), F.col("text_hash").alias("__hash")).distinct()
    keyed = docs.withColumns({"__key": F.coalesce(F.col(id_col), F.lit(NULL_ID)), "__hash": F.xxhash64(F.col(text_col).cast("string"))})
    order = Window.partitionBy("__key", "__hash").orderBy(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if c != text_col]))
    return keyed.join(kept, ["__key", "__hash"]).withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(docs.columns)
