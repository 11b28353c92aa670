"""Conversation prefix trie: ROLLUP over positional columns of turn names.

A turn's name is two 64-bit hashes of its role and text. Conversations become rows of ``WIDTH``
positional columns of names, one row for each block of ``WIDTH`` turns, and one ROLLUP over the
columns aggregates all prefixes together; grouping_id tells the length. A long conversation goes on
in further blocks, keyed by the node at which its block before ended: the XOR of position-mixed
names up to there, so all blocks of all conversations are rolled up in one job.

What a subtree sums is spread over conversations first: a node belongs to its smallest member, and
every node below is a prefix of its own smallest member's conversation. So a first ROLLUP finds
smallest members, sizes and ends; running sums from the end of each conversation collect what it
owns from each position on; a second ROLLUP adds these over the members of each node.

Nothing groups a whole conversation or a whole node: turns are numbered by range partitions plus
offsets, running values go over blocks of blocks, nodes are partial aggregates, and the ids that end
in one node are packed in ranges and hashed as a stream.

Defined results: a null role or text is empty; turns are ordered by number (null first), then by
SHA-256 of role, line feed and text; each row is a turn, repeated ones too; rows without conv_id belong to no
conversation; without conversations there is no node, not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import scratch_table

#: Positional columns of a block; blocks that one running value passes at a time; ids in a packed row.
WIDTH, SUPER, PACK = 8, 1024, 4096

_WORD = r"[^\\x20\\x09-\\x0D]+"


def number_turns(conversations: DataFrame, words: bool = True) -> DataFrame:
    """(conv_id, nth, a, b, words): every turn's place in its conversation from 1, its name and
    the words of its text. The turns are ranged over partitions and numbered inside, then each
    conversation's parts are moved by what stands in the parts before."""
    said = conversations.where("conv_id IS NOT NULL").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    named = said.selectExpr(
        "conv_id", "turn", "xxhash64(1, length(role), role, text) AS a", "xxhash64(2, length(role), role, text) AS b",
        "CAST(conv(substr(sha2(concat(role, '\\n', text), 256), 1, 15), 16, 10) AS BIGINT) AS place",
        f"CAST(regexp_count(text, '{_WORD}') AS BIGINT) AS words" if words else "0L AS words", "monotonically_increasing_id() AS tie")
    # equal turns may change places; the tie lets a range end between them
    ranged = named.repartitionByRange("conv_id", "turn", "place", "a", "b", "tie").withColumn("part", F.spark_partition_id())
    ranged = scratch_table(ranged.drop("tie"), "turns")
    parts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "place", "a", "b"))
    return ranged.withColumn("inside", inside).join(moved, ["conv_id", "part"]).select(
        "conv_id", (F.col("moved") + F.col("inside")).alias("nth"), "a", "b", "words")


def _running(rows: DataFrame, values: dict[str, str], fold, start: bool) -> DataFrame:
    """``rows`` (one for each conv_id and block) with, as each name of ``values``, its column folded
    over the blocks before (``start``) or after. Whole super-blocks are folded first."""
    rows = rows.withColumn("super", F.floor(F.col("block") / SUPER).cast("bigint"))
    way = (lambda c: F.col(c)) if start else (lambda c: F.col(c).desc())
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = ahead(Window.partitionBy("conv_id").orderBy(way("super")))
    within = ahead(Window.partitionBy("conv_id", "super").orderBy(way("block")))
    supers = rows.groupBy("conv_id", "super").agg(*[fold(c).alias(f"all_{n}") for n, c in values.items()]).select(
        "conv_id", "super", *[fold(f"all_{n}").over(over).alias(f"far_{n}") for n in values])
    near = rows.select("*", *[fold(c).over(within).alias(f"near_{n}") for n, c in values.items()])
    return near.join(supers, ["conv_id", "super"]).select(
        *[c for c in rows.columns if c != "super"],
        *[_both(fold, F.coalesce(f"far_{n}", F.lit(0)), F.coalesce(f"near_{n}", F.lit(0))).alias(n) for n in values])


def _both(fold, x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y) if fold is F.bit_xor else x + y


def _mix(i: int) -> tuple[str, str]:
    """The two position-mixed hashes of positional column i; 0 where it is empty."""
    at = f"block * {WIDTH} + {i + 1}"
    return f"if(a{i} IS NULL, 0L, xxhash64({at}, a{i}, b{i}))", f"if(a{i} IS NULL, 0L, xxhash64(b{i}, a{i}, {at}))"


def blocks(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each conversation and block: (conv_id, block, a0, b0, w0, ..., before1, before2,
    ends): names and words by position, the node that the blocks before end in, and the number of
    positions filled if the conversation ends here. ``lengths`` has (conv_id, n) of every
    conversation; one without turns has one empty block."""
    at = turns.withColumn("block", F.floor((F.col("nth") - 1) / WIDTH).cast("bigint")).withColumn("col", (F.col("nth") - 1) % WIDTH)
    wide = at.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("col") == i, F.col(c))).alias(f"{x}{i}") for i in range(WIDTH) for x, c in (("a", "a"), ("b", "b"), ("w", "words"))])
    none = lengths.where("n = 0").select("conv_id", F.lit(0).cast("bigint").alias("block"))
    wide = wide.unionByName(none, allowMissingColumns=True)
    filled = reduce(lambda x, y: x + y, [F.col(f"a{i}").isNotNull().cast("bigint") for i in range(WIDTH)])
    mixes = [_mix(i) for i in range(WIDTH)]
    wide = wide.withColumns({"filled": filled, "x1": F.expr(" ^ ".join(m[0] for m in mixes)), "x2": F.expr(" ^ ".join(m[1] for m in mixes))})
    linked = _running(wide, {"before1": "x1", "before2": "x2"}, F.bit_xor, start=True).join(lengths, "conv_id")
    return linked.withColumn("ends", F.when(F.col("block") * WIDTH + F.col("filled") == F.col("n"), F.col("filled"))).drop("n", "filled")


def _roll_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """One row for each node: block, before1, before2, the positional names up to its level, level,
    n_convs, conv_id, n_ends and ``aggregates``."""
    columns = ", ".join(f"(a{i}, b{i})" for i in range(WIDTH))
    names = ", ".join(f"a{i}, b{i}" for i in range(WIDTH))
    levels = {(1 << 2 * (WIDTH - j)) - 1: j for j in range(WIDTH + 1)}  # grouping_id: a bit for each column rolled away
    level = "CASE " + " ".join(f"WHEN gid = {g} THEN {j}" for g, j in levels.items()) + " END"
    ends = ", ".join(f"count_if(ends = {j}) AS ends{j}" for j in range(WIDTH + 1))
    rolled = rows.sparkSession.sql(f"""
        SELECT block, before1, before2, {names}, grouping_id() AS gid, count(1) AS n_convs, min(conv_id) AS conv_id, {ends}, {aggregates}
        FROM {{rows}} GROUP BY block, before1, before2, ROLLUP ({columns})""", rows=rows)
    told = rolled.withColumn("level", F.expr(level)).withColumn("n_ends", F.expr(_at_level("ends", 0))).drop(*[f"ends{j}" for j in range(WIDTH + 1)])
    last = " OR ".join(f"level = {j} AND a{j - 1} IS NOT NULL" for j in range(1, WIDTH + 1))
    return told.where(f"level = 0 AND block = 0 OR {last}")


def _at_level(name: str, least: int) -> str:
    return "CASE level " + " ".join(f"WHEN {j} THEN {name}{j}" for j in range(least, WIDTH + 1)) + " END"


def _keyed(nodes: DataFrame) -> DataFrame:
    """With depth, the node's key (k1, k2) and its parent's (p1, p2; null at the root)."""
    mixes = [_mix(i) for i in range(WIDTH)]
    found = nodes.withColumns({
        "depth": F.expr(f"block * {WIDTH} + level"),
        "k1": F.expr("before1 ^ " + " ^ ".join(m[0] for m in mixes)), "k2": F.expr("before2 ^ " + " ^ ".join(m[1] for m in mixes))})
    own = ["CASE level " + " ".join(f"WHEN {j} THEN {mixes[j - 1][k]}" for j in range(1, WIDTH + 1)) + " END" for k in (0, 1)]
    return found.withColumns({"p1": F.expr(f"k1 ^ {own[0]}"), "p2": F.expr(f"k2 ^ {own[1]}")})


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, given as (conv_id, nth, a, b, words) and (conv_id, n):
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    n_ends). A node's own text is turn ``depth`` of conversation ``conv_id``."""
    rows = scratch_table(blocks(turns, lengths), "blocks")
    first = _roll_up(rows, ", ".join(f"max(w{i}) AS words{i + 1}" for i in range(WIDTH)))
    own = first.where("n_convs > 1 OR n_ends = n_convs").selectExpr(
        "conv_id", "block", "level", f"if(level = 0, 0L, (n_convs - 1) * {_at_level('words', 1)}) AS own", "n_ends = n_convs AS leaf")
    owned = own.groupBy("conv_id", "block").agg(
        *[F.sum(F.when(F.col("level") == j, F.col("own"))).alias(f"own{j}") for j in range(1, WIDTH + 1)], F.count_if("leaf").alias("leaf"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in owned.columns[2:]}
    given = rows.select("conv_id", "block").join(owned, ["conv_id", "block"], "left").withColumns(zero).withColumn(
        "own", F.expr(" + ".join(f"own{j}" for j in range(1, WIDTH + 1))))
    given = _running(given, {"later": "own", "leaf_later": "leaf"}, F.sum, start=False)
    parts = [f"later + {' + '.join(f'own{i}' for i in range(max(j, 1), WIDTH + 1))} AS from{j}" for j in range(WIDTH + 1)]
    given = given.selectExpr("conv_id", "block", "leaf + leaf_later AS leaf", *parts)
    names = [f"{x}{i}" for i in range(WIDTH) for x in "ab"]
    second = rows.select("conv_id", "block", *names, "before1", "before2", "ends").join(given, ["conv_id", "block"])
    nodes = _keyed(_roll_up(second, "sum(leaf) AS n_leaves, " + ", ".join(f"sum(from{j}) AS from{j}" for j in range(WIDTH + 1))))
    nodes = scratch_table(nodes.selectExpr(
        "k1", "k2", "depth", "p1", "p2", "conv_id", "n_convs", "n_ends", "n_leaves", f"{_at_level('from', 0)} AS saved_tokens"), "nodes")
    parents = nodes.selectExpr("k1 AS p1", "k2 AS p2", "depth + 1 AS depth", "conv_id AS parent_conv_id")
    kids = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    found = nodes.join(parents, ["p1", "p2", "depth"], "left").join(kids, ["k1", "k2", "depth"], "left").join(
        digests(_ends(rows)), ["k1", "k2", "depth"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "n_ends")


def _ends(rows: DataFrame) -> DataFrame:
    """(k1, k2, depth, conv_id): the node in which each conversation ends."""
    mixes = [_mix(i) for i in range(WIDTH)]
    return rows.where("ends IS NOT NULL").selectExpr(
        *[f"before{k + 1} ^ " + " ^ ".join(m[k] for m in mixes) + f" AS k{k + 1}" for k in (0, 1)], f"block * {WIDTH} + ends AS depth", "conv_id")


_KEY = [("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64())]


def _pack(batches):
    """Neighbours of one node as rows of up to PACK ids, joined by commas."""
    key, ids = None, []

    def out():
        return pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "depth"), key), first=ids[0], ids=",".join(map(str, ids)))],
                                          pa.schema([*_KEY, ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for k1, k2, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "depth", "conv_id"))):
            if ids and ((k1, k2, depth) != key or len(ids) == PACK):
                yield out()
                ids.clear()
            key = (k1, k2, depth)
            ids.append(conv)
    if ids:
        yield out()


def _hash(batches):
    key, digest = None, None

    def out():
        return pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "depth"), key), ends_sha256=digest.hexdigest())],
                                          pa.schema([*_KEY, ("ends_sha256", pa.string())]))

    for batch in batches:
        for k1, k2, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "depth", "ids"))):
            if (k1, k2, depth) != key:
                if key:
                    yield out()
                key, digest = (k1, k2, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key:
        yield out()


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of (k1, k2, depth, conv_id): SHA-256 of a node's ids, ascending,
    joined by commas. Ranges of ids are packed where they lie, so the task that hashes a node, which
    the digest forces to be one, streams a row for each PACK ids."""
    key = ["k1", "k2", "depth"]
    packed = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(
        _pack, "k1 bigint, k2 bigint, depth bigint, first bigint, ids string")
    return packed.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hash, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")
