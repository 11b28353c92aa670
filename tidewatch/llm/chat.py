"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logging writes a conversation again after each turn, so most logged conversations are prefixes of
longer ones. Each turn's hash is mixed with its position, and the running XOR of these 128-bit
hashes along a conversation names every prefix. A conversation whose whole-length hash is the hash
of a longer one's strict prefix is dropped by an anti-join; equal conversations collapse to the
smallest conv_id. Prefix hashes are made distinct (partially before the shuffle) and so have no
hot keys, however many conversations share their first turns. Only hashes cross the network until
the conversations to keep are known.

No task holds a whole conversation: its turns are cut by their order into runs (the ranges of a range
partitioning), windows stay inside a run, and positions and running XORs are carried over from the
totals of the runs before, of which a conversation has at most one a range. Rendering groups
``part`` positions, so neither long conversations nor null or repeated turn numbers make a group
grow; the text is the parts in order.

Defined results: rows that repeat a turn wholly are one turn; turns are ordered by turn (null
first), role, and hash of the text; a null role or text is rendered empty and differs from an empty one; turns
without conv_id belong to no conversation and are left out; positions count turns, so gaps in the
numbers do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import scratch_table

#: Turns in one rendered part.
PART = 256
#: Layout of one turn.
TURN = ("<|", "|>\n", "\n<|end|>\n")


def _hashed(turns: DataFrame) -> DataFrame:
    """Turns with a hash of 128 bits of what is said (t1, t2) and one of the turn number."""
    said = [F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    return turns.where("conv_id IS NOT NULL").withColumns({
        "t1": F.xxhash64(F.lit(1), *said), "t2": F.xxhash64(F.lit(2), *said), "at": F.xxhash64(F.col("turn").isNull(), "turn")})


def _carried(runs: DataFrame, **totals) -> DataFrame:
    """``totals`` of each run of a conversation, carried over from the runs before it."""
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("conv_id", "run", *[F.coalesce(total.over(before), F.lit(0)).alias(name) for name, total in totals.items()])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, run, at, t1, t2, n, h1, h2, whole): the hash of the first n turns, for each n;
    ``whole`` on the last."""
    order = ["turn", "role", "t1", "t2"]
    once = _hashed(turns).select("conv_id", *order, "at").distinct()
    cut = scratch_table(once.repartitionByRange("conv_id", *order).withColumn("run", F.spark_partition_id()), "turns")
    runs = cut.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("turns"))
    starts = _carried(runs, start=F.sum("turns")).join(runs.groupBy("conv_id").agg(F.sum("turns").alias("length")), "conv_id")
    inside = Window.partitionBy("conv_id", "run").orderBy(*order)
    placed = cut.withColumn("n", F.row_number().over(inside).cast("bigint")).join(starts, ["conv_id", "run"]).withColumn(
        "n", F.col("n") + F.col("start")).withColumns({"x1": F.xxhash64("n", "t1"), "x2": F.xxhash64("t2", "n")})
    sums = placed.groupBy("conv_id", "run").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    carried = _carried(sums, c1=F.bit_xor("x1"), c2=F.bit_xor("x2"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(carried, ["conv_id", "run"]).select(
        "conv_id", "run", "at", "t1", "t2", "n", F.col("c1").bitwiseXOR(F.bit_xor("x1").over(upto)).alias("h1"),
        F.col("c2").bitwiseXOR(F.bit_xor("x2").over(upto)).alias("h2"), (F.col("n") == F.col("length")).alias("whole"))


def _maximal(rows: DataFrame) -> DataFrame:
    ends = rows.where("whole").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = rows.where("NOT whole").select("h1", "h2", "n").distinct()
    return ends.join(inner, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one starts with; equal ones
    count as copies of the smallest conv_id."""
    return _maximal(prefixes(turns))


def render(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, rendered) of the maximal conversations, a row for each
    ``part`` turns."""
    rows = scratch_table(prefixes(turns), "prefixes")
    kept = rows.select("conv_id", "run").distinct().join(_maximal(rows), "conv_id")
    turn = ["conv_id", "at", "t1", "t2"]
    places = rows.join(kept, ["conv_id", "run"]).select(*turn, "n", "n_turns", "n_copies")
    said = _hashed(turns).groupBy(*turn).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    a, b, c = TURN
    line = F.concat(F.lit(a), F.coalesce("role", F.lit("")), F.lit(b), F.coalesce("text", F.lit("")), F.lit(c))
    lines = F.sort_array(F.collect_list(F.struct("n", line.alias("line"))))
    return said.join(places, turn).groupBy(
        "conv_id", F.floor((F.col("n") - 1) / part).cast("bigint").alias("part"), "n_turns", "n_copies").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))
