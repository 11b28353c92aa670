"""Mixing sources to target weights by temperature.

With p the share of a source in all tokens, its weight is p^a / sum of p^a: a = 1 keeps the natural
mix, a = 0 makes it uniform. The entropy of the weights and the largest repetition (weight * budget
/ tokens of the source) both fall as a grows; the smallest a in [0, 1] at which the entropy is at
most ``entropy_ratio`` * ln(sources) and no source is repeated more than ``max_repeat`` times is
found by bisection. Each Spark job takes six halvings at once (63 inner points) over the table of
sources; only those 65 rows reach the driver.

The weights are realised in whole documents. A source's documents are dealt by a hash of id, text
and number among equal rows into blocks of about ``block_tokens`` tokens, so neither null ids nor
copies fill a block; ``group_blocks`` blocks are a group. A source's token budget is a number of
whole epochs and a rest; in each epoch the groups, and the blocks of a group, come in another
pseudo-random order, the rest takes blocks in the order of the last epoch until it is used up, and
the block at which it runs out is drawn document by document. So windows run over the groups of a
source, over the blocks of a group, and over the documents of one block of each source.

Defined results: a null source is the source ''; texts without words are never drawn; rows that
repeat an id, and wholly equal rows, count and are drawn like others; an empty table gives an empty
mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD_PATTERN, scratch_table

ENTROPY_RATIO, MAX_REPEAT, BLOCK_TOKENS = 0.95, 4.0, 20_000
#: Blocks that are ordered together; a source's groups are ordered in their turn.
GROUP_BLOCKS = 4096
#: Equal rows that one task numbers.
_COPIES = 4096
#: Bisection: 2^-48 and less between the ends; the exponent is then rounded, so that the order of
#: summation cannot change the mix.
_ROUNDS, _POINTS, _DIGITS = 8, 64, 10


def n_tokens(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def exponent(sources: DataFrame, budget: float, entropy_ratio: float = ENTROPY_RATIO, max_repeat: float = MAX_REPEAT) -> float:
    """The smallest exponent in [0, 1] that meets both limits (1 if none does). ``sources`` has
    one row per source with its positive number of tokens."""
    total = F.lit(float(sources.agg(F.sum("tokens")).first()[0]))
    shares = sources.select((F.col("tokens") / total).alias("p"), F.col("tokens").cast("double").alias("tokens"))
    low, high = 0.0, 1.0
    for step in range(_ROUNDS):
        width = (high - low) / _POINTS
        powers = shares.select("p", "tokens", F.explode(F.sequence(F.lit(0), F.lit(_POINTS))).alias("k")).select(
            "tokens", "k", F.pow("p", F.lit(low) + F.col("k") * F.lit(width)).alias("q"))
        points = powers.groupBy("k").agg(
            F.count(F.lit(1)).alias("n"), F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("s"),
            F.max(F.col("q") / F.col("tokens")).alias("most")).select(
            "k", ((F.log("z") - F.col("s") / F.col("z") <= entropy_ratio * F.log(F.col("n").cast("double")))
                  & (F.col("most") / F.col("z") * budget <= max_repeat)).alias("ok"))
        met = sorted(r["k"] for r in points.where("ok").collect())
        if not met:
            return 1.0
        if met[0] == 0:
            return round(low, _DIGITS)
        low, high = low + (met[0] - 1) * width, low + met[0] * width
    return round(high, _DIGITS)


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, n_tokens, key) of every row with words. Wholly equal rows are counted before
    the shuffle and numbered after it, in chunks that are dealt to tasks anew; ``key`` hashes the id,
    the text and that number."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        n_tokens(text_col).alias("n_tokens"), F.md5(F.col(text_col).cast("binary")).alias("text_hash")).where("n_tokens > 0")
    counts = scratch_table(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "copies")
    few = counts.where(F.col("copies") <= _COPIES).select(*rows.columns, F.lit(0).cast("bigint").alias("at"), "copies")
    many = counts.where(F.col("copies") > _COPIES).select(
        *rows.columns, F.explode(F.expr(f"sequence(0L, copies - 1, {_COPIES}L)")).alias("at"), "copies")
    chunk = F.expr(f"explode(sequence(at, least(at + {_COPIES}L, copies) - 1))").alias("copy")
    numbered = few.unionByName(many.repartition(*rows.columns, "at")).select(*rows.columns, chunk)
    name = _order(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens"), F.col("text_hash"), F.col("copy"))
    return numbered.select("doc_id", "source", "n_tokens", F.conv(F.substring(name, 1, 12), 16, 10).cast("bigint").alias("key"))


def _before(tokens: str, keys: list[str], unit: str) -> Column:
    """Tokens of the units before this one, in the pseudo-random order of a source's epoch."""
    order = Window.partitionBy(*keys).orderBy(_order(F.col("source"), F.col("epoch"), F.col(unit)), unit)
    return F.coalesce(F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        budget_ratio: float = 1.0, entropy_ratio: float = ENTROPY_RATIO, max_repeat: float = MAX_REPEAT,
        block_tokens: int = BLOCK_TOKENS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """The mix as (doc_id, source, n_tokens, epoch, block, block_start, source_budget), a row for
    each time that a document is drawn. block_start is where its block starts in the source's
    stream of source_budget tokens; ordering by block_start / source_budget interleaves sources by
    weight. The budget is ``budget_ratio`` times the tokens there are."""
    rows = scratch_table(_numbered(docs, id_col, text_col, source_col), "mix")
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).cache()
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    a = exponent(sources, total * budget_ratio, entropy_ratio, max_repeat) if total else 1.0
    blocks = max(1, -(-total // block_tokens))
    share = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    whole = sources.select(share.alias("q")).agg(F.sum("q")).first()[0] or 1.0
    plan = sources.select(
        "source", "tokens", F.round(share / F.lit(whole) * F.lit(total * budget_ratio)).cast("bigint").alias("source_budget")).withColumns({
            "epochs": F.expr("source_budget div tokens"), "rest": F.expr("source_budget % tokens")})

    dealt = rows.withColumn("block", F.col("key") % blocks).drop("key")
    sums = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")).withColumn("group", F.expr(f"block div {group_blocks}"))
    epochs = plan.withColumn("epoch", F.explode(F.expr("sequence(0L, epochs)")))
    groups = sums.groupBy("source", "group").agg(F.sum("block_tokens").alias("group_tokens")).join(epochs.select("source", "epoch"), "source").select(
        "source", "group", "epoch", _before("group_tokens", ["source", "epoch"], "group").alias("group_start"))
    schedule = sums.join(groups, ["source", "group"]).withColumn(
        "before", F.col("group_start") + _before("block_tokens", ["source", "epoch", "group"], "block")).join(plan, "source").where(
            "epoch < epochs OR before < rest").withColumns({
                "block_start": F.expr("epoch * tokens + before"),
                "cut": F.expr("CASE WHEN epoch = epochs AND before + block_tokens > rest THEN rest - before END")})
    drawn = dealt.join(schedule.select("source", "block", "epoch", "block_start", "cut", "source_budget"), ["source", "block"])
    kept = ["doc_id", "source", "n_tokens", "epoch", "block", "block_start", "source_budget"]
    order = Window.partitionBy("source", "block").orderBy(
        _order(F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    partly = drawn.where("cut IS NOT NULL").withColumn("upto", F.sum("n_tokens").over(order)).where("upto <= cut")
    return drawn.where("cut IS NULL").select(kept).unionByName(partly.select(kept))
