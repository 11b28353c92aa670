"""Record linkage (J1, J4-J6, M5): id match and blocked fuzzy matching.

Within a company the score is 0.1 + 0.6 * title + 0.3 * location, so its parts are scored apart and
only once each:

1. both sides are reduced to *distinct signatures per block* (company), cut with a checkpoint;
2. pairs of distinct *titles* of a block are filtered by two lossless bounds with the location at
   its best (string lengths, then per-character counts), and the LCS kernel runs once for each
   distinct unordered pair of titles that is left, whatever companies and locations it stands in;
3. only titles that can still reach the threshold are joined back to signatures; pairs of
   locations are scored the same way (distinct pairs, length bound first);
4. scores at or above the threshold are joined back to the records.

A block whose number of title pairs is large is tiled over ``S x S`` salted sub-blocks, so one hot
company never lands in a single task, whatever its size. Companies whose id contains the separator
are scored by token sets (M3) over whole signatures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.functions import similarity as S
from tidewatch.session import ensure_checkpoint_dir

PAIRS_PER_TILE = 250_000
#: Bounds of the rounds of a best-first search below the threshold, before the last one at 0.
FALLING_BOUNDS = (0.8, 0.65)


def salted_block_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: Column, right_id: Column,
                      pairs_per_tile: int | None = None) -> DataFrame:
    """Inner equi-join on ``keys`` whose heavy blocks are split into ``S x S`` tiles.

    ``S = ceil(sqrt(n_left * n_right / pairs_per_tile))`` per block (1 for ordinary blocks);
    the block-size table is an aggregate (one row per block)."""
    pairs_per_tile = pairs_per_tile or PAIRS_PER_TILE
    ln = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ln"))
    rn = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rn"))
    pairs = F.col("_ln").cast("double") * F.col("_rn").cast("double")
    salt = ln.join(rn, keys).select(
        *keys, F.greatest(F.lit(1), F.ceil(F.sqrt(pairs / F.lit(float(pairs_per_tile))))).cast("int").alias("_s"))
    l2 = (
        left.join(salt, keys)
        .withColumn("_sl", F.pmod(F.xxhash64(left_id), F.col("_s")).cast("int"))
        .withColumn("_sr", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
        .drop("_s")
    )
    r2 = (
        right.join(salt, keys)
        .withColumn("_sr", F.pmod(F.xxhash64(right_id), F.col("_s")).cast("int"))
        .withColumn("_sl", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
        .drop("_s")
    )
    # The join multiplies rows, so the pair work is not proportional to the input bytes that
    # AQE uses to size partitions: spread the tiles over a fixed number of partitions (an
    # explicit count, which AQE does not coalesce) on both sides of the co-partitioned join.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = keys + ["_sl", "_sr"]
    return l2.repartition(n, *tile).join(r2.repartition(n, *tile), tile).drop("_sl", "_sr")


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _with_lcs(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``pairs`` with the LCS length of columns ``a`` and ``b``; the kernel sees each distinct
    unordered pair of unequal strings once."""
    low, high = F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high")
    once = pairs.where(F.col(a) != F.col(b)).select(low, high).distinct().withColumn("_lcs", S.lcs_len_udf(F.col("_low"), F.col("_high")))
    return pairs.select("*", low, high).join(once, ["_low", "_high"], "left").withColumn(
        out, F.coalesce("_lcs", F.length(a).cast("bigint"))).drop("_low", "_high", "_lcs")


def _score_parts(q: DataFrame, c: DataFrame, block: str, t: float) -> DataFrame:
    """Scored pairs of distinct signatures (block, q_title, q_loc) and (block, c_title, c_loc)."""
    qt, ct = q.select(block, "q_title").distinct(), c.select(block, "c_title").distinct()
    qt = qt.selectExpr("*", *S.char_count_sql("q_title", "_qh")).selectExpr("*", S.char_other_sql("q_title", "_qh"))
    ct = ct.selectExpr("*", *S.char_count_sql("c_title", "_ch")).selectExpr("*", S.char_other_sql("c_title", "_ch"))
    len_bound, count_bound = S.title_bounds_sql("q_title", "c_title", "_qh", "_ch")
    titles = _cut(salted_block_join(qt, ct, [block], F.col("q_title"), F.col("c_title")).where(
        F.expr(f"{len_bound} >= {t!r}D")).where(F.expr(f"{count_bound} >= {t!r}D")).select(block, "q_title", "c_title"))
    titles = _with_lcs(titles, "q_title", "c_title", "_t").withColumn(
        "_t", S.ratio_from_lcs(F.length("q_title"), F.length("c_title"), F.col("_t"))).where(
        S.combine(F.lit(100.0), F.col("_t"), F.lit(100.0)) >= F.lit(t))
    pairs = _cut(titles.join(q, [block, "q_title"]).join(c, [block, "c_title"]).where(
        S.combine(F.lit(100.0), F.col("_t"), S.ratio_upper_bound(F.col("q_loc"), F.col("c_loc"))) >= F.lit(t)))
    pairs = _with_lcs(pairs, "q_loc", "c_loc", "_l")
    score = S.combine(F.lit(100.0), F.col("_t"), S.ratio_from_lcs(F.length("q_loc"), F.length("c_loc"), F.col("_l")))
    return pairs.select(block, "q_title", "q_loc", "c_title", "c_loc", score.alias("score"))


def _score_token_sets(q: DataFrame, c: DataFrame, block: str) -> DataFrame:
    """M3 over whole signatures, for blocks whose id contains the separator (their ``title_sorted``
    keeps the title's order, see ``with_signature``)."""
    pairs = salted_block_join(q, c, [block], F.concat_ws("|", "q_title", "q_loc"), F.concat_ws("|", "c_title", "c_loc"))
    sig = lambda side: F.concat_ws("|", block, f"{side}_title", f"{side}_loc")
    scored = S.with_token_set_ratio(pairs.withColumns({"_a": sig("q"), "_b": sig("c")}), "_a", "_b", "_r")
    return scored.select(block, "q_title", "q_loc", "c_title", "c_loc", (F.col("_r") / F.lit(100.0)).alias("score"))


def score_signature_pairs(queries: DataFrame, candidates: DataFrame, threshold: float, block: str = "company_id") -> DataFrame:
    """Distinct (query signature, candidate signature) pairs of one block scoring >= threshold.

    Inputs carry ``block, title_sorted, location_norm``; output columns:
    ``block, q_title, q_loc, c_title, c_loc, score``."""
    t = S.check_threshold(threshold)
    q = _cut(queries.select(block, F.col("title_sorted").alias("q_title"), F.col("location_norm").alias("q_loc")).distinct())
    c = _cut(candidates.select(block, F.col("title_sorted").alias("c_title"), F.col("location_norm").alias("c_loc")).distinct())
    odd = F.col(block).contains(S.SEPARATOR)
    scored = _score_parts(q.where(~odd), c.where(~odd), block, t).unionByName(_score_token_sets(q.where(odd), c.where(odd), block))
    # a score of exactly 0 is never selected, even at threshold 0
    return scored.where((F.col("score") >= F.lit(t)) & (F.col("score") > F.lit(0.0)))


def match_by_source_id(batch: DataFrame, entities: DataFrame) -> DataFrame:
    """Equi-match on (company_id, source_identifier); NULL or '' never matches; several
    hits resolve to the earliest record. The entity side is pre-aggregated to one row per key
    before the join. Adds ``matched_id`` and ``matched_seq``."""
    idx = (
        entities.where(F.col("source_identifier").isNotNull() & (F.col("source_identifier") != ""))
        .groupBy("company_id", "source_identifier")
        .agg(F.min_by("id", "entity_seq").alias("matched_id"), F.min("entity_seq").alias("matched_seq"))
    )
    return batch.join(idx, ["company_id", "source_identifier"], "left")


def _earliest_per_signature(candidates: DataFrame, key: str, seq: str) -> DataFrame:
    return candidates.groupBy("company_id", "title_sorted", "location_norm").agg(
        F.min_by(key, seq).alias("c_key"), F.min(seq).alias("c_seq")
    )


def find_best_match(queries: DataFrame, candidates: DataFrame, threshold: float = S.DEFAULT_THRESHOLD,
                    query_key: str = "batch_seq", cand_key: str = "id", cand_seq: str = "entity_seq",
                    with_best_score: bool = False) -> DataFrame:
    """J4/J2/J3 core: per query row, the candidate of the same company with the highest score
    >= threshold; ties go to the lowest ``cand_seq``. Queries without a match keep NULLs.
    Candidate filtering (window, status) is the caller's ``where`` on ``candidates``.

    ``with_best_score`` adds ``best_score``, the highest score even if it is below the threshold (0
    without candidates). It is searched best first: a round at the threshold, then rounds at falling
    bounds for the signatures that have no score yet, so the lowest, which prune little, see few."""
    cand = _cut(_earliest_per_signature(candidates, cand_key, cand_seq))
    t = S.check_threshold(threshold)
    best = _best_of(score_signature_pairs(queries, cand, t), cand)
    if not with_best_score:
        return queries.join(best, ["company_id", "title_sorted", "location_norm"], "left")
    signature = ["company_id", "title_sorted", "location_norm"]
    left, found = _cut(queries.select(*signature).distinct()), []
    for bound in [t, *(b for b in FALLING_BOUNDS if b < t), *([0.0] if t > 0 else [])]:
        found.append(_cut(best if bound == t else _best_of(score_signature_pairs(left, cand, bound), cand)))
        left = _cut(left.join(found[-1], signature, "left_anti"))
        if left.isEmpty():
            break
    told = queries.join(reduce(DataFrame.unionByName, found), signature, "left")
    hit = F.col("match_score") >= F.lit(t)
    return told.withColumn("best_score", F.coalesce("match_score", F.lit(0.0))).withColumns(
        {"match_key": F.when(hit, F.col("match_key")), "match_score": F.when(hit, F.col("match_score"))})


def _best_of(scored: DataFrame, cand: DataFrame) -> DataFrame:
    """The best candidate of each query signature: highest score, then earliest."""
    return (
        scored.join(
            cand.withColumnRenamed("title_sorted", "c_title").withColumnRenamed("location_norm", "c_loc"),
            ["company_id", "c_title", "c_loc"],
        )
        .groupBy("company_id", "q_title", "q_loc")
        .agg(F.max_by(F.struct("c_key", "score"), F.struct(F.col("score"), -F.col("c_seq"))).alias("m"))
        .select(
            "company_id",
            F.col("q_title").alias("title_sorted"),
            F.col("q_loc").alias("location_norm"),
            F.col("m.c_key").alias("match_key"),
            F.col("m.score").alias("match_score"),
        )
    )


def find_all_matches(queries: DataFrame, candidates: DataFrame, threshold: float = S.DEFAULT_THRESHOLD,
                     limit: int | None = None, query_key: str = "batch_seq", cand_key: str = "id",
                     cand_seq: str = "entity_seq") -> DataFrame:
    """Every candidate >= threshold per query, ranked by score desc then candidate order;
    ``limit`` applies only when > 0. Adds ``match_key, match_score, match_rank``."""
    from pyspark.sql import Window

    sp = score_signature_pairs(queries, candidates, threshold)
    cand = candidates.select(
        "company_id",
        F.col("title_sorted").alias("c_title"), F.col("location_norm").alias("c_loc"),
        F.col(cand_key).alias("match_key"), F.col(cand_seq).alias("_cseq"),
    )
    pairs = (
        queries.join(
            sp.withColumnRenamed("q_title", "title_sorted").withColumnRenamed("q_loc", "location_norm"),
            ["company_id", "title_sorted", "location_norm"],
        )
        .join(cand, ["company_id", "c_title", "c_loc"])
        .withColumnRenamed("score", "match_score")
    )
    w = Window.partitionBy(query_key).orderBy(F.col("match_score").desc(), F.col("_cseq"))
    ranked = pairs.withColumn("match_rank", F.row_number().over(w))
    if limit is not None and limit > 0:
        ranked = ranked.where(F.col("match_rank") <= limit)
    return ranked.drop("_cseq", "c_title", "c_loc")


def is_match(score: Column, threshold: float = S.DEFAULT_THRESHOLD) -> Column:
    """Inclusive threshold comparison."""
    return score >= F.lit(S.check_threshold(threshold))


def match_explanation(sig1: Column, sig2: Column, score: Column, threshold: float = S.DEFAULT_THRESHOLD) -> Column:
    """M5: explainability struct. The reason text formats the score like Python's ``%.2f`` on
    the binary value (an Arrow-batched helper), not Java's half-up formatting."""
    t = S.check_threshold(threshold)
    ok = score >= F.lit(t)
    return F.struct(
        sig1.alias("signature1"),
        sig2.alias("signature2"),
        F.round(score, 3).alias("similarity"),
        F.lit(t).alias("threshold"),
        ok.alias("is_match"),
        F.concat(
            F.lit("Similarity ("), format_2f(score), F.lit(") "),
            F.when(ok, F.lit(">=    ")).otherwise(F.lit("<     ")),
            F.lit(f" threshold ({t!r})"),
        ).alias("reason"),
    )


@F.pandas_udf(StringType())
def _format_2f_udf(x):
    return x.map(lambda v: None if v != v else f"{v:.2f}")


def format_2f(c: Column) -> Column:
    return _format_2f_udf(c.cast("double"))
