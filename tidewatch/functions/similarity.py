"""Signature similarity (M1-M6).

The score is component-wise: ``(0.10*ratio(company) + 0.60*token_sort_ratio(title) +
0.30*ratio(location)) / 100`` where ``ratio`` is the Indel similarity
``(1 - (la+lb-2*LCS)/(la+lb)) * 100`` (both empty -> 100).

Split of work:
* the LCS length is the only part Spark has no built-in for; it runs in an Arrow-batched
  pandas UDF (bit-parallel LCS over numpy uint64 lanes, one pair a lane and one character of every
  pair a step; strings beyond 64 characters on both sides take one big-int word each);
* everything around it (token sorting, the ratio formula, weights, threshold, the
  lossless length bound) is native column arithmetic, evaluated in the same operation order
  as the reference formula so the inclusive threshold cut is bit-identical.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Component weights and the default threshold.
COMPANY_WEIGHT = 0.10
TITLE_WEIGHT = 0.60
LOCATION_WEIGHT = 0.30
DEFAULT_THRESHOLD = 0.90
SEPARATOR = "|"


def check_threshold(threshold: float) -> float:
    """M6: the threshold must lie in [0, 1]."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"Similarity threshold must be between 0.0 and 1.0, got {threshold}")
    return float(threshold)


# ---------------------------------------------------------------------------
# Small per-pair helpers (pure Python); used inside the pandas UDF and by tests.
# ---------------------------------------------------------------------------


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b`` (Hyyro 2004)."""
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """M1: Indel normalised similarity on a 0-100 scale."""
    lensum = len(a) + len(b)
    if lensum == 0:
        return 100.0
    dist = lensum - 2 * lcs_length(a, b)
    return (1.0 - dist / lensum) * 100


def token_sort_ratio(a: str, b: str) -> float:
    """M2: ratio of the whitespace tokens sorted and re-joined."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """M3: the best Indel ratio among three strings: the common tokens, and the common tokens
    followed by those of one side only (each sorted); 0 if a side has no token. Common tokens that
    make up a whole side score 100."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_left, only_right = (" ".join(sorted(x)) for x in (left & right, left - right, right - left))
    if both and not (only_left and only_right):
        return 100.0
    gap = 1 if both else 0
    size_left, size_right = len(both) + gap + len(only_left), len(both) + gap + len(only_right)

    def score(edits: int, size: int) -> float:
        return 100 - 100 * edits / size

    best = score(len(only_left) + len(only_right) - 2 * lcs_length(only_left, only_right), size_left + size_right)
    if both:
        best = max(best, score(gap + len(only_left), len(both) + size_left), score(gap + len(only_right), len(both) + size_right))
    return best


def similarity(sig1: str, sig2: str) -> float:
    """M4 on two signature strings (reference semantics, used as the test oracle)."""
    p1, p2 = sig1.split("|"), sig2.split("|")
    if len(p1) != 3 or len(p2) != 3:
        return token_set_ratio(sig1, sig2) / 100.0
    combined = (
        COMPANY_WEIGHT * ratio(p1[0], p2[0])
        + TITLE_WEIGHT * token_sort_ratio(p1[1], p2[1])
        + LOCATION_WEIGHT * ratio(p1[2], p2[2])
    )
    return combined / 100.0


_LANE = 64
#: Entries (strings x characters) of one mask table: 16 MB.
_MASKS = 1 << 21


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """LCS length of each pair. The shorter string of a pair, up to 64 characters, is a uint64 lane
    whose bits are its positions; the others are read character by character for all lanes at once,
    so a step is a handful of array operations however many pairs there are."""
    out = np.zeros(len(left), np.int64)
    pairs = [(b, a) if len(a) > len(b) else (a, b) for a, b in zip(left, right)]  # short one first
    lanes = [i for i, (a, b) in enumerate(pairs) if 0 < len(a) <= _LANE]
    for i, (a, b) in enumerate(pairs):
        if len(a) > _LANE:
            out[i] = lcs_length(a, b)
    lanes.sort(key=lambda i: -len(pairs[i][1]))
    alphabet = {c: k for k, c in enumerate(dict.fromkeys("".join(a for a, _ in (pairs[i] for i in lanes))), 1)}
    step = max(1, _MASKS // (len(alphabet) + 1))
    for at in range(0, len(lanes), step):
        some = lanes[at:at + step]
        out[some] = _lane_lcs([pairs[i] for i in some], alphabet)
    return out


def _lane_lcs(pairs: list[tuple[str, str]], alphabet: dict[str, int]) -> np.ndarray:
    """LCS lengths of (up to 64 characters, any length), longest second string first."""
    codes = lambda text: np.fromiter((alphabet.get(c, 0) for c in text), np.int64, len(text))
    short, long = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    lane = np.repeat(np.arange(len(pairs)), short)
    bit = (np.arange(len(lane)) - np.repeat(np.cumsum(short) - short, short)).astype(np.uint64)
    masks = np.zeros((len(pairs), len(alphabet) + 1), np.uint64)
    np.bitwise_or.at(masks, (lane, codes("".join(a for a, _ in pairs))), np.uint64(1) << bit)
    flat, begin = codes("".join(b for _, b in pairs)), np.cumsum(long) - long
    full = np.where(short == _LANE, ~np.uint64(0), (np.uint64(1) << (short % _LANE).astype(np.uint64)) - np.uint64(1))
    v = full.copy()
    for t in range(int(long[0])):
        m = int(np.searchsorted(-long, -t))  # second strings longer than t
        u = v[:m] & masks[np.arange(m), flat[begin[:m] + t]]
        v[:m] = ((v[:m] + u) | (v[:m] - u)) & full[:m]
    return short - np.bitwise_count(v)


# ---------------------------------------------------------------------------
# Spark side.
# ---------------------------------------------------------------------------


@F.pandas_udf(LongType())
def lcs_len_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched LCS length; identical pairs inside one batch are computed once."""
    frame = pd.DataFrame({"a": a.fillna(""), "b": b.fillna("")})
    uniq = frame.drop_duplicates()
    uniq = uniq.assign(v=lcs_lengths(uniq["a"].tolist(), uniq["b"].tolist()))
    return frame.merge(uniq, on=["a", "b"], how="left")["v"].astype("int64")


# Deterministic in fact; flagged otherwise so the optimizer cannot copy the call into a pushed-down
# filter (which would run the Python kernel twice per pair).
lcs_len_udf = lcs_len_udf.asNondeterministic()


def ratio_from_lcs(len_a: Column, len_b: Column, lcs: Column) -> Column:
    """M1 formula given the LCS length, same operation order as the reference library."""
    lensum = (len_a + len_b).cast("double")
    dist = (len_a + len_b - F.lit(2) * lcs).cast("double")
    return F.when(lensum == 0, F.lit(100.0)).otherwise((F.lit(1.0) - dist / lensum) * F.lit(100))


def ratio_col(a: Column, b: Column) -> Column:
    """M1 on two string columns (LCS via the pandas UDF; equal strings short-circuit)."""
    la, lb = F.length(a), F.length(b)
    lcs = F.when(a == b, la).otherwise(lcs_len_udf(a, b))
    return ratio_from_lcs(la, lb, lcs)


def combine(company_score: Column, title_score: Column, location_score: Column) -> Column:
    """M4 weighting, left-to-right like the reference: (0.1c + 0.6t) + 0.3l, then / 100."""
    return (
        F.lit(COMPANY_WEIGHT) * company_score
        + F.lit(TITLE_WEIGHT) * title_score
        + F.lit(LOCATION_WEIGHT) * location_score
    ) / F.lit(100.0)


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """Lossless bound: LCS <= min(la, lb); same formula, so it is >= the true ratio bit-wise."""
    la, lb = F.length(a), F.length(b)
    return ratio_from_lcs(la, lb, F.least(la, lb))


# Character-count bound. LCS(a, b) <= sum over groups of characters of min(count_a, count_b);
# grouping characters only loosens it, so any grouping is lossless. Frequent letters stand alone;
# few groups keep the generated code small enough to be compiled.
CHAR_GROUPS = ["e", "t", "a", "o", "i", "n", "s", "r", "hldcu", "mfpgw", "ybvkxjqz", "0123456789", " "]


def char_count_sql(col: str, prefix: str) -> list[str]:
    """Counts of each group of characters of ``col`` as INT columns ``{prefix}0..``, as SQL text for
    one ``selectExpr``."""
    return [f"length({col}) - length(translate({col}, '{group}', '')) AS {prefix}{i}" for i, group in enumerate(CHAR_GROUPS)]


def char_other_sql(col: str, prefix: str) -> str:
    total = " + ".join(f"{prefix}{i}" for i in range(len(CHAR_GROUPS)))
    return f"length({col}) - ({total}) AS {prefix}x"


def ratio_sql(la: str, lb: str, lcs: str) -> str:
    """M1 formula as Spark SQL text, same operations as ``ratio_from_lcs``."""
    return (f"(CASE WHEN ({la} + {lb}) = 0 THEN 100.0D ELSE "
            f"(1.0D - CAST(({la} + {lb} - 2 * ({lcs})) AS DOUBLE) / CAST(({la} + {lb}) AS DOUBLE)) * 100 END)")


def combine_sql(c: str, t: str, l: str) -> str:
    return f"(({COMPANY_WEIGHT!r}D * {c} + {TITLE_WEIGHT!r}D * {t}) + {LOCATION_WEIGHT!r}D * {l}) / 100.0D"


def title_bounds_sql(qt: str, ct: str, qh: str, ch: str) -> tuple[str, str]:
    """(length bound, character-count bound) of M4 for titles of one company with equal locations,
    as SQL text."""
    lqt, lct = f"length({qt})", f"length({ct})"
    length_bound = combine_sql("100.0D", ratio_sql(lqt, lct, f"least({lqt}, {lct})"), "100.0D")
    counts = " + ".join([f"least({qh}{i}, {ch}{i})" for i in range(len(CHAR_GROUPS))] + [f"least({qh}x, {ch}x)"])
    return length_bound, combine_sql("100.0D", ratio_sql(lqt, lct, f"least({lqt}, {lct}, {counts})"), "100.0D")


def same_company_score_bound(title_a: Column, title_b: Column, loc_a: Column, loc_b: Column) -> Column:
    """Upper bound of M4 for two signatures of the same company (company ratio = 100)."""
    return combine(F.lit(100.0), ratio_upper_bound(title_a, title_b), ratio_upper_bound(loc_a, loc_b))


def same_company_score(title_sorted_a: Column, title_sorted_b: Column, loc_a: Column, loc_b: Column) -> Column:
    """M4 for two signatures of the same company, from pre-sorted titles and locations."""
    return combine(F.lit(100.0), ratio_col(title_sorted_a, title_sorted_b), ratio_col(loc_a, loc_b))


def with_token_set_ratio(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """M3 on two string columns, in native array functions around the LCS of the one-sided tokens."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.col(c), r"\s+"), lambda x: x != ""))
    text = lambda c: F.array_join(F.array_sort(c), " ")
    step = df.withColumns({"_ta": tokens(a), "_tb": tokens(b)})
    step = step.withColumns({
        "_both": text(F.array_intersect("_ta", "_tb")), "_oa": text(F.array_except("_ta", "_tb")), "_ob": text(F.array_except("_tb", "_ta"))})
    step = step.withColumn("_n", lcs_len_udf(F.col("_oa"), F.col("_ob")))
    la, lb, ln = F.length("_oa"), F.length("_ob"), F.length("_both")
    gap = F.when(ln > 0, 1).otherwise(0)
    score = lambda edits, size: F.lit(100) - F.try_divide((F.lit(100) * edits).cast("double"), size.cast("double"))
    main = score(la + lb - 2 * F.col("_n"), ln + gap + la + ln + gap + lb)
    value = (
        F.when((F.size("_ta") == 0) | (F.size("_tb") == 0), F.lit(0.0))
        .when((ln > 0) & ((la == 0) | (lb == 0)), F.lit(100.0))
        .when(ln > 0, F.greatest(main, score(gap + la, ln + ln + gap + la), score(gap + lb, ln + ln + gap + lb)))
        .otherwise(main))
    return step.withColumn(out, value).drop("_ta", "_tb", "_both", "_oa", "_ob", "_n")


def with_score(df: DataFrame, a: tuple[str, str, str, str], b: tuple[str, str, str, str], out: str = "score") -> DataFrame:
    """M4 for arbitrary pairs of rows: ``a`` and ``b`` name the columns company, sorted title,
    location and signature of each side. Signatures whose company id contains the separator are
    scored by token sets (M3) in a branch of their own, so the rows of either branch never run
    the other's code."""
    odd = F.coalesce(F.col(a[0]).contains(SEPARATOR) | F.col(b[0]).contains(SEPARATOR), F.lit(False))
    parts = [F.lit(100.0) if x == y else ratio_col(F.col(x), F.col(y)) for x, y in zip(a[:3], b[:3])]
    whole = df.where(~odd).withColumn(out, combine(*parts))
    sets = with_token_set_ratio(df.where(odd), a[3], b[3], out).withColumn(out, F.col(out) / F.lit(100.0))
    return whole.unionByName(sets)
