"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a native expression over the words and lines of the whole text, and every rule
compares one measure with one threshold; ``compile_rules`` turns the table into a boolean column and
an array of the names of broken rules. No row leaves its task.

Repeated three-word windows are found by sorting the windows' hashes with their positions inside
the row and comparing neighbours: n log n in the length of the text, with no exchange.

Defined results: a null text has no words and fails; windows are compared by 64-bit hashes within
one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD_PATTERN

#: Frequent words of the corpus's languages (fixed values).
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "with", "for", "be", "have", "it", "on", "as",
              "de", "la", "le", "les", "et", "des", "en", "un", "une", "que", "est", "pour", "dans",
              "el", "los", "las", "y", "se", "del", "por", "con", "una",
              "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "nicht"]
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

#: (name, measure, comparison, threshold): a text breaks a rule if the comparison does not hold.
RULES = [
    ("enough_words", "n_words", ">=", 50.0),
    ("not_too_many_words", "n_words", "<=", 1_000_000.0),
    ("word_length_low", "mean_word_chars", ">=", 2.0),
    ("word_length_high", "mean_word_chars", "<=", 12.0),
    ("symbols", "symbol_ratio", "<=", 0.1),
    ("stop_words", "stop_ratio", ">=", 0.02),
    ("repeated_lines", "dup_line_ratio", "<=", 0.5),  # a text of three lines may repeat one
    ("repeated_words", "repeat_ratio", "<=", 0.5),
]


#: Measures that are ratios: (numerator, denominator); a zero denominator gives zero.
_RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
}
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words) of
    every row; ``row`` is a struct of the columns of ``docs`` but the text."""
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    text = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # arrays are named step by step, so that each is made once
    words = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))).withColumns({
        "n": F.size("words"), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_PATTERN))})
    hashed = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = hashed.withColumn("windows", F.expr(
        "sort_array(transform(slice(arrays_zip(hashes, slice(hashes, 2, greatest(n, 1)), slice(hashes, 3, greatest(n, 1))), 1, greatest(n - 2, 0)),"
        " (x, i) -> struct(xxhash64(x.hashes, x.`1`, x.`2`) AS h, i AS i)))"))
    # same[k]: sorted window k is the same as the next one
    same = windows.withColumn("same", F.expr("zip_with(windows, slice(windows, 2, greatest(n, 1)), (a, b) -> coalesce(a.h = b.h, false))"))
    starts = same.withColumn("starts", F.expr(
        "sort_array(transform(filter(arrays_zip(windows, same, concat(array(false), same)), x -> x.same OR x.`2`), x -> x.windows.i))"))
    size = lambda e: F.size(e).cast("bigint")
    return starts.select(
        "row", F.col("n").cast("bigint").alias("n_words"),
        F.length(F.translate("text", _SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        size("lines").alias("n_lines"), (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        size(F.filter("words", lambda w: F.translate(w, *_LETTERS).isin(STOP_WORDS))).alias("n_stop_words"),
        # a window adds three words, or as many as lie before the next window
        F.expr("aggregate(zip_with(starts, slice(starts, 2, greatest(n, 1)), (a, b) -> CAST(least(3, coalesce(b - a, 3)) AS BIGINT)), 0L, (n, x) -> n + x)")
        .alias("n_repeat_words"))


def _measure(name: str) -> Column:
    if name not in _RATIOS:
        return F.col(name)
    a, b = _RATIOS[name]
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def compile_rules(rules=None) -> Column:
    """Names of the rules that a row of measures breaks."""
    holds = {">=": lambda x, t: x >= t, "<=": lambda x, t: x <= t}
    return F.filter(F.array(*[
        F.when(~holds[op](_measure(measure), F.lit(limit)), F.lit(name)) for name, measure, op, limit in (RULES if rules is None else rules)]),
        lambda x: x.isNotNull())


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, text_col: str = "text", rules=None) -> DataFrame:
    """Measures with ``broken``, the names of broken rules, and ``kept``."""
    return measures(docs, text_col).withColumn("broken", compile_rules(rules)).withColumn("kept", (F.size("broken") == 0) & ~base_failed())
