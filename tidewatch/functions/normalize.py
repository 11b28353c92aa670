"""Title / location normalisation and signatures (N1-N4), as native Spark column expressions.

Everything here is a plain ``Column -> Column`` function: no UDF and no shuffle; rows stay where
they are. (The lambdas over words are interpreted by the JVM, not code-generated.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being matched; they are stated
# plainly and in their natural order.
# ---------------------------------------------------------------------------

# Title abbreviations -> expansion (word-level lookup after punctuation removal).
TITLE_ABBREVIATIONS: dict[str, str] = {
    "sr": "senior",
    "sr.": "senior",
    "jr": "junior",
    "jr.": "junior",
    "mgr": "manager",
    "mgr.": "manager",
    "eng": "engineer",
    "engr": "engineer",
    "engr.": "engineer",
    "dev": "developer",
    "devops": "development operations",
    "sre": "site reliability engineer",
    "qa": "quality assurance",
    "ui": "user interface",
    "ux": "user experience",
    "vp": "vice president",
    "cto": "chief technology officer",
    "ceo": "chief executive officer",
    "cfo": "chief financial officer",
    "coo": "chief operating officer",
    "svp": "senior vice president",
    "evp": "executive vice president",
    "assoc": "associate",
    "asst": "assistant",
    "dir": "director",
    "dir.": "director",
    "admin": "administrator",
    "coord": "coordinator",
    "coord.": "coordinator",
    "acct": "account",
    "dept": "department",
    "ops": "operations",
    "spec": "specialist",
}

# Location lookups: used for the whole lower-cased string first, then per word.
LOCATION_NORMALIZATIONS: dict[str, str] = {
    "sf": "san francisco",
    "ny": "new york",
    "nyc": "new york city",
    "la": "los angeles",
    "dc": "washington dc",
    "remote us": "remote",
    "remote - us": "remote",
    "remote (us)": "remote",
    "work from home": "remote",
    "wfh": "remote",
}

# Two-letter US state codes, checked per word before the location lookup.
STATE_ABBREVIATIONS: dict[str, str] = {
    "ca": "california",
    "ny": "new york",
    "tx": "texas",
    "fl": "florida",
    "il": "illinois",
    "ma": "massachusetts",
    "wa": "washington",
    "pa": "pennsylvania",
    "oh": "ohio",
    "ga": "georgia",
    "nc": "north carolina",
    "mi": "michigan",
    "nj": "new jersey",
    "va": "virginia",
    "az": "arizona",
    "co": "colorado",
    "or": "oregon",
    "md": "maryland",
    "tn": "tennessee",
    "in": "indiana",
}

UNKNOWN_LOCATION = "unknown"
SIGNATURE_SEPARATOR = "|"

# Unicode whitespace as Python's str.isspace() defines it; written out so the JVM regex
# (ASCII \s by default) and DuckDB's RE2 agree with it.
WS_CLASS = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Word characters = letters, numbers, underscore (Unicode), as in Python's \w.
WORD_CLASS = r"\p{L}\p{N}_"
TITLE_DROP_RE = "[^" + WORD_CLASS + WS_CLASS + "-]"
LOCATION_DROP_RE = "[^" + WORD_CLASS + WS_CLASS + ",]"
WS_RUN_RE = "[" + WS_CLASS + "]+"
LOCATION_SPLIT_RE = "[" + WS_CLASS + ",]+"


def _map_lit(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _tokens(c: Column, sep_re: str) -> Column:
    return F.filter(F.split(c, sep_re), lambda w: w != F.lit(""))


def normalize_title(title: Column) -> Column:
    """N1. NULL/'' -> ''. Lower, punctuation -> space (hyphen kept), per-word abbreviation
    expansion (before hyphen splitting), hyphen -> space, whitespace collapsed."""
    abbrev = _map_lit(TITLE_ABBREVIATIONS)
    cleaned = F.regexp_replace(F.lower(title), TITLE_DROP_RE, " ")
    words = _tokens(cleaned, WS_RUN_RE)
    expanded = F.transform(words, lambda w: F.coalesce(F.try_element_at(abbrev, w), w))
    joined = F.array_join(expanded, " ")
    out = F.array_join(_tokens(F.replace(joined, F.lit("-"), F.lit(" ")), " "), " ")
    return F.when(title.isNull() | (title == ""), F.lit("")).otherwise(out)


def normalize_location(location: Column) -> Column:
    """N2. NULL/'' -> 'unknown'. Whole lower-cased string lookup first (untrimmed); else
    punctuation -> space (comma kept), tokens split on whitespace/commas, each token through
    the state map then the location map, joined by spaces; empty -> 'unknown'."""
    loc_map = _map_lit(LOCATION_NORMALIZATIONS)
    state_map = _map_lit(STATE_ABBREVIATIONS)
    low = F.lower(location)
    cleaned = F.regexp_replace(low, LOCATION_DROP_RE, " ")
    words = _tokens(cleaned, LOCATION_SPLIT_RE)
    mapped = F.transform(
        words,
        lambda w: F.coalesce(F.try_element_at(state_map, w), F.try_element_at(loc_map, w), w),
    )
    joined = F.array_join(mapped, " ")
    processed = F.when(joined == "", F.lit(UNKNOWN_LOCATION)).otherwise(joined)
    return (
        F.when(location.isNull() | (location == ""), F.lit(UNKNOWN_LOCATION))
        .otherwise(F.coalesce(F.try_element_at(loc_map, low), processed))
    )


def token_sort(text: Column) -> Column:
    """Whitespace tokens sorted by code point, joined by one space (token_sort_ratio input)."""
    return F.array_join(F.array_sort(_tokens(text, WS_RUN_RE)), " ")


def signature(company_id: Column, title_norm: Column, location_norm: Column) -> Column:
    """N3 from already normalised parts: ``company|title|location``."""
    return F.concat(company_id, F.lit(SIGNATURE_SEPARATOR), title_norm, F.lit(SIGNATURE_SEPARATOR), location_norm)


def create_signature(company_id: Column, title: Column, location: Column) -> Column:
    """N3 from raw fields."""
    return signature(company_id, normalize_title(title), normalize_location(location))


def with_signature(df, company_col: str = "company_id", title_col: str = "title", location_col: str = "location"):
    """Adds ``title_norm``, ``title_sorted``, ``location_norm`` and ``signature`` columns.

    Same expressions as ``normalize_title`` / ``normalize_location`` / ``token_sort``, handed
    to Spark as SQL text (two ``selectExpr`` calls) so building the plan costs two round
    trips instead of hundreds of Column constructions."""
    keep = [f"`{c}`" for c in df.columns if c not in ("title_norm", "location_norm", "title_sorted", "signature")]
    step = df.selectExpr(*keep, f"{spark_sql_normalize_title(f'`{title_col}`')} AS title_norm",
                         f"{spark_sql_normalize_location(f'`{location_col}`')} AS location_norm")
    # a company id with the separator makes signatures that are compared as token sets, where the
    # order of the title counts: such titles stay as they are
    return step.selectExpr("*", f"CASE WHEN instr(`{company_col}`, '|') > 0 THEN title_norm ELSE {spark_sql_token_sort('title_norm')} END AS title_sorted",
                           f"concat(`{company_col}`, '|', title_norm, '|', location_norm) AS signature")


# ---------------------------------------------------------------------------
# Spark SQL text of the same expressions (JVM-parsed; used on hot paths).
# ---------------------------------------------------------------------------


def _spark_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spark_map(d: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{_spark_str(k)}, {_spark_str(v)}" for k, v in d.items()) + ")"


def _spark_tokens(expr: str, sep_re: str) -> str:
    return f"filter(split({expr}, {_spark_str(sep_re)}), w -> w != '')"


def spark_sql_normalize_title(x: str) -> str:
    words = _spark_tokens(f"regexp_replace(lower({x}), {_spark_str(TITLE_DROP_RE)}, ' ')", WS_RUN_RE)
    expanded = f"array_join(transform({words}, w -> coalesce(try_element_at({_spark_map(TITLE_ABBREVIATIONS)}, w), w)), ' ')"
    out = f"array_join({_spark_tokens(f'replace({expanded}, {_spark_str(chr(45))}, {_spark_str(chr(32))})', ' ')}, ' ')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {out} END)"


def spark_sql_normalize_location(x: str) -> str:
    loc_map = _spark_map(LOCATION_NORMALIZATIONS)
    words = _spark_tokens(f"regexp_replace(lower({x}), {_spark_str(LOCATION_DROP_RE)}, ' ')", LOCATION_SPLIT_RE)
    mapped = (f"array_join(transform({words}, w -> coalesce(try_element_at({_spark_map(STATE_ABBREVIATIONS)}, w), "
              f"try_element_at({loc_map}, w), w)), ' ')")
    processed = f"coalesce(nullif({mapped}, ''), '{UNKNOWN_LOCATION}')"
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '{UNKNOWN_LOCATION}' "
            f"ELSE coalesce(try_element_at({loc_map}, lower({x})), {processed}) END)")


def spark_sql_token_sort(x: str) -> str:
    return f"array_join(array_sort({_spark_tokens(x, WS_RUN_RE)}), ' ')"


def normalization_details(title: Column, location: Column) -> Column:
    """Original and normalised title/location as one struct."""
    return F.struct(
        title.alias("original_title"),
        normalize_title(title).alias("normalized_title"),
        location.alias("original_location"),
        normalize_location(location).alias("normalized_location"),
    )
