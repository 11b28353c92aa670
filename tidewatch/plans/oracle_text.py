"""DuckDB SQL of the normalisation and of the similarity, for the oracles only. It shares nothing
with the Spark expressions: the tables, character classes, weights and formulas are stated again."""

from __future__ import annotations

# Fixed values, as in the behaviour being matched.
TITLE_WORDS = {
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

PLACES = {
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

STATES = {
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

_SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NOT_TITLE = rf"[^\p{{L}}\p{{N}}_{_SPACE}-]"
_NOT_PLACE = rf"[^\p{{L}}\p{{N}}_{_SPACE},]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _look_up(expr: str, table: dict[str, str], otherwise: str) -> str:
    return f"(CASE {expr} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in table.items()) + f" ELSE {otherwise} END)"


def _words(expr: str, separators: str) -> str:
    return f"list_filter(string_split_regex({expr}, {_text(f'[{separators}]+')}), lambda w: w <> '')"


def title(expr: str) -> str:
    clean = f"regexp_replace(lower({expr}), {_text(_NOT_TITLE)}, ' ', 'g')"
    spelt = f"array_to_string(list_transform({_words(clean, _SPACE)}, lambda w: {_look_up('w', TITLE_WORDS, 'w')}), ' ')"
    return (f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN '' ELSE "
            f"array_to_string(list_filter(string_split(replace({spelt}, '-', ' '), ' '), lambda w: w <> ''), ' ') END)")


def place(expr: str) -> str:
    clean = f"regexp_replace(lower({expr}), {_text(_NOT_PLACE)}, ' ', 'g')"
    word = _look_up("w", STATES, _look_up("w", PLACES, "w"))
    joined = f"array_to_string(list_transform({_words(clean, _SPACE + ',')}, lambda w: {word}), ' ')"
    whole = _look_up(f"lower({expr})", PLACES, f"(CASE WHEN {joined} = '' THEN 'unknown' ELSE {joined} END)")
    return f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN 'unknown' ELSE {whole} END)"


def sorted_words(expr: str) -> str:
    return f"array_to_string(list_sort({_words(expr, _SPACE)}), ' ')"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, bits of a HUGEINT as the row of prefix lengths
    (strings of up to 126 characters; the fixtures' are shorter than 80)."""
    full = f"((1::HUGEINT << length({b})::HUGEINT) - 1)"
    places = (f"list_reduce(list_transform(range(1, length({b}) + 1), lambda k: CASE WHEN substr({b}, k::BIGINT, 1) = c "
              f"THEN (1::HUGEINT << (k - 1)::HUGEINT) ELSE 0::HUGEINT END), lambda x, y: x | y, 0::HUGEINT)")
    row = (f"list_reduce(list_transform(string_split({a}, ''), lambda c: {places}), "
           f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})")
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({b}) - bit_count({row}) END)"


def _ratio(a: str, b: str, common: str) -> str:
    size = f"(length({a}) + length({b}))"
    return f"(CASE WHEN {size} = 0 THEN 100.0 ELSE (1.0::DOUBLE - ({size} - 2 * {common})::DOUBLE / {size}::DOUBLE) * 100 END)"


def _weighted(titles: str, places: str) -> str:
    return f"((0.1::DOUBLE * 100.0::DOUBLE + 0.6::DOUBLE * {titles}) + 0.3::DOUBLE * {places}) / 100.0::DOUBLE"


def score(ta: str, tb: str, la: str, lb: str) -> str:
    """Similarity of two signatures of one company."""
    return _weighted(_ratio(ta, tb, lcs(ta, tb)), _ratio(la, lb, lcs(la, lb)))


def score_bound(ta: str, tb: str, la: str, lb: str) -> str:
    """What the lengths allow at most."""
    shorter = lambda a, b: f"least(length({a}), length({b}))"
    return _weighted(_ratio(ta, tb, shorter(ta, tb)), _ratio(la, lb, shorter(la, lb)))
