"""URL filters: rules indexed by their rarest literal token.

A URL's tokens are the runs of ASCII letters and digits of its lower-cased text after ``://``. Each
rule has literal tokens that any URL it fits must hold as whole tokens. The tokens of the rules
are counted over all URLs and each rule is filed under its rarest one; a URL's tokens fetch
the candidate rules by a join, and only candidates run their regular expression. A rule without a
literal token is filed under the empty token, which every URL has.

Two kinds of rules: host rules (host and path prefix, for the host and its subdomains; the longest
that fits decides) and, where none fits, patterns in which ``*`` stands for any text and ``^``
for a separator or an end; a URL that a blocking pattern fits is blocked, others are allowed.

All work is done per distinct URL, so a URL that fills a third of the table is judged once. Rules
are a table like others: Spark broadcasts it if its size allows, else it is shuffled.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and is allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict).
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Patterns over the lower-cased URL after "://".
BLOCK_PATTERNS = ["^spam-farm^", "^cheap-pills^", "^adult-x^", "^casino^", "^xxx^", "^viagra^", "^free-download^*.exe^", "^login^*^redirect^", "^ads^*^banner^", "^free-bets^", "^ads-track^"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """The URL after the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host(after: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(after: Column) -> Column:
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(literal: str) -> list[str]:
    """Tokens of a rule's text that stand between separators on both sides (``^`` and other
    separators count; ``*`` and open ends may continue a token)."""
    return sorted(set(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", literal)))


def compile_rules(host_rules=HOST_RULES, block_patterns=BLOCK_PATTERNS) -> list[tuple]:
    """(rule, kind, regex, verdict, tokens)."""
    out = []
    for h, p, verdict in host_rules:
        # the host is anchored at a label's start and ended by the path's slash; the path's
        # last token may go on in the URL
        out.append((h + p, "host", r"^(?:[^/]*\.)?" + re.escape(h + p), verdict, tokens_of("^" + h.lower() + p.lower())))
    for pattern in block_patterns:
        body = "".join(".*" if x == "*" else "(?:^|[^a-z0-9]|$)" if x == "^" else re.escape(x) for x in pattern)
        out.append((pattern, "pattern", body, "block", tokens_of(pattern)))
    return out


def judge(pages: DataFrame, url_col: str = "url", host_rules=HOST_RULES, block_patterns=BLOCK_PATTERNS) -> DataFrame:
    """``pages`` with the columns (host, path, rule, verdict, pattern) in place of any of these
    names: ``rule`` is the host rule that decides, ``pattern`` the first blocking pattern if none
    does."""
    spark = pages.sparkSession
    rules = spark.createDataFrame(compile_rules(host_rules, block_patterns), "rule string, kind string, regex string, verdict string, tokens array<string>")
    parsed = pages.select(F.col(url_col).alias("url")).where("url LIKE '%://%'").distinct().withColumn("after", rest(F.col("url"))).select(
        "url", F.concat(host(F.col("after")), path(F.col("after"))).alias("place"), F.translate("after", _UPPER, _LOWER).alias("lower"))
    found = parsed.select("*", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct(
        F.regexp_extract_all("lower", F.lit("[a-z0-9]+"), F.lit(0))))).alias("token"))
    filed = rules.select("rule", F.explode_outer(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    seen = found.select("token").join(filed.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = filed.join(seen, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    candidates = found.join(index.join(rules.drop("tokens"), "rule"), "token")
    fits = candidates.where("regexp_like(CASE WHEN kind = 'host' THEN place ELSE lower END, regex)")
    decided = fits.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "host", F.struct(F.length("rule").alias("size"), "rule", "verdict"))).alias("best"),
        F.min(F.when(F.col("kind") == "pattern", F.col("rule"))).alias("first"))
    told = decided.select(
        F.col("url").alias("__url"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("first").isNotNull(), F.lit("block"))).alias("verdict"),
        F.when(F.col("best").isNull(), F.col("first")).alias("pattern"))
    other = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")]
    joined = pages.select(*other, F.col(url_col).alias("__key")).join(told, F.col("__key") == F.col("__url"), "left").withColumn("url", F.col("__key"))
    after = rest(F.col("url"))
    return joined.select(*[F.col("__key").alias(c) if c == url_col else F.col(c) for c in other], host(after).alias("host"), path(after).alias("path"),
                         "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "pattern")
