"""DuckDB SQL of the queries of this subpackage that SQL can express: plain statements of the
contracts over the tables, with none of the operators' indexes, hashes or automata."""

from __future__ import annotations

from tidewatch.llm import chat, mixing, quality, urlfilter

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _chat() -> str:
    a, b, c = (_text(x) for x in chat.TURN)
    return f"""
WITH said AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS l FROM said GROUP BY conv_id),
once AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM conv GROUP BY l),
kept AS (SELECT * FROM once a WHERE NOT EXISTS (
  SELECT 1 FROM conv b WHERE b.l[1] = a.l[1] AND len(b.l) > len(a.l) AND b.l[1:len(a.l)] = a.l))
SELECT conv_id, (n - 1) // {chat.PART} AS part, len(any_value(l)) AS n_turns, any_value(n_copies) AS n_copies,
  string_agg({a} || coalesce(role, '') || {b} || coalesce(text, '') || {c}, '' ORDER BY n) AS rendered
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS n FROM said) JOIN kept USING (conv_id) GROUP BY 1, 2"""


def _mix() -> str:
    ok = (f"(ln(list_sum(list_transform(ps, lambda p: pow(p, {{0}})))) - list_sum(list_transform(ps, lambda p: pow(p, {{0}}) * ln(pow(p, {{0}}))))"
          f" / list_sum(list_transform(ps, lambda p: pow(p, {{0}}))) <= {mixing.ENTROPY_RATIO} * ln(len(ps))"
          f" AND list_max(list_transform(ps, lambda p: pow(p, {{0}}) / p)) / list_sum(list_transform(ps, lambda p: pow(p, {{0}}))) <= {mixing.MAX_REPEAT})")
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(text, '{_WORD}')) AS BIGINT) AS n_tokens, md5(text) AS h FROM documents WHERE text IS NOT NULL),
doc AS (SELECT * FROM d WHERE n_tokens > 0),
src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM doc GROUP BY source),
tot AS (SELECT CAST(sum(tokens) AS BIGINT) AS total FROM src),
lists AS (SELECT list(tokens / total ORDER BY source) AS ps FROM src, tot),
bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, ps FROM lists
  UNION ALL
  SELECT i + 1, CASE WHEN {ok.format('((low + high) / 2)')} THEN low ELSE (low + high) / 2 END,
    CASE WHEN {ok.format('((low + high) / 2)')} THEN (low + high) / 2 ELSE high END, ps FROM bis WHERE i < 48),
expo AS (SELECT CASE WHEN {ok.format('0.0')} THEN 0.0 WHEN NOT {ok.format('1.0')} THEN 1.0 ELSE round(high, 10) END AS a FROM bis WHERE i = 48),
share AS (SELECT source, tokens, pow(tokens / total, a) AS q, total FROM src, tot, expo),
plan AS (SELECT source, tokens, CAST(round(q / (SELECT sum(q) FROM share) * total) AS BIGINT) AS source_budget, total FROM share),
plan2 AS (SELECT *, source_budget // tokens AS epochs, source_budget % tokens AS rest FROM plan),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, n_tokens, h) - 1 AS copy FROM doc),
dealt AS (SELECT numbered.*, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || n_tokens || '|' || h || '|' || copy), 1, 12) AS BIGINT)
  % greatest(1, CAST(ceil(total / {mixing.BLOCK_TOKENS}) AS BIGINT)) AS block FROM numbered, tot),
sums AS (SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS block_tokens FROM dealt GROUP BY 1, 2),
sched AS (SELECT s.*, e.epoch, p.tokens, p.epochs, p.rest, p.source_budget,
    CAST(coalesce(sum(block_tokens) OVER (PARTITION BY s.source, e.epoch
      ORDER BY md5(s.source || '|' || e.epoch || '|' || (s.block // {mixing.GROUP_BLOCKS})), s.block // {mixing.GROUP_BLOCKS},
        md5(s.source || '|' || e.epoch || '|' || s.block), s.block
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sums s JOIN plan2 p USING (source), LATERAL (SELECT unnest(range(0, p.epochs + 1)) AS epoch) e),
drawn AS (SELECT t.doc_id, t.source, t.n_tokens, s.epoch, t.block, s.epoch * s.tokens + s.before AS block_start, s.source_budget,
    CASE WHEN s.epoch = s.epochs AND before + block_tokens > rest THEN rest - before END AS cut
  FROM dealt t JOIN sched s ON s.source = t.source AND s.block = t.block WHERE s.epoch < s.epochs OR s.before < s.rest),
partly AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY md5(epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), n_tokens
  ROWS UNBOUNDED PRECEDING) AS upto FROM drawn WHERE cut IS NOT NULL)
SELECT doc_id, source, n_tokens, epoch, block, block_start, source_budget FROM drawn WHERE cut IS NULL
UNION ALL SELECT doc_id, source, n_tokens, epoch, block, block_start, source_budget FROM partly WHERE upto <= cut"""


_DECONTAMINATE = rf"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS k
  FROM it, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p) WHERE len(w) > 0),
doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS k
  FROM doc, (SELECT DISTINCT l FROM win), LATERAL (SELECT unnest(range(1, len(w) - l + 2)) AS p)),
hit AS (SELECT doc_id, p, l, item FROM dw JOIN win USING (l, k)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, LATERAL (SELECT unnest(range(p, p + l)) AS q) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _urls() -> str:
    rules = ", ".join(f"({_text(h)}, {_text(p)}, {_text(v)})" for h, p, v in urlfilter.HOST_RULES)
    patterns = ", ".join(f"({_text(rule)}, {_text(regex)})" for rule, kind, regex, _, _ in urlfilter.compile_rules() if kind == "pattern")
    return rf"""
WITH r(h, p, v) AS (VALUES {rules}), pat(rule, regex) AS (VALUES {patterns}),
after AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, rest, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM after),
best AS (SELECT page_id, max(struct_pack(n := length(h || p), rule := h || p, verdict := v)) AS b
  FROM u, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
blocked AS (SELECT page_id, min(rule) AS pattern FROM u, pat WHERE regexp_matches({_LOWER.format('rest')}, regex) GROUP BY page_id)
SELECT u.page_id, host, path, b.rule AS rule, coalesce(b.verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN b IS NULL THEN pattern END AS pattern
FROM u LEFT JOIN best USING (page_id) LEFT JOIN blocked USING (page_id)"""


_SUBSTRING = rf"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM doc, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS p)),
first AS (SELECT k, min(struct_pack(d := doc_id, p := p)) AS f FROM win GROUP BY k),
cov AS (SELECT DISTINCT doc_id, q FROM win JOIN first USING (k), LATERAL (SELECT unnest(range(p, p + 20)) AS q) WHERE f.d <> doc_id OR f.p <> p),
gone AS (SELECT doc_id, count(*) AS n_removed FROM cov GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM doc),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM word ANTI JOIN cov USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _quality() -> str:
    stops = ", ".join(_text(w) for w in quality.STOP_WORDS)
    measure = {"n_words": "n_words"} | {name: f"coalesce({a} / nullif({b}, 0), 0)" for name, (a, b) in quality._RATIOS.items()}
    broken = ", ".join(f"CASE WHEN NOT ({measure[m]} {op} {limit}) THEN {_text(name)} END" for name, m, op, limit in quality.RULES)
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
tri AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS k FROM doc, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS p)),
twice AS (SELECT doc_id, k FROM tri GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM tri JOIN twice USING (doc_id, k), LATERAL (SELECT unnest(range(p, p + 3)) AS q) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    len(list_filter(w, lambda x: {_LOWER.format('x')} IN ({stops}))) AS n_stop_words, coalesce(n, 0) AS n_repeat_words
  FROM doc LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([{broken}], lambda x: x IS NOT NULL) AS b FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(b) = 0 AS kept, array_to_string(b, ',') AS broken FROM j"""


#: crc32 of the decimal digits of {0}, unsigned: eight steps a byte.
_CRC32 = """(xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295))"""

_PREFIX_TRIE = rf"""
WITH said AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(coalesce(role, '') || chr(10) || coalesce(text, '')), 1, 15)) AS p,
    struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, list(s ORDER BY p) AS l, {_CRC32.format("conv_id")} % 4 AS h FROM said GROUP BY conv_id),
built AS (SELECT c.conv_id, coalesce(b.l[1:c.h], []) || coalesce(c.l[c.h + 1:], []) AS l FROM conv c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 20),
pre AS (SELECT conv_id, d, l[1:d] AS k, len(l) = d AS whole FROM built, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d)),
node AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (whole) AS n_ends,
    sha256(coalesce(string_agg(CASE WHEN whole THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM pre GROUP BY k, d),
kid AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT node.k, node.depth, coalesce(n, 0) AS n_children, CASE WHEN node.depth = 0 THEN 0
    ELSE (n_convs - 1) * len(regexp_extract_all(node.k[node.depth].t, '{_WORD}')) END AS saved FROM node LEFT JOIN kid ON kid.k = node.k AND kid.depth = node.depth),
sub AS (SELECT u.k, u.depth, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM own u JOIN own v ON v.depth >= u.depth AND v.k[1:u.depth] = u.k GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, own.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256, n.n_ends
FROM node n JOIN own ON own.k = n.k AND own.depth = n.depth JOIN sub ON sub.k = n.k AND sub.depth = n.depth
LEFT JOIN node p ON p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1]"""


_DIVERGENCE = rf"""
WITH doc AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT i, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term FROM word GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
cnt AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
tot AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (CAST(coalesce(t.n, 0) AS HUGEINT) + v) AS p
  FROM grp g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (CAST(any_value(a) AS HUGEINT) + any_value(v)) AS q
  FROM cnt JOIN (SELECT lang, sum(n) AS a FROM tot GROUP BY lang) USING (lang) JOIN sizes USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 4),
told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM told) WHERE part = 'pair' OR rank <= 200"""


ORACLES: dict[str, str] = {
    "op1_chat_format": _chat(),
    "op2_temperature_mix": _mix(),
    "op3_decontaminate": _DECONTAMINATE,
    "op5_url_filter": _urls(),
    "op9_substring_dedup": _SUBSTRING,
    "op10_quality_rules": _quality(),
    "op11_prefix_trie": _PREFIX_TRIE,
    "op13_source_divergence": _DIVERGENCE,
}
