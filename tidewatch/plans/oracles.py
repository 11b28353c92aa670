"""DuckDB oracle SQL for the registered queries (same derivations, written independently as
SQL over the driver's pre-registered views). Normalisation and similarity are stated again in
``oracle_text``, with tables and weights of their own."""

from __future__ import annotations

from tidewatch.plans import oracle_text as T_

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
AS_OF = "DATE '1996-01-01'"
T = "0.9"

ORACLES: dict[str, str] = {}


def _postings(loc: str = "r.r_name", name: str = "postings") -> str:
    return f"""{name} AS (
  SELECT p.p_partkey::BIGINT AS batch_seq, lower(replace(p.p_brand, '#', '-')) AS company_id, p.p_brand AS company_name,
         concat_ws(' ', p.p_name, p.p_type) AS title, {loc} AS location,
         'https://jobs.example.com/' || lower(replace(p.p_brand, '#', '-')) || '/' || p.p_partkey AS url,
         CAST(p.p_partkey AS VARCHAR) AS source_identifier, n.n_name AS department
  FROM part p JOIN nation n ON n.n_nationkey = (p.p_size % 25) JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def _sig(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, {T_.sorted_words('title_norm')} AS title_sorted, company_id || '|' || title_norm || '|' || location_norm AS signature
  FROM (SELECT *, {T_.title('title')} AS title_norm, {T_.place('location')} AS location_norm FROM {src}))"""


E0 = f"""e0_raw AS (
  SELECT 'e-' || batch_seq AS id, batch_seq AS entity_seq, company_id, company_name, title, location, url,
         CASE batch_seq % 7 WHEN 0 THEN 'closed' WHEN 1 THEN 'missing' WHEN 2 THEN 'reopened' ELSE 'active' END AS status,
         {NOW} - to_days((batch_seq % 30 + 60)::INTEGER) AS first_seen,
         {NOW} - to_days((batch_seq % 60)::INTEGER) AS last_seen,
         {NOW} - to_days((batch_seq % 60)::INTEGER) AS updated_at,
         'new' AS classification, source_identifier, department
  FROM postings WHERE batch_seq % 3 = 0),
{_sig('e0_raw', 'e0')}"""

B1 = f"""b1_raw AS (
  SELECT batch_seq, company_id, company_name, title, location, url,
         CASE WHEN batch_seq % 11 = 0 THEN NULL ELSE source_identifier END AS source_identifier, department
  FROM postings WHERE batch_seq % 3 <> 0 OR batch_seq % 2 = 0),
{_sig('b1_raw', 'b1')}"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- normalisation / similarity ---------------------------------------------------------------

oracle("n1_normalize_title", _with(_postings()) + f"SELECT batch_seq, title, {T_.title('title')} AS title_norm FROM postings")
oracle("n1_normalize_document_text", f"SELECT doc_id, {T_.title('text')} AS text_norm FROM documents")
oracle("n2_normalize_location", _with(_postings('n.n_name')) +
       f"SELECT batch_seq, location, {T_.place('location')} AS location_norm FROM postings")
oracle("n3_create_signature", _with(_postings(), _sig('postings', 'ps')) + "SELECT batch_seq, signature FROM ps")
oracle("n4_normalization_details", _with(_postings('n.n_name')) +
       f"SELECT batch_seq, title AS original_title, {T_.title('title')} AS normalized_title, "
       f"location AS original_location, {T_.place('location')} AS normalized_location FROM postings")
oracle("m2_token_sort", _with(_postings(), _sig('postings', 'ps')) + "SELECT batch_seq, title_sorted FROM ps")

PAIRS = _with(_postings(), _postings('n.n_name', 'postings_n'), _sig('postings', 'pa'), _sig('postings_n', 'pb'),
              f"""pairs AS (SELECT a.batch_seq, a.signature, b.signature AS b_signature,
  {T_.score('a.title_sorted', 'b.title_sorted', 'a.location_norm', 'b.location_norm')} AS score
  FROM pa a JOIN pb b USING (batch_seq))""")
oracle("m4_similarity", PAIRS + "SELECT batch_seq, score FROM pairs")
oracle("j6_is_match", PAIRS + f"SELECT batch_seq, score >= {T} AS is_match FROM pairs")
oracle("m5_match_explanation", PAIRS + f"""SELECT batch_seq, round(score, 3) AS similarity, score >= {T} AS is_match,
  'Similarity (' || format('{{:.2f}}', score) || ') ' || CASE WHEN score >= {T} THEN '>=    ' ELSE '<     ' END || ' threshold (0.9)' AS reason
  FROM pairs""")

# --- linkage ------------------------------------------------------------------------------------

LINK = _with(_postings(), E0, B1)

oracle("j1_match_by_source_id", LINK + """, idx AS (
  SELECT company_id, source_identifier, arg_min(id, entity_seq) AS matched_id FROM e0
  WHERE source_identifier IS NOT NULL AND source_identifier <> '' GROUP BY ALL)
SELECT b.batch_seq, idx.matched_id FROM b1 b LEFT JOIN idx USING (company_id, source_identifier)""")


def _best_sql(cand_filter: str) -> str:
    bound = T_.score_bound('b.title_sorted', 'c.title_sorted', 'b.location_norm', 'c.location_norm')
    score = T_.score('b.title_sorted', 'c.title_sorted', 'b.location_norm', 'c.location_norm')
    return LINK + f""", cand AS (SELECT * FROM e0 WHERE {cand_filter}),
scored AS (
  SELECT b.batch_seq, c.id, c.entity_seq, {score} AS score
  FROM b1 b JOIN cand c ON b.company_id = c.company_id
  WHERE {bound} >= {T}),
best AS (
  SELECT batch_seq, id AS match_key, score AS match_score FROM scored WHERE score >= {T} AND score > 0
  QUALIFY row_number() OVER (PARTITION BY batch_seq ORDER BY score DESC, entity_seq) = 1)
SELECT b.batch_seq, best.match_key, best.match_score FROM b1 b LEFT JOIN best USING (batch_seq)"""


oracle("j2_best_similar_recent", _best_sql(f"status <> 'closed' AND last_seen >= {NOW} - INTERVAL 30 DAY"))
oracle("j3_best_similar_closed", _best_sql("status = 'closed'"))
oracle("j4_find_best_match", _best_sql("TRUE"))
oracle("j4_best_score_below_threshold", _best_sql("TRUE").split("best AS (")[0].replace(f">= {T}", ">= 0") + f"""best AS (
  SELECT batch_seq, id, score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY batch_seq ORDER BY score DESC, entity_seq) = 1)
SELECT b.batch_seq, CASE WHEN score >= {T} THEN best.id END AS match_key, coalesce(score, 0) AS best_score FROM b1 b LEFT JOIN best USING (batch_seq)""")
oracle("j5_find_all_matches", _best_sql("TRUE").split("best AS (")[0] + f"""ranked AS (
  SELECT batch_seq, id AS match_key, score AS match_score,
         row_number() OVER (PARTITION BY batch_seq ORDER BY score DESC, entity_seq) AS match_rank
  FROM scored WHERE score >= {T} AND score > 0)
SELECT batch_seq, match_key, match_score, match_rank FROM ranked WHERE match_rank <= 3""")

OBSERVED = LINK + """, observed AS (
  SELECT DISTINCT e.id FROM b1 b JOIN e0 e ON b.company_id = e.company_id AND b.source_identifier = e.source_identifier
  WHERE b.source_identifier IS NOT NULL AND b.source_identifier <> ''),
marked AS (
  SELECT e.* REPLACE (CASE WHEN e.status = 'active' AND o.id IS NULL THEN 'missing' ELSE e.status END AS status,
                      CASE WHEN e.status = 'active' AND o.id IS NULL THEN """ + NOW + """ ELSE e.updated_at END AS updated_at)
  FROM e0 e LEFT JOIN observed o USING (id)),
closed AS (
  SELECT * REPLACE (CASE WHEN status = 'missing' AND last_seen < """ + NOW + """ - INTERVAL 14 DAY THEN 'closed' ELSE status END AS status,
                    CASE WHEN status = 'missing' AND last_seen < """ + NOW + """ - INTERVAL 14 DAY THEN """ + NOW + """ ELSE updated_at END AS updated_at)
  FROM marked)
"""
oracle("j7_mark_missing", OBSERVED + "SELECT id, status, updated_at FROM marked")
oracle("c5_close_old_missing", LINK + f"""SELECT id,
  CASE WHEN status = 'missing' AND last_seen < {NOW} - INTERVAL 14 DAY THEN 'closed' ELSE status END AS status,
  CASE WHEN status = 'missing' AND last_seen < {NOW} - INTERVAL 14 DAY THEN {NOW} ELSE updated_at END AS updated_at FROM e0""")

# --- views ----------------------------------------------------------------------------------------

CJ = f"""cj AS (
  SELECT 'c-' || c.c_custkey AS id, c.c_custkey::BIGINT AS entity_seq, lower(c.c_mktsegment) AS company_id,
         c.c_mktsegment AS company_name, c.c_name AS title, n.n_name AS location,
         'https://jobs.example.com/c/' || c.c_custkey AS url,
         CASE c.c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'repost' ELSE 'existing' END AS classification,
         CASE c.c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'missing' WHEN 2 THEN 'closed' ELSE 'reopened' END AS status,
         {NOW} - to_days((c.c_custkey % 45)::INTEGER) - to_hours((c.c_custkey % 24)::INTEGER) AS last_seen,
         {NOW} - to_days((c.c_custkey % 45)::INTEGER) - to_hours((c.c_custkey % 24)::INTEGER) - to_days((c.c_custkey % 17)::INTEGER) AS first_seen,
         CAST(c.c_custkey AS VARCHAR) AS source_identifier,
         CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE c.c_mktsegment END AS department,
         repeat(c.c_name || ' ', (c.c_custkey % 40)::INTEGER) AS description
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
CJS = _with(CJ, _sig('cj', 'cjs'))
APPS = f"""apps AS (
  SELECT 'app-' || o_orderkey AS id, 'c-' || o_custkey AS job_id, CAST(o_orderdate AS DATE) AS applied_date,
         CASE o_orderstatus WHEN 'O' THEN 'applied' WHEN 'P' THEN 'interview' ELSE 'rejected' END AS stage,
         o_orderpriority AS notes,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(o_orderdate AS DATE) + 7
              WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) + 14 END AS next_follow_up,
         o_orderdate AS created_at
  FROM orders)"""
FUPS = """fups AS (
  SELECT 'app-' || conv_id AS application_id, turn AS seq, TIMESTAMP '2024-01-01 00:00:00' + to_hours(turn::INTEGER) AS "timestamp",
         CASE WHEN role = 'user' THEN 'application' ELSE 'follow-up' END AS type, text AS notes
  FROM conversations)"""

VIEW = "id, company_id, title, location, status, classification"
oracle("f1_filter_company", _with(CJ) + f"SELECT {VIEW} FROM cj WHERE company_id = 'building'")
oracle("f2_filter_status", _with(CJ) + f"SELECT {VIEW} FROM cj WHERE status = 'reopened'")
oracle("f3_search", _with(CJ) + f"""SELECT {VIEW} FROM cj WHERE company_id = 'machinery' AND status = 'active'
  AND (contains(lower(title), 'tion_1') OR contains(lower(company_name), 'tion_1') OR contains(lower(location), 'tion_1'))""")
oracle("f4_filter_classification_dates", _with(CJ) + f"""SELECT {VIEW}, first_seen, last_seen FROM cj
  WHERE classification = 'repost' AND first_seen >= TIMESTAMP '2023-12-20 00:00:00' AND last_seen <= TIMESTAMP '2024-01-25 00:00:00'""")

URL_PARTS = r"""u AS (
  SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
         regexp_extract(CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) <> ''
                             THEN substr(url, length(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) + 2) ELSE url END,
                        '^//([^/?#]*)', 1) AS host
  FROM src)"""
oracle("f5_validate_url", "WITH src AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES (''), (NULL), ('example.com'), ('ftp://x'), ('http://')) t(url)),\n"
       + URL_PARTS + """
SELECT url, err IS NULL AS is_valid, err AS error FROM (
  SELECT url, CASE WHEN url IS NULL OR url = '' THEN 'URL must be a non-empty string'
                   WHEN scheme = '' THEN 'URL must include a scheme (http:// or https://)'
                   WHEN host = '' THEN 'URL must include a domain'
                   WHEN scheme NOT IN ('http', 'https') THEN 'URL scheme must be http or https' END AS err
  FROM u)""")
oracle("u1_url_host", "WITH src AS (SELECT page_id, url FROM pages),\n" + URL_PARTS.replace("SELECT url,", "SELECT page_id, url,")
       + "\nSELECT page_id, host FROM u")

oracle("f6_validate_record", _with(CJ, _sig('cj', 'cjs')) + """, r AS (
  SELECT id, CASE WHEN entity_seq % 37 = 0 THEN NULL ELSE title END AS title,
         CASE WHEN entity_seq % 29 = 0 THEN 'unknown' ELSE status END AS status,
         CASE WHEN entity_seq % 31 = 0 THEN NULL ELSE first_seen END AS created_at, classification
  FROM cjs),
v AS (
  SELECT id, list_filter([CASE WHEN title IS NULL THEN '''title'' is a required property' END,
                          CASE WHEN status NOT IN ('active', 'missing', 'closed', 'reopened') THEN 'status is not one of the allowed values' END,
                          CASE WHEN created_at IS NULL THEN 'created_at is not of type ''string''' END], lambda x: x IS NOT NULL) AS vs
  FROM r)
SELECT id, len(vs) AS violation_count, array_to_string(vs, '; ') AS violations FROM v""")

oracle("f7_validate_company_id", """WITH ids AS (
  SELECT DISTINCT lower(c_mktsegment) || '-' || lower(n_name) AS company_id FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT company_id, err IS NULL AS is_valid, err AS error FROM (
  SELECT company_id, CASE WHEN company_id IS NULL OR company_id = '' THEN 'Company ID must be a non-empty string'
    WHEN NOT regexp_full_match(company_id, '[a-z0-9-]+') THEN 'Company ID must be lowercase alphanumeric with hyphens only'
    WHEN starts_with(company_id, '-') OR ends_with(company_id, '-') THEN 'Company ID cannot start or end with a hyphen'
    WHEN contains(company_id, '--') THEN 'Company ID cannot contain consecutive hyphens' END AS err
  FROM ids)""")
oracle("f9_needs_follow_up", _with(APPS) + f"SELECT id, job_id, next_follow_up FROM apps WHERE next_follow_up IS NOT NULL AND next_follow_up <= {AS_OF}")
oracle("f10_active_unapplied", _with(CJ, APPS) + "SELECT id, status FROM cj WHERE status <> 'closed' AND id NOT IN (SELECT job_id FROM apps WHERE stage = 'interview')")
oracle("f11_lookup_by_id", _with(CJ) + f"SELECT {VIEW} FROM cj WHERE id = 'c-42' ORDER BY entity_seq LIMIT 1")

oracle("p1_job_detail", _with(CJ, APPS) + """, obs AS (
  SELECT 'c-' || o_custkey AS entity_id, o_orderdate AS ts FROM orders),
stats AS (
  SELECT entity_id, count(*) AS observation_count,
         string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY ts DESC) FILTER (WHERE rn <= 3) AS recent
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) AS rn FROM obs) GROUP BY entity_id)
SELECT cj.id, coalesce(stats.observation_count, 0) AS observation_count, coalesce(stats.recent, '') AS recent_observations,
       CASE WHEN length(description) > 500 THEN substr(description, 1, 500) || '...' ELSE description END AS description_short,
       cj.id IN (SELECT job_id FROM apps) AS has_application
FROM cj LEFT JOIN stats ON stats.entity_id = cj.id""")
oracle("o1_sort_last_seen", _with(CJ) + "SELECT id, last_seen, entity_seq FROM cj ORDER BY last_seen DESC, entity_seq")
oracle("o2_sort_company_title", _with(CJ) + "SELECT id, company_name, entity_seq FROM cj ORDER BY company_name, entity_seq")
oracle("a4_distinct_companies", _with(CJ) + """SELECT company_id, arg_max(company_name, entity_seq) AS company_name,
  min(entity_seq) AS first_position FROM cj GROUP BY company_id""")
oracle("j8_application_cards", _with(CJ, APPS) + f"""SELECT a.id, a.job_id, cj.title, cj.company_name, a.stage,
  (a.next_follow_up IS NOT NULL AND a.next_follow_up <= {AS_OF}) AS needs_follow_up
  FROM apps a JOIN cj ON cj.id = a.job_id""")
oracle("j9_has_application", _with(CJ, APPS) + "SELECT id, id IN (SELECT job_id FROM apps) AS has_application FROM cj")

DIFF_COLS = ["company_id", "company_name", "title", "location", "url", "status", "classification", "first_seen",
             "last_seen", "source_identifier"]
_changed = ", ".join(f"CASE WHEN b.{c} IS DISTINCT FROM a.{c} THEN '{c}' END" for c in DIFF_COLS)
oracle("j10_snapshot_diff", OBSERVED + f""", remaining AS (
  SELECT * FROM closed WHERE NOT (status = 'closed' AND last_seen < {NOW} - INTERVAL 40 DAY)),
after AS (
  SELECT id, {', '.join(DIFF_COLS)} FROM remaining
  UNION ALL
  SELECT 'e-' || batch_seq, company_id, company_name, title, location, url, 'active', 'new', {NOW}, {NOW}, source_identifier
  FROM b1 WHERE batch_seq NOT IN (SELECT entity_seq FROM e0)),
j AS (
  SELECT coalesce(b.id, a.id) AS id, b.id IS NOT NULL AS in_b, a.id IS NOT NULL AS in_a,
         list_filter([{_changed}], lambda x: x IS NOT NULL) AS ch
  FROM (SELECT id, {', '.join(DIFF_COLS)} FROM e0) b FULL OUTER JOIN after a ON a.id = b.id)
SELECT id, CASE WHEN NOT in_b THEN 'added' WHEN NOT in_a THEN 'removed' WHEN len(ch) > 0 THEN 'changed' ELSE 'unchanged' END AS change,
       CASE WHEN in_a AND in_b THEN array_to_string(ch, ',') ELSE '' END AS changed_columns
FROM j""")

# --- observation log / metrics -------------------------------------------------------------------

LOG = """log AS (SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS entity_id, ts, event_id FROM events)"""
oracle("a5_observation_stats", _with(LOG) + """SELECT entity_id, min(ts) AS first_seen, max(ts) AS last_seen,
  count(*) AS observation_count FROM log GROUP BY entity_id""")
oracle("a5_stats_folded_by_run", _with(LOG) + """SELECT entity_id, min(ts) AS first_seen, max(ts) AS last_seen,
  count(*) AS observation_count FROM log GROUP BY entity_id""")
oracle("w2_gap_since_previous", _with(LOG) + """SELECT entity_id, event_id,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity_id ORDER BY ts, event_id)) / 1000000.0 AS gap_seconds FROM log""")
oracle("r4_presence_sessions", _with(LOG) + """, g AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 3 DAY THEN 1 ELSE 0 END)
              OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS sid
  FROM (SELECT *, lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS prev FROM log))
SELECT entity_id, min(ts) AS session_start, max(ts) + INTERVAL 3 DAY AS session_end, count(*) AS observations
FROM g GROUP BY entity_id, sid""")
oracle("r3_run_window_counts", """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start,
  time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS observations
FROM events GROUP BY ALL""")
# what the watermark (the latest sighting less a day) has passed
oracle("r3_run_window_counts_stream", f"""SELECT * FROM ({ORACLES["r3_run_window_counts"]})
WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)""")
oracle("r2_entity_lifecycle_stream", """
WITH log AS (SELECT event_type || ':' || user_id AS entity_id, ts FROM events),
wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS wm FROM log),
g AS (SELECT *, lag(ts) OVER w AS prev, lead(ts) OVER w AS next, row_number() OVER w AS rn FROM log
      WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
seen AS (SELECT entity_id, ts, count(*) OVER (PARTITION BY entity_id ORDER BY ts) AS sightings, prev, next, rn FROM g),
ev AS (
  SELECT entity_id, CASE WHEN rn > 1 AND ts > prev + INTERVAL 7 DAY THEN 'reopened' ELSE 'active' END AS status, ts AS due, sightings
  FROM seen WHERE rn = 1 OR ts > prev + INTERVAL 3 DAY
  UNION ALL
  SELECT entity_id, 'missing', ts + INTERVAL 3 DAY, sightings FROM seen WHERE next IS NULL OR next > ts + INTERVAL 3 DAY
  UNION ALL
  SELECT entity_id, 'closed', ts + INTERVAL 7 DAY, sightings FROM seen WHERE next IS NULL OR next > ts + INTERVAL 7 DAY)
SELECT entity_id, status, due AS "at", sightings FROM ev, wm WHERE due < wm""")
oracle("a6_evaluate_labels", """SELECT *,
  CASE WHEN expected_positive > 0 THEN true_positives / expected_positive ELSE 0.0 END AS detection_rate,
  CASE WHEN expected_negative > 0 THEN false_positives / expected_negative ELSE 0.0 END AS false_positive_rate,
  CASE WHEN expected_negative > 0 THEN true_negatives / expected_negative ELSE 0.0 END AS new_accuracy
FROM (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS true_positives,
             count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS false_positives,
             count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS missed,
             count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS true_negatives,
             count(*) FILTER (WHERE quality = 1) AS expected_positive,
             count(*) FILTER (WHERE quality = 0) AS expected_negative FROM labels)""")
oracle("a7_classification_stability", _with(LOG) + """SELECT CAST(first_ts AS DATE) AS run_date, count(*) AS new_entities
FROM (SELECT entity_id, min(ts) AS first_ts FROM log GROUP BY entity_id) GROUP BY ALL""")
oracle("a8_volume_alert", _with(_postings()) + "SELECT company_id, count(*) AS job_count, count(*) < 10 AS alert FROM postings GROUP BY company_id")

# --- applications ----------------------------------------------------------------------------------

oracle("t1_add_application", """SELECT 'app-' || o_orderkey AS id, 'c-' || o_custkey AS job_id,
  coalesce(CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END, DATE '1998-08-02') AS applied_date,
  CASE WHEN o_orderstatus = 'P' THEN 'interview' ELSE 'applied' END AS stage,
  coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, '') AS notes,
  NULL::VARCHAR AS contact_person FROM orders""")
oracle("t2_update_application", _with(APPS) + """, upd AS (
  SELECT 'app-' || l_orderkey AS id,
         arg_max(CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'screening' END, (l_linenumber, l_shipdate, l_partkey, l_suppkey))
           FILTER (WHERE l_returnflag IN ('R', 'A')) AS u_stage,
         arg_max('line ' || l_linenumber, (l_linenumber, l_shipdate, l_partkey, l_suppkey)) FILTER (WHERE l_linestatus = 'F') AS u_notes,
         max(l_shipdate) AS u_ts
  FROM lineitem GROUP BY 1)
SELECT a.id, coalesce(u_stage, a.stage) AS stage, coalesce(u_notes, a.notes) AS notes, u_ts AS updated_at
FROM apps a LEFT JOIN upd USING (id)""")
oracle("t3_add_follow_up", _with(APPS, FUPS) + """SELECT application_id, seq, "timestamp", type, notes FROM fups
  WHERE application_id IN (SELECT id FROM apps)""")
oracle("t4_delete_application", _with(APPS) + """SELECT id, job_id FROM apps
  WHERE id NOT IN (SELECT 'app-' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
oracle("t5_application_by_job", _with(APPS) + """SELECT job_id, arg_min(id, (created_at, id)) AS application_id, count(*) AS applications
  FROM apps GROUP BY job_id""")
oracle("t6_next_reminder", _with(APPS, FUPS) + """, last AS (SELECT application_id AS id, max("timestamp") AS last_follow_up FROM fups GROUP BY 1)
SELECT a.id, last.last_follow_up, greatest(CAST(last.last_follow_up AS DATE), a.applied_date) + 7 AS next_due
FROM apps a LEFT JOIN last USING (id)""")

# --- sources / storage --------------------------------------------------------------------------------

ROUND_TRIP = "company_id, title, location, url, source_identifier"
oracle("s1_flatten_board_object", _with(_postings()) + f"SELECT {ROUND_TRIP}, department FROM postings")
oracle("s2_flatten_board_array", _with(_postings()) + f"SELECT {ROUND_TRIP}, department FROM postings")
oracle("s3_flatten_board_postings", _with(_postings()) + f"SELECT {ROUND_TRIP}, NULL::VARCHAR AS department FROM postings")
oracle("s5_union_sources", _with(_postings()) + f"""SELECT {ROUND_TRIP},
  CASE WHEN CAST(right(company_id, 1) AS INTEGER) % 3 = 2 THEN NULL ELSE department END AS department FROM postings""")
oracle("s5_registered_shape", _with(_postings()) + """, f AS (SELECT *, CAST(right(company_id, 1) AS INTEGER) % 3 <> 0 AS feed FROM postings)
SELECT company_id, title, location, url, CASE WHEN feed AND batch_seq % 10 = 0 THEN NULL ELSE source_identifier END AS source_identifier,
  CASE WHEN feed AND batch_seq % 10 = 0 THEN 'missing ref' END AS problem FROM f""")
oracle("s4_source_to_endpoint", """WITH c AS (
  SELECT lower(replace(s_name, '#', '-')) AS id,
         CASE s_suppkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'workday' END AS adapter FROM supplier)
SELECT id, adapter, CASE adapter
  WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || id || '/jobs'
  WHEN 'lever' THEN 'https://jobs.lever.co/' || id || '?mode=json'
  ELSE 'https://' || id || '.wd1.myworkdayjobs.com/wday/cxs/' || id || '/External/jobs' END AS endpoint FROM c""")
oracle("s8_export_csv_rows", CJS + """SELECT id, company_id, company_name, title, location, coalesce(department, '') AS department, url,
  classification, status, strftime(first_seen, '%Y-%m-%dT%H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%S') AS last_seen,
  signature FROM cjs""")
oracle("s9_export_view_rows", _with(CJ) + """SELECT company_name AS "Company", title AS "Title", location AS "Location", status AS "Status",
  classification AS "Classification", strftime(first_seen, '%Y-%m-%d') AS "First Seen", strftime(last_seen, '%Y-%m-%d') AS "Last Seen",
  url AS "URL" FROM cj WHERE status = 'active'""")
SNAP = _with(LOG) + ", snaps AS (SELECT strftime(ts, '%Y%m%d') AS snapshot_ts FROM log)\n"
oracle("s13_list_snapshots", SNAP + "SELECT snapshot_ts, count(*) AS job_count FROM snaps GROUP BY 1")
oracle("s14_rotate_snapshots", SNAP + """SELECT snapshot_ts FROM (SELECT DISTINCT snapshot_ts FROM snaps)
  QUALIFY row_number() OVER (ORDER BY snapshot_ts DESC) > 10""")
oracle("s17_archive_old", CJS + f"""SELECT id, company_id, signature, last_seen, strftime(last_seen, '%Y-%m') AS archive_month
  FROM cjs WHERE status = 'closed' AND last_seen < {NOW} - INTERVAL 30 DAY""")
oracle("s17_archive_twice", ORACLES["s17_archive_old"])
oracle("s19_load_companies", """SELECT lower(replace(s_name, '#', '-')) AS id,
  CASE s_suppkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'workday' END AS adapter, NULL::VARCHAR AS problem,
  regexp_full_match(lower(replace(s_name, '#', '-')), '[a-z0-9-]+') AND NOT contains(lower(replace(s_name, '#', '-')), '--')
    AND NOT starts_with(lower(replace(s_name, '#', '-')), '-') AND NOT ends_with(lower(replace(s_name, '#', '-')), '-') AS id_format_valid
  FROM supplier""")

oracle("o3_sort_oldest_first", _with(CJ) + "SELECT id, first_seen, entity_seq FROM cj ORDER BY first_seen, entity_seq")
oracle("o3_sort_applications_by_date", _with(APPS) + "SELECT id, applied_date, stage FROM apps WHERE stage = 'interview' ORDER BY applied_date, id")
oracle("f12_validate_collection", _with(CJ, _sig('cj', 'cjs')) + """, r AS (
  SELECT company_id AS collection_id, CASE WHEN entity_seq % 37 = 0 THEN NULL ELSE title END AS title,
         CASE WHEN entity_seq % 29 = 0 THEN 'unknown' ELSE status END AS status,
         CASE WHEN entity_seq % 31 = 0 THEN NULL ELSE first_seen END AS created_at
  FROM cjs),
per AS (
  SELECT collection_id, bool_and(title IS NOT NULL AND status IN ('active', 'missing', 'closed', 'reopened') AND created_at IS NOT NULL) AS ok,
         count(*) AS job_count FROM r GROUP BY collection_id)
SELECT collection_id, (CASE WHEN collection_id = 'household' THEN '0.9.0' ELSE '1.0.0' END) = '1.0.0' AND ok AS is_valid, job_count FROM per""")


# --- classification cycle -----------------------------------------------------------------------
# A plain walk in batch order: one recursion step per posting of a company (companies run side by
# side), over a list of all its known records.

_BOUND = T_.score_bound("a.title_sorted", "b.title_sorted", "a.location_norm", "b.location_norm")
_PAIR = T_.score("a.title_sorted", "b.title_sorted", "a.location_norm", "b.location_norm")


def _pick(test: str) -> str:
    """The record with the highest score among those that pass, ties to the earliest, as a list of
    none or one."""
    return f"""list_sort(list_transform(list_filter(state, lambda x: {test} AND list_contains(near_sigs, x.sig)),
    lambda x: struct_pack(worse := -near_scores[list_position(near_sigs, x.sig)], ord := x.ord, ref := x.ref)))[1:1]"""


WALK = "WITH RECURSIVE " + ",\n".join([_postings(), E0, B1]) + f""",
sig AS (SELECT DISTINCT company_id, signature, title_sorted, location_norm FROM (
  SELECT company_id, signature, title_sorted, location_norm FROM e0 UNION ALL SELECT company_id, signature, title_sorted, location_norm FROM b1)),
pair AS MATERIALIZED (SELECT a.company_id, a.signature AS a, b.signature AS b, {_PAIR} AS score
  FROM sig a JOIN sig b ON a.company_id = b.company_id WHERE {_BOUND} >= {T}),
near AS MATERIALIZED (SELECT company_id, a, list(b ORDER BY b) AS near_sigs, list(score ORDER BY b) AS near_scores FROM pair WHERE score >= {T} GROUP BY ALL),
todo AS MATERIALIZED (SELECT b.company_id, b.batch_seq, b.signature, nullif(b.source_identifier, '') AS sid, b.source_identifier, near_sigs, near_scores,
    row_number() OVER (PARTITION BY b.company_id ORDER BY b.batch_seq) AS n
  FROM b1 b LEFT JOIN near ON near.company_id = b.company_id AND near.a = b.signature),
start AS (SELECT company_id, list(struct_pack(ref := 'K:' || id, ord := entity_seq::BIGINT, sig := signature, status := status,
    last_seen := last_seen::TIMESTAMP, sid := source_identifier, cls := classification, updated_at := updated_at::TIMESTAMP) ORDER BY entity_seq) AS state
  FROM e0 GROUP BY company_id),
walk AS (
  SELECT c.company_id, 0::BIGINT AS n, coalesce(state, []) AS state, NULL::BIGINT AS batch_seq, NULL::VARCHAR AS decision,
    NULL::VARCHAR AS entity_ref, NULL::VARCHAR AS target_ref, NULL::DOUBLE AS score
  FROM (SELECT company_id FROM e0 UNION SELECT company_id FROM b1) c LEFT JOIN start USING (company_id)
  UNION ALL
  SELECT company_id, n,
    CASE decision
      WHEN 'existing' THEN list_transform(state, lambda x: CASE WHEN x.ref = entity_ref THEN struct_pack(ref := x.ref, ord := x.ord, sig := x.sig,
        status := CASE x.status WHEN 'missing' THEN 'active' ELSE x.status END, last_seen := {NOW}, sid := x.sid, cls := x.cls, updated_at := {NOW}) ELSE x END)
      WHEN 'reopened' THEN list_transform(state, lambda x: CASE WHEN x.ref = entity_ref THEN struct_pack(ref := x.ref, ord := x.ord, sig := x.sig,
        status := 'reopened', last_seen := {NOW}, sid := sid, cls := x.cls, updated_at := {NOW}) ELSE x END)
      ELSE list_append(state, struct_pack(ref := 'B:' || batch_seq, ord := 1000000000000 + batch_seq, sig := signature, status := 'active',
        last_seen := {NOW}, sid := source_identifier, cls := decision, updated_at := {NOW})) END,
    batch_seq, decision, entity_ref, target_ref, score
  FROM (SELECT *, CASE WHEN len(hit) > 0 THEN 'existing' WHEN len(recent) > 0 THEN 'repost' WHEN len(closed) > 0 THEN 'reopened' ELSE 'new' END AS decision,
      CASE WHEN len(hit) > 0 THEN hit[1].ref WHEN len(recent) = 0 AND len(closed) > 0 THEN closed[1].ref ELSE 'B:' || batch_seq END AS entity_ref,
      CASE WHEN len(hit) > 0 THEN NULL WHEN len(recent) > 0 THEN recent[1].ref WHEN len(closed) > 0 THEN closed[1].ref END AS target_ref,
      CASE WHEN len(hit) > 0 THEN NULL WHEN len(recent) > 0 THEN -recent[1].worse WHEN len(closed) > 0 THEN -closed[1].worse END AS score
    FROM (SELECT walk.company_id, todo.n, walk.state, todo.batch_seq, todo.signature, todo.sid, todo.source_identifier,
        list_filter(walk.state, lambda x: x.sid = todo.sid)[1:1] AS hit,
        {_pick(f"x.status <> 'closed' AND x.last_seen >= {NOW} - INTERVAL 30 DAY")} AS recent,
        {_pick("x.status = 'closed'")} AS closed
      FROM walk JOIN todo ON todo.company_id = walk.company_id AND todo.n = walk.n + 1))),
decided AS (SELECT batch_seq, company_id, decision,
    CASE WHEN entity_ref LIKE 'K:%' THEN substr(entity_ref, 3) ELSE sha256('fixture|' || company_id || '|' || substr(entity_ref, 3)) END AS entity_id,
    CASE WHEN target_ref LIKE 'K:%' THEN substr(target_ref, 3) ELSE sha256('fixture|' || company_id || '|' || substr(target_ref, 3)) END AS target_id, score
  FROM walk WHERE n > 0),
ended AS (SELECT company_id, unnest(state) AS s FROM walk QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY n DESC) = 1),
classified AS (SELECT company_id, CASE WHEN s.ref LIKE 'K:%' THEN substr(s.ref, 3) ELSE sha256('fixture|' || company_id || '|' || substr(s.ref, 3)) END AS id,
    s.status AS status, s.cls AS classification, s.last_seen AS last_seen, s.updated_at AS updated_at, s.sid AS source_identifier FROM ended),
marked AS (SELECT * REPLACE (CASE WHEN gone THEN 'missing' ELSE status END AS status, CASE WHEN gone THEN {NOW} ELSE updated_at END AS updated_at), status AS before
  FROM (SELECT *, status = 'active' AND id NOT IN (SELECT entity_id FROM decided) AS gone FROM classified)),
final AS (SELECT * REPLACE (CASE WHEN late THEN 'closed' ELSE status END AS status, CASE WHEN late THEN {NOW} ELSE updated_at END AS updated_at)
  FROM (SELECT *, status = 'missing' AND last_seen < {NOW} - INTERVAL 14 DAY AS late FROM marked))
"""
_SUMMARY = """summary AS (SELECT d.company_id, count(*) AS jobs_fetched, count(entity_id) AS jobs_classified,
    count(*) FILTER (classification = 'new') AS new_jobs, count(*) FILTER (classification = 'repost') AS repost_jobs,
    count(*) FILTER (classification = 'existing') AS existing_jobs, count(*) FILTER (decision = 'existing') AS decided_existing,
    count(*) FILTER (decision = 'repost') AS decided_repost, count(*) FILTER (decision = 'reopened') AS decided_reopened,
    count(*) FILTER (decision = 'new') AS decided_new
  FROM decided d LEFT JOIN final f ON f.id = d.entity_id GROUP BY d.company_id)"""

oracle("c1_c4_classify_batch", WALK + "SELECT batch_seq, company_id, decision, entity_id, target_id, score FROM decided")
oracle("c6_cycle_state", WALK + "SELECT id, status, classification, last_seen, updated_at, source_identifier FROM final")
oracle("a1_run_summary", WALK + f", {_SUMMARY} SELECT * FROM summary")
oracle("a2_run_totals", WALK + f""", {_SUMMARY} SELECT count(*) AS companies_processed, count(*) AS companies_succeeded, 0 AS companies_failed,
  CAST(sum(jobs_fetched) AS BIGINT) AS jobs_fetched, CAST(sum(jobs_classified) AS BIGINT) AS jobs_classified FROM summary""")
oracle("a3_lifecycle_counts", WALK + """SELECT count(*) FILTER (before = 'active' AND status IN ('missing', 'closed')) AS marked_missing,
  count(*) FILTER (before <> 'closed' AND status = 'closed') AS closed FROM final""")

_FAULTY = """c AS (SELECT s_suppkey AS company_seq,
    lower(replace(s_name, '#', '-')) || CASE WHEN s_suppkey % 11 = 0 THEN '_x' ELSE '' END AS id,
    CASE WHEN s_suppkey % 5 = 0 THEN 'missing required field: name' WHEN s_suppkey % 7 = 0 THEN 'invalid adapter'
      WHEN s_suppkey % 3 = 0 THEN 'must have at least one source' END AS problem FROM supplier)"""
oracle("s19_load_companies_faulty", _with(_FAULTY) + """SELECT company_seq, id, problem,
  regexp_full_match(id, '[a-z0-9-]+') AND NOT contains(id, '--') AND NOT starts_with(id, '-') AND NOT ends_with(id, '-') AS id_format_valid FROM c""")
oracle("a2_run_totals_with_failures", _with(_postings(), _FAULTY, """co AS (
  SELECT company_id AS id, count(*) AS n, 0 AS bad FROM postings GROUP BY ALL UNION ALL SELECT id, 0, 1 FROM c WHERE problem IS NOT NULL),
g AS (SELECT id, sum(n) AS n, max(bad) AS bad FROM co GROUP BY id)""") + """SELECT count(*) AS companies_processed, count(*) FILTER (bad = 0) AS companies_succeeded,
  CAST(count(*) FILTER (bad = 1) AS INTEGER) AS companies_failed, CAST(sum(n) AS BIGINT) AS jobs_fetched, CAST(sum(n) AS BIGINT) AS jobs_classified FROM g""")
_REPORT = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (
    "jobs_fetched", "jobs_classified", "new_jobs", "repost_jobs", "existing_jobs", "decided_existing", "decided_repost", "decided_reopened", "decided_new"))
oracle("a1_a2_run_report", WALK + f""", {_SUMMARY}, {_FAULTY}, every AS (
  SELECT *, 0 AS bad FROM summary UNION ALL SELECT id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1 FROM c WHERE problem IS NOT NULL),
each AS (SELECT company_id, max(bad) AS bad, {_REPORT} FROM every GROUP BY company_id)
SELECT 'company' AS level, company_id, CAST(1 AS BIGINT) AS companies_processed, CAST(bad AS BIGINT) AS companies_failed, each.* EXCLUDE (company_id, bad),
  CAST(90.5 AS DOUBLE) AS duration_seconds FROM each
UNION ALL SELECT 'run', NULL, count(*), CAST(sum(bad) AS BIGINT), {_REPORT}, CAST(90.5 AS DOUBLE) FROM each""")
oracle("s13_list_versions", LINK + f"""SELECT '20240101-000000-000000' AS snapshot_ts, count(*) AS job_count, '1.0.0' AS version FROM e0
UNION ALL SELECT '20240102-000000-000000', count(*) FILTER (NOT (status = 'closed' AND last_seen < {NOW} - INTERVAL 30 DAY)), '1.0.0' FROM e0""")
oracle("a7_decisions_per_run", _with(LOG) + """, seen AS (SELECT DISTINCT entity_id, CAST(ts AS DATE) AS run_date FROM log),
f AS (SELECT *, min(run_date) OVER (PARTITION BY entity_id) AS first_run FROM seen)
SELECT run_date, count(*) FILTER (run_date = first_run) AS decided_new, count(*) FILTER (run_date > first_run) AS decided_existing FROM f GROUP BY run_date""")

oracle("c7_observation_append", WALK + f"""SELECT entity_id, {NOW} AS timestamp, d.batch_seq, b.source_identifier, b.url,
  CASE WHEN decision = 'reopened' THEN 'Job reopened' END AS note FROM decided d JOIN b1 b USING (batch_seq)""")
oracle("t7_applications_survive_the_cycle", WALK + """SELECT e0.id AS job_id, e0.status AS status_before, f.status AS status_after
  FROM e0 LEFT JOIN final f ON f.id = e0.id""")
oracle("s18_migrate", LINK + "SELECT id, status = 'closed' AS archived, '1.1.0' AS schema_version FROM e0")
oracle("r5_split_late", _with(LOG) + "SELECT entity_id, event_id, ts < (SELECT max(ts) FROM log) - INTERVAL 10 DAY AS late FROM log")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
