"""The fixtures once more, as SQL text to put in front of expected results."""

from __future__ import annotations

# White space as Python's str.strip() sees it.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def quoted(text: str) -> str:
    """A Python text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


DOCS = """docs AS (
  SELECT *,
    'doc_' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.doc' WHEN 2 THEN '.DOCX'
      WHEN 3 THEN '.xls' WHEN 4 THEN '.xlsx' WHEN 5 THEN '.txt' ELSE '.zip' END AS filename,
    CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf'
      WHEN 4 THEN NULL ELSE 'application/octet-stream' END AS mime_type
  FROM documents)"""


def _escaped(c: str) -> str:
    """Text as it stands between the quotes of a JSON string."""
    codes = (
        (r"'\'", r"'\\'"),
        ("'\"'", "'\\\"'"),
        ("chr(10)", r"'\n'"),
        ("chr(13)", r"'\r'"),
        ("chr(9)", r"'\t'"),
    )
    for raw, code in codes:
        c = f"replace({c}, {raw}, {code})"
    return c


RESPONSES = f"""resp0 AS (
  SELECT d.*, a.attempt, CASE WHEN doc_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS provider,
    '{{"summary": "' || {_escaped("text")} || '", "fit_percentage": ' ||
      CASE doc_id % 5 WHEN 0 THEN (doc_id % 101)::VARCHAR WHEN 1 THEN '"' || (doc_id % 101) || '%"'
        WHEN 2 THEN '"' || (doc_id % 101) || '.5"' WHEN 3 THEN '"n/a"' ELSE 'null' END ||
      ', "key_matches": ["lang ' || lang || '", "document"]' AS head
  FROM documents d, (SELECT unnest([1, 2, 3]) AS attempt) a),
resp1 AS (
  SELECT *, head || ', "key_gaps": ["' || source || '"]}}' AS record, head || '}}' AS shorter FROM resp0),
resp2 AS (
  SELECT *, CASE (doc_id + attempt) % 7
    WHEN 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || record || chr(10) || '```' || chr(10) || 'Anything else?'
    WHEN 1 THEN record
    WHEN 2 THEN '{{"a": 1}} and {{"b": 2}}'
    WHEN 3 THEN left(record, 40)
    WHEN 4 THEN '  No record for: ' || text || chr(10)
    WHEN 5 THEN '```json' || chr(10) || shorter || chr(10) || '```' || chr(10) END AS answer
  FROM resp1),
resp AS (
  SELECT *, CASE WHEN provider = 'p1'
    THEN '{{"candidates": [{{"content": {{"parts": [{{"text": "' || {_escaped("answer")} || '"}}]}}}}]}}'
    ELSE '{{"choices": [{{"message": {{"content": "' || {_escaped("answer")} || '"}}}}]}}' END AS body
  FROM resp2)"""

# The JSON span of every answer, and whether it is one object.
CLEANED = """cleaned AS (
  SELECT *,
    regexp_replace(regexp_replace(answer, '```json\\s*', '', 'g'), '```\\s*$', '') AS bare,
    CASE WHEN contains(bare, '{') AND strpos(bare, '}') > 0
      AND strpos(bare, '{') < length(bare) - strpos(reverse(bare), '}') + 1
      THEN substr(bare, strpos(bare, '{'),
        length(bare) - strpos(reverse(bare), '}') + 2 - strpos(bare, '{'))
      ELSE bare END AS js,
    coalesce(starts_with(js, '{') AND json_valid(js), false) AS ok
  FROM resp)"""

CANDIDATES = """brands AS (
  SELECT o_custkey AS ck, list(DISTINCT p_brand ORDER BY p_brand) AS skills
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders),
people AS (
  SELECT c.*, nat.n_name, reg.r_name, reg.r_regionkey FROM customer c
  JOIN nation nat ON c_nationkey = n_nationkey JOIN region reg ON n_regionkey = r_regionkey),
positions AS (
  SELECT c_custkey AS candidate_id, n, o_orderpriority AS title, 'Company ' || o_orderstatus AS company,
    n_name AS location, strftime(o_orderdate, '%m/%Y') AS duration,
    date_trunc('month', o_orderdate)::DATE AS month
  FROM numbered JOIN people ON o_custkey = c_custkey),
worked AS (
  SELECT candidate_id, list(struct_pack(title, company, location, duration) ORDER BY n) AS experience,
    date_diff('day', min(month), max(month)) / 365.25 AS years
  FROM positions GROUP BY 1),
cand AS (
  SELECT c_custkey AS candidate_id, r_regionkey,
    CASE WHEN c_custkey % 97 <> 0 THEN c_name END AS name,
    CASE WHEN c_custkey % 50 = 0 THEN 'n/a'
      ELSE 'c' || c_custkey || '@mail' || (c_custkey % 10) || '.example.com' END AS email,
    '+' || (c_nationkey + 1) || '(' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || ')555-'
      || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone,
    n_name || ', ' || r_name AS location,
    coalesce(skills, []) AS skills, coalesce(experience, []) AS experience, years,
    c_mktsegment AS degree, r_name AS institution, n_name AS edu_location,
    coalesce((SELECT year(min(o_orderdate)) FROM orders WHERE o_custkey = c_custkey)::VARCHAR, '') AS edu_year,
    'cv_' || c_custkey || '.pdf' AS filename, c_acctbal >= 0 AS success
  FROM people LEFT JOIN brands ON ck = c_custkey LEFT JOIN worked ON worked.candidate_id = c_custkey)"""

JOBS = """options AS (
  SELECT r_regionkey AS job_id, r_regionkey AS r, chr(10) || ' Specialist for ' || r_name || ' ' || chr(9) AS description,
    (['BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD', 'AUTOMOBILE'])[r_regionkey + 1] AS edu,
    (['40', NULL, '50', '40', '60'])[r_regionkey + 1] AS weight_skills,
    (['40', NULL, '30', '40', '20'])[r_regionkey + 1] AS weight_experience,
    (['20', NULL, '20', '30', ''])[r_regionkey + 1] AS weight_education,
    (['africa', '', NULL, 'nation_3', ' MIDDLE '])[r_regionkey + 1] AS location_preference,
    CASE WHEN r_regionkey = 0 THEN '50-60k' END AS salary_range,
    CASE WHEN r_regionkey <> 1 THEN '50' END AS min_fit_percent
  FROM region),
jobs AS (
  SELECT job_id, ([40, 40, 50, 0, 60])[r + 1] AS ws, ([40, 40, 30, 0, 20])[r + 1] AS we,
    20 AS wd, min_fit_percent, location_preference
  FROM options WHERE r <> 3),
reqs AS (
  SELECT r AS job_id, 0 AS ord, 'priority_keywords' AS kind, 'Brand#' || (r + 1) AS term FROM options
  UNION ALL SELECT r, 1, 'priority_keywords', 'Brand#' || (r + 2) FROM options
  UNION ALL SELECT r, 1 * 2147483648 + 0, 'required_skills', 'Brand#' || (r + 6) FROM options
  UNION ALL SELECT r, 2 * 2147483648 + 0, 'min_experience', '5' FROM options
  UNION ALL SELECT r, 3 * 2147483648 + 0, 'edu_requirements', edu FROM options
  UNION ALL SELECT r, 4 * 2147483648 + 0, 'deal_breakers', 'Brand#' || (r + 11) FROM options
  UNION ALL SELECT r, 5 * 2147483648 + 0, 'nice_to_have', 'Brand#' || (r + 16) FROM options
  UNION ALL SELECT r, 5 * 2147483648 + 1, 'nice_to_have', 'Brand#' || (r + 17) FROM options
  UNION ALL SELECT r, 6 * 2147483648 + 0, 'experience_areas', '1-URGENT' FROM options
  UNION ALL SELECT r, 6 * 2147483648 + 1, 'experience_areas', 'company o' FROM options
  UNION ALL SELECT r, 7 * 2147483648 + 0, 'technical_skills', 'Brand#' || (r + 21) FROM options WHERE r <> 2
  UNION ALL SELECT r, 8 * 2147483648 + 0, 'certifications', 'specified' FROM options WHERE r = 4)"""

APPLICATIONS = """sent AS (
  SELECT DISTINCT job_id, candidate_id FROM (
    SELECT r_regionkey AS job_id, candidate_id FROM cand UNION ALL SELECT candidate_id % 5, candidate_id FROM cand))"""

RECORD_WORDS = f"""texts AS (
  SELECT candidate_id, list_filter(list_transform(
      string_split_regex(lower(concat_ws(' ', name, email, phone, location, list_aggregate(skills, 'string_agg', ' '),
        list_aggregate(list_transform(experience, lambda e: concat_ws(' ', e.title, e.company, e.location, e.duration)),
          'string_agg', ' '), degree, institution, edu_location, edu_year)), '[{SPACE},;()]+'),
      lambda w: regexp_replace(w, '[.:]+$', '')), lambda w: w <> '') AS words
  FROM cand),
phrases AS (SELECT candidate_id, ' ' || list_aggregate(words, 'string_agg', ' ') || ' ' AS txt FROM texts)"""

CHECKS = """checks AS (
  SELECT s.job_id, s.candidate_id, q.ord, q.kind, q.term,
    CASE q.kind WHEN 'min_experience' THEN coalesce(c.years, 0) >= 5
      WHEN 'edu_requirements' THEN c.degree = q.term
      ELSE contains(p.txt, ' ' || lower(q.term) || ' ') END AS found,
    CASE WHEN q.kind = 'min_experience' AND found THEN 'Meets minimum experience requirement (5+ years)'
      WHEN q.kind = 'min_experience' THEN 'Lacks minimum experience requirement (5 years)'
      WHEN q.kind = 'nice_to_have' THEN q.term || ' (nice-to-have)' ELSE q.term END AS label
  FROM sent s JOIN cand c USING (candidate_id) JOIN phrases p USING (candidate_id) JOIN jobs j USING (job_id)
  JOIN reqs q USING (job_id) WHERE c.success)"""

FIT = """parts AS (
  SELECT job_id, candidate_id,
    count(*) FILTER (kind NOT IN ('min_experience', 'edu_requirements', 'nice_to_have')) AS n_terms,
    count(*) FILTER (kind NOT IN ('min_experience', 'edu_requirements', 'nice_to_have') AND found) AS n_found,
    bool_or(kind = 'deal_breakers' AND NOT found) AS broken,
    bool_or(kind = 'edu_requirements' AND NOT found) AS unmet,
    count(*) FILTER (kind = 'nice_to_have' AND found) AS extras,
    coalesce(list(label ORDER BY ord) FILTER (found), []) AS matches,
    coalesce(list(label ORDER BY ord) FILTER (NOT found AND kind <> 'nice_to_have'), []) AS gaps
  FROM checks GROUP BY ALL),
scored AS (
  SELECT p.*, j.ws, j.we, j.wd, j.min_fit_percent, n_found::DOUBLE / n_terms AS skill_share,
    least(1.0::DOUBLE, coalesce(c.years, 0) / 5.0::DOUBLE) AS experience_share,
    CASE WHEN unmet THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS education_share,
    CASE WHEN broken THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS penalty, 2.0::DOUBLE * extras AS boost,
    coalesce(c.name, 'Unknown') AS candidate_name
  FROM parts p JOIN jobs j USING (job_id) JOIN cand c USING (candidate_id)),
fit AS (
  SELECT *, least(100, greatest(0, round((ws * skill_share + we * experience_share + wd * education_share)
      * penalty + boost)))::INT AS fit_percentage,
    len(matches) AS n_met, len(gaps) AS n_gaps,
    'The candidate is ' || CASE WHEN fit_percentage >= 75 THEN 'a strong' WHEN fit_percentage >= 50 THEN 'a fair'
      ELSE 'a weak' END || ' fit at ' || fit_percentage || ' percent. ' || n_met || ' of ' || (n_met + n_gaps)
      || ' requirements are met.'
      || CASE WHEN n_met > 0 THEN ' Main matches: ' || list_aggregate(matches, 'string_agg', ', ') || '.' ELSE '' END
      || CASE WHEN n_gaps > 0 THEN ' Main gaps: ' || list_aggregate(gaps, 'string_agg', ', ') || '.' ELSE '' END
      AS summary,
    coalesce(list_aggregate(matches, 'string_agg', ', '), '') AS matches_text,
    coalesce(list_aggregate(gaps, 'string_agg', ', '), '') AS gaps_text
  FROM scored)"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fit_percentage DESC, candidate_id) AS rank
  FROM fit WHERE fit_percentage >= coalesce(min_fit_percent::INT, 0))"""

CAND_WITH = with_(CANDIDATES)
FIT_WITH = with_(CANDIDATES, JOBS, APPLICATIONS, RECORD_WORDS, CHECKS, FIT, RANKED)

CALLS = """calls AS (
  SELECT event_id, user_id, ts, event_type AS model, strftime(ts, '%Y-%m-%d') AS day,
    CASE WHEN event_type IN ('click', 'view') THEN 'p1' ELSE 'p2' END AS provider
  FROM events),
used AS (SELECT provider, model, day, count(*) AS calls FROM calls GROUP BY ALL),
catalog AS (
  SELECT provider, CASE provider WHEN 'p1' THEN 1 ELSE 2 END AS provider_ord, model,
    CASE model WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS model_ord,
    (count(*) * 102) // (count(DISTINCT day) * 100) AS daily_limit, true AS enabled
  FROM calls GROUP BY provider, model
  UNION ALL
  SELECT 'p3', 3, 'spare', 1, max(n), false FROM (SELECT count(*) AS n FROM calls GROUP BY model)),
days AS (SELECT DISTINCT day FROM calls)"""

STATES = """job_events AS (
  SELECT event_id, ts, user_id AS job_id,
    CASE WHEN user_id % 2 = 0 THEN 'extraction' ELSE 'candidate_fit' END AS type,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
      ELSE 'processing' END AS status,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 100 WHEN 'error' THEN NULL
      ELSE event_id % 100 END AS progress
  FROM events),
states AS (
  SELECT job_id, arg_max(status, (ts, event_id)) AS status, any_value(type) AS type,
    coalesce(arg_max(progress, (ts, event_id)) FILTER (progress IS NOT NULL), 0) AS progress,
    min(ts) FILTER (status = 'pending') AS created_at, max(ts) AS updated_at
  FROM job_events GROUP BY job_id HAVING count(*) FILTER (status = 'pending') > 0)"""
