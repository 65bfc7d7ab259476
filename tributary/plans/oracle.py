"""The catalogue's queries in SQL. Where a query is left out, SQL can't state it shortly; tests cover it."""

from __future__ import annotations

from tributary.config import FULL_NAME, Config

_NORMAL = r"trim(regexp_replace(regexp_replace(replace(lower(trim({0})), '&', ' and '), '[/_.;:()\[\]-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: CASE WHEN regexp_matches(w, '^([A-Za-z]\\.)+$') THEN upper(w) WHEN lower(w) IN ('da','de','del','van','von','bin','binti') THEN lower(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"
_MAIL = "CASE c_custkey % 4 WHEN 0 THEN ' User' || c_custkey || '@GMAIL.com ' WHEN 1 THEN ' User' || c_custkey || '@corp.example' WHEN 2 THEN ' User' || c_custkey ELSE ' User' || c_custkey || '@Yahoo.com' END"

_MERGED = """
a AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS amount,
        upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS place FROM customer),
b AS (SELECT c_custkey AS k, CAST(CAST(floor(c_acctbal) AS BIGINT) + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS pay,
        CASE WHEN c_custkey % 4 = 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Plant' ELSE 'Other' END AS site
      FROM customer WHERE c_custkey % 2 = 0),
merged AS (
  SELECT a.id AS "employeeNumber", a.amount AS "ctcAnnual", CASE WHEN a.k % 4 = 0 THEN site ELSE place END AS "workLocation", 'INR' AS currency,
         array_to_string(list_filter([CASE WHEN pay <> amount THEN 'ctcAnnual:conflict' END, CASE WHEN a.k % 4 = 2 THEN 'workLocation:conflict' END], lambda x: x IS NOT NULL), ',') AS flags,
         CASE WHEN pay <> amount THEN pay ELSE '' END AS alternatives, CAST(CASE WHEN pay IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n_rows,
         CAST(CASE WHEN pay IS NULL THEN 4 WHEN a.k % 4 = 0 THEN 11 ELSE 10 END AS BIGINT) AS n_transforms
  FROM a LEFT JOIN b ON a.k = b.k)
"""
_PROFILE = """
cells AS (
  SELECT 'customer' AS file_name, h AS header, c_custkey AS row_idx, v AS value FROM (
    SELECT c_custkey, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) AS h, unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS v FROM customer)
  UNION ALL
  SELECT 'supplier', h, s_suppkey, v FROM (
    SELECT s_suppkey, unnest(['s_suppkey', 's_name', 's_nationkey']) AS h, unnest([CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR)]) AS v FROM supplier)),
looked AS (
  SELECT *, length(regexp_replace(value, '[^0-9]', '', 'g')) AS digits, regexp_matches(value, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS is_number,
         row_number() OVER (PARTITION BY file_name, header ORDER BY row_idx) AS rn
  FROM cells WHERE value IS NOT NULL AND trim(value) NOT IN ('', '-', 'null', 'NULL') AND NOT regexp_matches(lower(trim(value)), '^n/?a$')),
counted AS (
  SELECT file_name, header, count(*) AS present, count(DISTINCT lower(trim(value))) AS unique_count,
         count(*) FILTER (digits BETWEEN 10 AND 13) AS phones, count(*) FILTER (is_number AND NOT digits BETWEEN 10 AND 13) AS numbers,
         count(*) FILTER (regexp_matches(value, '[0-9]{3,}')) AS ids, string_agg(value, '|' ORDER BY row_idx) FILTER (rn <= 8) AS samples
  FROM looked GROUP BY ALL)
"""
_PUSH = """
base AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS record_id, CAST(CASE WHEN c_custkey % 9 = 0 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS employee_number,
         c_custkey % 10 = 3 AS was_failed, c_custkey % 17 = 0 AS excluded, c_custkey % 7 = 0 AS missing, CASE WHEN c_custkey % 10 = 3 THEN 2 ELSE 1 END AS attempt
  FROM customer {where}),
held AS (SELECT CAST(c_custkey AS VARCHAR) AS employee_number FROM customer WHERE c_custkey % 10 = 5),
open AS (
  SELECT b.*, h.employee_number IS NOT NULL AS taken, NOT excluded AND NOT missing AND b.employee_number LIKE '%8' AND attempt = 1 AS busy
  FROM base b LEFT JOIN held h USING (employee_number)),
ranked AS (SELECT *, coalesce(max(CASE WHEN busy THEN 1 END) OVER (PARTITION BY employee_number ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS cleared FROM open),
single AS (SELECT *, CASE WHEN excluded THEN 409 WHEN missing THEN 422 WHEN busy AND NOT cleared THEN 503 WHEN taken AND NOT was_failed THEN 409 ELSE 201 END AS st FROM ranked),
calls AS (
  SELECT record_id, employee_number, CAST(attempt AS BIGINT) AS attempt,
         CASE WHEN st = 201 AND NOT was_failed AND coalesce(max(CASE WHEN st = 201 THEN 1 END) OVER (PARTITION BY employee_number ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 409 ELSE st END AS status
  FROM single)
"""
_LABELS = """(VALUES (0, 'mapping_ambiguous', 'Ambiguous mapping'), (1, 'mapping_competing', 'Competing columns'), (2, 'mapping_missing_required', 'Required field unmapped'),
  (3, 'value_ambiguous_date', 'Ambiguous date'), (4, 'value_unknown_enum', 'Unknown enum value'), (5, 'conflict_cross_file', 'Cross-file conflict'),
  (6, 'duplicate_fuzzy', 'Possible duplicate'), (7, 'validation_failed', 'Validation failed')) AS l(i, kind, label)"""

_MAPPED = """
s AS (SELECT CAST(c_custkey AS INTEGER) AS col_ord, c_custkey % 50 AS f, c_mktsegment AS top, CAST(c_custkey * 37 % 100 AS DOUBLE) / 100 AS score, CAST(c_custkey * 11 % 40 AS DOUBLE) / 100 AS margin FROM customer),
d AS (SELECT *, score >= CAST(0.92 AS DOUBLE) OR (score >= CAST(0.82 AS DOUBLE) AND margin >= CAST(0.18 AS DOUBLE)) AS auto, score >= CAST(0.45 AS DOUBLE) AS likely, margin < CAST(0.18 AS DOUBLE) AS close FROM s),
t AS (SELECT *, CASE WHEN auto OR (likely AND NOT close) THEN top END AS target, CASE WHEN auto THEN 'auto' WHEN likely THEN 'escalated' ELSE 'ignored' END AS status,
             CASE WHEN auto THEN 'match' WHEN likely AND close THEN 'ambiguous' WHEN likely THEN 'weak' ELSE 'leftover' END AS reason FROM d),
r AS (SELECT *, CASE WHEN target IS NOT NULL THEN row_number() OVER (PARTITION BY f, target ORDER BY score DESC, col_ord) END AS rn FROM t),
m AS (SELECT col_ord, f, top, score, CASE WHEN rn > 1 AND score < CAST(0.8 AS DOUBLE) THEN NULL ELSE target END AS target,
       CASE WHEN rn > 1 AND score < CAST(0.8 AS DOUBLE) THEN 'ignored' WHEN rn > 1 THEN 'escalated' ELSE status END AS status,
       CASE WHEN rn > 1 AND score < CAST(0.8 AS DOUBLE) THEN 'weaker' WHEN rn > 1 THEN 'competing' ELSE reason END AS reason FROM r)
"""
_DECIDED = """
esc AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS escalation_id, o_orderkey AS k, o_custkey AS who, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS r,
    CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS f, CASE WHEN o_orderkey % 5 = 0 THEN 'resolved' ELSE 'open' END AS was,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS "at" FROM orders),
made AS (SELECT *, printf('%012d', "at") || escalation_id AS turn, k % 10 = 4 AS no, CASE WHEN k % 10 = 4 THEN 'reject_record' WHEN k % 4 = 0 THEN 'accept_value' WHEN k % 7 = 0 THEN 'exclude_record' WHEN k % 11 = 0 THEN 'merge_records' ELSE 'set_field' END AS command
    FROM esc WHERE was = 'open' AND k % 2 = 0),
gone AS (SELECT who AS r, min(turn) AS gone FROM made WHERE r IS NULL AND command IN ('exclude_record', 'merge_records') GROUP BY who),
behind AS (SELECT *, r IS NOT NULL AND coalesce(sum(CASE WHEN no THEN 0 ELSE 1 END) OVER (PARTITION BY r, f ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS closed FROM made),
outs AS (SELECT b.*, least(min(CASE WHEN b.r IS NOT NULL AND (no OR command IN ('exclude_record', 'merge_records')) THEN turn END) OVER (PARTITION BY b.r), gone) AS fst FROM behind b LEFT JOIN gone USING (r) WHERE NOT closed),
ends AS (SELECT *, min(CASE WHEN NOT no AND turn >= fst THEN turn END) OVER (PARTITION BY r) AS en FROM outs),
counts AS (SELECT escalation_id, r, coalesce(f, '') AS f, CASE WHEN no THEN 'rejected' ELSE 'resolved' END AS status, command, "at", r IS NOT NULL AND coalesce(turn = en, false) AS whole FROM ends WHERE r IS NULL OR en IS NULL OR turn <= en)
"""


def _values(*rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


_CONFIG = Config()
_LIKE = "CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE CAST(1 AS DOUBLE) - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"
_TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
_SHARE = "CAST(len(list_filter(samples, lambda v: {0})) AS DOUBLE) / len(samples)"
_MAIL_LIKE = r"regexp_matches(v, '^[^\s@]+@[^\s@]+\.[^\s@]+$')"
#: Every column against every field, scored; then decided and competing as in _MAPPED.
_SCORED = f"""
{_PROFILE},
fields AS (SELECT * FROM {_values(*((f.key, i, f.type, f.required) for i, f in enumerate(_CONFIG.fields)))} AS t(field, ord, type, required)),
ways AS (SELECT * FROM {_values(*((k, w) for k, ws in _CONFIG.synonyms.items() if k != FULL_NAME for w in ws))} AS t(field, way)),
cols AS (SELECT file_name, header, CASE header WHEN 'c_name' THEN 1 WHEN 'c_nationkey' THEN 2 WHEN 'c_mktsegment' THEN 3 WHEN 's_name' THEN 1 WHEN 's_nationkey' THEN 2 ELSE 0 END AS col_ord,
    {_NORMAL.format('header')} AS normal, list(value ORDER BY row_idx) FILTER (rn <= 8) AS samples FROM looked GROUP BY ALL),
named AS (SELECT c.*, f.*, {_LIKE.format(a='normal', b=_NORMAL.format('field'))} AS own,
    (SELECT max(CASE WHEN normal = way THEN 0.96 WHEN contains(normal, way) OR contains(way, normal) THEN 0.88 ELSE {_LIKE.format(a='normal', b=_NORMAL.format('way'))} END) FROM ways w WHERE w.field = f.field) AS by_way,
    (SELECT {_TOKENS.format("string_agg(" + _NORMAL.format('way') + ", ' ')")} FROM ways w WHERE w.field = f.field) AS words, {_TOKENS.format('normal')} AS head FROM cols c, fields f),
bests AS (SELECT *, greatest(own, by_way, CASE WHEN len(list_intersect(head, words)) > 0 THEN CAST(len(list_intersect(head, words)) AS DOUBLE) / greatest(len(head), 1) * 0.8 ELSE 0 END) AS best,
    CASE WHEN type = 'email' THEN {_SHARE.format(_MAIL_LIKE)} * 0.14
      WHEN type = 'phone' THEN {_SHARE.format("length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 10 AND 13")} * 0.1
      WHEN type = 'date' THEN {_SHARE.format("regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR regexp_matches(v, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') OR regexp_matches(v, '(?i)[0-9]{{1,2}}-[a-z]{{3}}-[0-9]{{2,4}}')")} * 0.12
      WHEN type = 'number' THEN {_SHARE.format("regexp_matches(v, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')")} * 0.08
      WHEN field = 'employeeNumber' THEN {_SHARE.format("regexp_matches(v, '(?i)[a-z]*-?[0-9]{{3,}}')")} * 0.06 ELSE 0 END AS bonus,
    CASE WHEN type = 'date' AND len(list_filter(samples, lambda v: NOT ({_MAIL_LIKE} OR (regexp_matches(v, '(?i)[a-z]{{4,}}') AND NOT regexp_matches(v, '[0-9]'))))) = 0 THEN 0.4
      WHEN type = 'email' AND len(list_filter(samples, lambda v: contains(v, '@'))) = 0 THEN 0.45
      WHEN field = 'ctcAnnual' AND len(list_filter(samples, lambda v: NOT {_MAIL_LIKE})) = 0 THEN 0.5 ELSE 0 END AS penalty FROM named),
scored AS (SELECT *, CAST(greatest(0, least(0.99, best + bonus - penalty)) AS DOUBLE) AS score FROM bests),
ranked AS (SELECT *, row_number() OVER w AS rn, score - coalesce(lead(score) OVER w, 0) AS ahead FROM scored WINDOW w AS (PARTITION BY file_name, header ORDER BY score DESC, ord)),
s AS (SELECT file_name AS f, header, col_ord, max(CASE WHEN rn = 1 THEN field END) AS top, max(CASE WHEN rn = 1 THEN score END) AS score, max(CASE WHEN rn = 1 THEN ahead END) AS margin, string_agg(field, ',' ORDER BY rn) FILTER (rn <= 3) AS candidates FROM ranked GROUP BY ALL),
{{_MAPPED}}
"""
_TAIL = _MAPPED[_MAPPED.index("d AS (") : _MAPPED.index("m AS (")]
_SCORED = _SCORED.replace("{_MAPPED}", _TAIL + _MAPPED[_MAPPED.index("m AS (") :].replace("SELECT col_ord, f, top, score,", "SELECT col_ord, f, header, candidates, margin, score,"))
ORACLES: dict[str, str] = {
    "map_columns": f"""
WITH {_SCORED} SELECT f AS file_name, header, coalesce(target, '') AS target, round(score, 9) AS confidence, round(margin, 9) AS margin, status, reason, candidates FROM m""",
    "vocabulary_top3": f"""
WITH c AS (SELECT p_partkey, p_size, {_NORMAL.format("(CASE p_partkey % 4 WHEN 0 THEN p_name || '_X' WHEN 1 THEN regexp_replace(p_name, '^[^ ]+ ', '') WHEN 2 THEN p_name || ' ' || p_brand ELSE replace(p_name, 'e', 'a') END)")} AS normal FROM part),
f AS (SELECT p_type AS field, {_NORMAL.format('p_type')} AS own, min(p_partkey) AS ord, {_TOKENS.format("string_agg(" + _NORMAL.format('p_name') + ", ' ')")} AS words FROM part GROUP BY p_type),
w AS (SELECT DISTINCT p_type AS field, p_name AS way, {_NORMAL.format('p_name')} AS plain FROM part),
m AS (SELECT p_partkey, field, max(CASE WHEN normal = way THEN 0.96 WHEN contains(normal, way) OR contains(way, normal) THEN 0.88 ELSE {_LIKE.format(a='normal', b='plain')} END) AS by_way FROM c, w GROUP BY ALL),
b AS (SELECT p_partkey, field, ord, greatest(by_way, {_LIKE.format(a='normal', b='own')}, len(list_intersect({_TOKENS.format('normal')}, words))::DOUBLE / len({_TOKENS.format('normal')}) * 0.8)
    + CASE WHEN ord % 3 = 0 AND p_partkey % 3 = 0 THEN 0.04 ELSE 0 END AS total FROM m JOIN f USING (field) JOIN c USING (p_partkey)),
r AS (SELECT *, least(0.99, total) AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY least(0.99, total) DESC, ord) AS rn FROM b)
SELECT p_partkey AS col_ord, CAST(max(round(score, 9)) AS DOUBLE) AS best, string_agg(field, ',' ORDER BY rn) AS fields FROM r WHERE rn <= 3 GROUP BY p_partkey""",
    "required_without_source": f"""
WITH {_SCORED} SELECT 'mapping_missing_required' AS kind, field, CAST(0.2 AS DOUBLE) AS confidence, CAST(7 AS BIGINT) AS n_options
FROM fields WHERE required AND field NOT IN (SELECT target FROM m WHERE target IS NOT NULL AND status <> 'ignored')""",
    "normalize_text": f"SELECT p_partkey, {_NORMAL.format("'  ' || replace(p_type, ' ', '_/') || '&R.D '")} AS normal FROM part",
    "token_overlap": f"""
WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split({_NORMAL.format('p_name')}, ' '), lambda x: x <> '')) AS a,
                  list_distinct(list_filter(string_split({_NORMAL.format("(p_type || ' ' || p_brand)")}, ' '), lambda x: x <> '')) AS b FROM part)
SELECT p_partkey, CAST(len(a) AS BIGINT) AS n_tokens, CAST(len(list_intersect(a, b)) AS BIGINT) AS n_shared FROM t""",
    "header_similarity_topk": f"""
WITH m AS (SELECT n_nationkey, r_regionkey, {_NORMAL.format('n_name')} AS a, {_NORMAL.format('r_name')} AS b FROM nation, region),
s AS (SELECT *, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE CAST(1 AS DOUBLE) - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END, 9) AS score FROM m),
r AS (SELECT *, row_number() OVER w AS rank, round(score - coalesce(lead(score) OVER w, 0.0), 9) AS lead FROM s WINDOW w AS (PARTITION BY n_nationkey ORDER BY score DESC, r_regionkey))
SELECT n_nationkey, r_regionkey, score, rank, lead FROM r WHERE rank <= 3""",
    "title_case": f"SELECT p_partkey, {_TITLE.format("trim(regexp_replace(' j.r.  VAN ' || upper(p_name) || ' ', '\\s+', ' ', 'g'))")} AS titled FROM part",
    "name_split": f"""
SELECT c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN 'Arun' WHEN 1 THEN 'Maria del' WHEN 2 THEN 'Pooja' ELSE 'Ana ' || {_TITLE.format('lower(c_mktsegment)')} END AS first_name,
  CASE c_custkey % 4 WHEN 0 THEN 'Nair' || split_part(c_name, '#', 2) WHEN 1 THEN {_TITLE.format('c_mktsegment')} WHEN 2 THEN '' ELSE 'Sato' END AS last_name
FROM customer""",
    "blank_filter": "SELECT event_type, count(*) FILTER (event_id % 8 IN (0, 1, 2, 3, 5)) AS n_blank, count(*) AS n FROM events GROUP BY event_type",
    "number_parse": """
WITH v AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN CAST(cents AS DOUBLE) WHEN 1 THEN CAST(cents AS DOUBLE) WHEN 2 THEN CAST(cents || '.5' AS DOUBLE) WHEN 3 THEN 1000.0 + abs(cents) % 1000 END AS number FROM v""",
    "money_format": r"""
WITH o AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS s FROM orders)
SELECT o_orderkey, CASE WHEN length(s) <= 3 THEN s ELSE reverse(regexp_replace(regexp_replace(reverse(left(s, length(s) - 3)), '(..)', '\1,', 'g'), ',$', '')) || ',' || right(s, 3) END AS shown FROM o""",
    "email_clean": f"""
WITH m AS (SELECT c_custkey, lower(trim({_MAIL})) AS v FROM customer)
SELECT c_custkey, v AS value, CASE c_custkey % 4 WHEN 1 THEN 0.97 WHEN 2 THEN 0.2 ELSE 0.4 END::DOUBLE AS confidence,
       CASE c_custkey % 4 WHEN 1 THEN '' WHEN 2 THEN 'invalid' ELSE 'personal_email' END AS issue, split_part(v, '@', 2) AS domain FROM m""",
    "phone_clean": """
WITH v AS (SELECT c_custkey, c_custkey % 5 AS k, CAST(c_custkey AS VARCHAR) AS s, '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p FROM customer)
SELECT c_custkey, CASE WHEN k IN (0, 1, 2) THEN '+91' || p WHEN k = 3 THEN '+144' || p END AS phone, k < 4 AS looks_phone FROM v""",
    "employee_id": "SELECT c_custkey, c_custkey || CASE c_custkey % 4 WHEN 1 THEN 'B' ELSE '' END AS id FROM customer",
    "date_parse_mixed": """
WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders),
s AS (SELECT *, k IN (1, 2) AND d <= 12 AND d <> m AS two FROM d),
r AS (SELECT *, printf('%04d-%02d-%02d', y, d, m) AS swapped FROM s)
SELECT o_orderkey, CASE WHEN k = 5 THEN 'invalid' WHEN two THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN k = 5 OR two THEN '' ELSE iso END AS iso,
       CASE WHEN NOT two THEN '' WHEN k = 1 THEN iso ELSE swapped END AS dmy, CASE WHEN NOT two THEN '' WHEN k = 1 THEN swapped ELSE iso END AS mdy FROM r""",
    "enum_map_unknown": """
WITH e AS (SELECT CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'search' THEN 'view' WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' WHEN 'buy' THEN 'buy' ELSE upper(event_type) END AS value,
  CASE WHEN event_type IN ('purchase', 'search', 'click', 'view', 'buy') THEN '' ELSE 'unknown_enum' END AS issue,
  CASE WHEN event_type IN ('purchase', 'search') THEN 0.94 WHEN event_type IN ('click', 'view', 'buy') THEN 0.99 ELSE 0.35 END::DOUBLE AS confidence FROM events)
SELECT value, issue, count(*) AS n, max(confidence) AS confidence FROM e GROUP BY ALL""",
    "profile_columns": f"""
WITH {_PROFILE}, totals AS (SELECT file_name, header, count(*) AS rows FROM cells GROUP BY ALL)
SELECT file_name, header, rows, present, round(1 - CAST(present AS DOUBLE) / rows, 9) AS null_rate, unique_count, samples,
       CASE WHEN phones > 0.7 * present THEN 'phone' WHEN numbers > 0.7 * present THEN 'number' WHEN unique_count <= 8 AND unique_count < 0.4 * present THEN 'enum' WHEN ids > 0.8 * present THEN 'id' ELSE 'string' END AS inferred
FROM counted JOIN totals USING (file_name, header)""",
    "map_decision": f"WITH {_MAPPED} SELECT col_ord, coalesce(target, '') AS target, status, reason FROM m",
    "mapping_board": f"WITH {_MAPPED} SELECT col_ord, status FROM m WHERE status <> 'ignored' OR score >= CAST(0.4 AS DOUBLE)",
    "uncertain_columns": f"WITH {_MAPPED} SELECT col_ord, status, score AS confidence FROM m WHERE status = 'escalated' OR (status = 'ignored' AND score >= CAST(0.3 AS DOUBLE)) ORDER BY col_ord LIMIT 12",
    "mapping_updates": f"""
WITH {_MAPPED}, u AS (SELECT *, col_ord % 10 = 0 AND status <> 'auto' AS may, CAST(CAST(col_ord AS BIGINT) * 13 % 100 AS DOUBLE) / 100 AS c FROM m),
v AS (SELECT *, may AND c >= CAST(0.82 AS DOUBLE) AS sure, may AND c >= CAST(0.45 AS DOUBLE) AS likely FROM u)
SELECT col_ord, CASE WHEN sure THEN 'phone' ELSE coalesce(target, '') END AS target, CASE WHEN sure THEN c ELSE score END AS confidence,
       CASE WHEN sure THEN 'auto' ELSE status END AS status, CASE WHEN likely THEN 'assisted' ELSE reason END AS reason FROM v""",
    "mapping_escalations": f"""
WITH {_MAPPED} SELECT CASE WHEN reason = 'competing' THEN 'mapping_competing' ELSE 'mapping_ambiguous' END AS kind, 'f' || f || ':' || c_name AS mapping_id,
       'Where does it belong: ' || c_name AS title, score AS confidence, CAST(3 AS BIGINT) AS n_options,
       'Map to ' || top || ' (' || CAST(round(score * 100) AS INTEGER) || '%)' AS "first", 'other · ' || CAST(round(score / 2 * 100) AS INTEGER) || '%' AS "second"
FROM m JOIN customer ON c_custkey = col_ord WHERE status = 'escalated'""",
    "first_escalations": """
SELECT o_orderkey AS escalation_id FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END, CASE WHEN o_orderkey % 7 = 0 THEN 'm' END,
    CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 't' || (o_orderkey % 2) END ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
    "merge_sources": f"WITH {_MERGED} SELECT * FROM merged",
    "payload_rows": """
SELECT CAST(c_custkey AS VARCHAR) AS "employeeNumber", CASE WHEN c_custkey % 3 = 0 THEN 'Ann' ELSE 'Cher' END AS "firstName", CASE WHEN c_custkey % 3 = 0 THEN 'Lee' ELSE '' END AS "lastName",
       CASE WHEN c_custkey % 2 = 0 THEN 'Sales North' ELSE '' END AS department, 'active' AS status, CAST(CASE WHEN c_custkey % 2 = 0 THEN 0.99 ELSE 0.94 END AS DOUBLE) AS sure,
       CASE WHEN c_custkey % 4 = 0 THEN 'kept longer form' WHEN c_custkey % 2 = 0 THEN 'title case' ELSE '' END AS how,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'lastName:missing_from_split' END AS flags
FROM customer""",
    "incremental_merge": f"WITH {_MERGED} SELECT * FROM merged",
    "profile_merged": f"""
WITH {_PROFILE}, totals AS (SELECT file_name, header, count(*) AS rows FROM cells GROUP BY ALL),
first AS (SELECT header, string_agg(value, '|' ORDER BY row_idx) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY row_idx) AS n FROM looked WHERE file_name = 'customer' AND row_idx % 3 <> 0) WHERE n <= 8 GROUP BY header)
SELECT c.header, rows, present, round(1 - CAST(present AS DOUBLE) / rows, 9) AS null_rate, first.samples,
       CASE WHEN phones > 0.7 * present THEN 'phone' WHEN numbers > 0.7 * present THEN 'number' WHEN unique_count <= 8 AND unique_count < 0.4 * present THEN 'enum' WHEN ids > 0.8 * present THEN 'id' ELSE 'string' END AS inferred, true AS close
FROM counted c JOIN totals USING (file_name, header) JOIN first ON first.header = c.header WHERE file_name = 'customer'""",
    "delimited_exact": """SELECT c_custkey, 'say "' || c_mktsegment || '",' || chr(10) || c_custkey || ',' AS note FROM customer""",
    "workbook_rows": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer",
    "target_rows": "SELECT CAST(c_custkey AS VARCHAR) AS employee_number, 'b' AS batch_id, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 2 = 0",
    "conflict_escalations": f"""
WITH {_MERGED}, f AS (SELECT 'ctcAnnual' AS field, 2 AS o FROM merged WHERE flags LIKE '%ctcAnnual:conflict%' UNION ALL SELECT 'workLocation', 1 FROM merged WHERE flags LIKE '%workLocation:conflict%')
SELECT 'Cross-file conflict' AS label, field, count(*) AS n, CAST(sum(o) AS BIGINT) AS n_options, CAST(0.5 AS DOUBLE) AS confidence FROM f GROUP BY field""",
    "exact_dedupe": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1""",
    "fuzzy_pairs": """
WITH p AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', -1) AS last, p_brand || '-' || p_size || '-' || p_type AS phone, round(p_retailprice, 2) AS dob, p_brand AS number, lower(split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', -1)) AS nm FROM part),
n AS (SELECT *, regexp_replace(nm, '[^a-z]', '', 'g') AS c FROM p)
SELECT a.id AS keep_id, b.id AS drop_id, a.phone = b.phone AS by_phone, a.dob = b.dob AND a.number <> b.number AS by_dob
FROM n a JOIN n b ON a.id < b.id AND (a.phone = b.phone OR (a.dob = b.dob AND a.number <> b.number))
WHERE length(a.c) > 3 AND (a.c = b.c OR contains(a.c, b.c) OR contains(b.c, a.c) OR (a.nm[1] = b.nm[1] AND lower(a.last) = lower(b.last)))""",
    "missing_required": """
WITH r AS (SELECT c_custkey AS k, c_custkey % 7 = 0 AS no_mail, c_custkey % 5 = 0 OR c_custkey % 11 = 0 AS no_status FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 3 <> 0)
SELECT CAST(k AS VARCHAR) AS record_id, CASE WHEN no_mail THEN 'email' ELSE 'status' END AS field,
       'Missing: ' || CASE WHEN no_mail AND no_status THEN 'Mail, Segment' WHEN no_mail THEN 'Mail' ELSE 'Segment' END AS evidence, CAST(0.2 AS DOUBLE) AS confidence
FROM r WHERE no_mail OR no_status""",
    "date_order": "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y-%m-%d') > strftime(l_shipdate, '%Y-%m-%d') GROUP BY o_orderpriority",
    "skip_set_validation": "SELECT c_custkey, 'Missing: Mail' AS evidence FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND (o_custkey = c_custkey OR o_custkey + 1 = c_custkey))",
    "escalation_summary": f"SELECT kind, count(*) AS n, label FROM orders JOIN {_LABELS} ON o_orderkey % 8 = i WHERE o_orderstatus = 'O' GROUP BY kind, label",
    "push_status": f"WITH {_PUSH.format(where='')} SELECT record_id, employee_number, attempt, status, status = 201 AS ok FROM calls",
    "push_outcome": f"WITH {_PUSH.format(where='WHERE c_custkey % 10 = 3 AND c_custkey % 17 <> 0')} SELECT status, count(*) AS n FROM calls GROUP BY status",
    "rollback_net": """
SELECT 'in the target' AS what, CAST(0 AS BIGINT) AS n
UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN 'rolled_back' ELSE 'failed' END, count(*) FROM customer GROUP BY 1""",
    "rollback_calls": """
SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS record_id, 'DELETE' AS method,
       '/api/v1/employee/' || CASE WHEN c_custkey % 6 <> 0 THEN 'a+b%2F' || c_custkey ELSE lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS path, 204 AS status, true AS ok,
       '{"employeeNumber":"' || CASE WHEN c_custkey % 6 <> 0 THEN 'a b/' || c_custkey ELSE lpad(CAST(c_custkey AS VARCHAR), 12, '0') END || '","batchId":"batch_7"}' AS body
FROM customer WHERE c_custkey % 3 = 0""",
    "push_log": f"""
WITH {_PUSH.format(where='')},
said AS (SELECT c.*, CASE WHEN status = 201 THEN 'push.ok' ELSE 'push.fail' END AS action,
  CASE WHEN status = 201 THEN 'POST /api/v1/employee → 201' WHEN status = 422 THEN '422 missing segment' WHEN status = 503 THEN '503 target is busy, try again' WHEN excluded THEN '409 record is excluded' ELSE '409 employee exists already' END AS why,
  CASE WHEN status = 201 THEN 'created' ELSE CAST(status AS VARCHAR) END AS after FROM calls c JOIN base b USING (record_id))
SELECT action, why, after, count(*) AS n, min(employee_number) AS first_subject FROM said GROUP BY ALL""",
    "resolve_decisions": f'WITH {_DECIDED} SELECT escalation_id, status, command, "at", whole FROM counts',
    "close_related": f"""
WITH {_DECIDED},
settled AS (SELECT r, f, bool_or(whole) AS whole FROM counts WHERE status <> 'rejected' AND r IS NOT NULL GROUP BY r, f),
after AS (SELECT e.*, CASE WHEN c.status IS NOT NULL THEN c.status WHEN e.was = 'open' AND EXISTS (SELECT 1 FROM settled s WHERE s.r = e.r AND (s.f = coalesce(e.f, '') OR s.whole)) THEN 'resolved' ELSE e.was END AS now
  FROM esc e LEFT JOIN counts c USING (escalation_id))
SELECT escalation_id, now AS status FROM after""",
    "merge_pairs": """
WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS q, c_name, c_mktsegment FROM customer),
two AS (SELECT k, CASE WHEN k % 8 = 2 THEN 'early' ELSE c_mktsegment END AS f FROM c WHERE q = 2),
one AS (SELECT c.k, two.k IS NOT NULL AS took, coalesce(two.f, '') AS f, CASE WHEN c.k % 16 = 1 THEN '' ELSE c_name END AS m FROM c LEFT JOIN two ON two.k = c.k + 1 WHERE q = 1),
zero AS (SELECT c.k, one.k IS NOT NULL AS took, coalesce(one.took, false) AS both_took, coalesce(one.f, '') AS f, coalesce(one.m, '') AS m FROM c LEFT JOIN one ON one.k = c.k + 1 WHERE q = 0),
rows_ AS (
  SELECT k AS c_custkey, f AS "firstName", m AS email, array_to_string(list_sort(['r' || k] || CASE WHEN took THEN ['r' || (k + 1)] ELSE [] END || CASE WHEN both_took THEN ['r' || (k + 2)] ELSE [] END), ',') AS row_ids, false AS excluded, CASE WHEN took THEN '' ELSE 'firstName:duplicate' END AS flags FROM zero
  UNION ALL SELECT k, f, m, array_to_string(list_sort(['r' || k] || CASE WHEN took THEN ['r' || (k + 1)] ELSE [] END), ','), true, '' FROM one
  UNION ALL SELECT k, f, 'two', 'r' || k, true, '' FROM two
  UNION ALL SELECT k, '', '', 'r' || k, true, '' FROM c WHERE q = 3)
SELECT * FROM rows_""",
    "dispatched": r"""
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, c_custkey % 9 = 0 AS blank, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg FROM customer),
v AS (
  SELECT k, blank, 'employeeNumber' AS field, s AS value, 0.96 AS confidence, '' AS issue FROM c
  UNION ALL SELECT k, blank, 'firstName', seg, 0.95, '' FROM c
  UNION ALL SELECT k, blank, 'phone', '+9198' || lpad(s, 8, '0'), 0.93, '' FROM c
  UNION ALL SELECT k, blank, 'dateOfBirth', '2001-01-' || lpad(CAST(k % 40 AS VARCHAR), 2, '0'), CASE WHEN k % 40 BETWEEN 1 AND 31 THEN 0.98 ELSE 0.2 END, CASE WHEN k % 40 BETWEEN 1 AND 31 THEN '' ELSE 'invalid' END FROM c
  UNION ALL SELECT k, blank, 'managerEmployeeNumber', s, 0.9, '' FROM c
  UNION ALL SELECT k, blank, 'workLocation', seg, 0.9, '' FROM c
  UNION ALL SELECT k, blank, 'panNumber', 'ABCDE' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || CASE WHEN k % 2 = 0 THEN 'F' ELSE '' END, CASE WHEN k % 2 = 0 THEN 0.96 ELSE 0.4 END, CASE WHEN k % 2 = 0 THEN '' ELSE 'invalid' END FROM c
  UNION ALL SELECT k, blank, 'costCode', s, 0.8, '' FROM c)
SELECT k AS c_custkey, field, CASE WHEN blank THEN '' ELSE value END AS value, CAST(CASE WHEN blank THEN 1.0 ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN blank THEN '' ELSE issue END AS issue FROM v""",
    "value_issue_options": """
WITH c AS (SELECT c_custkey AS k, c_custkey % 12 + 1 AS a, c_custkey % 11 + 1 AS b FROM customer),
e AS (
  SELECT 'value_unknown_enum' AS kind, 'status' AS field, 'term,active,inactive,on_notice,terminated,exclude' AS options, 0.4 AS confidence FROM c WHERE k % 4 = 0
  UNION ALL SELECT 'validation_failed', 'email', 'accept,clear,exclude', 0.35 FROM c WHERE k % 3 = 0
  UNION ALL SELECT 'validation_failed', 'email', 'exclude', 0.2 FROM c WHERE k % 3 = 2
  UNION ALL SELECT 'value_ambiguous_date', 'dateOfBirth', 'dmy,mdy', 0.55 FROM c WHERE a <> b)
SELECT kind, field, options, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n FROM e GROUP BY ALL""",
    "tail_views": "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events ORDER BY ts DESC, event_id DESC LIMIT 30",
    "upsert_latest": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "recent_topk": "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, 'c' || o_custkey AS client_name, o_orderstatus AS status, CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders ORDER BY o_orderdate DESC, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') LIMIT 12",
    "event_ring": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 80",
    "currency_default": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'USD' WHEN c_custkey % 3 <> 0 THEN 'INR' ELSE '' END AS currency, CASE WHEN c_custkey % 4 = 0 THEN 0.94 WHEN c_custkey % 3 <> 0 THEN 0.7 ELSE 1 END::DOUBLE AS confidence FROM customer",
    "delta_rule_threshold": """
SELECT 'Strip employee prefix' AS title, 'employeeNumber, managerEmployeeNumber' AS applies_to, 'inferred' AS origin FROM supplier WHERE s_suppkey % 2 = 0 HAVING count(*) >= 3
UNION ALL SELECT 'Permanent is full_time', 'employmentType', 'inferred' UNION ALL SELECT 'Default currency INR', 'currency', 'inferred'""",
    "json_roundtrip": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "clean_records": f"WITH {_MERGED} SELECT \"employeeNumber\" FROM merged WHERE flags = ''",
}
