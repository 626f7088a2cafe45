"""DuckDB statements that give the same rows as the registered queries.

Where a query parses text that was written from base columns, the statement reads those columns
directly, so the check is a round trip and not a second parser.
"""

from __future__ import annotations

# Values of the derived resumes, straight from `orders`.
_RESUME = """
b AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderpriority AS pr,
         strftime(o_orderdate, '%b %Y') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d,
         't' || (o_custkey % 7) AS "tenantId", 'j' || o_orderkey AS "jobId"
  FROM orders),
rl AS (SELECT b.*, CAST(r.r AS BIGINT) AS r FROM b, (VALUES (0), (1), (2)) r(r) WHERE r.r < k % 4),
bl AS (
  SELECT rl.*, x.b AS bno,
    CASE WHEN k % 17 = 5 AND x.b = 0 THEN rtrim(repeat('long text ', 60))
         ELSE 'Shipped ' || ((k * (r + 1) + x.b * 7) % 90 + 1) || ' units for client ' || c ||
              CASE WHEN x.b = 1 THEN ' with extra care and planning for every single site' ELSE '' END END AS text
  FROM rl, (VALUES (0), (1), (2)) x(b) WHERE x.b < (k + r) % 4
  UNION ALL
  SELECT rl.*, 9, 'Handled returns' FROM rl WHERE k % 5 = 0),
u AS (SELECT k, CASE WHEN k % 8 = 2 THEN 1 ELSE 0 END AS untitled FROM b),
roles AS (
  SELECT "tenantId", "jobId", rl.k, r + untitled AS role_no,
    CASE WHEN r = 0 THEN pr || ' lead' ELSE pr || ' clerk' END AS title,
    CASE WHEN r = 0 THEN 'Desk#' || c || ' - ' || m || ' – Present' ELSE 'Dock ' || r || ' ' || m || ' - ' || m END AS company,
    m AS "startDate", CASE WHEN r = 0 THEN 'Present' ELSE m END AS "endDate"
  FROM rl JOIN u USING (k)
  UNION ALL
  SELECT "tenantId", "jobId", k, 0, NULL, NULL, NULL, NULL FROM b WHERE k % 8 = 2),
bullets AS (
  SELECT "tenantId", "jobId", bl.k, r + untitled AS role_no,
         row_number() OVER (PARTITION BY bl.k, r ORDER BY bno) - 1 AS bullet_no, text
  FROM bl JOIN u USING (k)
  UNION ALL SELECT "tenantId", "jobId", k, 0, 0, 'Worked freelance' FROM b WHERE k % 8 = 2
  UNION ALL SELECT "tenantId", "jobId", k, 0, 1, 'Built ' || k || ' boards' FROM b WHERE k % 8 = 2),
skills AS (
  SELECT "tenantId", "jobId", k, unnest(s) AS skill, generate_subscripts(s, 1) - 1 AS skill_pos FROM (
    SELECT *, list_concat(
      CASE k % 4 WHEN 0 THEN ['SQL', 'Python'] WHEN 1 THEN ['Python', 'Excel', 'SQL']
                 WHEN 2 THEN ['excel', 'Planning'] ELSE ['SQL', 'Rust', 'SQL'] END,
      ['Audit ' || (k % 50) || ' depots']) AS s
    FROM b WHERE k % 11 <> 0)),
summaries AS (
  SELECT b.*, 'Buyer ' || c || ' grew ' || pr || ' accounts. Closed ' || p || ' in sales.' ||
    CASE WHEN k % 7 = 0 THEN ' Write buyer' || c || '@mail.example' ELSE '' END ||
    CASE WHEN k % 13 = 0 THEN ' Call 415-555-' || lpad(CAST(c % 10000 AS VARCHAR), 4, '0') ELSE '' END AS summary
  FROM b)
"""

# Values of the derived job descriptions, straight from `part`.
_JD = """
jb AS (
  SELECT p_partkey AS pk, p_name AS name, p_brand AS brand, p_type AS ty, p_size AS size FROM part),
jd AS (
  SELECT *,
    CASE WHEN pk % 3 = 0 THEN ty || ' ' || name || ' planner wanted' ELSE 'Role: ' || ty || ' ' || name || ' planner' END AS first_line,
    'Team moves ' || name || ' stock.' AS team_line,
    CASE WHEN pk % 4 = 1 THEN 'What You''ll Do' ELSE 'Responsibilities' END AS h1,
    CASE WHEN pk % 4 = 2 THEN 'Key Requirements' ELSE 'Qualifications' END AS h2,
    ['Plan ' || brand || ' shipments', 'Audit ' || size || ' depots'] AS responsibilities,
    ['Knows ' || ty || ' stock', size || ' years of ' || name || ' trade'] AS requirements,
    CASE WHEN pk % 5 = 0 THEN NULL ELSE
      ['SQL', 'Python'] || CASE WHEN pk % 2 = 0 THEN ['Excel'] ELSE [] END || CASE WHEN pk % 7 = 0 THEN [brand] ELSE [] END
    END AS listed
  FROM jb),
jds AS (
  SELECT *, CASE WHEN listed IS NOT NULL THEN listed ELSE
      list_sort(list_distinct(list_filter(
        regexp_extract_all(array_to_string([first_line, team_line, h1] || responsibilities || [h2] || requirements, chr(10)), '[A-Za-z+#]{2,}'),
        lambda w: regexp_matches(w, '^[A-Z]|^[A-Z+#]*[A-Z][A-Z+#]*$')))) END AS skills,
    CASE WHEN pk % 6 = 0 THEN 'Head of ' || name WHEN pk % 3 = 0 THEN 'Unknown Role' ELSE ty || ' ' || name || ' planner' END AS title,
    CASE WHEN pk % 2 = 0 THEN ty ELSE 'Unknown' END AS industry,
    first_line || ' ' || team_line AS summary
  FROM jd)
"""

# Token helpers as macros would be shared state, so they are spelled out per statement.
_TOKENS = (
    "list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(lower({0}), '[[:punct:]]', ' ', 'g'), "
    "'[ \\t\\n\\r]+'), lambda w: w <> ''), lambda w: "
    "CASE WHEN w LIKE '%ing' AND length(w) > 4 THEN left(w, length(w) - 3) "
    "WHEN w LIKE '%ed' AND length(w) > 3 THEN left(w, length(w) - 2) "
    "WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, length(w) - 2) "
    "WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END))"
)
_WORDS = "list_filter(string_split_regex({0}, '[ \\t\\n\\r]+'), lambda w: w <> '')"
_SYLLABLES = (
    "CAST(coalesce(list_sum(list_transform({0}, lambda w: greatest(1, "
    "len(regexp_extract_all(lower(w), '[aeiouy]+')) - CASE WHEN lower(w) LIKE '%e' AND "
    "len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))), 0) AS BIGINT)"
)


def tokens(expr: str) -> str:
    return _TOKENS.format(expr)


def words(expr: str) -> str:
    return _WORDS.format(expr)


def syllables(word_list: str) -> str:
    return _SYLLABLES.format(word_list)


def _score(hits: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 1.0 ELSE round({hits}::DOUBLE / {total}, 3) END"


ORACLES: dict[str, str] = {}

# --- lines, sections, parsing ---------------------------------------------

ORACLES["line_explode"] = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS line_no, line FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, trim(unnest(l), E' \\t\\r\\n') AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''
"""

ORACLES["resume_roles"] = f"""
WITH {_RESUME}
SELECT r."tenantId", r."jobId", CAST(r.role_no AS INTEGER) AS role_no, title, company, "startDate", "endDate",
       CAST(count(x.text) AS INTEGER) AS achievements
FROM roles r LEFT JOIN bullets x ON r.k = x.k AND r.role_no = x.role_no
GROUP BY ALL
"""

ORACLES["resume_bullets"] = f"""
WITH {_RESUME}
SELECT "tenantId", "jobId", CAST(role_no AS INTEGER) AS role_no, CAST(bullet_no AS INTEGER) AS bullet_no, text FROM bullets
"""

ORACLES["resume_sections"] = f"""
WITH {_RESUME},
e AS (SELECT "tenantId", "jobId", 'education' AS section, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS lines FROM b),
s AS (SELECT "tenantId", "jobId", 'skills' AS section, count(*) AS lines FROM skills GROUP BY ALL),
m AS (SELECT "tenantId", "jobId", 'summary' AS section, 2 AS lines FROM b),
p AS (SELECT "tenantId", "jobId", 'projects' AS section, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS lines FROM b WHERE k % 3 < 2),
x AS (
  SELECT "tenantId", "jobId", 'experience' AS section, sum(n) AS lines FROM (
    SELECT "tenantId", "jobId", count(*) AS n FROM rl GROUP BY ALL
    UNION ALL SELECT "tenantId", "jobId", count(*) FROM bl GROUP BY ALL
    UNION ALL SELECT "tenantId", "jobId", CASE WHEN k % 8 = 1 THEN 1 ELSE 2 END FROM b WHERE k % 8 IN (1, 2)) GROUP BY ALL)
SELECT "tenantId", "jobId", section, CAST(lines AS BIGINT) AS lines FROM (
  SELECT * FROM e UNION ALL SELECT * FROM s UNION ALL SELECT * FROM m UNION ALL SELECT * FROM p UNION ALL SELECT * FROM x)
"""

ORACLES["resume_summary"] = f"""
WITH {_RESUME}
SELECT "tenantId", "jobId", summary, pr || ' buyer' AS role, d AS "updatedAt",
       CASE WHEN k % 2 = 0 THEN 'BSc|MSc Trade' ELSE 'BSc' END AS education,
       coalesce((SELECT string_agg(skill, '|' ORDER BY skill_pos) FROM skills s WHERE s.k = summaries.k), '') AS skills
FROM summaries
"""

ORACLES["projects_fold"] = f"""
WITH {_RESUME}
SELECT "tenantId", "jobId", 'Ledger ' || c AS name, 'moved ' || p || ' rows and kept ' || k || ' books' AS description
FROM b WHERE k % 3 = 0
"""

ORACLES["jd_sections"] = f"""
WITH {_JD},
a AS (
  SELECT pk, 'summary' AS section, [first_line, team_line] AS l FROM jds
  UNION ALL SELECT pk, 'responsibilities', responsibilities FROM jds
  UNION ALL SELECT pk, 'requirements', requirements FROM jds
  UNION ALL SELECT pk, 'skills', listed FROM jds WHERE listed IS NOT NULL)
SELECT pk, section, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM a
"""

ORACLES["jd_canonical"] = f"""
WITH {_JD}
SELECT pk, title, industry, 'Unknown' AS location, 'upload' AS source, summary,
       array_to_string(responsibilities, '|') AS responsibilities, array_to_string(requirements, '|') AS requirements,
       array_to_string(skills, '|') AS skills
FROM jds
"""

ORACLES["derive_skills"] = """
SELECT doc_id, unnest(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z+#]{2,}'),
       lambda w: regexp_matches(w, '^[A-Z]|^[A-Z+#]*[A-Z][A-Z+#]*$'))))) AS skill
FROM documents
"""

# --- style ----------------------------------------------------------------

_UPPER = "regexp_matches(line, '\\p{Lu}') AND NOT regexp_matches(line, '[\\p{Ll}\\p{Lt}]')"
_TITLE = "regexp_matches(line, '^[^\\p{Lu}\\p{Ll}\\p{Lt}]*([\\p{Lu}\\p{Lt}]\\p{Ll}*([^\\p{Lu}\\p{Ll}\\p{Lt}]+|$))+$')"
_STYLE_COUNTS = f"""
  CAST(count(*) FILTER (length(line) <= 40 AND {_UPPER}) AS INTEGER) AS upper_lines,
  CAST(count(*) FILTER (length(line) <= 40 AND NOT ({_UPPER}) AND {_TITLE}) AS INTEGER) AS title_lines
"""
_CASE = (
    "CASE WHEN upper_lines + title_lines = 0 THEN 'sentence' "
    "WHEN upper_lines::DOUBLE / (upper_lines + title_lines) >= 0.6 THEN 'upper' "
    "WHEN title_lines >= (upper_lines + title_lines) * 0.5 THEN 'title' ELSE 'sentence' END"
)

ORACLES["style_signals"] = f"""
WITH l AS (
  SELECT doc_id, trim(unnest(string_split(text, chr(10))), E' \\t\\r\\n') AS line FROM documents),
n AS (SELECT doc_id, count(*) AS n_lines, {_STYLE_COUNTS} FROM l WHERE line <> '' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n.doc_id IS NULL THEN 'sentence' ELSE {_CASE} END AS heading_case,
       CASE WHEN coalesce(n_lines, 0) > 120 THEN 'condensed' WHEN coalesce(n_lines, 0) < 60 THEN 'spacious' ELSE 'balanced' END AS layout_density
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
"""

# headings of each derived resume in text order, and the first bullet sign
ORACLES["style_profile"] = f"""
WITH {_RESUME},
h AS (
  SELECT b.*,
    (CASE WHEN k % 10 = 3 THEN [] ELSE ['experience'] END) || ['education'] ||
    (CASE WHEN k % 11 = 0 THEN [] ELSE ['skills'] END) || (CASE WHEN k % 3 < 2 THEN ['projects'] ELSE [] END) AS detected
  FROM b)
SELECT "tenantId", "jobId",
  array_to_string(CASE WHEN k % 4 = 0 THEN list_concat(['skills', 'summary'], list_filter(detected, lambda s: s NOT IN ('skills', 'summary'))) ELSE detected END, ',') AS section_order,
  CASE WHEN k % 8 = 1 THEN 'dash'
       WHEN k % 8 = 2 OR EXISTS (SELECT 1 FROM bl WHERE bl.k = h.k AND bno < 9) THEN ['dash', 'bullet', 'asterisk'][CAST(k % 3 AS INTEGER) + 1]
       ELSE 'bullet' END AS bullet_style,
  CASE WHEN k % 5 = 0 THEN 'Arial' ELSE 'Calibri' END AS font_family,
  CASE k % 3 WHEN 0 THEN 22 WHEN 1 THEN 26 ELSE 22 END AS font_size,
  'spacious' AS layout_density
FROM h
"""

# --- personal data --------------------------------------------------------

_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_PHONE = "\\b(?:\\+?\\d{1,3})?[\\s-]?\\(?\\d{3}\\)?[\\s-]?\\d{3}[\\s-]?\\d{4}\\b"

ORACLES["pii_flags"] = f"""
SELECT doc_id, regexp_matches(text, '{_EMAIL}') AS has_email, regexp_matches(text, '{_PHONE}') AS has_phone FROM documents
"""

ORACLES["pii_redact"] = f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '{_EMAIL}', '[REDACTED]', 'g'), '{_PHONE}', '[REDACTED]', 'g') AS text
FROM documents
"""

ORACLES["span_redact"] = """
SELECT doc_id, '[REDACTED]' || CASE WHEN length(text) > 10 THEN substring(text, 6, length(text) - 10) ELSE '' END || '[REDACTED]' AS text
FROM documents WHERE length(text) >= 10
UNION ALL SELECT doc_id, text FROM documents WHERE length(text) < 10
"""

# --- scalars --------------------------------------------------------------

ORACLES["tokens"] = f"SELECT doc_id, unnest({tokens('text')}) AS token FROM documents"

ORACLES["token_norm"] = f"""
SELECT token, count(*) AS texts FROM (
  SELECT unnest({tokens('text')}) AS token FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)
) GROUP BY token
"""

ORACLES["readability"] = f"""
WITH w AS (SELECT doc_id, text, {words('text')} AS ws FROM documents),
n AS (SELECT doc_id, CAST(len(ws) AS INTEGER) AS words, CAST(greatest(length(text) - length(replace(text, '.', '')), 1) AS INTEGER) AS sentences,
             CAST({syllables('ws')} AS INTEGER) AS syllables FROM w)
SELECT doc_id, words, sentences, syllables FROM n
"""

ORACLES["escape_xml"] = """
SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM pages
"""

ORACLES["title_case"] = """
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || ' ' || p_brand || ' o''neil', '[A-Za-z]+|[^A-Za-z]+'),
       lambda w: upper(left(w, 1)) || lower(substring(w, 2))), '') AS titled FROM part
"""

# --- skills and chunks ----------------------------------------------------

ORACLES["skill_aggregate"] = f"""
WITH {_RESUME}, {_JD},
s AS (
  SELECT "tenantId", "jobId", 'base' AS source, skill FROM skills
  UNION ALL SELECT "tenantId", "jobId", 'job', unnest(jds.skills) FROM b JOIN jds ON b.c = jds.pk),
n AS (SELECT "tenantId", "jobId", lower(trim(skill)) AS skill, source FROM s),
g AS (SELECT "tenantId", "jobId", skill, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS frequency FROM n GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY "tenantId", "jobId" ORDER BY frequency DESC, skill) - 1 AS INTEGER) AS skill_no FROM g
"""

ORACLES["corpus_skills"] = """
WITH s AS (
  SELECT source, unnest(regexp_extract_all(text, '[A-Za-z+#]{2,}')) AS w, lang FROM documents),
n AS (SELECT lang, lower(w) AS skill, source FROM s WHERE regexp_matches(w, '^[A-Z]|^[A-Z+#]*[A-Z][A-Z+#]*$'))
SELECT lang, skill, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS frequency FROM n GROUP BY lang, skill
"""

ORACLES["chunk_dedup"] = """
SELECT source, text, CAST(score AS DOUBLE) AS score, first_seen, best_doc FROM (
  SELECT source, text, n_chars % 97 AS score, doc_id AS best_doc, min(doc_id) OVER (PARTITION BY source, text) AS first_seen,
         row_number() OVER (PARTITION BY source, text ORDER BY n_chars % 97 DESC, doc_id) AS rn
  FROM documents) WHERE rn = 1
"""

ORACLES["topk_chunks"] = """
WITH d AS (
  SELECT source, text, max(n_chars % 97) AS score, min(doc_id) AS first_seen FROM documents GROUP BY source, text)
SELECT source, first_seen, CAST(score AS DOUBLE) AS score, CAST(chunk_no AS INTEGER) AS chunk_no FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, first_seen) AS chunk_no FROM d) WHERE chunk_no <= 20
"""

# --- nearest neighbours and retrieval -------------------------------------

_COS = "round(list_cosine_similarity(q.e, v.e), 12)"
_VEC = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"

ORACLES["knn_cosine"] = f"""
WITH {_VEC},
p AS (SELECT q.label, q.vec_id AS query_id, v.vec_id AS doc_id, {_COS} AS s FROM e q JOIN e v ON q.label = v.label)
SELECT label, query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY s DESC, doc_id) AS rank FROM p) WHERE rank <= 10
"""

ORACLES["knn_cross_tenant"] = f"""
WITH {_VEC},
p AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_COS} AS s FROM e q, e v)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM p) WHERE rank <= 10
"""

ORACLES["knn_index"] = f"""
WITH {_VEC},
p AS (SELECT q.label, q.vec_id AS query_id, v.vec_id AS doc_id, {_COS} AS s FROM e q JOIN e v ON q.label = v.label)
SELECT 't' || label AS "tenantId", query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY s DESC, doc_id) AS rank FROM p) WHERE rank <= 10
"""

ORACLES["knn_index_recall"] = """
SELECT 't' || label AS "tenantId", CAST(count(*) * least(10, count(*)) AS BIGINT) AS neighbours, true AS recalled
FROM embeddings WHERE label IS NOT NULL GROUP BY label
"""

_CONTEXT = f"""
WITH {_VEC},
v AS (SELECT 't' || (e.vec_id % 3) AS "tenantId", 'd' || lpad(CAST(e.vec_id AS VARCHAR), 9, '0') AS id, e.e, coalesce(d.text, '') AS text
      FROM e LEFT JOIN documents d ON d.doc_id = e.vec_id),
q AS (SELECT 't' || (vec_id // 3 % 3) AS "tenantId", 'j' || (vec_id // 3) AS "jobId", vec_id % 3 AS query_no, e FROM e),
p AS (SELECT q."tenantId", q."jobId", q.query_no, v.id, v.text, {_COS} AS s FROM q JOIN v ON q."tenantId" = v."tenantId"),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "tenantId", "jobId", query_no ORDER BY s DESC, id) AS rank FROM p) WHERE rank <= 10),
f AS (
  SELECT 't' || (user_id % 3) AS "tenantId", 'j' || user_id AS "jobId", 'j' || user_id || '#' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS id,
         event_type || ' ' || (event_id % 4) AS text, value / 100.0 AS s FROM events),
c AS (
  SELECT "tenantId", "jobId", text, s, 'q' || lpad(CAST(query_no AS VARCHAR), 10, '0') || '#' || lpad(CAST(rank AS VARCHAR), 10, '0') AS arrival, id FROM h
  UNION ALL SELECT f."tenantId", f."jobId", text, s, 'r#' || id, id FROM f
  SEMI JOIN q ON f."tenantId" = q."tenantId" AND f."jobId" = q."jobId"),
r AS (
  SELECT *, row_number() OVER (PARTITION BY "tenantId", "jobId", text ORDER BY s DESC, arrival) AS rn,
         min(arrival) OVER (PARTITION BY "tenantId", "jobId", text) AS first_seen FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY "tenantId", "jobId" ORDER BY s DESC, first_seen) AS chunk_no FROM r WHERE rn = 1)
"""

ORACLES["retrieve_context"] = _CONTEXT + """
SELECT "tenantId", "jobId", CAST(chunk_no AS INTEGER) AS chunk_no, id, text FROM t WHERE chunk_no <= 20
"""

ORACLES["context_details"] = _CONTEXT + """
SELECT t."tenantId", t."jobId", CAST(chunk_no AS INTEGER) AS chunk_no, t.id, CAST(round(s * 10000) AS INTEGER) AS score_e4,
       coalesce(d.source, '') AS source, coalesce(e.event_type, '') AS tags
FROM t LEFT JOIN documents d ON t.id[1] = 'd' AND d.doc_id = TRY_CAST(substr(t.id, 2) AS BIGINT)
LEFT JOIN events e ON t.id[1] = 'j' AND e.event_id = TRY_CAST(split_part(t.id, '#', 2) AS BIGINT)
WHERE chunk_no <= 20
"""

ORACLES["context_coverage"] = _CONTEXT + """
, g AS (
  SELECT DISTINCT 't' || (vec_id // 3 % 3) AS "tenantId", 'j' || (vec_id // 3) AS "jobId" FROM embeddings WHERE vec_id % 3 = 0),
x AS (
  SELECT "tenantId", "jobId", count(*) AS n, string_agg(lower(text), chr(10)) AS body FROM t WHERE chunk_no <= 20 GROUP BY ALL)
SELECT g."tenantId", g."jobId", CAST(coalesce(n, 0) AS INTEGER) AS chunks,
       (contains(body, 'error')::INT + contains(body, 'purchase')::INT) / 2.0::DOUBLE AS requirements,
       (contains(body, 'view 1')::INT + contains(body, 'nowhere')::INT) / 2.0::DOUBLE AS responsibilities,
       contains(body, 'click')::INT::DOUBLE AS skills
FROM g LEFT JOIN x USING ("tenantId", "jobId")
"""

ORACLES["feedback_prefix"] = """
SELECT 't' || (user_id % 3) AS "tenantId", 'j' || user_id AS "jobId", count(*) AS items, max(value / 100.0) AS best
FROM events GROUP BY ALL
"""

# --- coverage -------------------------------------------------------------

ORACLES["substring_coverage"] = f"""
WITH h AS (SELECT b.item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text))) AS hit FROM benchmark b)
SELECT count(*) AS total, count(*) FILTER (hit) AS hits, {_score("count(*) FILTER (hit)", "count(*)")} AS score FROM h
"""

ORACLES["substring_items"] = """
SELECT d.source, b.item_id, count(*) AS texts FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY ALL
"""

ORACLES["chunk_coverage"] = f"""
WITH {_RESUME}, {_JD},
st AS (SELECT k, string_agg(skill, ' ' ORDER BY skill_pos) AS t FROM skills GROUP BY k),
ch AS (SELECT s.k, s.c, coalesce(lower(t), '') AS a, lower(summary) AS z FROM summaries s LEFT JOIN st USING (k)),
it AS (
  SELECT pk, 'requirements' AS kind, unnest(requirements) AS item FROM jds
  UNION ALL SELECT pk, 'responsibilities', unnest(responsibilities) FROM jds UNION ALL SELECT pk, 'skills', unnest(skills) FROM jds),
h AS (SELECT k, kind, round(count(*) FILTER (contains(a, lower(item)) OR contains(z, lower(item)))::DOUBLE / count(*), 3) AS s
      FROM ch JOIN it ON ch.c = it.pk GROUP BY ALL)
SELECT *, round((requirements + responsibilities + skills) / 3, 3) AS mean FROM (
  SELECT "tenantId", "jobId", max(s) FILTER (kind = 'requirements') AS requirements, max(s) FILTER (kind = 'responsibilities') AS responsibilities,
         max(s) FILTER (kind = 'skills') AS skills FROM h JOIN b USING (k) GROUP BY ALL)
"""

_TURNS = f"""
WITH have AS (SELECT DISTINCT conv_id, unnest({tokens('text')}) AS token FROM conversations WHERE role = 'assistant'),
want AS (SELECT conv_id, turn AS target_id, text, {tokens('text')} AS ts FROM conversations WHERE role <> 'assistant'),
x AS (SELECT conv_id, target_id, unnest(ts) AS token FROM want),
n AS (SELECT x.conv_id, x.target_id, count(*) AS n_tokens, count(h.token) AS n_hits FROM x LEFT JOIN have h ON x.conv_id = h.conv_id AND x.token = h.token GROUP BY ALL),
c AS (SELECT w.conv_id, w.target_id, w.text, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_hits, 0) AS n_hits, coalesce(n_tokens > 0 AND n_hits = n_tokens, false) AS covered
      FROM want w LEFT JOIN n ON w.conv_id = n.conv_id AND w.target_id = n.target_id)
"""

ORACLES["token_coverage"] = _TURNS + """
SELECT conv_id, target_id, n_tokens, n_hits, covered FROM c
"""

ORACLES["missing_targets"] = _TURNS + """
SELECT conv_id, target_id, text FROM c WHERE NOT covered
"""

ORACLES["keyword_coverage"] = f"""
WITH have AS (SELECT DISTINCT conv_id, unnest({tokens('text')}) AS token FROM conversations WHERE role = 'assistant'),
k AS (SELECT DISTINCT conv_id, unnest({words("text")}) AS keyword FROM conversations WHERE role <> 'assistant'),
want AS (SELECT conv_id, keyword, {tokens('keyword')} AS ts FROM k),
x AS (SELECT conv_id, keyword, unnest(ts) AS token FROM want),
n AS (SELECT x.conv_id, x.keyword, count(*) = count(h.token) AS covered FROM x LEFT JOIN have h ON x.conv_id = h.conv_id AND x.token = h.token GROUP BY ALL),
a AS (SELECT k.conv_id, k.keyword, coalesce(covered, false) AS covered FROM k LEFT JOIN n ON n.conv_id = k.conv_id AND n.keyword = k.keyword)
SELECT conv_id, count(*) AS total, count(*) FILTER (covered) AS hits, {_score("count(*) FILTER (covered)", "count(*)")} AS score FROM a GROUP BY conv_id
"""

ORACLES["unsupported"] = """
SELECT item_id, text FROM benchmark b
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text)))
"""

ORACLES["banned_claims"] = """
WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part)
SELECT d.doc_id, k.keyword FROM documents d JOIN k ON contains(lower(d.text), lower(k.keyword))
"""

# --- scores ---------------------------------------------------------------

ORACLES["bullet_consistency"] = f"""
WITH {_RESUME},
l AS (SELECT "tenantId", "jobId", k, len(string_split(text, ' ')) AS n FROM bullets),
m AS (SELECT *, avg(n) OVER (PARTITION BY k) AS mean FROM l),
g AS (SELECT "tenantId", "jobId", k, count(*) AS bullets, count(*) FILTER (abs(n - mean) <= greatest(mean * 0.6, 3)) AS near FROM m GROUP BY ALL)
SELECT b."tenantId", b."jobId", coalesce(bullets, 0) AS bullets, coalesce(round(near::DOUBLE / bullets, 3), 0.0) AS consistency
FROM b LEFT JOIN g USING (k)
"""

ORACLES["turn_consistency"] = f"""
WITH l AS (SELECT conv_id, len({words('text')}) AS n FROM conversations),
m AS (SELECT *, avg(n) OVER (PARTITION BY conv_id) AS mean FROM l)
SELECT conv_id, CAST(count(*) AS BIGINT) AS bullets, CAST(count(*) FILTER (abs(n - mean) <= greatest(mean * 0.6, 3)) AS BIGINT) AS near FROM m GROUP BY conv_id
"""

_EVAL = f"""
WITH {_RESUME}, {_JD},
rt AS (
  SELECT k, unnest({tokens('t')}) AS token FROM (
    SELECT k, summary AS t FROM summaries UNION ALL SELECT k, text FROM bullets UNION ALL SELECT k, skill FROM skills
    UNION ALL SELECT k, 'Ledger ' || c || ' moved ' || p || ' rows and kept ' || k || ' books' FROM b WHERE k % 3 = 0)),
have AS (SELECT DISTINCT k, token FROM rt),
tg AS (
  SELECT k, pos, target FROM (
    SELECT k, generate_subscripts(l, 1) AS pos, unnest(l) AS target FROM (
      SELECT b.k, requirements || responsibilities || jds.skills AS l FROM b JOIN jds ON b.c = jds.pk))),
kw AS (
  SELECT k, pos, target FROM (
    SELECT k, generate_subscripts(l, 1) AS pos, unnest(l) AS target FROM (SELECT b.k, jds.skills AS l FROM b JOIN jds ON b.c = jds.pk))),
tt AS (SELECT DISTINCT target, unnest({tokens('target')}) AS token FROM (SELECT target FROM tg UNION SELECT target FROM kw)),
tc AS (SELECT tg.k, tg.pos, tg.target, count(*) = count(h.token) AS ok FROM tg JOIN tt USING (target) LEFT JOIN have h ON h.k = tg.k AND h.token = tt.token GROUP BY ALL),
kc AS (SELECT kw.k, kw.pos, kw.target, count(*) = count(h.token) AS ok FROM kw JOIN tt USING (target) LEFT JOIN have h ON h.k = kw.k AND h.token = tt.token GROUP BY ALL),
ts AS (SELECT k, count(*) AS targets, count(*) FILTER (ok) AS "targetHits", coalesce(string_agg(target, '|' ORDER BY pos) FILTER (NOT ok), '') AS missing FROM tc GROUP BY k),
ks AS (SELECT k, count(*) AS keywords, count(*) FILTER (ok) AS "keywordHits", coalesce(string_agg(target, '|' ORDER BY pos) FILTER (NOT ok), '') AS missing_keywords FROM kc GROUP BY k),
bt AS (SELECT k, string_agg(text, ' ' ORDER BY role_no, bullet_no) AS t, count(*) AS n FROM bullets GROUP BY k),
full_text AS (SELECT s.*, summary || coalesce(' ' || t, '') AS all_text, coalesce(n, 0) AS bullets FROM summaries s LEFT JOIN bt USING (k)),
ub AS (SELECT k, count(*) FILTER (NOT (text = 'Handled returns' AND k % 2 = 0)) AS un FROM bullets GROUP BY k),
fw AS (SELECT f.*, coalesce(un, 0) AS unsupported, {words('all_text')} AS ws FROM full_text f LEFT JOIN ub USING (k))
"""

ORACLES["evaluate_report"] = _EVAL + f"""
SELECT fw."tenantId", fw."jobId", CAST(targets AS INTEGER) AS targets, CAST("targetHits" AS INTEGER) AS "targetHits",
  CAST(keywords AS INTEGER) AS keywords, CAST("keywordHits" AS INTEGER) AS "keywordHits", missing, missing_keywords,
  CAST(unsupported AS INTEGER) AS unsupported,
  round(greatest(0.39 * (len(ws) / greatest(length(all_text) - length(replace(all_text, '.', '')), 1)) + 11.8 * ({syllables('ws')}::DOUBLE / len(ws)) - 15.59, 1.0), 2) AS grade
FROM fw JOIN ts USING (k) JOIN ks USING (k)
"""

ORACLES["quality_gate"] = _EVAL + f"""
SELECT fw."tenantId", fw."jobId",
  round("targetHits"::DOUBLE / targets, 3) >= 0.7 AND round("keywordHits"::DOUBLE / keywords, 3) >= 0.6 AND unsupported = 0 AS passed
FROM fw JOIN ts USING (k) JOIN ks USING (k)
"""

# --- validation -----------------------------------------------------------

_ISSUES = f"""
WITH {_RESUME},
i AS (
  SELECT k, 10 AS o, 0 AS o2, 0 AS o3, 'MISSING_SECTION' AS code, 'Required section ''experience'' is missing' AS message FROM b WHERE k NOT IN (SELECT k FROM roles)
  UNION ALL SELECT k, 11, 0, 0, 'MISSING_SECTION', 'Required section ''skills'' is missing' FROM b WHERE k % 11 = 0
  UNION ALL SELECT r.k, 20, r.role_no, -1, 'EMPTY_ACHIEVEMENTS', 'Experience item ' || r.role_no || ' missing achievements'
    FROM roles r WHERE NOT EXISTS (SELECT 1 FROM bullets x WHERE x.k = r.k AND x.role_no = r.role_no)
  UNION ALL SELECT k, 20, role_no, bullet_no * 2, 'BULLET_TOO_LONG', 'Achievement exceeds 500 characters: ' || left(text, 50) FROM bullets WHERE length(text) > 500
  UNION ALL SELECT k, 20, role_no, bullet_no * 2 + 1, 'NO_METRIC', 'Achievement lacks metric: ' || left(text, 50) FROM bullets WHERE NOT regexp_matches(text, '[0-9]')
  UNION ALL SELECT k, 30, 0, 0, 'NO_SKILLS', 'Skills section is empty' FROM b WHERE k % 11 = 0
  UNION ALL SELECT k, 30, 0, 0, 'DUPLICATE_SKILL', 'Duplicate skills detected: [''' || string_agg(s, ''', ''' ORDER BY s) || ''']' FROM (
    SELECT DISTINCT k, lower(skill) AS s FROM (SELECT k, skill FROM skills GROUP BY k, skill HAVING count(*) > 1)) GROUP BY k
  UNION ALL SELECT k, 40, 0, 0, 'PII_EMAIL', 'Email detected in tailored resume' FROM b WHERE k % 7 = 0
  UNION ALL SELECT k, 41, 0, 0, 'PII_PHONE', 'Phone number detected in tailored resume' FROM b WHERE k % 13 = 0
  UNION ALL SELECT k, 50, 0, 0, 'CHANGE_LOG_FORMAT', 'Change log entry 0 missing type/detail' FROM b WHERE k % 19 = 0
  UNION ALL SELECT k, 50, 0, 1, 'CHANGE_LOG_RATIONALE', 'Change log entry 0 missing rationale' FROM b WHERE k % 23 = 0
  UNION ALL SELECT k, 60, 0, 0, 'COVER_LENGTH', 'Cover letter exceeds 4000 characters' FROM b WHERE k % 29 = 0
  UNION ALL SELECT k, 61, 0, 0, 'COVER_TONE', 'Unsupported tone ''rude''' FROM b WHERE k % 31 = 0 AND (k % 2 = 1 OR k % 29 = 0)
  UNION ALL SELECT k, 70, 0, 0, 'BANNED_CLAIM', 'Banned keyword present: Freelance' FROM b WHERE k % 8 = 2)
"""

ORACLES["validate_issues"] = _ISSUES + """
SELECT "tenantId", "jobId", CAST(row_number() OVER (PARTITION BY i.k ORDER BY o, o2, o3) - 1 AS INTEGER) AS ord, code, message
FROM i JOIN b USING (k)
"""

ORACLES["validate_status"] = _ISSUES + """
, nb AS (SELECT k, count(*) AS n FROM bullets GROUP BY k), ns AS (SELECT k, count(*) AS n FROM skills GROUP BY k)
SELECT "tenantId", "jobId", CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.k = b.k) THEN 'FAILED' ELSE 'PASSED' END AS status,
       CAST(coalesce(nb.n, 0) AS INTEGER) AS bullet_count, CAST(coalesce(ns.n, 0) AS INTEGER) AS skills_count
FROM b LEFT JOIN nb USING (k) LEFT JOIN ns USING (k)
"""

ORACLES["gate"] = _ISSUES + """
SELECT "tenantId", 'render' AS step, count(*) AS jobs FROM b WHERE k NOT IN (SELECT k FROM i) GROUP BY ALL
UNION ALL SELECT "tenantId", 'fail', count(*) FROM b WHERE k IN (SELECT k FROM i) GROUP BY ALL
"""

# --- embedding documents, queries, prompts --------------------------------

_DOCS = f"""
WITH {_RESUME}, {_JD},
bt AS (SELECT k, role_no, string_agg(text, chr(10) ORDER BY bullet_no) AS t FROM bullets GROUP BY ALL),
ab AS (SELECT k, string_agg(text, chr(10) ORDER BY role_no, bullet_no) AS t FROM bullets GROUP BY k),
sk AS (
  SELECT "tenantId", "jobId", skill, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS frequency FROM (
    SELECT "tenantId", "jobId", 'base' AS source, lower(skill) AS skill FROM skills
    UNION ALL SELECT "tenantId", "jobId", 'job', lower(unnest(jds.skills)) FROM b JOIN jds ON b.c = jds.pk
    UNION ALL SELECT v."tenantId", v."jobId", 'validated-0', lower(s.skill) FROM skills s JOIN b v ON v.k = s.k + 1) GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY "tenantId", "jobId" ORDER BY frequency DESC, skill) - 1 AS n FROM sk)
"""

ORACLES["embedding_docs"] = _DOCS + """
SELECT id, text, type, label FROM (
  SELECT "tenantId" || '#' || "jobId" || '#jd' AS id, array_to_string([summary] || requirements || responsibilities, chr(10)) AS text, 'job-description' AS type, title AS label
  FROM b JOIN jds ON b.c = jds.pk
  UNION ALL
  SELECT "tenantId" || '#' || "jobId" || '#base#' || r.role_no, trim(coalesce(title, '') || chr(10) || coalesce(t, ''), chr(10)), 'base-experience', coalesce(company, '')
  FROM roles r LEFT JOIN bt ON r.k = bt.k AND r.role_no = bt.role_no
  UNION ALL
  SELECT v."tenantId" || '#' || v."jobId" || '#validated#0', trim(s.summary || chr(10) || coalesce(t, ''), chr(10)), 'validated-resume', 'validated-0'
  FROM summaries s JOIN b v ON v.k = s.k + 1 LEFT JOIN ab ON ab.k = s.k
  UNION ALL
  SELECT "tenantId" || '#' || "jobId" || '#skill#' || n, skill, 'skill', sources FROM sr)
"""

ORACLES["query_texts"] = _DOCS + """
SELECT "tenantId", "jobId", 0 AS query_no, jds.summary AS text FROM b JOIN jds ON b.c = jds.pk
UNION ALL SELECT "tenantId", "jobId", 1, array_to_string(requirements, chr(10)) FROM b JOIN jds ON b.c = jds.pk
UNION ALL SELECT "tenantId", "jobId", 2, coalesce(t, '') FROM b LEFT JOIN ab USING (k)
"""

ORACLES["embedding_summary"] = _DOCS + """
, parts AS (
  SELECT b."tenantId", b."jobId", '#jd' AS part FROM b JOIN jds ON b.c = jds.pk
  UNION ALL SELECT b."tenantId", b."jobId", '#base#' || r.role_no FROM b JOIN jds ON b.c = jds.pk JOIN roles r ON r.k = b.k
  UNION ALL SELECT b."tenantId", b."jobId", '#validated#0' FROM b JOIN jds ON b.c = jds.pk JOIN b o ON o.k = b.k - 1
  UNION ALL SELECT "tenantId", "jobId", '#skill#' || n FROM sr),
ids AS (SELECT "tenantId", "jobId", "tenantId" || '#' || "jobId" || part AS id FROM parts)
SELECT "tenantId", "jobId", string_agg(id, '|' ORDER BY id) AS vector_ids, CAST(count(*) AS BIGINT) AS document_count,
       'index' AS index_name, 'collection' AS collection, true AS stamped
FROM ids GROUP BY ALL
"""

ORACLES["prompt_rows"] = f"""
WITH {_RESUME}
SELECT "tenantId", "jobId", 'Rewrite the plan {{"alignments": [' || k || ']}} with options {{"tone": "' ||
  CASE WHEN k % 2 = 0 THEN 'formal' ELSE 'professional' END || '", "keywords": ' ||
  CASE WHEN k % 3 = 0 THEN '["' || pr || '"]' ELSE '[]' END || ', "styleGuide": {{}}}}. Answer with JSON {{bullets}}.' AS prompt
FROM b
"""

ORACLES["model_output"] = """
SELECT event_id, props AS text FROM events
"""

ORACLES["model_json"] = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 10 = 0 THEN 'reject' ELSE 'ok' END AS outcome
FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT event_id, -1, 'reject' FROM events WHERE event_id % 10 = 0
"""

# --- rendering ------------------------------------------------------------

_RENDER = f"""
WITH {_RESUME},
st AS (
  SELECT b.*, CASE WHEN k % 3 = 0 THEN 'upper' WHEN k % 3 = 1 THEN 'title' ELSE 'sentence' END AS hc,
         CASE k % 4 WHEN 0 THEN '-' WHEN 1 THEN '*' ELSE '•' END AS sym,
         CASE WHEN k % 2 = 0 THEN ['skills', 'summary', 'experience', 'projects', 'education']
              ELSE ['summary', 'skills', 'experience', 'projects', 'education'] END AS ord
  FROM b),
hd AS (
  SELECT *, CASE WHEN hc = 'upper' THEN upper(n) WHEN hc = 'title' THEN t ELSE n END AS heading FROM (
    SELECT st.*, x.s AS section, x.n, x.t FROM st, (VALUES ('summary', 'Summary', 'Summary'), ('skills', 'Skills', 'Skills'),
      ('experience', 'Experience', 'Experience'), ('projects', 'Projects', 'Projects'), ('education', 'Education', 'Education'), ('change_log', 'Change log', 'Change Log')) x(s, n, t))),
rh AS (
  SELECT r.*, hc, sym, ord,
    CASE WHEN title IS NULL THEN '' ELSE title || ' – ' || company || ' (' || "startDate" || CASE WHEN hc = 'upper' THEN ' - ' ELSE ' – ' END || "endDate" || ')' END AS line
  FROM roles r JOIN st USING (k)),
body AS (
  SELECT k, 0 AS so, 0 AS o1, 0 AS o2, 'header' AS section, 'header' AS kind,
    CASE WHEN hc = 'upper' THEN 'TAILORED RESUME – ' || upper(pr || ' buyer')
         WHEN hc = 'title' THEN 'Tailored Resume – ' || array_to_string(list_transform(regexp_extract_all(pr || ' buyer', '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), '')
         ELSE 'Tailored Resume – ' || pr || ' buyer' END AS line FROM st
  UNION ALL SELECT k, list_position(ord, section), -1, 0, section, 'heading', heading FROM hd
    WHERE section IN ('summary', 'education') OR (section = 'skills' AND k % 11 <> 0) OR (section = 'experience' AND k IN (SELECT k FROM roles)) OR (section = 'projects' AND k % 3 = 0)
  UNION ALL SELECT k, list_position(ord, 'summary'), 0, 0, 'summary', 'body', summary FROM summaries JOIN st USING (k)
  UNION ALL SELECT k, list_position(ord, 'skills'), skill_pos, 0, 'skills', 'bullet', sym || ' ' || skill FROM skills JOIN st USING (k)
  UNION ALL SELECT k, list_position(ord, 'experience'), role_no, -1, 'experience', 'role', line FROM rh
  UNION ALL SELECT k, list_position(ord, 'experience'), role_no, bullet_no, 'experience', 'bullet', sym || ' ' || text FROM bullets JOIN st USING (k)
  UNION ALL SELECT k, list_position(ord, 'projects'), 0, 0, 'projects', 'bullet', sym || ' Ledger ' || c || ': moved ' || p || ' rows and kept ' || k || ' books' FROM st WHERE k % 3 = 0
  UNION ALL SELECT k, list_position(ord, 'education'), 0, 0, 'education', 'bullet', sym || ' BSc' FROM st
  UNION ALL SELECT k, list_position(ord, 'education'), 1, 0, 'education', 'bullet', sym || ' MSc Trade' FROM st WHERE k % 2 = 0
  UNION ALL SELECT k, 9, -1, 0, section, 'heading', heading FROM hd WHERE section = 'change_log' AND k % 6 = 0
  UNION ALL SELECT k, 9, 0, 0, 'change_log', 'bullet', sym || ' bullet: <b>' || k || '</b>' FROM st WHERE k % 6 = 0)
"""

ORACLES["render_lines"] = _RENDER + """
SELECT b."tenantId", b."jobId", CAST(row_number() OVER (PARTITION BY k ORDER BY so, o1, o2) - 1 AS INTEGER) AS line_no, section, kind,
       CASE WHEN kind = 'bullet' THEN '  ' ELSE '' END || line AS text
FROM body JOIN b USING (k)
"""

ORACLES["render_paragraphs"] = _RENDER + """
, dv AS (
  SELECT k, so, o1, 1 AS o2, section, 'divider' AS kind, repeat('―', 20) AS line FROM body WHERE kind = 'heading' AND section <> 'experience' AND k % 10 = 0
  UNION ALL SELECT * FROM body)
SELECT b."tenantId", b."jobId", CAST(row_number() OVER (PARTITION BY k ORDER BY so, o1, o2) - 1 AS INTEGER) AS para_no, section, kind,
  replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS text,
  kind IN ('header', 'heading', 'role') AS bold, greatest(10, CASE WHEN k % 5 = 0 THEN 8 ELSE 22 END + CASE WHEN kind = 'header' THEN 4 ELSE 0 END) AS size,
  CASE WHEN k % 7 = 0 THEN 40 WHEN k % 7 = 1 THEN 120 ELSE 80 END AS spacing_after
FROM dv JOIN b USING (k)
"""

ORACLES["section_order"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'education,skills,summary,experience,projects' ELSE 'summary,skills,experience,projects,education' END AS section_order FROM orders
"""

# --- intake ---------------------------------------------------------------

ORACLES["ingest"] = """
SELECT 't' || (conv_id % 5) AS "tenantId", role AS kind, 't' || (conv_id % 5) || '/' || role || '/' || sha256(text) || '.txt' AS key, text
FROM conversations WHERE turn % 4 <> 3 AND text <> ''
"""

ORACLES["rejects"] = """
SELECT conv_id, turn, CASE WHEN text = '' THEN 'content is required' ELSE 'content is not base64' END AS reason FROM conversations WHERE turn % 4 = 3 OR text = ''
"""

ORACLES["upload_metadata"] = """
SELECT 't' || (conv_id % 5) || '#t' || (conv_id % 5) || '/' || role || '/' || sha256(text) || '.txt' AS "tenantJobId", 'UPLOAD' AS "entityType",
       CASE WHEN turn % 2 = 0 THEN '{"turn":"' || turn || '","kind":"override"}' ELSE '{"kind":"' || role || '","turn":"' || turn || '"}' END AS metadata
FROM conversations WHERE turn % 4 <> 3 AND text <> ''
"""

ORACLES["requests"] = """
SELECT 't' || (o_custkey % 7) AS "tenantId", 'j' || o_orderkey AS "jobId", 'jd/' || o_custkey AS jd_key, 'cv/' || o_orderkey AS resume_key,
       CASE WHEN o_orderkey % 3 = 0 THEN 'style/' || (o_orderkey % 10) END AS style_key
FROM orders WHERE o_orderkey % 9 <> 0
"""

ORACLES["request_rejects"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'tenantId' ELSE '' END AS missing_tenant, CASE WHEN o_orderkey % 9 = 0 THEN 'baseResume' ELSE '' END AS missing_resume
FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey % 9 = 0
"""

ORACLES["resolve_documents"] = """
SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 4 = 0 THEN 'inline ' || o.o_orderkey ELSE d.text END AS text
FROM orders o LEFT JOIN documents d ON d.doc_id = o.o_custkey
WHERE o.o_orderkey % 4 = 0 OR d.text IS NOT NULL
"""

ORACLES["assemble_blocks"] = """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role <> 'system' AND text <> '' GROUP BY conv_id
"""

# --- job state, artifacts, streams ----------------------------------------

_STATUS = """
WITH s AS (
  SELECT 't' || (user_id % 3) AS "tenantId", 'j' || user_id AS "jobId", event_id, epoch_us(ts) // 1000000 AS "updatedAt",
         CASE WHEN event_type = 'purchase' THEN 'RESULT' ELSE 'STATUS' END AS "entityType",
         CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM events)
"""

ORACLES["latest_status"] = _STATUS + """
SELECT "tenantId", "jobId", "entityType", status, event_id, "updatedAt" FROM (
  SELECT *, row_number() OVER (PARTITION BY "tenantId", "jobId", "entityType" ORDER BY "updatedAt" DESC, event_id DESC) AS rn FROM s) WHERE rn = 1
"""

ORACLES["job_status"] = _STATUS + """
, l AS (SELECT "tenantId", "jobId", "entityType", max_by(status, ("updatedAt", status)) AS status FROM s GROUP BY ALL)
SELECT j."tenantId", j."jobId", coalesce(r.status, t.status, 'UNKNOWN') AS status, coalesce(t.status, 'UNKNOWN') AS raw_status
FROM (SELECT 't' || (c_custkey % 3) AS "tenantId", 'j' || c_custkey AS "jobId" FROM customer) j
LEFT JOIN l r ON r."tenantId" = j."tenantId" AND r."jobId" = j."jobId" AND r."entityType" = 'RESULT'
LEFT JOIN l t ON t."tenantId" = j."tenantId" AND t."jobId" = j."jobId" AND t."entityType" = 'STATUS'
"""

ORACLES["stream_upsert"] = ORACLES["latest_status"]

ORACLES["keyed_table"] = ORACLES["latest_status"]

_STUCK = """
WITH s AS (
  SELECT 't' || (user_id % 3) AS t, 'j' || (event_id // 3) AS job, {unit} AS moment, event_type,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM events),
j AS (
  SELECT t, job, max({{'moment': moment, 'status': status}}) FILTER (event_type <> 'purchase') AS latest, bool_or(event_type = 'purchase') AS done
  FROM s GROUP BY ALL)
SELECT t AS "tenantId", job AS "jobId", latest['moment'] AS "{name}" FROM j
WHERE NOT done AND latest['status'] = 'RUNNING' AND latest['moment'] < (SELECT max(moment) FROM s) - {limit}
"""
ORACLES["stuck_jobs"] = _STUCK.format(unit="epoch_us(ts) // 1000000", name="updatedAt", limit=900)
ORACLES["stuck_jobs_stream"] = _STUCK.format(unit="epoch_us(ts) // 1000", name="started_ms", limit=900_000)

ORACLES["retention"] = """
SELECT 't' || (user_id % 3) AS "tenantId", event_id, epoch_us(ts) // 1000000 AS "lastModified" FROM events
WHERE epoch_us(ts) // 1000000 >= 1706659200 - 7 * 86400
"""

ORACLES["expired_artifacts"] = """
SELECT user_id % 3 AS tenant, count(*) AS expired FROM events
WHERE epoch_us(ts) // 1000000 < 1706659200 - 7 * 86400 GROUP BY ALL
"""

ORACLES["stream_retention"] = """
SELECT event_id FROM events WHERE epoch_us(ts) // 1000000 < 1706659200 - 7 * 86400
"""

ORACLES["artifact_manifest"] = """
SELECT 't' || (o_custkey % 7) AS "tenantId", 'j' || o_orderkey AS "jobId", k.key, 1706659200 + 7 * 86400 AS "expiresAt" FROM orders,
LATERAL (SELECT unnest(list_filter([
  't' || (o_custkey % 7) || '/j' || o_orderkey || '/1706659200/tailored_resume.docx', 't' || (o_custkey % 7) || '/j' || o_orderkey || '/1706659200/tailored_resume.pdf',
  't' || (o_custkey % 7) || '/j' || o_orderkey || '/1706659200/change_log.json',
  CASE WHEN o_orderkey % 2 = 0 THEN 't' || (o_custkey % 7) || '/j' || o_orderkey || '/1706659200/cover_letter.json' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 't' || (o_custkey % 7) || '/j' || o_orderkey || '/1706659200/style_profile.json' END], lambda x: x IS NOT NULL)) AS key) k
"""

ORACLES["list_artifacts"] = """
SELECT 't1/j' || o_orderkey || '/1706659200/' || f.f AS key FROM orders, (VALUES ('tailored_resume.docx'), ('tailored_resume.pdf'), ('change_log.json')) f(f)
WHERE o_custkey % 7 = 1
UNION ALL SELECT 't1/j' || o_orderkey || '/1706659200/cover_letter.json' FROM orders WHERE o_custkey % 7 = 1 AND o_orderkey % 2 = 0
UNION ALL SELECT 't1/j' || o_orderkey || '/1706659200/style_profile.json' FROM orders WHERE o_custkey % 7 = 1 AND o_orderkey % 3 = 0
"""

ORACLES["stream_fail_alarm"] = """
SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) // 1000000 AS window_start, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY ALL
"""

# --- conformance and differences ------------------------------------------

ORACLES["schema_check"] = f"""
WITH {_RESUME},
n AS (SELECT k, count(*) * 4 AS problems FROM roles WHERE title IS NULL GROUP BY k)
SELECT "tenantId", "jobId", CAST(coalesce(problems, 0) AS INTEGER) AS problems, problems IS NULL AS conforms FROM b LEFT JOIN n USING (k)
"""

ORACLES["resume_diff"] = f"""
WITH {_RESUME},
o AS (SELECT "tenantId", "jobId", k, skill_pos, skill FROM skills),
t AS (SELECT "tenantId", "jobId", k, skill_pos, CASE WHEN skill_pos = 0 AND k % 2 = 0 THEN upper(skill) ELSE skill END AS skill FROM skills
      UNION ALL SELECT "tenantId", "jobId", k, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 4 IN (0, 2) THEN 3 ELSE 4 END, 'Added' FROM b WHERE k % 3 = 0)
SELECT "tenantId", "jobId", 'skills' AS section, CAST(skill_pos AS VARCHAR) AS slot,
  CASE WHEN o.skill IS NULL THEN 'add' WHEN t.skill IS NULL THEN 'remove' ELSE 'update' END AS action, coalesce(t.skill, '') AS detail
FROM o FULL OUTER JOIN t USING ("tenantId", "jobId", k, skill_pos) WHERE o.skill IS DISTINCT FROM t.skill
UNION ALL SELECT "tenantId", "jobId", 'summary', '0', 'update', 'short' FROM b WHERE k % 5 = 0
UNION ALL SELECT "tenantId", "jobId", 'education', '1', 'remove', '' FROM b WHERE k % 4 = 0
UNION ALL SELECT "tenantId", "jobId", 'role', '1', 'move', pr || ' lead' FROM b WHERE k % 8 = 6
UNION ALL SELECT "tenantId", "jobId", 'role', '1', 'remove', '' FROM b WHERE k % 8 = 3
UNION ALL SELECT "tenantId", "jobId", 'experience', '1.0', 'remove', '' FROM b WHERE k % 8 = 3 AND k % 5 = 0
UNION ALL SELECT "tenantId", "jobId", 'role', '2.title', 'update', pr || ' clerk II' FROM b WHERE k % 8 = 7
UNION ALL SELECT "tenantId", "jobId", 'projects', '0.description', 'update', 'short' FROM b WHERE k % 9 = 0
"""

# --- redaction, style packages, vectors, model answers --------------------

def _redacted(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '{_EMAIL}', '[REDACTED]', 'g'), '{_PHONE}', '[REDACTED]', 'g')"


ORACLES["redact_fields"] = f"""
WITH {_RESUME}, {_JD}
SELECT "tenantId", "jobId", CASE WHEN k % 2 = 0 THEN {_redacted("s.summary")} ELSE s.summary END AS resume_summary,
       CASE WHEN k % 2 = 0 THEN {_redacted("jds.summary")} ELSE jds.summary END AS job_summary
FROM summaries s JOIN jds ON s.c = jds.pk
"""

ORACLES["package_style"] = f"""
WITH {_RESUME}
SELECT "tenantId", "jobId", k % 2 = 0 OR k % 3 = 0 AS packaged, CASE WHEN k % 2 = 0 THEN 'dash' ELSE '' END AS bullet_style,
       CASE WHEN k % 3 = 0 THEN pr || ' buyer' ELSE '' END AS sample_role,
       CASE WHEN k % 3 = 0 AND k % 6 <> 0 THEN 'guide ' || k ELSE '' END AS sample_text,
       CASE WHEN (k % 2 = 0 OR k % 3 = 0) AND k % 5 <> 0 THEN 'style/' || k ELSE '' END AS source_key
FROM b
"""

ORACLES["empty_resumes"] = f"""
WITH {_RESUME}
SELECT "tenantId", "jobId", 'FAILED' AS status, 'EMPTY_RESUME' AS code FROM b WHERE k % 3 = 0
"""

ORACLES["embed_texts"] = f"""
SELECT "tenantId", "jobId", query_no, CAST(length(text) AS INTEGER) AS n_chars,
       CAST(length(text) - length(replace(text, ' ', '')) AS INTEGER) AS blanks
FROM ({ORACLES["query_texts"]}) WHERE text <> ''
"""

ORACLES["upsert_vectors"] = """
SELECT 't' || (vec_id % 3) AS "tenantId", 'd' || vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'second' ELSE 'first' END AS text,
       CAST(CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM embeddings
"""

ORACLES["generation_result"] = f"""
WITH {_RESUME}
SELECT "tenantId", "jobId", CASE WHEN k % 10 = 0 THEN '' ELSE 'Resume ' || k END AS summary,
       CAST(CASE WHEN k % 10 <> 0 AND k % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS changes,
       CASE WHEN k % 10 <> 0 AND k % 2 = 0 THEN 'Letter ' || k ELSE '' END AS letter,
       CASE WHEN k % 10 = 0 THEN 'reject' ELSE 'ok' END AS outcome
FROM b
"""

ORACLES["embed_once"] = ORACLES["embed_texts"]

ORACLES["generation_rejects"] = f"""
WITH {_RESUME}
SELECT "tenantId", "jobId",
       CASE WHEN k % 10 = 3 THEN 'experience_alignment' WHEN k % 7 = 2 THEN 'consistency_check' ELSE 'finished' END AS outcome,
       CASE WHEN k % 10 = 3 THEN 'I cannot do that' WHEN k % 7 = 2 THEN '{{"tailoredResume": ' || k ELSE 'Resume ' || k END AS summary
FROM b
"""

for _name in ("substring_coverage", "substring_items", "unsupported", "banned_claims"):
    ORACLES[f"{_name}_index"] = ORACLES[_name]

ORACLES["alarm_once"] = """
SELECT DISTINCT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) // 1000000 AS window_start FROM events WHERE event_type = 'error'
"""

ORACLES["file_documents"] = """
SELECT item_id, CASE WHEN item_id % 7 = 3 OR (item_id % 7 <> 6 AND item_id % 5 <> 4) THEN 'found'
                     WHEN item_id % 7 = 6 THEN 'document pointer must include either text or s3Key' ELSE 'object not found' END AS outcome,
       CASE WHEN item_id % 7 = 3 THEN sha256('inline ' || item_id)
            WHEN item_id % 7 <> 6 AND item_id % 5 <> 4 THEN sha256(rtrim(text, chr(10))) ELSE '' END AS text_sha256
FROM benchmark
UNION ALL SELECT item_id, 'not UTF-8', '' FROM benchmark WHERE item_id % 5 = 4
"""

ORACLES["eval_inputs"] = """
SELECT 'j' || item_id AS "jobId", 'input' AS outcome, CAST(length(text) AS INTEGER) AS chars, 0 AS n FROM benchmark
WHERE item_id % 5 <> 4 AND item_id % 11 <> 7 AND item_id % 3 <> 0
UNION ALL SELECT '', 'job: no valid JSON', 0, CAST(count(*) AS INTEGER) FROM benchmark WHERE item_id % 5 = 4
UNION ALL SELECT '', 'job: tenantId and jobId are required', 0, CAST(count(*) AS INTEGER) FROM benchmark WHERE item_id % 5 <> 4 AND item_id % 11 = 7
UNION ALL SELECT '', 'resume: tenantId and jobId are required', 0, CAST(count(*) AS INTEGER) FROM benchmark WHERE item_id % 3 <> 0 AND item_id % 11 = 7
"""

ORACLES["prompt_files"] = """
SELECT 'prompt_' || n_nationkey AS name, n_name AS description, 'Ask {' || n_name || '}' AS template,
       CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS stops FROM nation
"""

ORACLES["json_artifacts"] = f"""
WITH {_RESUME},
r AS (SELECT 'first' AS run, * FROM b UNION ALL SELECT 'second', * FROM b WHERE k % 4 = 0)
SELECT run, "tenantId", "jobId", 'change_log' AS kind, 'log ' || k AS body FROM r
UNION ALL SELECT run, "tenantId", "jobId", 'style_profile', 'style' FROM r WHERE k % 2 = 0
UNION ALL SELECT run, "tenantId", "jobId", 'cover_letter', 'letter' FROM r WHERE k % 3 = 0
"""

ORACLES["execution_inputs"] = """
SELECT 't' || (c_custkey % 3) AS "tenantId", CASE WHEN c_custkey % 2 = 1 THEN 'job-' ELSE 'plain-' END || c_custkey AS "jobId",
       CASE WHEN c_custkey % 2 = 1 THEN 'formal' ELSE c_mktsegment END AS tone,
       CASE WHEN c_custkey % 4 = 1 THEN 'jobDescription and baseResume inputs are required' ELSE '' END AS reason
FROM customer
"""
