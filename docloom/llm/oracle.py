"""SQL, for DuckDB, of the training-data queries that SQL can express."""

P1 = r"""
SELECT DISTINCT section_id FROM sections
WHERE length(coalesce(heading, '') || chr(10) || coalesce(raw_content, '')) > 2000
"""

P1_REBUILT = r"""
SELECT DISTINCT section_id, md5(coalesce(heading, '') || chr(10) || coalesce(raw_content, '')) AS digest, true AS fits FROM sections
WHERE length(coalesce(heading, '') || chr(10) || coalesce(raw_content, '')) > 2000
"""

P5_LINES = r"""
WITH s AS (
  SELECT section_id, file_path, string_split(raw_content, chr(10)) AS parts,
         lower(regexp_extract(page_url, '//(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS site
  FROM sections WHERE page_url IS NOT NULL),
n AS (SELECT DISTINCT section_id, file_path, site, parts, unnest(range(1, len(parts) + 1)) AS line_no FROM s WHERE site <> ''),
l AS (SELECT section_id, file_path, site, line_no, lower(regexp_replace(parts[line_no], '\P{L}+', '', 'g')) AS letters FROM n),
k AS (SELECT * FROM l WHERE length(letters) >= 20),
sizes AS (SELECT site, count(DISTINCT file_path) AS site_pages FROM s WHERE site <> '' GROUP BY site),
often AS (
  SELECT site, letters FROM k JOIN sizes USING (site)
  GROUP BY site, letters, site_pages
  HAVING count(DISTINCT file_path) >= 4 AND count(DISTINCT file_path) * 10 >= site_pages),
hit AS (SELECT DISTINCT k.section_id, CAST(k.line_no AS INTEGER) AS line_no FROM k JOIN often USING (site, letters))
"""

P5 = P5_LINES + "SELECT section_id, line_no FROM hit"

P5_CLEAN = (
    P5_LINES
    + r"""
, gone AS (SELECT section_id, list(line_no) AS bad FROM hit GROUP BY section_id),
one AS (SELECT section_id, any_value(raw_content) AS raw_content FROM sections GROUP BY section_id)
SELECT one.section_id, CASE WHEN bad IS NULL THEN raw_content ELSE
  array_to_string(list_transform(
    list_filter(range(1, len(string_split(raw_content, chr(10))) + 1), lambda i: NOT list_contains(bad, i)),
    lambda i: string_split(raw_content, chr(10))[i]), chr(10)) END AS raw_content
FROM one LEFT JOIN gone ON one.section_id = gone.section_id
"""
)

P4_TEXTS = r"""
WITH t AS (SELECT DISTINCT section_id, regexp_extract_all(lower(coalesce(doc_title, '') || ' ' || coalesce(raw_content, '')), '[\p{L}\p{N}]+') AS w FROM sections),
g AS (SELECT DISTINCT section_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS gram
      FROM (SELECT section_id, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) >= 30)),
n AS (SELECT section_id, count(*) AS size FROM g GROUP BY section_id),
c AS (SELECT a.section_id AS a, b.section_id AS b, count(*) AS common
      FROM g a JOIN g b ON a.gram = b.gram AND a.section_id < b.section_id GROUP BY ALL),
pairs AS (SELECT c.a, c.b FROM c JOIN n x ON x.section_id = c.a JOIN n y ON y.section_id = c.b
          WHERE c.common * 10 >= (x.size + y.size - c.common) * 6)
"""

P4 = P4_TEXTS + "SELECT a AS section_id_a, b AS section_id_b FROM pairs"

P4_GROUPS = (
    P4_TEXTS.replace("WITH t AS", "WITH RECURSIVE t AS")
    + r"""
, k AS (SELECT section_id, array_to_string(w, ' ') AS key FROM t WHERE len(w) >= 30),
f AS (SELECT key, min(section_id) AS first FROM k GROUP BY key),
e AS (SELECT DISTINCT x.first AS a, y.first AS b FROM pairs JOIN k p ON p.section_id = pairs.a JOIN k q ON q.section_id = pairs.b
      JOIN f x ON x.key = p.key JOIN f y ON y.key = q.key WHERE p.key <> q.key),
ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT first AS node, first AS seen FROM f UNION SELECT r.node, ends.b FROM r JOIN ends ON ends.a = r.seen),
roots AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node),
l AS (SELECT a AS node, count(*) AS links FROM ends GROUP BY a)
SELECT k.section_id, c.class_id, CAST(coalesce(l.links, 0) AS INTEGER) AS links FROM k JOIN f USING (key) JOIN roots c ON c.node = f.first LEFT JOIN l ON l.node = f.first
"""
)

P7_HITS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text <> ''),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text <> ''),
u AS (SELECT DISTINCT item_id, least(12, len(w)) AS size, array_to_string(w[k : k + least(12, len(w)) - 1], ' ') AS unit
      FROM (SELECT *, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS unit
      FROM (SELECT doc_id, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS k FROM d, (SELECT DISTINCT size FROM u))),
hit AS (SELECT doc_id, item_id, count(DISTINCT k) AS places FROM g JOIN u USING (size, unit) GROUP BY doc_id, item_id)
"""

P7 = P7_HITS + "SELECT doc_id, item_id FROM hit"
P7_REPORT = P7_HITS + "SELECT item_id, count(*) AS documents, CAST(sum(places) AS BIGINT) AS places FROM hit GROUP BY item_id"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_rebuilt": P1_REBUILT, "p4_found": P4, "p4_groups": P4_GROUPS, "p5_found": P5, "p5_clean": P5_CLEAN, "p7_found": P7, "p7_report": P7_REPORT}
