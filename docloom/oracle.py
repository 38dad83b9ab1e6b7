"""SQL, for DuckDB, of the core's queries that SQL can express."""

from __future__ import annotations

from docloom.functions.text import BLOCK_STOPWORDS, INSTALL_PREFIXES, STOPWORDS
from docloom.operators.answers import MOST, NO_ANSWER
from docloom.operators.extract import AFTER_COLON, INLINE_COMMANDS, SCRIPT_STARTS, TOPICS
from docloom.operators.index import PREPARING, VERIFYING, VERIFYING_INSTALL
from docloom.operators import grounded, scored
from docloom.operators.search import INSTALLING, PREREQ_WEIGHT, RELEASES, VERIFY_INSTALL_WEIGHT, VERIFY_WEIGHT, WANT_WEIGHTS, WANTS
from docloom.questions import QUESTIONS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def norm(x: str) -> str:
    return rf"lower(trim(regexp_replace(coalesce({x}, ''), '[\s\x{{00a0}}]+', ' ', 'g')))"


def terms(x: str, stop: str = STOP) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-zA-Z0-9_.\-/]+'), lambda t: length(t) >= 3 AND NOT list_contains({stop}, t))"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
STRIP = r"regexp_replace(url, '[?#](.|\n)*$', '')"
NORMAL = rf"regexp_replace(trim({STRIP}), '/+$', '')"
NODES = "n AS (SELECT DISTINCT ON (section_id) * FROM sections)"
ITEMS = "q AS (SELECT DISTINCT ON (item_id) item_id AS query_id, text FROM eval_items)"
HELM_NAMES = "SELECT DISTINCT regexp_extract(command, 'helm install ([a-zA-Z0-9._-]+)', 1) AS name FROM (SELECT unnest(commands) AS command FROM sections)"
FIXED = ", ".join(f"({-1 - i}, '{text}')" for i, text in enumerate(QUESTIONS))
ASKED = f"""q AS (SELECT DISTINCT ON (item_id) item_id AS query_id, text FROM eval_items UNION ALL SELECT * FROM (VALUES {FIXED}) AS v(query_id, text)
  UNION ALL SELECT -100, 'what output should i expect when i install ' || min(name) FROM ({HELM_NAMES}) WHERE name <> '')"""
PATHTEXT = "coalesce(array_to_string(heading_path, ' > '), '')"

ANCESTORS = f"""
{NODES},
up AS (SELECT b.file_path, a.section_id AS ancestor, b.section_id AS descendant
       FROM n b JOIN n a ON a.file_path = b.file_path AND a.section_id < b.section_id AND a.level < b.level
       WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.file_path = b.file_path AND c.section_id > a.section_id AND c.section_id < b.section_id AND c.level <= a.level)),
tree AS (SELECT *, row_number() OVER (PARTITION BY descendant ORDER BY ancestor DESC) AS distance FROM up)
"""

STRUCTURAL = f"""r AS (SELECT file_path, section_id, row_number() OVER (PARTITION BY file_path ORDER BY section_id) AS k FROM n),
p1 AS (SELECT descendant AS section_id, ancestor AS parent FROM tree WHERE distance = 1),
near0 AS (SELECT section_id, section_id AS neighbour, 0 AS kind, 0 AS place_in FROM n UNION ALL SELECT section_id, parent, 1, 0 FROM p1
  UNION ALL SELECT ancestor, descendant, 2, row_number() OVER (PARTITION BY ancestor ORDER BY distance, descendant) FROM tree QUALIFY row_number() OVER (PARTITION BY ancestor ORDER BY distance, descendant) <= 6
  UNION ALL SELECT a.section_id, b.section_id, 3, b.section_id FROM p1 a JOIN p1 b ON a.parent = b.parent AND a.section_id <> b.section_id
  UNION ALL SELECT a.section_id, b.section_id, 4, b.k - a.k FROM r a JOIN r b ON a.file_path = b.file_path AND abs(b.k - a.k) BETWEEN 1 AND RADIUS),
near1 AS (SELECT section_id, neighbour, min(row(kind, place_in)) AS first FROM near0 GROUP BY ALL),
near AS (SELECT section_id, neighbour, CAST(row_number() OVER (PARTITION BY section_id ORDER BY first, neighbour) AS INTEGER) AS place FROM near1)"""

OVERLAP = f"""
{NODES}, {ASKED},
qt AS (SELECT query_id, unnest(list_distinct({terms("text")})) AS term FROM q),
p AS (SELECT section_id, unnest(list_distinct({terms("heading")})) AS term, 12 AS weight FROM n
      UNION ALL SELECT section_id, unnest(list_distinct({terms(PATHTEXT)})), 8 FROM n
      UNION ALL SELECT section_id, unnest(list_distinct({terms("doc_title")})), 6 FROM n
      UNION ALL SELECT section_id, unnest(list_distinct({terms("substring(coalesce(raw_content, ''), 1, 1600)")})), 4 FROM n),
o AS (SELECT query_id, section_id, CAST(sum(weight) AS DOUBLE) AS score FROM p JOIN qt USING (term) GROUP BY ALL)
"""

INTENT = f"""SELECT query_id, {", ".join(f"{any_of(norm('text'), words)} AS wants_{name}" for name, words in WANTS.items())}, {any_of(norm("text"), INSTALLING)} AS installs,
coalesce({", ".join(f"nullif(regexp_extract({norm('text')}, '{r}', 1), '')" for r in RELEASES)}) AS release FROM q"""

SUBJECT = f"""
hk AS (SELECT {norm("heading")} AS key, arg_min(heading, section_id) AS shown FROM n WHERE heading <> '' GROUP BY 1 HAVING {norm("heading")} <> ''),
tk AS (SELECT {norm("doc_title")} AS key, arg_min(doc_title, section_id) AS shown FROM n WHERE doc_title <> '' GROUP BY 1 HAVING {norm("doc_title")} <> ''),
h1 AS (SELECT query_id, arg_max(shown, row(length(key), shown)) AS heading FROM q JOIN hk ON contains({norm("text")}, key) GROUP BY 1),
t1 AS (SELECT query_id, arg_max(shown, row(length(key), shown)) AS title FROM q JOIN tk ON contains({norm("text")}, key) GROUP BY 1),
w0 AS (SELECT query_id, {terms("text")} AS ts FROM q),
w1 AS (SELECT query_id, unnest(ts) AS key, unnest(range(0, len(ts))) AS i FROM w0),
w2 AS (SELECT query_id, arg_max(shown, row(length(key), -i)) AS word FROM w1 JOIN hk USING (key) GROUP BY 1),
intent AS ({INTENT}),
subj AS (SELECT q.query_id, coalesce(nullif(regexp_extract(text, '(?i)([a-zA-Z0-9._/-]+\\.(?:yaml|yml|json|sh))', 1), ''), h1.heading, t1.title, release, word) AS subject
  FROM q JOIN intent ON q.query_id = intent.query_id LEFT JOIN h1 ON h1.query_id = q.query_id LEFT JOIN t1 ON t1.query_id = q.query_id LEFT JOIN w2 ON w2.query_id = q.query_id)
"""

FLAG_SCORE = " + ".join(
    [f"CASE WHEN {any_of('h', VERIFYING)} THEN {VERIFY_WEIGHT} ELSE 0 END"]
    + [f"CASE WHEN wants_{w} AND coalesce(len({a}), 0) > 0 THEN {k} ELSE 0 END" for w, (a, k) in WANT_WEIGHTS.items()]
    + [f"CASE WHEN wants_prereq AND {any_of('h', PREPARING)} THEN {PREREQ_WEIGHT} ELSE 0 END", f"CASE WHEN wants_output AND installs AND {any_of('h', VERIFYING_INSTALL)} THEN {VERIFY_INSTALL_WEIGHT} ELSE 0 END"]
)
#: The points of a subject, from its definition: exact heading 100 or heading holding it 70, path 60, content 45, title 20, a YAML file name in content 30 more.
SUBJECT_SCORE = """CASE WHEN s IS NULL OR s = '' THEN 0 ELSE CASE WHEN h = s THEN 100 WHEN contains(h, s) THEN 70 ELSE 0 END
  + CASE WHEN contains(pt, s) THEN 60 ELSE 0 END + CASE WHEN contains(c, s) THEN 45 ELSE 0 END + CASE WHEN contains(t, s) THEN 20 ELSE 0 END
  + CASE WHEN (subject LIKE '%.yaml' OR subject LIKE '%.yml') AND contains(c, s) THEN 30 ELSE 0 END END"""
VIEWS = f"""nn AS (SELECT *, {norm("heading")} AS h, {norm(PATHTEXT)} AS pt, {norm("raw_content")} AS c, {norm("doc_title")} AS t FROM n),
qs AS (SELECT i.*, {norm("q.text")} AS qt, subject, {norm("subject")} AS s FROM intent i JOIN q USING (query_id) JOIN subj USING (query_id)),
cmd AS (SELECT section_id, {norm("command")} AS command FROM (SELECT section_id, unnest(commands) AS command FROM n))"""

LEXICAL = f"""{OVERLAP}, {SUBJECT}, {VIEWS},
rp AS (SELECT query_id, section_id, CAST(sum(points) AS INTEGER) AS points FROM (
  SELECT DISTINCT query_id, section_id, 15 AS points FROM qs, cmd WHERE wants_output AND installs AND release IS NOT NULL AND contains(command, release)
  UNION ALL SELECT query_id, section_id, 18 FROM qs, nn WHERE wants_output AND installs AND release IS NOT NULL AND contains(c, release) AND len(outputs) > 0) GROUP BY ALL),
pts AS (SELECT query_id, section_id, {SUBJECT_SCORE} AS pts FROM qs, nn WHERE s <> ''),
scored AS (SELECT qs.query_id, nn.section_id, coalesce(pts.pts, 0) AS pts, CAST(coalesce(o.score, 0) + {FLAG_SCORE} + coalesce(pts.pts, 0) + coalesce(rp.points, 0) AS DOUBLE) AS score
  FROM qs CROSS JOIN nn LEFT JOIN o ON o.query_id = qs.query_id AND o.section_id = nn.section_id LEFT JOIN pts ON pts.query_id = qs.query_id AND pts.section_id = nn.section_id
  LEFT JOIN rp ON rp.query_id = qs.query_id AND rp.section_id = nn.section_id),
lexical AS (SELECT query_id, section_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS INTEGER) AS rank FROM scored WHERE score > 0
  QUALIFY rank <= 12)
"""

CONTENT = f"""concat_ws(chr(10) || chr(10), 'Document title: ' || coalesce(doc_title, ''), 'Heading path: ' || {PATHTEXT}, 'Heading: ' || coalesce(heading, ''),
  CASE WHEN len(commands) > 0 THEN 'Commands:' || chr(10) || array_to_string(commands, chr(10)) END, CASE WHEN len(outputs) > 0 THEN 'Outputs:' || chr(10) || array_to_string(outputs[1:3], chr(10)) END,
  CASE WHEN len(yamls) > 0 THEN 'YAML:' || chr(10) || array_to_string(yamls[1:2], chr(10) || chr(10)) END, CASE WHEN len(steps) > 0 THEN 'Steps:' || chr(10) || array_to_string(steps[1:8], chr(10)) END,
  CASE WHEN regexp_replace(coalesce(raw_content, ''), '\\s+', '', 'g') <> '' THEN 'Content:' || chr(10) || raw_content END)"""

BM25 = f"""
bw AS (SELECT section_id, {terms(CONTENT, "['']")} AS words FROM n),
bs AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM bw),
bt AS (SELECT section_id, len, term, count(*) AS tf FROM (SELECT section_id, len(words) AS len, unnest(words) AS term FROM bw) GROUP BY ALL),
bd AS (SELECT term, count(*) AS df FROM bt GROUP BY term),
bqt AS (SELECT query_id, unnest(list_distinct({terms("text")})) AS term FROM q),
bscored AS (SELECT query_id, section_id, round(sum(ln(1 + ((SELECT n FROM bs) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (SELECT mean FROM bs)))), 6) AS score
  FROM bt JOIN bd USING (term) JOIN bqt USING (term) GROUP BY ALL),
bm AS (SELECT query_id, section_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS INTEGER) AS rank FROM bscored QUALIFY rank <= 12)
"""
BM25_ONLY = f"WITH {NODES}, {ASKED}, {BM25}"

YAML_BARE = r"regexp_matches(bare, '^[A-Za-z0-9_.-]+:\s*.*$')"
PLAIN = r"(NOT regexp_matches(bare, '(?i)^(note!|info:|example:|warning:)') AND NOT regexp_matches(bare, '^(kubectl |helm |terraform |eksctl |aws |curl |export |java -jar |\./)'))"
LINES = rf"""{NODES},
l0 AS (SELECT section_id, string_split(regexp_replace(coalesce(raw_content, ''), '\n$', ''), chr(10)) AS ls FROM n),
l AS (SELECT section_id, CAST(i AS INTEGER) AS pos, regexp_replace(ls[i + 1], '\s+$', '') AS line, regexp_replace(regexp_replace(ls[i + 1], '\s+$', ''), '^\s+', '') AS bare FROM (SELECT section_id, ls, unnest(range(0, len(ls))) AS i FROM l0))"""
HEADERS = r"regexp_matches(line, '^\s*(NAME\s+NAMESPACE\s+REVISION|NAME\s+READY\s+STATUS|CLUSTER\s+NODEGROUP\s+STATUS|NAMESPACE\s+NAME\s+CLASS|certificate_arn\s*=|db_endpoint\s*=|db_user\s*=|efs_id\s*=|name_servers\s*=)')"


def islands(goes_on: str, starts: str) -> str:
    return rf"""{LINES},
f AS (SELECT *, {goes_on} AS goes, {starts} AS begins FROM l),
g AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY section_id ORDER BY pos) AS island FROM f),
h AS (SELECT *, min(CASE WHEN begins THEN pos END) OVER (PARTITION BY section_id, island) AS "at" FROM g WHERE goes),
k AS (SELECT section_id, "at", list(line ORDER BY pos) AS ls FROM h WHERE pos >= "at" GROUP BY section_id, island, "at")"""


BLOCK = r"regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '^\s+', ''), '\s+$', '')"
FENCES = r"""fz AS (SELECT section_id, regexp_extract_all(coalesce(raw_content, ''), '(?ms)```([a-zA-Z0-9_-]*)\n(.*?)^```', 1) AS a, regexp_extract_all(coalesce(raw_content, ''), '(?ms)```([a-zA-Z0-9_-]*)\n(.*?)^```', 2) AS b FROM n),
fence AS (SELECT section_id, CAST(i AS INTEGER) AS block_no, lower(a[i]) AS lang, regexp_replace(b[i], '\s+$', '') AS content FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM fz))"""
CMD = r"replace(replace(trim(regexp_replace(replace(regexp_replace(trim(regexp_replace(trim(raw), '^`+|`+$', '', 'g')), '^\$\s+', ''), '\', ' '), '\s+', ' ', 'g')), ' .alpha .', '.alpha.'), ' .kubernetes .', '.kubernetes.')"

SQL: dict[str, str] = {
    "url_parts": rf"""SELECT DISTINCT url_id, {STRIP} AS stripped, {NORMAL} AS normal, {HOST} AS host,
      CAST(len(list_filter(string_split(regexp_extract({STRIP}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/]*)?(/.*)?$', 1), '/'), lambda s: s <> '')) AS INTEGER) AS depth,
      nullif(regexp_extract(url, '/pages/(\d+)(?:/|$)', 1), '') AS page_id FROM discovered_urls""",
    "url_split_internal": rf"""WITH u AS (SELECT DISTINCT * FROM discovered_urls), h AS (SELECT *, {HOST} AS host FROM u), d AS (SELECT min(host) AS domain FROM h WHERE host <> '')
      SELECT CASE WHEN host = domain THEN 'internal' ELSE 'external' END AS kind, source, count(*) AS urls, count(DISTINCT url) AS distinct_urls FROM h, d WHERE host <> '' GROUP BY ALL""",
    "url_allow_deny": r"""SELECT DISTINCT url_id, url FROM discovered_urls WHERE regexp_matches(url, '/wiki/spaces/|/pages/\d+') AND NOT regexp_matches(url, '/label/|/download/|\.pdf$')""",
    "url_requests": rf"SELECT {STRIP} AS page_url, min(url_id) AS url_id FROM discovered_urls WHERE url IS NOT NULL GROUP BY 1",
    "url_external_captures": rf"""WITH d AS (SELECT min({HOST}) AS domain FROM discovered_urls WHERE {HOST} <> '')
      SELECT DISTINCT url_id, url, depth FROM discovered_urls, d WHERE source = 'external_l1' AND depth < 4 AND {HOST} = domain""",
    "url_sources": rf"WITH u AS (SELECT DISTINCT * FROM discovered_urls) SELECT source, count(*) AS urls, count(DISTINCT {NORMAL}) AS pages, max(depth) AS deepest FROM u GROUP BY source",
    "crawl_frontier": rf"""WITH RECURSIVE e AS (SELECT DISTINCT {NORMAL.replace("url,", "from_url,")} AS a, {NORMAL} AS b FROM discovered_urls WHERE from_url IS NOT NULL AND url IS NOT NULL),
      r AS (SELECT DISTINCT {NORMAL} AS page, 0 AS depth FROM discovered_urls WHERE source = 'sitemap' AND url IS NOT NULL
            UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.page WHERE r.depth < 6)
      SELECT page, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY page""",
    "page_folders": r"""WITH p AS (SELECT fetch_id, page_url, title, left(regexp_replace(regexp_replace(coalesce(title, ''), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 90) AS safe FROM pages_raw)
      SELECT DISTINCT fetch_id, CASE WHEN safe = '' THEN 'untitled' ELSE safe END || '_' || coalesce(nullif(regexp_extract(page_url, '/pages/(\d+)(?:/|$)', 1), ''), left(sha256(coalesce(page_url, '') || chr(10)), 16)) AS folder,
      left(sha256(coalesce(page_url, '') || chr(10) || coalesce(title, '') || chr(10)), 16) AS hash FROM p""",
    "page_best_html": """SELECT DISTINCT fetch_id, CASE WHEN export_view_html <> '' THEN 'export_view' WHEN page_html <> '' THEN 'page' END AS html_source,
      CAST(length(coalesce(nullif(export_view_html, ''), nullif(page_html, ''))) AS INTEGER) AS chars FROM pages_raw""",
    "page_latest": "SELECT page_url, arg_max(fetch_id, row(fetched_at, fetch_id)) AS fetch_id, count(DISTINCT fetch_id) AS fetches FROM pages_raw WHERE page_html <> '' GROUP BY page_url",
    "page_errors": """WITH p AS (SELECT DISTINCT fetch_id, status, rest_export_view, url_export_view FROM pages_raw)
      SELECT status, count(*) AS fetches, CAST(count(*) FILTER (WHERE rest_export_view.attempted) AS BIGINT) AS rest_attempts, count(rest_export_view.error) AS rest_errors, count(url_export_view.error) AS url_errors FROM p GROUP BY status""",
    "page_stats": """WITH p AS (SELECT DISTINCT page_url, scope_used, html_source, unnest(map_entries(stats)) AS e FROM pages_md)
      SELECT scope_used, e.key AS part, count(*) AS pages, CAST(sum(e.value) AS BIGINT) AS total FROM p GROUP BY ALL""",
    "text_normalized": f"SELECT doc_id, md5({norm('text')}) AS digest, CAST(length({norm('text')}) AS INTEGER) AS chars FROM documents",
    "text_terms": f"WITH {ITEMS} SELECT query_id, {terms('text')} AS terms FROM q",
    "text_term_frequencies": f"SELECT term, count(*) AS documents FROM (SELECT unnest(list_distinct({terms('text')})) AS term FROM documents) GROUP BY term",
    "text_sentences": r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents)
      SELECT doc_id, CAST(i AS INTEGER) AS "at", ss[i + 1] AS sentence FROM (SELECT doc_id, ss, unnest(range(0, len(ss))) AS i FROM s)""",
    "text_urls": rf"WITH {NODES} SELECT section_id, unnest(list_distinct(regexp_extract_all(coalesce(raw_content, ''), 'https?://[^\s)>\]]+'))) AS url FROM n",
    "text_windows": r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents),
      s AS (SELECT doc_id, ws, list_filter(range(0, len(ws), 150), lambda s: s = 0 OR len(ws) - s - 50 >= 100) AS starts FROM w WHERE len(ws) > 0)
      SELECT doc_id, CAST(i AS INTEGER) AS "window", array_to_string(ws[starts[i + 1] + 1 : CASE WHEN i + 1 = len(starts) THEN len(ws) ELSE starts[i + 1] + 200 END], ' ') AS content FROM (SELECT *, unnest(range(0, len(starts))) AS i FROM s)""",
    "fenced_blocks": f"WITH {NODES}, {FENCES} SELECT * FROM fence",
    "numbered_steps": rf"""WITH {NODES}, s AS (SELECT section_id, list_filter(list_transform(string_split(coalesce(raw_content, ''), chr(10)), lambda x: trim(regexp_replace(regexp_extract(x, '^\s*\d+\.\s+(.*)$', 1), '\s+$', ''))), lambda x: x <> '') AS ss FROM n),
      d AS (SELECT section_id, list_filter(ss, lambda x, i: list_position(ss, x) = i) AS ss FROM s)
      SELECT section_id, CAST(i AS INTEGER) AS "at", ss[i + 1] AS step FROM (SELECT *, unnest(range(0, len(ss))) AS i FROM d)""",
    "yaml_islands": rf"""WITH {islands(rf"(bare = '' OR ({PLAIN} AND NOT regexp_matches(bare, '^\d+\.\s+') AND ({YAML_BARE} OR regexp_matches(bare, '^-\s+.*$') OR regexp_matches(bare, '^\{{.*\}}$'))))", f"(bare <> '' AND {PLAIN} AND {YAML_BARE})")}
      SELECT section_id, "at", {BLOCK} AS block FROM k WHERE len(list_filter(ls, lambda x: trim(x) <> '')) >= 3 AND len(list_filter(ls, lambda x: trim(x) <> '' AND contains(x, ':'))) >= 2""",
    "output_islands": (rf"""WITH {islands(rf"({HEADERS} OR NOT (bare = '' OR regexp_matches(bare, '^(#|\d+\.)')))", HEADERS)} SELECT section_id, "at", {BLOCK} AS block FROM k WHERE len(ls) >= 2""").replace(
        "coalesce(raw_content, '')", "replace(coalesce(raw_content, ''), 'NAME READY AGE', 'NAME READY STATUS')"
    ),
    "install_commands": rf"""WITH {NODES}, c AS (SELECT section_id, unnest(commands) AS raw FROM n), m AS (SELECT section_id, {CMD} AS command FROM c)
      SELECT DISTINCT section_id, command, ({" OR ".join(f"starts_with(command, '{p}')" for p in INSTALL_PREFIXES)}) AS installs FROM m""",
    "topic_tags": f"""WITH {NODES}, t AS (SELECT section_id, {norm("concat_ws(' ', doc_title, heading, raw_content)")} AS w FROM n)
      {" UNION ALL ".join(f"SELECT section_id, '{tag}' AS tag FROM t WHERE {any_of('w', needles)}" for tag, needles in TOPICS.items())}""",
    "section_parents": f"WITH {ANCESTORS} SELECT n.section_id, max(ancestor) AS parent, CAST(count(ancestor) AS INTEGER) AS depth FROM n LEFT JOIN tree ON descendant = n.section_id GROUP BY n.section_id",
    "section_descendants": f"WITH {ANCESTORS} SELECT ancestor AS section_id, count(*) AS descendants, CAST(max(distance) AS INTEGER) AS deepest FROM tree GROUP BY ancestor",
    "section_useful_descendants": f"WITH {ANCESTORS} SELECT ancestor, descendant, CAST(distance AS INTEGER) AS distance FROM tree JOIN n ON section_id = descendant WHERE len(commands) > 0 OR len(yamls) > 0 OR len(outputs) > 0 OR len(scripts) > 0 OR len(steps) > 0",
    "section_siblings": f"WITH {ANCESTORS}, p AS (SELECT descendant AS section_id, ancestor AS parent FROM tree WHERE distance = 1) SELECT a.section_id, b.section_id AS sibling FROM p a JOIN p b ON a.parent = b.parent AND a.section_id <> b.section_id",
    "section_neighbours": f"""WITH {NODES}, r AS (SELECT file_path, section_id, row_number() OVER (PARTITION BY file_path ORDER BY section_id) AS k FROM n)
      SELECT a.section_id, CAST(b.k - a.k AS INTEGER) AS "offset", b.section_id AS neighbour FROM r a JOIN r b ON a.file_path = b.file_path AND abs(b.k - a.k) BETWEEN 1 AND 2""",
    "query_intents": f"WITH {ASKED} {INTENT}",
    "query_subjects": f"WITH {NODES}, {ASKED}, {SUBJECT} SELECT query_id, subject FROM subj",
    "overlap_top": f"WITH {OVERLAP} SELECT query_id, section_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 10",
    "lexical_search": f"WITH {LEXICAL} SELECT * FROM lexical",
    "bm25_search": f"{BM25_ONLY} SELECT * FROM bm",
    "vector_search": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
      s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
      SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "scores_minmax": f"""{BM25_ONLY}, m AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm)
      SELECT query_id, section_id, round(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END, 5) AS scaled FROM m""",
    "ranks_fused": f"""WITH {LEXICAL}, {BM25} SELECT query_id, section_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT query_id, section_id, rank FROM lexical UNION ALL SELECT query_id, section_id, rank FROM bm) GROUP BY ALL""",
    "subject_points": f"WITH {LEXICAL} SELECT query_id, section_id, CAST(pts AS DOUBLE) AS points FROM scored WHERE pts > 0",
    "subject_tiers": f"""WITH {LEXICAL}, y AS (SELECT l.query_id, l.section_id, CASE WHEN s IS NULL OR s = '' THEN 5 WHEN h = s THEN 1 WHEN contains(h, s) THEN 2 WHEN contains(t, s) THEN 3 WHEN contains(c, s) THEN 4 ELSE 5 END AS tier
        FROM lexical l JOIN qs USING (query_id) JOIN nn USING (section_id))
      SELECT query_id, section_id, CAST(tier AS INTEGER) AS tier FROM y QUALIFY tier = min(tier) OVER (PARTITION BY query_id)""",
    "require_filter": f"""WITH {LEXICAL}, {BM25}, fit AS (SELECT bm.query_id, bm.section_id, pts, rank FROM bm JOIN scored USING (query_id, section_id) JOIN n USING (section_id) WHERE pts > 0 AND len(yamls) > 0)
      SELECT query_id, section_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pts DESC, rank) AS INTEGER) AS rank FROM fit
      UNION ALL SELECT query_id, section_id, rank FROM bm WHERE query_id NOT IN (SELECT query_id FROM fit)""",
    "index_build": f"""WITH {NODES}, {BM25.replace(" bqt AS", " unused AS").split("unused AS")[0].rstrip().rstrip(",")},
      f AS (SELECT section_id, unnest(list_distinct({terms("heading")})) AS term, 12 AS weight FROM n UNION ALL SELECT section_id, unnest(list_distinct({terms(PATHTEXT)})), 8 FROM n
            UNION ALL SELECT section_id, unnest(list_distinct({terms("doc_title")})), 6 FROM n UNION ALL SELECT section_id, unnest(list_distinct({terms("substring(coalesce(raw_content, ''), 1, 1600)")})), 4 FROM n),
      every AS (SELECT section_id, term FROM bt UNION SELECT section_id, term FROM f),
      k AS (SELECT DISTINCT 'h' AS kind, {norm("heading")} AS key FROM n WHERE heading <> '' UNION SELECT DISTINCT 't', {norm("doc_title")} FROM n WHERE doc_title <> ''),
      {ANCESTORS.replace(NODES + ",", "").strip()}
      SELECT (SELECT count(*) FROM every) AS postings, (SELECT CAST(sum(tf) AS BIGINT) FROM bt) AS words, (SELECT CAST(sum(weight) AS BIGINT) FROM f) AS weights, (SELECT count(*) FROM bd) AS terms, (SELECT count(*) FROM k WHERE key <> '') AS keys,
        (SELECT count(*) FROM tree) AS closure, (SELECT count(*) FROM tree JOIN n ON section_id = descendant WHERE len(commands) > 0 OR len(yamls) > 0 OR len(outputs) > 0 OR len(scripts) > 0 OR len(steps) > 0) AS useful, (SELECT count(*) FROM n) AS sections""",
    "answer_sources": f"""{BM25_ONLY}, c AS (SELECT query_id, rank, coalesce(doc_title, '') AS doc_title, coalesce(heading, '') AS heading, coalesce(nullif(page_url, ''), 'N/A') AS page_url FROM bm JOIN n USING (section_id) WHERE rank <= 10),
      f AS (SELECT query_id, doc_title, heading, page_url, min(rank) AS first FROM c GROUP BY ALL)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, doc_title, heading, page_url) AS INTEGER) AS place, doc_title, heading, page_url FROM f QUALIFY place <= 8""",
    "answer_commands": f"""{BM25_ONLY}, c AS (SELECT query_id, flatten(list(commands ORDER BY rank)) AS items FROM bm JOIN n USING (section_id) WHERE rank <= 10 AND len(commands) > 0 GROUP BY query_id)
      SELECT query_id, list_filter(items, lambda x, i: trim(x) <> '' AND list_position(list_transform(items, lambda y: trim(y)), trim(x)) = i) AS items FROM c""",
    "answer_ungrounded_urls": rf"""WITH {NODES}, r AS (SELECT file_path, section_id, row_number() OVER (PARTITION BY file_path ORDER BY section_id) AS k FROM n),
      near AS (SELECT a.section_id AS query_id, b.section_id FROM r a JOIN r b ON a.file_path = b.file_path AND abs(a.k - b.k) = 1),
      said AS (SELECT DISTINCT section_id AS query_id, unnest(regexp_extract_all(raw_content, 'https?://[^\s)>\]]+')) AS url FROM n),
      known AS (SELECT query_id, unnest(list_append(regexp_extract_all(coalesce(raw_content, ''), 'https?://[^\s)>\]]+'), coalesce(page_url, ''))) AS url FROM near JOIN n USING (section_id))
      SELECT query_id, url FROM said WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.query_id = said.query_id AND k.url = said.url)""",
    "stream_new_pages": rf"SELECT DISTINCT {STRIP} AS page_url FROM discovered_urls WHERE url IS NOT NULL",
}

BRIDGE = f"""{ANCESTORS.replace(NODES + ",", "").strip()}, {STRUCTURAL.replace("RADIUS", "3")},
matched AS (SELECT DISTINCT query_id, section_id FROM qs, cmd WHERE (release IS NOT NULL AND contains(command, release))
  OR (contains(qt, 'helm install') AND contains(command, 'helm install')) OR (contains(qt, 'helm upgrade') AND contains(command, 'helm upgrade'))),
mine AS (SELECT m.* FROM matched m JOIN qs USING (query_id) WHERE wants_output AND installs),
around AS (SELECT query_id, section_id, 0 AS kind, place AS place_in, neighbour FROM mine JOIN near USING (section_id)
  UNION ALL SELECT query_id, m.section_id, 1, b.section_id, b.section_id FROM mine m JOIN n a ON a.section_id = m.section_id JOIN n b ON b.file_path = a.file_path AND len(b.outputs) > 0),
bridged AS (SELECT query_id, neighbour, min(row(a.section_id, kind, place_in)) AS first FROM around a JOIN nn ON nn.section_id = neighbour
  WHERE len(nn.outputs) > 0 OR {any_of("h", VERIFYING)} GROUP BY ALL),
bridge AS (SELECT query_id, neighbour AS section_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, neighbour) AS INTEGER) AS place FROM bridged)"""

HYBRID = f"""{LEXICAL}, {BM25}, {BRIDGE},
every AS (SELECT query_id, section_id, score, rank, 'l' AS r FROM lexical UNION ALL SELECT query_id, section_id, score, rank, 'b' FROM bm),
bounds AS (SELECT *, min(score) OVER (PARTITION BY query_id, r) AS lo, max(score) OVER (PARTITION BY query_id, r) AS hi FROM every),
exact AS (SELECT DISTINCT query_id, section_id FROM qs JOIN nn ON s <> '' AND (h = s OR t = s)),
parts AS (SELECT query_id, section_id, (CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END) * (CASE r WHEN 'l' THEN 0.45::DOUBLE ELSE 0.3::DOUBLE END) + 10.0::DOUBLE / (60 + rank) AS part FROM bounds
  UNION ALL SELECT query_id, section_id, 2.0::DOUBLE FROM exact UNION ALL SELECT query_id, section_id, 2.75::DOUBLE FROM bridge
  UNION ALL SELECT query_id, d.section_id, 1.2::DOUBLE FROM exact JOIN tree ON ancestor = exact.section_id JOIN n d ON d.section_id = descendant
    WHERE len(d.commands) > 0 OR len(d.yamls) > 0 OR len(d.outputs) > 0 OR len(d.scripts) > 0 OR len(d.steps) > 0),
total0 AS (SELECT query_id, section_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL),
total AS (SELECT * FROM total0 UNION ALL SELECT query_id, section_id, 0.0::DOUBLE FROM q, (SELECT section_id FROM n ORDER BY section_id LIMIT 20) WHERE query_id NOT IN (SELECT query_id FROM total0)),
hybrid AS (SELECT query_id, section_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS INTEGER) AS rank FROM total)
"""

SENTENCES = r"list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(raw_content, ''), '\s+', ' ', 'g')), '([.!?:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"

SQL |= {
    "hybrid_ranking": f"WITH {HYBRID} SELECT * FROM hybrid",
    "page_embedded_links": r"""WITH h AS (SELECT DISTINCT fetch_id, coalesce(page_html, '') || '{"attrs": {"href": "' || replace(page_url, '/', '\/') || '"}, "url":"' || requested_url || '"}' AS html FROM pages_raw),
      l AS (SELECT fetch_id, unnest(list_concat(regexp_extract_all(html, '"href"\s*:\s*"([^"]+)"', 1), regexp_extract_all(html, '"url"\s*:\s*"([^"]+)"', 1))) AS link FROM h)
      SELECT DISTINCT fetch_id, replace(link, '\/', '/') AS link FROM l""",
    "markdown_sections": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''),
      l AS (SELECT doc_id, i AS pos, ls[i + 1] AS line, regexp_replace(regexp_replace(ls[i + 1], '^\s+', ''), '\s+$', '') AS bare FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM t)),
      o AS (SELECT *, regexp_matches(bare, '^(#{1,6})\s+(.*)$') AS opens FROM l),
      s AS (SELECT *, sum(CASE WHEN opens OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq FROM o)
      SELECT doc_id, CAST(seq AS INTEGER) AS section_seq, CAST(coalesce(max(CASE WHEN opens THEN length(regexp_extract(bare, '^(#{1,6})\s+(.*)$', 1)) END), 1) AS INTEGER) AS level,
        coalesce(max(CASE WHEN opens THEN trim(regexp_extract(bare, '^(#{1,6})\s+(.*)$', 2)) END), 'Document') AS heading,
        CAST(coalesce(sum(CASE WHEN NOT opens THEN length(line) + 1 END), 0) AS INTEGER) AS chars FROM s GROUP BY doc_id, seq""",
    "block_kinds": f"""WITH {NODES}, {FENCES}, b AS (SELECT fence.section_id, block_no, lower(coalesce(lang, '')) AS l, trim(content) AS c, lower(coalesce(heading, '')) AS h FROM fence JOIN n ON n.section_id = fence.section_id)
      SELECT section_id, block_no, CASE WHEN l IN ('yaml', 'yml') THEN 'yaml' WHEN l IN ('bash', 'sh', 'shell') THEN 'shell' WHEN l = 'sql' THEN 'sql' WHEN l = 'json' THEN 'json' WHEN starts_with(c, '#!') THEN 'script'
        WHEN regexp_matches(c, '^(apiVersion|kind|metadata|spec):') THEN 'yaml' WHEN regexp_matches(c, '^(\\$ )?(kubectl|helm|terraform|eksctl|aws|curl|export|java -jar|\\./)') THEN 'shell' WHEN starts_with(c, 'SQL>') THEN 'sql'
        WHEN contains(h, 'output') OR {HEADERS.replace("(line,", "(c,")} THEN 'output' WHEN regexp_matches(c, '^NAME\\s+READY') THEN 'output' ELSE 'code' END AS kind FROM b""",
    "answer_sentences": f"""{BM25_ONLY}, a AS (SELECT query_id, list_distinct({terms("text")}) AS asked FROM q),
      s AS (SELECT query_id, rank, {SENTENCES} AS ss FROM bm JOIN n USING (section_id) WHERE rank <= 5),
      e AS (SELECT query_id, rank, i, ss[i + 1] AS sentence FROM (SELECT *, unnest(range(0, len(ss))) AS i FROM s)),
      h AS (SELECT query_id, rank, i, sentence, len(list_intersect(asked, {terms("sentence")})) AS hits FROM e JOIN a USING (query_id)),
      b AS (SELECT query_id, rank, arg_max(sentence, row(hits, -i)) AS sentence FROM h WHERE hits > 0 GROUP BY ALL),
      f AS (SELECT query_id, sentence, min(rank) AS rank FROM b GROUP BY ALL)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, sentence) AS INTEGER) AS place, sentence FROM f QUALIFY place <= 3""",
    "section_structural_neighbours": f"WITH {ANCESTORS}, {STRUCTURAL.replace('RADIUS', '2')} SELECT * FROM near",
}

USEFUL = "(len({0}.commands) > 0 OR len({0}.yamls) > 0 OR len({0}.outputs) > 0 OR len({0}.scripts) > 0 OR len({0}.steps) > 0)"
ANCHOR = f"""{HYBRID},
useful AS (SELECT ancestor AS section_id, count(*) AS useful FROM tree JOIN n d ON d.section_id = descendant WHERE {USEFUL.format("d")} GROUP BY 1),
anchor AS (SELECT h.query_id, arg_max(h.section_id, row(s.score + least(coalesce(useful, 0), 10) * 4 + CASE WHEN pts > 0 THEN 10 ELSE 0 END, -h.rank)) AS section_id
  FROM hybrid h JOIN scored s ON s.query_id = h.query_id AND s.section_id = h.section_id LEFT JOIN useful u ON u.section_id = h.section_id WHERE h.rank <= 20 GROUP BY 1)
"""
CHOSEN = f"""{ANCHOR},
x AS (SELECT query_id, (wants_commands OR wants_yaml OR wants_output OR wants_script OR wants_steps) AND query_id NOT IN (SELECT query_id FROM bridge) AS expands, wants_output FROM intent),
ax AS (SELECT anchor.query_id, anchor.section_id FROM anchor JOIN x ON x.query_id = anchor.query_id WHERE expands),
met AS (SELECT query_id, section_id, 0 AS kind, 0 AS place_in FROM ax
  UNION ALL SELECT query_id, section_id, -1, place FROM bridge
  UNION ALL SELECT ax.query_id, d.section_id, 1, CAST(distance AS BIGINT) * 1099511627776 + d.section_id FROM ax JOIN tree ON ancestor = ax.section_id JOIN n d ON d.section_id = descendant WHERE {USEFUL.format("d")}
  UNION ALL SELECT ax.query_id, m.section_id, 2, m.section_id FROM ax JOIN n a ON a.section_id = ax.section_id JOIN n m ON m.file_path = a.file_path AND m.section_id <> a.section_id WHERE {USEFUL.format("m")}
  UNION ALL (SELECT h.query_id, h.section_id, 3, h.rank FROM hybrid h JOIN n m ON m.section_id = h.section_id AND len(m.outputs) > 0 JOIN x ON x.query_id = h.query_id AND expands AND wants_output QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) <= 6)
  UNION ALL SELECT h.query_id, h.section_id, 4, h.rank FROM hybrid h JOIN x ON x.query_id = h.query_id AND NOT expands),
firsts AS (SELECT query_id, section_id, min(row(kind, place_in)) AS first FROM met GROUP BY ALL)
"""
#: The batch of questions for the output of installing each name, in place of the others.
INSTALLS = f"""{LEXICAL.replace(ASKED, "q AS (SELECT CAST('0x' || substr(md5(name), 1, 12) AS BIGINT) AS query_id, 'what output should i expect when i install ' || name AS text FROM (" + HELM_NAMES + ") WHERE name <> '')")}, {BRIDGE}"""
SQL |= {
    "anchor_sections": f"WITH {ANCHOR} SELECT query_id, section_id FROM anchor",
    "hybrid_search": f"WITH {CHOSEN} SELECT query_id, section_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, section_id) AS INTEGER) AS rank FROM firsts QUALIFY rank <= 10",
    "command_matches": f"WITH {INSTALLS} SELECT query_id, section_id FROM matched",
    "output_bridge": f"WITH {INSTALLS} SELECT * FROM bridge",
}

PARAMS = f"""u AS (SELECT DISTINCT url_id, url, {STRIP} AS base, list_append(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), 'format=export_view') AS ps FROM discovered_urls),
v AS (SELECT url_id, base, list_transform(ps, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END) AS ps FROM u),
w AS (SELECT url_id, base, ps, list_transform(ps, lambda p: split_part(p, '=', 1)) AS ns FROM v)"""
FLAT = r"""t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''),
  l AS (SELECT doc_id, i AS pos, ls[i + 1] AS line, regexp_replace(regexp_replace(ls[i + 1], '^\s+', ''), '\s+$', '') AS bare FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM t)),
  o AS (SELECT *, regexp_matches(bare, '^(#{1,6})\s+(.*)$') AS opens FROM l),
  s AS (SELECT *, sum(CASE WHEN opens OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq FROM o),
  g AS (SELECT doc_id, seq, CAST(coalesce(max(CASE WHEN opens THEN length(regexp_extract(bare, '^(#{1,6})\s+(.*)$', 1)) END), 1) AS INTEGER) AS heading_level,
    coalesce(max(CASE WHEN opens THEN trim(regexp_extract(bare, '^(#{1,6})\s+(.*)$', 2)) END), 'Document') AS heading,
    regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT opens), ''), '^\s+', ''), '\s+$', '') AS content FROM s GROUP BY doc_id, seq),
  kept AS (SELECT * FROM g WHERE content <> '' OR trim(heading) <> '')"""
TOKENS = "regexp_replace(regexp_replace({0}, '([%_!])', '!\\1', 'g'), ' ', ' % ', 'g')"
SQL |= {
    "url_export_view": f"""WITH {PARAMS} SELECT DISTINCT url_id, base || '?' || array_to_string(list_transform(list_filter(ns, lambda n, i: list_position(ns, n) = i), lambda n: list_filter(ps, lambda p: split_part(p, '=', 1) = n)[-1]), '&') AS export_url FROM w""",
    "text_excerpts": r"""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat, list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents),
      e AS (SELECT doc_id, i, ss[i] AS sentence, sum(length(ss[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS total FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)),
      k AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY i) AS excerpt FROM e WHERE total <= 700 GROUP BY doc_id)
      SELECT s.doc_id, coalesce(excerpt, left(flat, 700)) AS excerpt FROM s LEFT JOIN k ON k.doc_id = s.doc_id""",
    "page_failures": """WITH p AS (SELECT DISTINCT fetch_id, status, rest_export_view, url_export_view FROM pages_raw)
      SELECT fetch_id, 'page' AS kind, status, 'HTTP ' || status AS error FROM p WHERE status >= 400 UNION ALL SELECT fetch_id, 'rest_export_view', rest_export_view.status, rest_export_view.error FROM p WHERE rest_export_view.error IS NOT NULL
      UNION ALL SELECT fetch_id, 'url_export_view', url_export_view.status, url_export_view.error FROM p WHERE url_export_view.error IS NOT NULL""",
    "sitemap_pages": rf"""WITH d AS (SELECT min({HOST}) AS domain FROM discovered_urls WHERE {HOST} <> ''), s AS (SELECT DISTINCT {STRIP} AS url FROM discovered_urls WHERE source = 'sitemap')
      SELECT url FROM s, d WHERE {HOST} = domain AND regexp_matches(url, '/wiki/spaces/|/pages/\d+') AND NOT regexp_matches(url, '/label/|/download/|\.pdf$')
        AND len(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(/.*)?$', 1), '/'), lambda x: x <> '')) <= 8""",
    "flat_sections": f"""WITH {FLAT} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INTEGER) AS section_index, heading, heading_level, CAST(length(content) AS INTEGER) AS chars FROM kept
      UNION ALL SELECT doc_id, 0, 'Document', 1, 0 FROM documents WHERE text = '' OR text IS NULL""",
    "fenced_places": rf"""WITH {NODES}, x AS (SELECT section_id, regexp_extract_all(coalesce(raw_content, ''), '(?s)```([a-zA-Z0-9_-]*)\n(.*?)```', 0) AS bs, string_split_regex(coalesce(raw_content, ''), '(?s)```([a-zA-Z0-9_-]*)\n(.*?)```') AS ts FROM n),
      y AS (SELECT section_id, bs, ts, unnest(range(1, len(bs) + 1)) AS i FROM x)
      SELECT section_id, CAST(i AS INTEGER) AS block_no, CAST(list_sum(list_transform(ts[1:i], lambda t: length(t))) + coalesce(list_sum(list_transform(bs[1:i - 1], lambda t: length(t))), 0) AS INTEGER) AS start, CAST(length(bs[i]) AS INTEGER) AS length FROM y""",
    "answer_subtopics": f"""WITH {ANCESTORS}, top AS (SELECT section_id, len(heading_path) AS depth FROM n WHERE level = 1),
      r AS (SELECT top.section_id AS query_id, CASE WHEN len(d.heading_path) > depth THEN d.heading_path[depth + 1] END AS subtopic, d.section_id, d.commands FROM top JOIN tree ON ancestor = top.section_id JOIN n d ON d.section_id = descendant WHERE len(d.commands) > 0),
      f AS (SELECT query_id, subtopic, flatten(list(commands ORDER BY section_id)) AS items FROM r WHERE subtopic IS NOT NULL GROUP BY ALL)
      SELECT query_id, subtopic, list_filter(items, lambda x, i: trim(x) <> '' AND list_position(list_transform(items, lambda y: trim(y)), trim(x)) = i) AS commands FROM f""",
    "answer_ungrounded_commands": f"""WITH {NODES}, r AS (SELECT file_path, section_id, row_number() OVER (PARTITION BY file_path ORDER BY section_id) AS k FROM n),
      near AS (SELECT a.section_id AS query_id, b.section_id FROM r a JOIN r b ON a.file_path = b.file_path AND abs(a.k - b.k) = 1),
      said AS (SELECT DISTINCT section_id AS query_id, command, {CMD.replace("raw", "command")} AS own FROM (SELECT section_id, unnest(commands) AS command FROM n)),
      known AS (SELECT query_id, {CMD.replace("raw", "command")} AS k FROM (SELECT query_id, unnest(commands) AS command FROM near JOIN n USING (section_id)) WHERE trim(command) <> '')
      SELECT query_id, command FROM said WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.query_id = said.query_id AND (k = own OR starts_with(k, own) OR starts_with(own, k)
        OR ' ' || replace(k, ' ', '  ') || ' ' LIKE '% ' || {TOKENS.format("own")} || ' %' ESCAPE '!'))""",
    "stream_arrivals": """WITH w AS (SELECT date_trunc('day', found_at) AS start, source FROM discovered_urls)
      SELECT start, source, count(*) AS urls FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(found_at) FROM discovered_urls) GROUP BY start, source""",
}

SCORED_SUBJECT = f"""{NODES}, {ASKED},
keyed AS (SELECT DISTINCT 'heading' AS kind, {norm("heading")} AS key FROM n WHERE heading <> '' UNION SELECT DISTINCT 'title', {norm("doc_title")} FROM n WHERE doc_title <> ''),
cand AS (SELECT query_id, kind, key, CASE WHEN contains({norm("text")}, key) THEN CASE kind WHEN 'heading' THEN 80 ELSE 70 END ELSE 0 END
    + len(list_intersect(list_distinct({terms("text")}), list_distinct({terms("key")}))) * CASE kind WHEN 'heading' THEN 10 ELSE 8 END AS points FROM q, keyed WHERE length(key) >= 3
  UNION ALL SELECT query_id, 'file', regexp_extract(text, '\\b[A-Za-z0-9_.-]+\\.(?:yaml|yml|sh|jar)\\b'), 200 FROM q WHERE regexp_extract(text, '\\b[A-Za-z0-9_.-]+\\.(?:yaml|yml|sh|jar)\\b') <> ''),
best AS (SELECT query_id, key AS subject, points FROM cand WHERE points >= CASE kind WHEN 'heading' THEN 20 WHEN 'title' THEN 18 ELSE 0 END QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY points DESC, kind, key) = 1),
subj AS (SELECT q.query_id, text, subject, CAST(points AS INTEGER) AS points FROM q LEFT JOIN best USING (query_id))"""
SCORED = f"""{SCORED_SUBJECT}, {ANCESTORS.replace(NODES + ",", "").strip()},
qs AS (SELECT query_id, {norm("text")} AS qt, {norm("subject")} AS s, {", ".join(f"{any_of(norm('text'), words)} AS wants_{name}" for name, words in grounded.WANTS.items())} FROM subj),
nn AS (SELECT *, {norm("heading")} AS h, {norm(PATHTEXT)} AS pt, {norm("raw_content")} AS c, {norm("doc_title")} AS t FROM n),
terms_of AS (SELECT section_id, 1 AS f, unnest(list_distinct({terms("heading")})) AS term FROM n UNION ALL SELECT section_id, 2, unnest(list_distinct({terms(PATHTEXT)})) FROM n
  UNION ALL SELECT section_id, 4, unnest(list_distinct({terms("doc_title")})) FROM n UNION ALL SELECT section_id, 16, unnest(list_distinct({terms("raw_content")})) FROM n),
asked_terms AS (SELECT query_id, unnest(list_distinct({terms("text")})) AS term FROM q),
sh AS (SELECT query_id, section_id, count(*) FILTER (WHERE f = 1) * 10 + count(*) FILTER (WHERE f = 2) * 8 + count(*) FILTER (WHERE f = 4) * 5 + least(count(*) FILTER (WHERE f = 16), 8) * 2 AS points FROM terms_of JOIN asked_terms USING (term) GROUP BY ALL),
below AS (SELECT ancestor AS section_id, count(*) AS below FROM tree JOIN n d ON d.section_id = descendant WHERE {USEFUL.format("d")} GROUP BY 1),
sc AS (SELECT qs.query_id, nn.section_id, CAST(coalesce(sh.points, 0) + CASE WHEN qt <> '' AND contains(h, qt) THEN 30 ELSE 0 END + CASE WHEN qt <> '' AND contains(pt, qt) THEN 24 ELSE 0 END + CASE WHEN qt <> '' AND contains(t, qt) THEN 18 ELSE 0 END
    + CASE WHEN s = '' THEN 0 WHEN h = s THEN 45 WHEN contains(h, s) THEN 30 WHEN contains(pt, s) THEN 22 WHEN contains(t, s) THEN 18 WHEN contains(c, s) THEN 10 ELSE 0 END
    + {" + ".join(f"CASE WHEN wants_{w} AND len({a}) > 0 THEN {k} ELSE 0 END" for w, (a, k) in scored.WANTED.items())} + least(coalesce(below, 0), 8) * 3 AS DOUBLE) AS score
  FROM qs CROSS JOIN nn LEFT JOIN sh ON sh.query_id = qs.query_id AND sh.section_id = nn.section_id LEFT JOIN below ON below.section_id = nn.section_id)"""
SQL |= {
    "scored_subjects": f"WITH {SCORED_SUBJECT} SELECT query_id, subject, points FROM subj",
    "scored_ranking": f"WITH {SCORED} SELECT query_id, section_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS INTEGER) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20",
}

#: Commands of a query's chosen sections; of a question that wants to install, only those that do.
GROUPS = f"""{LEXICAL}, {ANCESTORS.replace(NODES + ",", "").strip()},
useful AS (SELECT ancestor AS section_id, count(*) AS useful FROM tree JOIN n d ON d.section_id = descendant WHERE {USEFUL.format("d")} GROUP BY 1),
top20 AS (SELECT query_id, section_id, score, pts, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20),
anchor AS (SELECT query_id, arg_max(section_id, row(score + least(coalesce(useful, 0), 10) * 4 + CASE WHEN pts > 0 THEN 10 ELSE 0 END, -rank)) AS anchor FROM top20 LEFT JOIN useful USING (section_id) GROUP BY 1),
met AS (SELECT x.query_id, x.rank, CASE WHEN len(b.heading_path) > len(a.heading_path) THEN b.heading_path[len(a.heading_path) + 1] ELSE coalesce(b.heading, '') END AS label, b.commands AS cs
  FROM top20 x JOIN anchor y USING (query_id) JOIN n a ON a.section_id = y.anchor JOIN n b ON b.section_id = x.section_id WHERE x.rank <= 10 AND x.section_id <> y.anchor),
own AS (SELECT query_id, rank, label, list_filter(cs, lambda raw: NOT installs OR {" OR ".join(f"starts_with({CMD}, '{p}')" for p in INSTALL_PREFIXES)}) AS cs FROM met JOIN intent USING (query_id)),
flat AS (SELECT query_id, label, min(rank) AS rank, flatten(list(cs ORDER BY rank)) AS items FROM own WHERE len(cs) > 0 GROUP BY ALL),
made AS (SELECT query_id, label, rank, list_filter(items, lambda x, i: trim(x) <> '' AND list_position(list_transform(items, lambda y: trim(y)), trim(x)) = i) AS commands FROM flat),
bare AS (SELECT query_id, coalesce(a.heading, '') AS label, 1 AS rank, list_filter(a.commands, lambda raw: NOT installs OR {" OR ".join(f"starts_with({CMD}, '{p}')" for p in INSTALL_PREFIXES)}) AS items
  FROM anchor JOIN n a ON a.section_id = anchor JOIN intent USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM made WHERE len(commands) > 0)),
every AS (SELECT * FROM made WHERE len(commands) > 0 UNION ALL SELECT query_id, label, rank, list_filter(items, lambda x, i: trim(x) <> '' AND list_position(list_transform(items, lambda y: trim(y)), trim(x)) = i) FROM bare)"""
SQL |= {
    "answer_groups": f"WITH {GROUPS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, label) AS INTEGER) AS place, label, commands FROM every WHERE len(commands) > 0",
}


def form(x: str) -> str:
    """A command in one form."""
    return CMD.replace("raw", x)


def joined(x: str) -> str:
    """Lines of a text with their continuations."""
    plain = rf"regexp_replace({x}, '[ \t\r\f\v]+(\n|$)', '\1', 'g')"
    unit = r"((?:[^\n]*\\\n)*[^\n]*)((?:\n[ \t]*(?:--[A-Za-z0-9_-]|-[A-Za-z0-9])[^\n]*)*)(?:\n|$)"
    return rf"list_transform(list_zip(regexp_extract_all({plain}, '{unit}', 1), regexp_extract_all({plain}, '{unit}', 2)), lambda z: regexp_replace(z[1], '[ \t]*\\+\n[ \t]*', ' ', 'g') || regexp_replace(z[2], '\n[ \t]*', ' ', 'g'))"


def once(x: str) -> str:
    return f"list_filter({x}, lambda a, k: trim(a) <> '' AND list_position({x}, a) = k)"


HITS = " || ".join(f"regexp_extract_all(y, '(?i){p}')" for p in INLINE_COMMANDS.values())
AFTER = f"regexp_extract(y, '(?i):\\s*({'|'.join(INLINE_COMMANDS[name] for name in AFTER_COLON['sections'])})', 1)"
STARTS = lambda x, starts: "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in starts) + ")"
BODY = r"regexp_replace(bodies[i], '\s+$', '')"
COMMANDS = rf"""{NODES}, tx AS (SELECT section_id, regexp_replace(regexp_replace(coalesce(raw_content, ''), '^\s+', ''), '\s+$', '') AS x FROM n),
tl AS (SELECT section_id, x, {joined("x")} AS ls, regexp_extract_all(x, '(?ms)```([a-zA-Z0-9_-]*)\n(.*?)^```', 1) AS langs, regexp_extract_all(x, '(?ms)```([a-zA-Z0-9_-]*)\n(.*?)^```', 2) AS bodies FROM tx),
fe AS (SELECT section_id, i, lower(langs[i]) AS lang, list_transform({joined(BODY)}, lambda y: {form("y")}) AS own FROM (SELECT *, unnest(range(1, len(langs) + 1)) AS i FROM tl)),
fc AS (SELECT section_id, flatten(list(CASE WHEN lang IN ('bash', 'sh', 'shell') THEN own WHEN lang IN ('yaml', 'yml', 'text', 'plain') THEN [] ELSE list_filter(own, lambda y: {STARTS("y", INSTALL_PREFIXES)}) END ORDER BY i)) AS cs,
    flatten(list(CASE WHEN lang IN ('bash', 'sh', 'shell') THEN own ELSE [] END ORDER BY i)) AS shell, flatten(list(CASE WHEN lang IN ('bash', 'sh', 'shell') THEN list_filter(own, lambda y: {STARTS("y", SCRIPT_STARTS)}) ELSE [] END ORDER BY i)) AS ss FROM fe GROUP BY section_id),
ic AS (SELECT section_id, list_transform(flatten(list_transform(ls, lambda y: {HITS} || CASE WHEN {AFTER} <> '' THEN [{AFTER}] ELSE [] END)), lambda y: {form("y")}) AS cs FROM tl),
sql_of AS (SELECT section_id, list(trim(regexp_replace(regexp_replace(bodies[i], '^\s+', ''), '\s+$', '')) ORDER BY i) AS qs FROM (SELECT *, unnest(range(1, len(langs) + 1)) AS i FROM tl) WHERE lower(langs[i]) = 'sql' AND trim(regexp_replace(bodies[i], '\s+', '', 'g')) <> '' GROUP BY section_id),
cm AS (SELECT section_id, coalesce(fc.cs, []) || ic.cs AS cs, coalesce(shell, []) || ic.cs AS routed, coalesce(ss, []) AS ss, coalesce(qs, []) AS qs FROM ic LEFT JOIN fc USING (section_id) LEFT JOIN sql_of USING (section_id)),
cf AS (SELECT section_id, {once("cs")} AS commands, {once("ss")} AS scripts, {once("routed")} AS routed, qs FROM cm)"""
WORDY = r"regexp_replace(regexp_replace({0}, '^ +', ''), ' +$', '')"
SQL |= {
    "section_commands": f"WITH {COMMANDS} SELECT section_id, commands, scripts FROM cf",
    "section_commands_routed": f"WITH {COMMANDS}, r AS (SELECT section_id, routed AS commands, qs || list_filter(routed, lambda y: {STARTS('y', SCRIPT_STARTS)}) AS ss FROM cf) SELECT section_id, commands, {once('ss')} AS scripts FROM r",
    "section_artefacts": f"""WITH {COMMANDS}, {FENCES},
      yi AS ({SQL["yaml_islands"].replace("WITH " + NODES + ",", "WITH", 1)}), oi AS ({SQL["output_islands"].replace("WITH " + NODES + ",", "WITH", 1).replace("replace(coalesce(raw_content, ''), 'NAME READY AGE', 'NAME READY STATUS')", "coalesce(raw_content, '')")}),
      st AS ({SQL["numbered_steps"].replace("WITH " + NODES + ",", "WITH", 1)}),
      fy AS (SELECT section_id, list({WORDY.format("content")} ORDER BY block_no) FILTER (WHERE lang IN ('yaml', 'yml')) AS ys, list({WORDY.format("content")} ORDER BY block_no) FILTER (WHERE lang IN ('text', 'plain')) AS os FROM fence WHERE content <> '' GROUP BY section_id),
      yl AS (SELECT section_id, list(block ORDER BY "at") AS bs FROM yi GROUP BY section_id), ol AS (SELECT section_id, list(block ORDER BY "at") AS bs FROM oi GROUP BY section_id), sl AS (SELECT section_id, list(step ORDER BY "at") AS steps FROM st GROUP BY section_id),
      a AS (SELECT cf.section_id, commands, scripts, coalesce(ys, []) || coalesce(yl.bs, []) AS yy, coalesce(os, []) || coalesce(ol.bs, []) AS oo, coalesce(steps, []) AS steps
        FROM cf LEFT JOIN fy ON fy.section_id = cf.section_id LEFT JOIN yl ON yl.section_id = cf.section_id LEFT JOIN ol ON ol.section_id = cf.section_id LEFT JOIN sl ON sl.section_id = cf.section_id)
      SELECT section_id, commands, scripts, list_filter(yy, lambda x, i: trim(x) <> '' AND list_position(list_transform(yy, lambda z: trim(z)), trim(x)) = i) AS yamls,
        list_filter(oo, lambda x, i: trim(x) <> '' AND list_position(list_transform(oo, lambda z: trim(z)), trim(x)) = i) AS outputs, steps FROM a""",
}


BARE = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
ANYWHERE = r"(?s)```([a-zA-Z0-9_-]*)\n(.*?)```"
BLOCK_HITS = " || ".join(f"regexp_extract_all(y, '(?i){p}')" for name, p in INLINE_COMMANDS.items() if name != "helm upgrade")
BLOCK_AFTER = f"regexp_extract(y, '(?i):\\s*({'|'.join(INLINE_COMMANDS[name] for name in AFTER_COLON['blocks'])})', 1)"
KIND_OF = rf"""CASE WHEN lang IN ('yaml', 'yml') THEN 'yaml' WHEN lang IN ('bash', 'sh', 'shell') THEN 'shell_command' WHEN lang = 'sql' THEN 'sql' WHEN lang = 'json' THEN 'json' WHEN starts_with(tc, '#!') THEN 'script'
  WHEN regexp_matches(tc, '^(apiVersion|kind|metadata|spec):') THEN 'yaml' WHEN regexp_matches(tc, '^(\$ )?(kubectl|helm|terraform|eksctl|aws|curl|export|java -jar|\./)') THEN 'shell_command' WHEN starts_with(tc, 'SQL>') THEN 'sql'
  WHEN contains(ctx, 'output') OR {HEADERS.replace("(line,", "(tc,")} THEN 'output' WHEN regexp_matches(tc, '^NAME\s+READY') THEN 'output' ELSE 'code' END"""
TAGS = "list_filter([" + ", ".join(f"CASE WHEN {any_of('w', needles)} THEN '{tag}' END" for tag, needles in sorted(TOPICS.items())) + "], lambda x: x IS NOT NULL)"
SQL |= {
    "block_documents": rf"""WITH {NODES}, b AS (SELECT section_id, coalesce(doc_title, '') AS title, coalesce(heading, '') AS heading, coalesce(raw_content, '') AS x, {TAGS} AS topic_tags FROM (SELECT *, {norm("concat_ws(' ', doc_title, heading, raw_content)")} AS w FROM n)),
      fa AS (SELECT section_id, heading, x, regexp_extract_all(x, '{ANYWHERE}', 0) AS bs, regexp_extract_all(x, '{ANYWHERE}', 1) AS langs, regexp_extract_all(x, '{ANYWHERE}', 2) AS cs, string_split_regex(x, '{ANYWHERE}') AS ts FROM b),
      fi AS (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM fa),
      fp AS (SELECT section_id, heading, x, i, lower(langs[i]) AS lang, regexp_replace(cs[i], '\s+$', '') AS c, list_sum(list_transform(ts[1:i], lambda t: length(t))) + coalesce(list_sum(list_transform(bs[1:i - 1], lambda t: length(t))), 0) AS start, length(bs[i]) AS size FROM fi),
      fk AS (SELECT section_id, i, lang, c, trim(c) AS tc, lower(heading || chr(10) || substring(x, CAST(greatest(start - 250, 0) + 1 AS BIGINT), CAST(least(start, 250) AS BIGINT)) || chr(10) || substring(x, CAST(start + size + 1 AS BIGINT), 250)) AS ctx FROM fp),
      sl0 AS (SELECT section_id, list_transform(flatten(list_transform({joined("x")}, lambda y: {BLOCK_HITS} || CASE WHEN {BLOCK_AFTER} <> '' THEN [{BLOCK_AFTER}] ELSE [] END)), lambda y: {form("y")}) AS cs FROM b),
      sl AS (SELECT section_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT section_id, {once("cs")} AS cs FROM sl0)),
      yi AS ({SQL["yaml_islands"].replace("WITH " + NODES + ",", "WITH", 1)}), oi AS ({SQL["output_islands"].replace("WITH " + NODES + ",", "WITH", 1).replace("replace(coalesce(raw_content, ''), 'NAME READY AGE', 'NAME READY STATUS')", "coalesce(raw_content, '')")}),
      every AS (SELECT section_id, 'section' AS doc_type, NULL AS block_type, NULL AS block_lang, NULL AS block_index, {BARE.format(f"regexp_replace(x, '{ANYWHERE}', '', 'g')")} AS body FROM b
        UNION ALL SELECT section_id, 'block', {KIND_OF}, CASE WHEN lang = '' THEN 'plain' ELSE lang END, CAST(i AS VARCHAR), c FROM fk
        UNION ALL SELECT section_id, 'block', 'shell_command', 'bash', 'inline-shell-' || (i - 1), cs[i] FROM sl
        UNION ALL SELECT section_id, 'block', 'yaml', 'yaml', 'inline-yaml-' || (row_number() OVER (PARTITION BY section_id ORDER BY "at") - 1), block FROM yi
        UNION ALL SELECT section_id, 'block', 'output', 'text', 'inline-output-' || (row_number() OVER (PARTITION BY section_id ORDER BY "at") - 1), block FROM oi)
      SELECT section_id, doc_type, block_type, block_lang, block_index, topic_tags, CAST(length(body) AS INTEGER) AS body_chars,
        md5({BARE.format("CASE WHEN doc_type = 'section' THEN '# ' || title || chr(10) || '## ' || heading || chr(10) || chr(10) || body ELSE '# ' || title || chr(10) || '## ' || heading || chr(10) || '[BLOCK TYPE: ' || block_type || ']' || chr(10) || '```' || CASE WHEN block_lang = 'plain' THEN '' ELSE block_lang END || chr(10) || body || chr(10) || '```' END")}) AS content_md5
      FROM every JOIN b USING (section_id)""",
}


def first_ones(x: str) -> str:
    """Items without later ones of equal trimmed text and blank ones."""
    return f"list_filter({x}, lambda a, k: trim(a) <> '' AND list_position(list_transform({x}, lambda b: trim(b)), trim(a)) = k)"


GATHERED = ", ".join(f"{first_ones(f'flatten(list({name} ORDER BY rank) FILTER (WHERE len({name}) > 0))')} AS {name}" for name in ("yamls", "scripts", "steps", "commands"))
LISTED = lambda name, most: f"array_to_string({name}[1:{most}], chr(10))"
#: Answers: the sections chosen for each question, what they hold in their order, the anchor of the lexical ranking and the commands below it, and the first kind that is wanted.
ANSWERS = f"""{CHOSEN},
ch AS (SELECT query_id, section_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, section_id) AS INTEGER) AS rank FROM firsts QUALIFY rank <= 10),
bf0 AS (SELECT query_id, section_id, min(row(kind, at_)) AS first FROM (SELECT query_id, section_id, 0 AS kind, place AS at_ FROM bridge UNION ALL SELECT query_id, section_id, 1, rank FROM ch) GROUP BY ALL),
bf AS (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY first, section_id) AS rank FROM bf0),
got AS (SELECT query_id, {GATHERED} FROM ch JOIN n USING (section_id) GROUP BY query_id),
outs AS (SELECT query_id, {first_ones("flatten(list(outputs ORDER BY rank) FILTER (WHERE len(outputs) > 0))")} AS outputs FROM bf JOIN n USING (section_id) GROUP BY query_id),
{("top20 AS" + GROUPS.split("top20 AS", 1)[1]).replace(" anchor AS (", " ganchor AS (").replace("JOIN anchor y", "JOIN holds y").replace("FROM anchor JOIN n a", "FROM holds JOIN n a").replace("FROM top20 x", "FROM ch x").replace("met AS (SELECT x.query_id", "holds AS (SELECT g.* FROM ganchor g JOIN useful ON useful.section_id = g.anchor), gmet AS (SELECT x.query_id").replace("FROM met JOIN", "FROM gmet JOIN").replace("every AS (", "gevery AS (").replace(chr(10) + "anchor AS (", chr(10) + "ganchor AS (").replace(chr(10) + "own AS (", chr(10) + "gown AS (").replace("FROM own WHERE", "FROM gown WHERE")},
gtext AS (SELECT query_id, string_agg(label || chr(10) || array_to_string(commands, chr(10)), chr(10) || chr(10) ORDER BY rank, label) AS grouped FROM gevery WHERE len(commands) > 0 GROUP BY query_id),
asked AS (SELECT query_id, list_distinct({terms("text")}) AS asked FROM q),
sn AS (SELECT query_id, rank, {SENTENCES} AS ss FROM ch JOIN n USING (section_id) WHERE rank <= 5),
se AS (SELECT query_id, rank, i, ss[i + 1] AS sentence FROM (SELECT *, unnest(range(0, len(ss))) AS i FROM sn)),
sh AS (SELECT query_id, rank, i, sentence, len(list_intersect(asked, {terms("sentence")})) AS hits FROM se JOIN asked USING (query_id)),
sb AS (SELECT query_id, rank, arg_max(sentence, row(hits, -i)) AS sentence FROM sh WHERE hits > 0 GROUP BY ALL),
sf AS (SELECT query_id, sentence, min(rank) AS rank FROM sb GROUP BY ALL),
sp AS (SELECT query_id, sentence, row_number() OVER (PARTITION BY query_id ORDER BY rank, sentence) AS place FROM sf QUALIFY place <= 3),
st AS (SELECT query_id, string_agg(sentence, chr(10) ORDER BY place) AS said FROM sp GROUP BY query_id),
bg AS (SELECT query_id, string_agg(substring(trim(raw_content), 1, 500), chr(10) || chr(10) ORDER BY rank) AS beginnings FROM bf JOIN n USING (section_id) WHERE rank <= 3 AND trim(raw_content) <> '' GROUP BY query_id),
cd AS (SELECT query_id, CASE WHEN installs THEN list_filter(commands, lambda raw: {" OR ".join(f"starts_with({CMD}, '{p}')" for p in INSTALL_PREFIXES)}) ELSE commands END AS commands FROM got JOIN intent USING (query_id)),
al AS (SELECT i.query_id, CASE WHEN wants_output THEN 'output' WHEN wants_yaml AND NOT wants_commands THEN 'yaml' WHEN wants_script THEN 'script' WHEN wants_commands THEN 'commands' ELSE 'extract' END AS kind, beginnings,
    CASE WHEN wants_output THEN CASE WHEN len(outputs) > 0 THEN {LISTED("outputs", MOST["outputs"])} END WHEN wants_yaml AND NOT wants_commands THEN CASE WHEN len(yamls) > 0 THEN {LISTED("yamls", MOST["yamls"])} END
      WHEN wants_script THEN CASE WHEN len(scripts) > 0 THEN {LISTED("scripts", MOST["scripts"])} END
      WHEN wants_commands THEN CASE WHEN holds.query_id IS NOT NULL THEN grouped WHEN len(cd.commands) > 0 THEN array_to_string(cd.commands, chr(10)) END
      WHEN said IS NOT NULL THEN said || CASE WHEN wants_steps AND len(steps) > 0 THEN chr(10) || {LISTED("steps", MOST["steps"])} ELSE '' END END AS answer
  FROM intent i LEFT JOIN got ON got.query_id = i.query_id LEFT JOIN outs ON outs.query_id = i.query_id LEFT JOIN cd ON cd.query_id = i.query_id LEFT JOIN holds ON holds.query_id = i.query_id
  LEFT JOIN gtext ON gtext.query_id = i.query_id LEFT JOIN st ON st.query_id = i.query_id LEFT JOIN bg ON bg.query_id = i.query_id)"""
SQL |= {
    "answers": f"WITH {ANSWERS} SELECT query_id, CASE WHEN answer IS NOT NULL THEN kind WHEN beginnings IS NOT NULL THEN 'beginning' ELSE 'none' END AS kind, coalesce(answer, beginnings, '{NO_ANSWER}') AS answer FROM al",
}

SCORED_CHOSEN = f"""{SCORED},
rk AS (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20),
exact AS (SELECT query_id, section_id FROM qs JOIN nn ON s <> '' AND (h = s OR t = s)),
topn AS (SELECT query_id, arg_max(section_id, row(score, -section_id)) AS section_id FROM exact JOIN sc USING (query_id, section_id) GROUP BY 1),
best1 AS (SELECT query_id, section_id FROM topn JOIN below USING (section_id)),
rest1 AS (SELECT qs.*, subject FROM qs JOIN subj USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM best1)),
req0 AS (SELECT query_id, section_id, CASE WHEN h = s THEN 100 WHEN contains(h, s) THEN 70 ELSE 0 END + CASE WHEN contains(pt, s) THEN 60 ELSE 0 END + CASE WHEN contains(c, s) THEN 80 ELSE 0 END + CASE WHEN contains(t, s) THEN 15 ELSE 0 END AS points
  FROM rest1 JOIN nn ON wants_yaml AND (subject LIKE '%.yaml' OR subject LIKE '%.yml') AND len(yamls) > 0),
req AS (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, coalesce(rank, 21), section_id) AS at_ FROM req0 LEFT JOIN rk USING (query_id, section_id) WHERE points > 0),
rest2 AS (SELECT * FROM rest1 WHERE query_id NOT IN (SELECT query_id FROM req)),
cands AS (SELECT query_id, section_id, min(rank) AS rank FROM (SELECT query_id, section_id, 0 AS rank FROM exact UNION ALL SELECT query_id, section_id, rank FROM rk) GROUP BY ALL),
parts_of AS (SELECT query_id, section_id, count(*) FILTER (WHERE f = 1) * 12 + count(*) FILTER (WHERE f = 2) * 10 + count(*) FILTER (WHERE f = 4) * 8 AS points FROM terms_of JOIN asked_terms USING (term) GROUP BY ALL),
anchor2 AS (SELECT x.query_id, arg_max(x.section_id, row(coalesce(p.points, 0) + least(below, 10) * 4 + CASE WHEN s <> '' AND h = s THEN 50 ELSE 0 END + CASE WHEN s <> '' AND contains(t, s) THEN 20 ELSE 0 END + CASE WHEN s <> '' AND contains(pt, s) THEN 18 ELSE 0 END, -rank, -x.section_id)) AS section_id
  FROM cands x JOIN below USING (section_id) JOIN rest2 USING (query_id) JOIN nn ON nn.section_id = x.section_id LEFT JOIN parts_of p ON p.query_id = x.query_id AND p.section_id = x.section_id
  WHERE {" OR ".join(f"wants_{w}" for w in scored.WANTED)} GROUP BY 1),
tops AS (SELECT * FROM best1 UNION ALL SELECT * FROM anchor2),
met AS (SELECT query_id, section_id, 0 AS kind, 0 AS place_in FROM tops
  UNION ALL SELECT query_id, d.section_id, 1, CAST(distance AS BIGINT) * 1099511627776 + d.section_id FROM tops JOIN tree ON ancestor = tops.section_id JOIN n d ON d.section_id = descendant WHERE {USEFUL.format("d")}
  UNION ALL SELECT query_id, m.section_id, 2, m.section_id FROM tops JOIN n a ON a.section_id = tops.section_id JOIN n m ON m.file_path = a.file_path AND m.section_id <> a.section_id WHERE {USEFUL.format("m")}
  UNION ALL SELECT query_id, section_id, 0, at_ FROM req
  UNION ALL SELECT rk.query_id, rk.section_id, 0, rank FROM rk JOIN rest2 USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM anchor2)
  UNION ALL SELECT query_id, section_id, 9, k FROM rest2, (SELECT section_id, row_number() OVER (ORDER BY section_id) - 1 AS k FROM n QUALIFY k < 8) WHERE query_id NOT IN (SELECT query_id FROM anchor2)),
firsts AS (SELECT query_id, section_id, min(row(kind, place_in)) AS first FROM met GROUP BY ALL)"""
SQL |= {
    "scored_search": f"WITH {SCORED_CHOSEN} SELECT query_id, section_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, section_id) AS INTEGER) AS rank FROM firsts QUALIFY rank <= 8",
}

BLOCK_STOP = "[" + ", ".join(f"'{w}'" for w in BLOCK_STOPWORDS) + "]"
BLOCK_ROWS, BLOCK_REST = SQL["block_documents"].split("SELECT section_id, doc_type, block_type, block_lang, block_index, topic_tags, CAST(length(body)", 1)
CONTENT_OF = BLOCK_REST.split("md5(", 1)[1].rsplit(") AS content_md5", 1)[0]
TOPIC_OF = "CASE " + " ".join(f"WHEN {any_of(norm('q.text'), needles)} THEN '{name}'" for name, needles in TOPICS.items()) + " END"
GROUNDED = f"""{BLOCK_ROWS.strip()}, {ASKED}, {SUBJECT}, {BM25.replace("rank <= 12", f"rank <= {grounded.TOP_RETRIEVED}")},
docs AS (SELECT section_id, section_id || '/' || doc_type || '/' || coalesce(block_index, '') AS doc_id, doc_type, block_type, body, heading, title, topic_tags, {CONTENT_OF} AS content FROM every JOIN b USING (section_id)),
dn AS (SELECT *, {norm("heading")} AS h, {norm("title")} AS t, {norm("content")} AS c, list_distinct({terms("content", BLOCK_STOP)}) AS words FROM docs),
gi AS (SELECT q.query_id, {norm("subject")} AS s, {TOPIC_OF} AS topic, list_distinct({terms("q.text", BLOCK_STOP)}) AS asked, {", ".join(f"{any_of(norm('q.text'), words)} AS wants_{name}" for name, words in grounded.WANTS.items())} FROM q JOIN subj USING (query_id)),
gx AS (SELECT query_id, doc_id, score, CASE WHEN s = '' THEN 5 WHEN h = s THEN 1 WHEN contains(h, s) THEN 2 WHEN contains(t, s) THEN 3 WHEN contains(c, s) THEN 4 ELSE 5 END AS tier,
    {" + ".join(f"CASE WHEN wants_{w} AND block_type IN ({', '.join(repr(k) for k in kinds)}) THEN {n} ELSE 0 END" for w, (kinds, n) in grounded.KIND_BONUS.items())}
    + CASE WHEN wants_steps AND doc_type = 'section' THEN {grounded.SECTION_BONUS} ELSE 0 END + CASE WHEN list_contains(topic_tags, topic) THEN {grounded.TOPIC_BONUS} ELSE 0 END AS bonus, len(list_intersect(asked, words)) AS shared
  FROM bm JOIN dn USING (section_id) JOIN gi USING (query_id)),
gb AS (SELECT * FROM gx QUALIFY tier = min(tier) OVER (PARTITION BY query_id)),
gc AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE tier WHEN 1 THEN 10 WHEN 2 THEN 8 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END DESC, bonus DESC, shared DESC, score DESC, doc_id) AS INTEGER) AS rank FROM gb QUALIFY rank <= 10)"""
SQL |= {
    "grounded_documents": f"{GROUNDED} SELECT * FROM gc",
    "grounded_blocks": f"""{GROUNDED}, l AS (SELECT query_id, block_type, list(trim(body) ORDER BY rank) AS bs FROM gc JOIN docs USING (doc_id) WHERE doc_type = 'block' AND block_type IN ({", ".join(repr(k) for k in grounded.BLOCK_TYPES)}) AND trim(body) <> '' GROUP BY ALL)
      SELECT query_id, block_type, ({first_ones("bs")})[1:8] AS blocks FROM l""",
}
