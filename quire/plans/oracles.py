"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
GLUE = LOW.format("regexp_replace({}, '[*`\\\\]', '', 'g')")


def _words(x: str) -> str:
    return f"regexp_extract_all({GLUE.format(x)}, '[0-9a-z]+')"


def _units(x: str) -> str:
    return f"regexp_extract_all({GLUE.format(x)}, '[0-9a-z]+[,.;:!)]')"


def _kept(drop: int) -> str:
    return (
        f"(SELECT doc_id, array_to_string([l[1] FOR l IN list_zip(string_split(text, chr(10)), "
        f"range(1, len(string_split(text, chr(10))) + 1)) IF l[2] % {drop} <> 0], chr(10)) AS text FROM documents)"
    )


def _count(source: str, items: str, name: str) -> str:
    return f"(SELECT doc_id, {name}, count(*) AS n FROM (SELECT doc_id, unnest({items}) AS {name} FROM {source}) GROUP BY ALL)"


_DRAWN = f"""
l AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
d AS MATERIALIZED (SELECT doc_id, line, line_no, unnest({_words("line")}) AS word, generate_subscripts({_words("line")}, 1) = 1 AS opening FROM l),
c AS MATERIALIZED (SELECT doc_id, word, count(*) FILTER (opening) AS drawn_opening, count(*) FILTER (NOT opening) AS drawn_inline FROM d GROUP BY ALL)"""


def _deficit(html: int, name: str) -> str:
    return f"""
{name}_a AS MATERIALIZED (SELECT c.*, coalesce(m.n, 0) AS emitted_markdown, coalesce(h.n, 0) AS emitted_html
  FROM c LEFT JOIN {_count(_kept(7), _words("text"), "word")} m USING (doc_id, word)
         LEFT JOIN {_count(_kept(html), _words("text"), "word")} h USING (doc_id, word)),
{name}_b AS (SELECT *, least(emitted_markdown, emitted_html) AS emitted,
  drawn_opening + drawn_inline - least(emitted_markdown, emitted_html) AS shortfall FROM {name}_a),
{name} AS MATERIALIZED (SELECT doc_id, word, drawn_opening, drawn_inline, emitted, shortfall - least(shortfall, drawn_opening) AS unaccounted,
  emitted_markdown, greatest(0, drawn_opening + drawn_inline - emitted_markdown - drawn_opening) AS unaccounted_markdown,
  emitted_html, greatest(0, drawn_opening + drawn_inline - emitted_html - drawn_opening) AS unaccounted_html
  FROM {name}_b WHERE shortfall > 0)"""


_LINKS = r"""
own AS (SELECT page_id, generate_subscripts(h, 1) AS ord, regexp_replace(unnest(h), '^/', '') AS anchor
        FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
firsts AS (SELECT anchor, min(page_id) AS p FROM own WHERE ord = 1 GROUP BY 1),
toc AS (SELECT """ + UP.format("anchor") + """ AS folded_id, CAST(min(page_id) AS VARCHAR) AS toc_topic FROM own WHERE ord = 2 GROUP BY 1)"""

_SPANS = "(SELECT user_id, event_id AS \"begin\", event_id + 50 + event_id % 400 AS \"end\" FROM events{})"


def _merged(source: str) -> str:
    return f"""(SELECT user_id, min("begin") AS "begin", max("end") AS "end" FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "begin", "end") AS island FROM (
    SELECT *, CASE WHEN "begin" <= max("end") OVER (PARTITION BY user_id ORDER BY "begin", "end"
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source}))
  GROUP BY user_id, island)"""


_CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), "
    "'\\\\([[:punct:]])', '\\1', 'g'), '[`*_#>]+', ' ', 'g'), '\\s+', ' ', 'g'))"
)
_CAP = "array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ')"
_STEM = "regexp_replace(regexp_replace(" + LOW + ", '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g')"

SQL = {
    "search_snippet": f"""
SELECT doc_id, source AS title,
  CASE WHEN pos > 0 THEN {_CLEAN.format("substr(text, CAST(greatest(pos - 45, 1) AS BIGINT), 110)")} ELSE source END AS snippet
FROM (SELECT *, instr({LOW.format("text")}, 'clown') AS pos FROM documents)
WHERE pos > 0 OR contains({LOW.format("source")}, 'clown')""",
    "word_multiset": f"SELECT doc_id, word, n FROM {_count('documents', _words('text'), 'word')}",
    "punctuation_units": f"SELECT doc_id, unit, n FROM {_count('documents', _units('text'), 'unit')}",
    "word_deficits": f"WITH {_DRAWN},{_deficit(11, 'x')} SELECT * FROM x",
    "deficit_evidence": f"""WITH {_DRAWN},{_deficit(11, 'x')},
e AS (SELECT d.doc_id, d.word, d.line, min(line_no) AS line_no FROM d JOIN x USING (doc_id, word) WHERE x.unaccounted > 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY line_no) AS r, count(*) OVER (PARTITION BY doc_id, word) AS total FROM e)
SELECT doc_id, word, string_agg(line, ' | ' ORDER BY r) || CASE WHEN max(total) > 3 THEN ' | +' || (max(total) - 3) || ' more lines' ELSE '' END AS evidence
FROM r WHERE r <= 3 GROUP BY doc_id, word""",
    "deficit_totals": f"""WITH {_DRAWN},{_deficit(11, 'x')}
SELECT doc_id, count(*) AS n_words, CAST(sum(drawn_opening + drawn_inline) AS BIGINT) AS drawn, CAST(sum(emitted) AS BIGINT) AS emitted,
  CAST(sum(unaccounted) AS BIGINT) AS unaccounted, count(*) FILTER (unaccounted > 0) AS n_unaccounted FROM x GROUP BY ROLLUP (doc_id)""",
    "punctuation_deficits": f"""SELECT a.doc_id, a.unit, a.n AS drawn, coalesce(b.n, 0) AS emitted, a.n - coalesce(b.n, 0) AS unaccounted
FROM {_count('documents', _units('text'), 'unit')} a LEFT JOIN {_count(_kept(5), _units('text'), 'unit')} b USING (doc_id, unit)
WHERE a.n > coalesce(b.n, 0)""",
    "char_multiset_delta": """WITH a AS {0}, b AS {1}
SELECT doc_id, ch, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS lost, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS gained
FROM (SELECT * FROM a WHERE regexp_full_match(ch, '[\\p{{L}}\\p{{N}}]')) a FULL JOIN (SELECT * FROM b WHERE regexp_full_match(ch, '[\\p{{L}}\\p{{N}}]')) b USING (doc_id, ch)
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""".format(
        _count("documents", "regexp_extract_all(text, '(?s).')", "ch"), _count(_kept(7), "regexp_extract_all(text, '(?s).')", "ch")
    ),
    "snapshot_diff": """SELECT source, lang, CASE WHEN c.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'unexpected' ELSE 'changed' END AS state,
  b.n AS n_baseline, c.n AS n_current
FROM (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) b
FULL JOIN (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY ALL) c USING (source, lang)
WHERE b.n IS DISTINCT FROM c.n""",
    "ratchet_regressions": f"""WITH {_DRAWN},{_deficit(11, 'x')},{_deficit(3, 'y')}
SELECT doc_id, word, coalesce(x.unaccounted, 0) AS "before", y.unaccounted AS now, y.unaccounted - coalesce(x.unaccounted, 0) AS increase
FROM y LEFT JOIN x USING (doc_id, word) WHERE y.unaccounted > coalesce(x.unaccounted, 0)""",
    "catalog_merge": """WITH t AS (SELECT 'P' || s_suppkey * 3 AS folded_id, 'p' || s_suppkey * 3 AS topic_id, s_suppkey AS topic_no FROM supplier),
c AS (SELECT 'P' || o_custkey AS folded_id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS toc FROM orders GROUP BY 1)
SELECT folded_id, coalesce(topic_id, folded_id) AS topic_id, topic_no, toc, toc IS NOT NULL AS in_toc FROM t FULL JOIN c USING (folded_id)""",
    "in_toc_flags": """SELECT d.doc_id AS topic_id, l.doc_id IS NOT NULL AS in_toc, quality AS toc_level, toxic AS toc_style
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "source_index": "SELECT d.doc_id AS topic_id, coalesce(l.doc_id, (SELECT count(*) FROM labels)) AS source_index FROM documents d LEFT JOIN labels l USING (doc_id)",
    "thread_depth": """WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations),
r AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM t WHERE turn = 0
      UNION ALL SELECT t.conv_id, t.turn, r.depth + 1 FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1)
SELECT t.conv_id, CAST(t.turn AS VARCHAR) AS turn_id, r.depth FROM t LEFT JOIN r USING (conv_id, turn)""",
    "topic_ranges": """WITH c AS (SELECT DISTINCT conv_id, turn, role FROM conversations), m AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY 1)
SELECT conv_id, row_number() OVER w AS topic_no, turn AS start, coalesce(lead(turn) OVER w, last + 1) AS "end"
FROM c JOIN m USING (conv_id) WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "class_runs": """SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
    SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY ALL""",
    "merged_intervals": f"SELECT * FROM {_merged(_SPANS.format(''))}",
    "overlap_join": """SELECT a.user_id, a."begin" AS a_begin, a."end" AS a_end, b."begin" AS b_begin, b."end" AS b_end
FROM {} a JOIN {} b ON a.user_id = b.user_id AND a."begin" < b."end" AND b."begin" < a."end" """.format(_SPANS.format(" WHERE event_type = 'view'"), _SPANS.format(" WHERE event_type = 'click'")),
    "point_in_interval": """SELECT e.user_id, e.event_id, s."begin" AS span FROM events e LEFT JOIN {} s
ON e.user_id = s.user_id AND e.event_id >= s."begin" AND e.event_id < s."end" """.format(_merged(_SPANS.format(" WHERE event_type = 'click'"))),
    "prefix_ranges": """SELECT conv_id, turn, w AS width, CAST(e - w AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end" FROM (
  SELECT conv_id, turn, length(text) AS w, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations)""",
    "next_adjacency": """WITH n AS (SELECT user_id, event_id AS next_event_id, event_type AS next_event_type FROM events WHERE event_type <> 'view')
SELECT e.user_id, e.event_id, e.event_type, n.next_event_id, n.next_event_type FROM events e
ASOF LEFT JOIN n ON e.user_id = n.user_id AND e.event_id < n.next_event_id""",
    "topic_navigation": """SELECT source, doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS "next"
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""",
    "link_extract": """SELECT page_id, CAST(generate_subscripts(h, 1) AS INTEGER) AS ord, unnest(h) AS href
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""",
    "link_resolution": f"""WITH {_LINKS}
SELECT o.page_id, CAST(o.ord AS INTEGER) AS ord, o.anchor,
  CASE WHEN f.p % 5 = 0 THEN 'resource' WHEN f.p = o.page_id THEN 'same' WHEN f.p IS NOT NULL THEN 'topic' WHEN toc_topic IS NOT NULL THEN 'toc' ELSE 'dead' END AS how,
  CASE WHEN f.p % 5 = 0 THEN 'object/' || f.p WHEN f.p = o.page_id THEN '#' || o.anchor
       WHEN f.p IS NOT NULL THEN f.p || CASE WHEN o.anchor <> '' THEN '#' || o.anchor ELSE '' END ELSE toc_topic END AS url
FROM own o LEFT JOIN firsts f USING (anchor) LEFT JOIN toc ON toc.folded_id = {UP.format("o.anchor")}""",
    "dead_links": f"WITH {_LINKS} SELECT page_id, CAST(ord AS INTEGER) AS ord, anchor FROM own ANTI JOIN firsts USING (anchor)",
    "link_map": """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CAST(l_partkey AS VARCHAR) AS anchor, l_linenumber % 3 AS k, l_orderkey AS dest FROM lineitem),
u AS (SELECT ord, anchor, dest FROM t UNION ALL SELECT ord, 'FIG' || anchor, dest FROM t WHERE k = 0 UNION ALL SELECT ord, 'TBL' || anchor, dest FROM t WHERE k = 1)
SELECT anchor, arg_min(dest, ord) AS dest FROM u GROUP BY 1""",
    "anchor_repair": """WITH b AS (SELECT DISTINCT p_brand AS file, upper(list_last(string_split(p_name, ' '))) AS name FROM part),
h AS (SELECT b.file, b.name, count(*) AS n, any_value(a.anchor) AS r FROM b JOIN (SELECT DISTINCT p_brand AS file, p_name AS anchor FROM part) a
  ON a.file = b.file AND ends_with(lower(a.anchor), lower(b.name)) GROUP BY 1, 2)
SELECT b.file, b.name, CASE WHEN h.n = 1 THEN h.r END AS repair FROM b LEFT JOIN h USING (file, name)""",
    "properties_last_wins": """SELECT user_id, CAST(max(event_id) FILTER (event_type = 'click') AS VARCHAR) AS click, CAST(max(event_id) FILTER (event_type = 'view') AS VARCHAR) AS view,
  coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (event_type = 'purchase'), '') AS purchase FROM events GROUP BY 1""",
    "header_controls": """SELECT user_id, event_id, event_type FROM (SELECT *, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS stop FROM events)
WHERE stop IS NULL OR event_id <= stop""",
    "route_census": f"""SELECT CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, chr(10) || chr(10)) THEN 'sections'
    WHEN len({_words("text")}) < 30 THEN 'short' ELSE 'prose' END AS route,
  CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'best-effort' WHEN quality = 1 THEN 'typed' ELSE 'typed-degraded' END AS severity, count(*) AS n
FROM (SELECT coalesce(text, '') AS text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL""",
    "shelf_listing": f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY {LOW.format('text')}, doc_id) AS place, doc_id FROM documents",
    "file_identity": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents",
    "duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "numbered_depth": """SELECT *, CASE WHEN regexp_full_match(topic_id, '[0-9]+(\\.[0-9]+)*') THEN CAST(len(string_split(regexp_replace(topic_id, '\\.0$', ''), '.')) - 1 AS INTEGER) ELSE 0 END AS depth
FROM (SELECT l_orderkey, l_linenumber, l_orderkey || '.' || CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END || CASE WHEN l_linenumber > 5 THEN '.x' WHEN l_linenumber > 3 THEN '.7' ELSE '' END AS topic_id FROM lineitem)""",
    "stem_dedup": f"""SELECT p_partkey, stem, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS file_name FROM (
  SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS n FROM (SELECT p_partkey, {_STEM.format("string_split(p_name, ' ')[1]")} AS stem FROM part))""",
    "median_value": """SELECT event_type, value AS median, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = n // 2 + 1""",
    "topic_filter": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title FROM part WHERE contains(CAST(p_partkey AS VARCHAR), '7') OR contains(p_name, '7')",
    "incremental_probe": """SELECT doc_id, n_chars AS stamp, CASE WHEN doc_id % 6 = 0 OR doc_id % 2 = 1 THEN lang END AS detail,
  CASE WHEN doc_id % 6 = 0 THEN 'memory' WHEN doc_id % 2 = 1 THEN 'disk' ELSE 'probe' END AS source FROM documents""",
    "probe_stats": """SELECT count(*) FILTER (doc_id % 6 = 0) AS memory_hits, count(*) FILTER (doc_id % 2 = 1) AS disk_hits,
  count(*) FILTER (doc_id % 6 <> 0 AND doc_id % 2 = 0) AS probes FROM documents""",
    "cache_eviction": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "set_difference": """WITH a AS (SELECT DISTINCT c_custkey AS id FROM customer), b AS (SELECT DISTINCT o_custkey + 7 AS id FROM orders)
SELECT id, 'left' AS only_in FROM a ANTI JOIN b USING (id) UNION ALL SELECT id, 'right' FROM b ANTI JOIN a USING (id)""",
    "folded_words": f"""SELECT p_partkey, {UP.format("p_name")} AS upper_name, {_STEM.format("p_name")} AS stem, trim(regexp_replace(p_type, '[ \\t\\n]+', ' ', 'g')) AS kind,
  replace(replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM part""",
    "safe_links": """WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages),
x AS (SELECT page_id, unnest([url, ' JavaScript:' || url, 'MAILTO:' || url, 'data' || string_split(url, '/')[1] || ':x']) AS url FROM u)
SELECT page_id, url, bool_and(NOT regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(lower(trim(url)), '^(https?|ftp|mailto):')) AS safe, count(*) AS n FROM x GROUP BY 1, 2""",
    "control_kinds": """WITH w AS (SELECT l_linenumber AS n, CASE WHEN l_linenumber <= 6 THEN CAST(l_linenumber AS VARCHAR) ELSE 'x' END AS k FROM lineitem)
SELECT CASE k WHEN '1' THEN 'topic_start' WHEN '2' THEN 'table_start' WHEN '3' THEN 'parent' WHEN '4' THEN 'structural' WHEN '5' THEN 'select' ELSE 'text' END AS kind,
  CASE WHEN n BETWEEN 1 AND 9 THEN n - 1 ELSE 0 END AS depth, count(*) AS n, CASE k WHEN '3' THEN 1 WHEN '5' THEN 3 ELSE 0 END AS operands FROM (SELECT k, n AS n FROM w) GROUP BY ALL""",
    "selector_links": """WITH s AS (SELECT s_suppkey, s_name, s_nationkey AS d, s_acctbal < 0 AS open,
  ['book', 'hdr', 'spt', 'fig', 'tbl', 'figure', 'internet', 'image', 'menu'][s_suppkey % 9 + 1] AS k FROM supplier),
e AS (SELECT *, CASE WHEN d = 1 THEN 'not six or seven alternatives' WHEN open THEN 'an alternative is not bracketed' WHEN k = 'book' AND d = 0 THEN 'no document number'
  WHEN k IN ('hdr', 'spt', 'fig', 'tbl', 'figure') AND d = 0 THEN 'no document number or anchor' WHEN k IN ('internet', 'image') AND d = 0 THEN 'no external target' WHEN k = 'menu' THEN 'unknown kind' END AS error FROM s)
SELECT s_suppkey, CASE WHEN error IS NULL THEN CASE k WHEN 'book' THEN 'book_contents' WHEN 'hdr' THEN 'book_heading' WHEN 'spt' THEN 'book_spot' WHEN 'internet' THEN 'external_link' WHEN 'image' THEN 'external_image' ELSE 'book_anchor' END END AS kind,
  CASE WHEN error IS NULL THEN CASE WHEN k = 'book' THEN 'DOCNUM//D' || d || '/CCONTENTS' WHEN k IN ('internet', 'image') THEN '/D' || d ELSE 'DOCNUM//D' || d || '/' || upper(k) || s_name END END AS destination,
  CASE WHEN error IS NULL AND k = 'image' THEN '/D' || d END AS image, error FROM e""",
    "structure_census": r"""WITH t AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT CASE WHEN contains(text, ':') THEN ':' || lang END AS heading, contains(text, '@') AS s, contains(text, ' | ') AS b, contains(text, '!!') AS m, len(l) AS r,
  len([x FOR x IN l IF regexp_matches(x, '^[ \t\n\x0B\f\r]*(o|-|\*|\x{00b0}|\x{2022}|[A-Za-z][.)]|[0-9]{1,3}[.)])[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]')]) AS i FROM t),
g AS (SELECT *, array_to_string([x FOR x IN [CASE WHEN i > 0 THEN 'lists' END, CASE WHEN b THEN 'tables' END, CASE WHEN s THEN 'selectors' END, CASE WHEN m THEN 'messages' END] IF x IS NOT NULL], '+') AS f FROM c)
SELECT CASE WHEN f = '' THEN 'prose' ELSE f END AS signature, CASE f WHEN '' THEN 'heading + prose paragraphs only' WHEN 'lists' THEN 'prose + lists' WHEN 'tables' THEN 'contains fixed rows/tables'
  WHEN 'selectors' THEN 'contains selectors/cross-references' WHEN 'messages' THEN 'messages' ELSE 'mixed' END AS "class", heading, count(*) AS n, CAST(sum(r) AS BIGINT) AS "rows", CAST(sum(i) AS BIGINT) AS list_rows FROM g GROUP BY ALL""",
    "form_rows": """WITH s AS (SELECT *, count(*) FILTER (event_type IN ('purchase', 'view')) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
g AS (SELECT user_id, s, string_agg(CAST(event_id AS VARCHAR), '<br>' ORDER BY event_id) AS a, coalesce(string_agg(event_type, '<br>' ORDER BY event_id) FILTER (event_type = 'click'), '') AS b
  FROM s WHERE event_type IN ('purchase', 'click') GROUP BY user_id, s)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s) AS INTEGER) AS "row", a, b FROM g""",
    "numbered_steps": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL),
m AS (SELECT *, coalesce(l_linenumber = lag(l_linenumber) OVER w + 1 AND l_linestatus = lag(l_linestatus) OVER w AND l_returnflag <> 'R', false) AS f
  FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)), r AS (SELECT *, count(*) FILTER (NOT f) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM m)
SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER p AS n, bool_and(l_suppkey > 5) OVER p AS ok FROM r WINDOW p AS (PARTITION BY l_orderkey, g)) WHERE n >= 2 AND ok""",
    "declared_characters": """SELECT c_nationkey, string_agg(DISTINCT right(c_name, 1), '' ORDER BY right(c_name, 1)) AS characters FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1""",
    "earliest_slices": """SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""",
    "text_functions": r"""SELECT p_partkey, ' ' || rtrim(p_name, ' ') AS right_trimmed, p_name AS trimmed, '?' || p_name AS blank_trimmed, regexp_replace(p_type, '(?i)an', '$1', 'g') AS replaced,
  lower(hex(encode(p_name))) AS hex, base64(encode(p_name)) AS base64, p_name AS decoded, '```' || p_name || '``' || p_size || '```' AS code,
  CASE p_size % 3 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'image/bmp' ELSE 'application/octet-stream' END AS media,
  CASE right(p_brand, 1) WHEN '0' THEN 'italic' WHEN '4' THEN 'xph' ELSE 'hp' || right(p_brand, 1) END AS font, CASE WHEN p_size BETWEEN 1 AND 9 THEN p_size - 1 ELSE 0 END AS depth,
  p_name || '\_\*\[' || p_size || '\]' AS markdown, length(CAST(p_size AS VARCHAR)) <= 3 AS item FROM part""".replace("\\\\", "\\"),
    "url_codecs": """WITH w AS (SELECT page_id, url, regexp_replace(regexp_extract(html, 'href="([^"]*)"', 1), '^/', '') AS w FROM pages)
SELECT page_id, 'quire://shelf/' || page_id || '/' || url_encode(w) AS uri, page_id || '|' || w AS parts, sha1(strlen(url) || ':' || url || strlen(CAST(page_id AS VARCHAR)) || ':' || page_id) AS identity FROM w""",
    "find_in_text": f"""WITH s AS (SELECT doc_id, string_split({LOW.format("text")}, 'the') AS p FROM documents)
SELECT doc_id, CAST(len(p) - 1 AS INTEGER) AS n, array_to_string([CAST(list_sum([length(x) FOR x IN p[1:i]]) + 3 * (i - 1) + 1 AS BIGINT) FOR i IN range(1, len(p))], ',') AS places FROM s WHERE len(p) > 1""",
    "kind_counts": """SELECT user_id, string_agg(event_type || ':' || n, ' ' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""",
    "detail_counts": """SELECT n_nationkey AS book_id, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_topics,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_toc, (SELECT count(*) FROM nation r WHERE r.n_regionkey = nation.n_nationkey) AS n_resources FROM nation""",
    "resource_links": """WITH o AS (SELECT page_id, CAST(generate_subscripts(h, 1) AS INTEGER) AS ord, unnest(h) AS target FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))
SELECT page_id, ord, target, CASE WHEN target IN (SELECT target FROM o WHERE ord = 1) THEN 'object/' || target ELSE target END AS url FROM o""",
    "menus_valid": """WITH i AS (SELECT l_linestatus AS book, l_orderkey AS menu, l_partkey AS t FROM lineitem), k AS (SELECT DISTINCT o_orderstatus AS book, o_custkey AS t, true AS known FROM orders),
j AS (SELECT i.*, coalesce(known, false) AS fine FROM i LEFT JOIN k USING (book, t)) SELECT book, menu, 'p' || t AS target FROM (SELECT *, bool_and(fine) OVER (PARTITION BY book, menu) AS a FROM j) WHERE a""",
    "point_lookup": "SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('FRANCE', 'GERMANY')",
    "whole_threads": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS body FROM conversations WHERE text <> '' GROUP BY 1",
    "control_values": f"""SELECT p_partkey, {UP.format("p_name")} AS number, {_CAP} AS title, '(c) IBM ' || p_brand AS copyright, {_CAP} || '-X' AS date FROM part""",
    "code_words": """WITH c AS (SELECT p_partkey, [p_size + 64, p_size + 160, p_size + 208] AS c FROM part)
SELECT p_partkey, array_to_string([CASE WHEN w <= 126 OR w BETWEEN 161 AND 255 THEN chr(w) WHEN w = 160 THEN ' ' ELSE '?' END FOR w IN c], '') AS text,
  array_to_string([CASE WHEN w BETWEEN 97 AND 122 OR (w BETWEEN 224 AND 254 AND w <> 247) THEN w - 32 WHEN w = 223 THEN 83 ELSE w END FOR w IN c], ',') AS "upper",
  array_to_string([CASE WHEN w BETWEEN 65 AND 90 OR (w BETWEEN 192 AND 222 AND w <> 215) THEN w + 32 ELSE w END FOR w IN c], ',') AS "lower" FROM c""",
    "header_records": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'O' || o_orderkey END AS topic_id, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey AS INTEGER) END AS topic_no,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'C' || o_custkey END AS parent, true AS contents FROM orders""",
    "contents_lines": """SELECT c_custkey, c_nationkey AS nesting, 2 AS style, 'SEC' || c_custkey AS id, c_name AS title FROM customer
UNION ALL SELECT c_custkey, 7, c_nationkey, 'END', c_mktsegment FROM customer""",
    "font_spans": """SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS "column", CAST(l_linenumber - 1 AS INTEGER) AS length, 'B' AS code FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6
UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 10 AS INTEGER), 3, l_returnflag FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6""",
    "report_fields": r"""SELECT doc_id, sha256(replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(13), '\r'), chr(10), '\n')) AS escaped, text = text AS same,
  text IS NOT NULL AND NOT contains(regexp_replace(text, '\\[\\trn]', '', 'g'), '\') AS readable FROM documents""",
    "short_hashes": "SELECT p_partkey, substr(sha256(CAST(to_json([p_name, p_brand, CAST(p_size AS VARCHAR)]) AS VARCHAR)), 1, 16) AS hash FROM part",
    "request_parameters": """SELECT event_id, CASE WHEN fine THEN event_type END AS type, CASE WHEN fine THEN CAST(user_id AS VARCHAR) END AS user, CASE WHEN fine THEN 'a=b' END AS v
FROM (SELECT *, event_type NOT IN ('error', 'purchase') AS fine FROM events)""",
    "conditional_requests": "SELECT page_id, page_id % 4 <> 3 AS fresh FROM pages",
    "catalog_faults": f"SELECT {UP.format('p_name')} AS folded_id, 'duplicate id' AS fault FROM part GROUP BY 1 HAVING count(*) > 1",
    "whole_contents": """SELECT l_orderkey, l_partkey, depth FROM (SELECT l_orderkey, l_partkey, l_linenumber AS depth, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS declined FROM lineitem) WHERE NOT declined""",
    "first_headers": "SELECT o_orderstatus, o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2",
    "cell_owners": """SELECT l_partkey, l_suppkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN any_value(l_linestatus) END AS l_linestatus, count(*) AS n_claims, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY 1, 2""",
    "unaccounted_tokens": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1",
    "figure_anchors": """SELECT user_id, CAST(event_id AS VARCHAR) AS anchor, CAST(e AS VARCHAR) AS resource FROM (SELECT *, lead(event_id) OVER w AS e, lead(event_type) OVER w AS t
  FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'click' AND t = 'purchase'""",
    "page_runs": """SELECT o_custkey AS book_id, CAST(run AS BIGINT) AS run, o_orderstatus AS page_class, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM (
  SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM (
    SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS DISTINCT FROM o_orderstatus AS fresh FROM orders)) GROUP BY 1, run, o_orderstatus""",
    "big_endian": """WITH c AS (SELECT p_partkey, [CAST(ascii(substr(p_name, i, 1)) AS BIGINT) FOR i IN range(1, 5)] AS b FROM part)
SELECT p_partkey, b[1] * 256 + b[2] AS head, b[2] * 65536 + b[3] * 256 + b[4] AS "inner", CAST(NULL AS BIGINT) AS beyond FROM c""",
    "control_segments": """SELECT c_custkey, 'text' AS kind, NULL AS opcode, '' AS operands, 'note' AS payload FROM customer
UNION ALL SELECT c_custkey, 'topic_number', 'CTOPICN', CAST(c_custkey AS VARCHAR), c_name FROM customer
UNION ALL SELECT c_custkey, 'select', 'CSELECT', '1 CPARENT 3', c_mktsegment || ' x' FROM customer""",
    "carried_selections": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS s, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT a.l_orderkey, a.l_linenumber, coalesce(b.s = 'O' AND b.f = 'R', false) AS carried FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1""",
    "drawn_cells": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ANTI JOIN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R') USING (l_partkey, l_suppkey)""",
    "topic_headings": """SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN s_name WHEN s_nationkey < 5 THEN ' ' || lower(s_name) || '?' WHEN s_nationkey = 24 THEN 'About ' || s_name ELSE s_name || ' About ' || s_name END AS heading FROM supplier""",
    "line_texts": """SELECT p_partkey, p_name || ' ' || p_type || '?' AS asked, 2 AS n_asked, p_name || ' ' || p_name AS told, 0 AS n_told FROM part""",
    "listing_titles": "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name ELSE p_brand END AS shown_title, CASE WHEN p_size < 10 THEN p_type ELSE '1.3' END AS shown_build FROM part",
    "image_sizes": "SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size END AS width, CASE WHEN p_size >= 10 THEN 256 END AS height FROM part",
    "json_validity": "SELECT event_id, json_valid(props) AS whole, json_valid(left(props, length(props) - 1)) AS cut FROM events",
}
