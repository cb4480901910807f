"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q, v c
  WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_FOLDED = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP4 = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents), b AS (SELECT item_id, row_number() OVER () AS r, {_FOLDED} AS w FROM benchmark),
bi AS (SELECT r, item_id, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT r, item_id, n, i AS j, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
dk AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM di),
p AS MATERIALIZED (SELECT DISTINCT doc_id, i, n, r, j, item_id FROM dk JOIN bw USING (n, k)),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM p),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1),
g AS (SELECT *, i - j AS g, i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS e FROM p),
v AS (SELECT doc_id, item_id, min(i) AS place, max(i) - min(i) + n AS size FROM g GROUP BY doc_id, item_id, r, n, g, e),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, place, item_id NULLS LAST) AS o FROM v) WHERE o = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
       CAST(coalesce(size, 0) AS INTEGER) AS longest, CAST(place - 1 AS INTEGER) AS longest_at, y.item_id AS longest_item
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM i),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE r > 1) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string([x[1] FOR x IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(gone, x[2])], ' '), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

_DIGITS = "[CAST('0x' || substr(sha1(h), 5 * g + 1, 5) AS BIGINT) FOR g IN range(0, 8)]"
_BASE32 = "array_to_string([" + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v // {p} % 32 + 1, 1)" for p in (32768, 1024, 32, 1)) + f" FOR v IN {_DIGITS}], '')"

OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": OP1, "op4_decontaminate": OP4, "op5_substring_dedup": OP5, "op10_warc": OP10}
