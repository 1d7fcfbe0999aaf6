"""DuckDB counterparts of operators 1, 2, 3 and 7, written from their contracts."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_DEDUP_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], chr(10))) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN least USING (h), range(50) r(j) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (SELECT words.doc_id, count(hit.pos) AS n_removed,
                string_agg(word, ' ' ORDER BY words.pos) FILTER (hit.pos IS NULL) AS text
         FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.pos = words.pos GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

JACCARD_JOIN_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], chr(10))) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
         FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * pairs.n >= 80 * (p.n + q.n - pairs.n)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY r.doc_id
"""

SUFFIX_DEDUP_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k
        FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM b WHERE n >= 200)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
breaks AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM breaks),
spans AS (SELECT doc_id, run, min(i) AS low, max(i) + 200 AS high FROM runs GROUP BY 1, 2),
gaps AS (
  SELECT b.doc_id, s.high AS low, lead(s.low, 1, b.n) OVER (PARTITION BY b.doc_id ORDER BY s.low) AS high, h
  FROM b JOIN spans s ON s.doc_id = b.doc_id
  UNION ALL SELECT b.doc_id, 0, coalesce((SELECT min(low) FROM spans s WHERE s.doc_id = b.doc_id), b.n), h FROM b),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS h FROM gaps GROUP BY 1),
gone AS (SELECT doc_id, sum(high - low) AS n, count(*) AS spans FROM spans GROUP BY 1)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
       coalesce(gone.spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM b JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN gone ON gone.doc_id = b.doc_id
"""

DECONTAMINATE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
known AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i
        FROM item WHERE len(ws) > 0)),
win AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM known) WHERE len(ws) >= n)),
met AS (SELECT doc_id, win.n, i, item_id FROM win JOIN known ON known.k = win.k AND known.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM met) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
