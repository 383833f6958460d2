"""DuckDB SQL of the catalogue volumes, written apart from the engine's own expressions."""

from __future__ import annotations

FRN = 281474976710656
_EPOCH = "CAST(epoch(o_orderdate) AS BIGINT)"

RAW = f"""
src AS (SELECT coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l, doc_id, n_chars FROM documents),
srcs AS (SELECT s, row_number() OVER (ORDER BY s) AS n FROM (SELECT DISTINCT s FROM src)),
langs AS (SELECT s, l, row_number() OVER (ORDER BY s, l) AS n FROM (SELECT DISTINCT s, l FROM src)),
web AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, translate(regexp_extract(url, '^[a-z]+://[^/?#]*/(.*)$', 1), '/' || chr(92), '__') AS leaf, coalesce(length(html), 0) AS chars FROM pages),
hosts AS (SELECT host, row_number() OVER (ORDER BY host) AS n FROM (SELECT DISTINCT host FROM web)),
raw AS (
SELECT v.volume, v.ord AS volume_ord, CAST(5 AS BIGINT) AS record, CAST(NULL AS BIGINT) AS parent, v.volume AS name, true AS is_dir, false AS hidden, false AS system, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime_secs FROM (VALUES ('C:', 0), ('D:', 1), ('E:', 2)) v(volume, ord)
UNION ALL SELECT 'C:', 0, 1000 + r_regionkey, 5, r_name, true, r_name = 'MIDDLE EAST', false, 0, 0 FROM region
UNION ALL SELECT 'C:', 0, 2000 + n_nationkey, 1000 + n_regionkey, n_name, true, false, n_nationkey = 7, 0, 0 FROM nation
UNION ALL SELECT 'C:', 0, 1000000 + c_custkey, 2000 + c_nationkey, c_name, true, false, false, 0, 0 FROM customer
UNION ALL SELECT 'C:', 0, 1000000000 + o_orderkey, 1000000 + o_custkey, 'Order_' || o_orderkey || '.' || CASE o_orderstatus WHEN 'O' THEN 'txt' WHEN 'F' THEN 'PDF' ELSE 'dll' END, false, false, false, CAST(round(o_totalprice * 100) AS BIGINT), {_EPOCH} FROM orders
UNION ALL SELECT 'D:', 1, 1000 + n, 5, s, true, false, false, 0, 0 FROM srcs
UNION ALL SELECT 'D:', 1, 100000 + langs.n, 1000 + srcs.n, l, true, false, false, 0, 0 FROM langs JOIN srcs USING (s)
UNION ALL SELECT 'D:', 1, 1000000000 + doc_id, 100000 + n, 'doc_' || doc_id || '.' || l, false, false, false, n_chars, 0 FROM src JOIN langs USING (s, l)
UNION ALL SELECT 'E:', 2, 1000 + n, 5, host, true, false, false, 0, 0 FROM hosts
UNION ALL SELECT 'E:', 2, 1000000000 + page_id, 1000 + n, (CASE WHEN leaf = '' THEN 'index' ELSE leaf END) || '_' || page_id || '.HTML', false, false, false, chars, 0 FROM web JOIN hosts USING (host)
)"""

TREE = """
walk AS (
SELECT volume, record, is_dir, name AS path, '' AS parent_path, hidden OR system AS ex FROM raw WHERE parent IS NULL
UNION ALL SELECT r.volume, r.record, r.is_dir, w.path || chr(92) || r.name, w.path || chr(92), w.ex OR r.hidden OR r.system FROM raw r JOIN walk w ON r.volume = w.volume AND r.parent = w.record AND w.is_dir
),
e AS (SELECT raw.*, raw.record AS entry_id, 281474976710656 + raw.record AS frn, 281474976710656 + raw.parent AS parent_frn, lower(raw.name) AS low, walk.path, walk.parent_path, walk.ex FROM raw JOIN walk USING (volume, record))"""

BASE = f"WITH RECURSIVE {RAW},{TREE}\n"


def matching(condition: str, hidden: bool = False, columns: str = "volume, entry_id, name") -> str:
    seen = "true" if hidden else "NOT ex"
    return f"{BASE}SELECT {columns} FROM e WHERE {seen} AND ({condition})"


#: Hard links: an object for each part, a link in each order that lists it.
LINKS = """
li AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem JOIN part ON l_partkey = p_partkey),
links AS (SELECT 281474976710656 + 5000000000 + p AS frn, 281474976710656 + 1000000000 + o AS parent_frn, p_name AS name, 1000000000000 + o * 10000000 + p AS entry_id, CAST(round(p_retailprice * 100) AS BIGINT) AS size, o, p FROM li JOIN part ON p = p_partkey)"""

#: One batch of changes: three neighbouring events are one object; every second object stands before.
JOURNAL = """
ev AS (SELECT event_id AS usn, event_id // 3 AS k, event_type AS t, 'f_' || (event_id // 3) || '_' || (event_id % 5) || '.txt' AS name FROM events),
red AS (SELECT k, bool_or(t = 'error') AS del, bool_or(t = 'signup') AS cre, bool_or(t = 'click') AS ren, bool_or(t IN ('view', 'purchase')) AS st, min(usn) AS first_usn, arg_max(name, usn) AS new_name FROM ev GROUP BY k),
base AS (SELECT DISTINCT k, 1000 + k AS entry_id, 'f_' || k || '.txt' AS name, k * 10 AS size, CAST(0 AS BIGINT) AS mtime_secs FROM ev WHERE k % 2 = 0),
act AS (SELECT red.*, base.k IS NOT NULL AS was, base.size AS old_size, CASE WHEN k % 3 = 0 THEN k * 100 END AS got,
 CASE WHEN del THEN 'delete' WHEN cre OR ren THEN 'upsert' WHEN st AND base.k IS NOT NULL THEN 'stat' ELSE 'ignore' END AS action FROM red LEFT JOIN base USING (k)),
kept AS (SELECT k, entry_id, name, (action = 'delete' OR action = 'upsert' AND ren) AS tombstone,
 CASE WHEN action = 'upsert' AND NOT ren OR action = 'stat' THEN coalesce(got, size) ELSE size END AS size,
 CASE WHEN (action = 'upsert' AND NOT ren OR action = 'stat') AND got IS NOT NULL THEN 1000000000 ELSE 0 END AS mtime_secs, action, was FROM base JOIN act USING (k)),
made AS (SELECT k, (SELECT greatest(max(entry_id), 5) FROM base) + row_number() OVER (ORDER BY first_usn) AS entry_id, new_name AS name, false AS tombstone, coalesce(got, old_size, 0) AS size, CASE WHEN got IS NOT NULL THEN 1000000000 ELSE 0 END AS mtime_secs, action, was FROM act WHERE action = 'upsert'),
done AS (SELECT * FROM kept UNION ALL SELECT * FROM made)"""
