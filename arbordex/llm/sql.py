"""DuckDB SQL for the operators that SQL can express.

Not here: op2, op9 and op11 (tokenizers), op6 (hash keys), op7 (XXH64 and components), op8 (a trained model).
"""

from __future__ import annotations

from .secret_scan import EXTRA_RULES

_WS = r"\x20\x09-\x0D"
_LETTERS = r"\p{L}\p{M}"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '[^{_WS}]+')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
base AS (SELECT r, doc_id, t, w, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS wc, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS ls FROM d),
wins AS (SELECT r, i, w[i:i + 7] AS g FROM base, range(1, len(w) - 6) x(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM wins) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) y(k) GROUP BY r),
tops AS (SELECT r, max(c) AS top, count(*) AS n_distinct FROM (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(w) AS x FROM base) GROUP BY r, x) GROUP BY r),
f AS (SELECT base.*, coalesce(wc, 0) AS word_chars, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(top, 0) AS top, coalesce(n_distinct, 0) AS n_distinct,
 len(list_filter(w, lambda x: ends_with(x, '!!') OR ends_with(x, '??'))) AS shouted, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS again,
 len(list_filter(string_split(t, ''), lambda x: x <> lower(x))) AS up, len(list_filter(string_split(t, ''), lambda x: x <> lower(x) OR x <> upper(x) OR x = 'ß')) AS cased,
 length(t) - length(regexp_replace(t, '[{_LETTERS}]', '', 'g')) AS letters
 FROM base LEFT JOIN rep USING (r) LEFT JOIN tops USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * shouted > 3 * n_words OR 10 * again > 3 * n_words OR len(ls) >= 4 AND 2 * n_dup_lines > len(ls)
 OR 2 * up > cased AND cased > 0 OR 2 * letters < word_chars OR n_words >= 40 AND 4 * top > n_words OR n_words >= 60 AND n_distinct * n_distinct < 4 * n_words) AS kept FROM v
"""


#: The base kinds as the contract gives them, apart from the operator's own patterns: kind, pattern, group, least length.
_BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
]


def _spans(kind: str, pattern: str, group: int, least: int, order: int) -> str:
    pattern = pattern.replace("'", "''")
    parts = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""SELECT r, {order} AS o, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits, {parts} AS parts FROM d WHERE regexp_matches(t, '{pattern}')"""


_KINDS = "\nUNION ALL ".join(_spans(*rule, n) for n, rule in enumerate([*_BASE, *((r.kind, r.pattern, r.group, r.least) for r in EXTRA_RULES)]))
OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_KINDS}),
x AS (SELECT r, o, kind, least, i, length(gaps[i]) AS gap, length(hits[i]) AS n, length(parts[i]) AS p FROM m, range(1, len(hits) + 1) y(i)),
s AS (SELECT *, sum(gap + n) OVER (PARTITION BY r, o ORDER BY i) AS stop FROM x),
k AS (SELECT r, o, kind, stop - n AS start, kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM s WHERE p >= least),
a AS (SELECT r, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex, string_agg(span, ',' ORDER BY start, o) FILTER (WHERE o < 3) AS base, string_agg(span, ',' ORDER BY start, o) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""

OP4 = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT id, min(e) AS e FROM v WHERE id % 50 = 0 GROUP BY id),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON q.id <> c.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""

OP5 = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, length(role) + length(regexp_replace(role, '[^\\<"]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<"]', '', 'g')) + length('<turn role=""></turn>') + 1 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(chars) AS BIGINT) AS formatted_chars FROM n GROUP BY conv_id, alone
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d, range(1, len(ls) + 1) x(i)),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce('d' || doc_id, 'r' || r)) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256 FROM l LEFT JOIN f ON l.key = f.key GROUP BY l.r, l.doc_id
"""

OP12 = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS rest),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS c, hex(encode(id || run)) AS x FROM r GROUP BY id, run),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) + 1, 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))), lambda a, b: xor(a >> 8, rest[(xor(a, b) & 255) + 1]))) AS h FROM g, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS k FROM v, range(1, length(word) + 1) x(i)),
near AS (SELECT DISTINCT * FROM (SELECT a.word, b.word AS form, b.n AS form_n FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
 UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.k = b.word UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.k = b.word)),
best AS (SELECT word, count(*) AS n_near, arg_min(form, (-form_n, form)) AS form, max(form_n) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, CASE WHEN form_n >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS top FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.top = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, top AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word JOIN f e ON up.top = e.word WHERE e.form IS NULL
"""

OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT)
 + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > first_id, false) AS INT) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN firsts USING (t) LEFT JOIN marks ON d.doc_id = marks.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM j GROUP BY ALL),
letters AS (SELECT 'ABCDE'[i + 1] AS x, 1 << i AS bit FROM range(0, 5) r(i)),
o AS (SELECT '' AS filter_order, 0 AS held UNION ALL SELECT filter_order || x, CAST(held + bit AS INT) FROM o, letters WHERE held & bit = 0),
steps AS (SELECT filter_order, i AS step, (SELECT CAST(coalesce(sum(bit), 0) AS INT) FROM letters WHERE contains(substr(filter_order, 1, i - 1), x)) AS held, 1 << strpos('ABCDE', filter_order[i]) - 1 AS bit FROM o, range(1, 6) r(i) WHERE held = 31),
s AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE fails & (held | bit) = 0) AS kept, sum(n) FILTER (WHERE fails & held = 0 AND fails & bit > 0) AS removed, sum(n) FILTER (WHERE fails & held > 0 AND fails & bit > 0) AS redundant,
 sum(n) FILTER (WHERE fails = bit) AS unique_fails, sum(good) FILTER (WHERE fails & held = 0 AND fails & bit > 0) AS good_lost, sum(toxic) FILTER (WHERE fails & held = 0 AND fails & bit > 0) AS toxic_lost FROM c, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM s
"""

SQL = {"op1_quality_rules": OP1, "op3_secret_scan": OP3, "op4_topk_search": OP4, "op5_chat_format": OP5, "op10_line_dedup": OP10, "op12_spelling_variants": OP12, "op13_filter_audit": OP13}
