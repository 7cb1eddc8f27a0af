"""SQL for DuckDB of the queries that SQL can express, from their contracts and not from the operators' code.

Of op2 SQL compares all pairs, which the cells may miss some of; on the test tables, where vectors are
one cell, the two must agree.
"""

from __future__ import annotations

from .chat import ESCAPES, END, MARK, SPLIT, TRAINED
from .quality import RULES, STOP_WORDS

#: Words are what stands between these.
BLANKS = r"[ \t\n\x0b\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{BLANKS}'), lambda x: x <> '')"


#: Needs nodes (u) and both directions of links (u, v).
REACH = "reach AS (SELECT u, u AS v FROM nodes UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u), comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh, len(w) < 3 AS short FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.short = b.short AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 90 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS u FROM documents), {REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.u = d.doc_id
"""

COSINE = f"""
WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v FROM x WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
nodes AS (SELECT vec_id AS u FROM embeddings), {REACH}
SELECT vec_id, (SELECT count(*) FROM e WHERE e.u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON comp.u = vec_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT), 1)), '') AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""


def escaped(text: str) -> str:
    """A backslash first, as the others put one in."""
    for mark in sorted(ESCAPES, key=lambda m: m != "\\"):
        text = f"replace({text}, {quoted(mark)}, {quoted(ESCAPES[mark])})"
    return text


def chat(tricky: str) -> str:
    around = len(MARK) + len(SPLIT) + len(END)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {quoted(tricky)} UNION ALL SELECT -7, 1, '{TRAINED}', {quoted(tricky)}),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{TRAINED}'), '') AS loss,
  CAST(sum({around} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def quality() -> str:
    tests = []
    for rule in RULES:
        value = rule.measure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)")
        tests += [f"coalesce({value} < {rule.low}, false)"] * (rule.low is not None) + [f"coalesce({value} > {rule.high}, false)"] * (rule.high is not None)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {words('text')} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 7)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, CAST(sum(least(8, nxt - i)) AS BIGINT) AS n FROM (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 8) AS nxt FROM twice) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines, coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({', '.join(map(quoted, STOP_WORDS))}))) AS n_stop FROM d LEFT JOIN rep ON rep.r = d.r),
m AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept FROM m
"""


AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words('text')} AS w FROM documents),
m AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > low, false)}} AS s,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN m USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
b AS (SELECT part, s.A::INT + 2 * s.B::INT + 4 * s.C::INT + 8 * s.D::INT + 16 * s.E::INT AS mask, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), o AS (SELECT a.c || b.c || x.c || y.c || z.c AS o FROM c a, c b, c x, c y, c z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
st AS (SELECT o, i, 1 << (ascii(substr(o, i, 1)) - 65) AS own, CAST(coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(substr(o, CAST(j AS INT), 1)) - 65))), 0) AS INT) AS earlier FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS i)),
r AS (SELECT part, o, i, own, sum(CASE WHEN mask & (own | earlier) = 0 THEN docs ELSE 0 END) AS kept, sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN docs ELSE 0 END) AS removed, sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN docs ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN docs ELSE 0 END) AS uf, sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS gl, sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS tl FROM b, st GROUP BY ALL)
SELECT part, o AS filter_order, i AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(uf AS BIGINT) AS unique_fails, CAST(gl AS BIGINT) AS good_lost, CAST(tl AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

#: The crc32 of a decimal text, a bit at a time: each byte is followed by eight steps.
CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"

TIES = f"""
WITH h AS (SELECT *, sale_id IS NOT NULL AND {CRC} % 5 = 0 AS hot FROM sale_lines),
x AS (SELECT CASE WHEN hot THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN hot THEN -1 ELSE coalesce(item_id % 5, -1) END AS part, CASE WHEN hot THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
  CAST(floor(quantity / 10) AS BIGINT) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent, sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM x)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE pos <= 2
"""
