"""DuckDB SQL for the registered queries that SQL can express."""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, list_aggregate(w[i:i + least(13, len(w)) - 1], 'string_agg', ' ') AS win
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT k, i, d.n, item FROM (SELECT k, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win FROM docs, lengths, unnest(range(1, len(w) - n + 2)) AS r(i)) d
  JOIN windows USING (n, win)),
words AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS r(j) GROUP BY k),
found AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (k) LEFT JOIN found USING (k)
"""

_SPACED = r"regexp_extract_all(" + _FOLD + r", '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(list_aggregate(w[i:i + least(4, len(w)) - 1], 'string_agg', ' ')) AS s FROM d, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""

OP7 = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text,
    md5(coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-')) AS h
  FROM conversations),
p AS (SELECT *, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE pos = n_turns GROUP BY prefix),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n_turns))
SELECT conv_id, CAST(pos AS BIGINT) AS pos, CAST(n_turns AS BIGINT) AS n_turns,
  '<|im_start|>' || replace(replace(coalesce(role, 'user'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10)
    || replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10) AS rendered
FROM p JOIN kept USING (conv_id)
"""

OP8 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM d, unnest(range(0, n - 99)) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM again),
grouped AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM grouped GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), n) AS b FROM spans JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 0, coalesce(min(a), any_value(n)) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) JOIN kept USING (doc_id)
"""

OP9 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP10 = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS turn FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM src),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, cap <= level * w AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * max(CASE WHEN NOT is_full THEN level END) OVER () END AS target FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, doc_id, size) AS copy, sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM s),
p AS (SELECT c.*, source_size, target FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CAST(upto + read * source_size AS DOUBLE) / target AS finish FROM p, (VALUES (0), (1)) AS v(read) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, turn, doc_id, copy, read ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r),
k AS (SELECT source, copy, sum(size) AS taken FROM o WHERE run <= (SELECT floor(sum(target) + 1e-6) FROM t) GROUP BY source, copy)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM p LEFT JOIN k ON p.source IS NOT DISTINCT FROM k.source AND p.copy = k.copy
"""

# CRC-32 of an ASCII string, bit by bit.
_CRC32 = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""

_LAST = r"right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"

OP11 = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, coalesce('c' || conv_id, 'n') AS k FROM conversations),
raw AS (
  SELECT coalesce('c' || conv_id, 'n') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations),
d AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS r(i) WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS nth FROM d),
t AS (
  SELECT *, substring(role, 1, 1) AS ini, lag(substring(role, 1, 1)) OVER (PARTITION BY k ORDER BY nth) AS prev,
    CASE WHEN {_LAST} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY nth) > 1 THEN 'duplicate' WHEN {_LAST} NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM n),
counts AS (
  SELECT k, coalesce(max(turn)::BIGINT - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE nth > 1 AND (prev || ini) NOT IN ('su', 'ua', 'au')) AS illegal, max(nth) AS last
  FROM t GROUP BY k),
runs(p, m, cost, run, lines) AS (VALUES
  ('0', '0', 0, '', ''), ('0', 'u', 3, 'I', 'user:' || chr(10)), ('0', 'a', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', 'user:' || chr(10)), ('s', 'a', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', 'assistant:' || chr(10)),
  ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', 'user:' || chr(10))),
edits(m, ini, q, cost, e, role) AS (VALUES
  ('0', NULL, '0', 4, 'D', NULL), ('s', NULL, 's', 4, 'D', NULL), ('u', NULL, 'u', 4, 'D', NULL), ('a', NULL, 'a', 4, 'D', NULL),
  ('0', 's', 's', 0, 'K', NULL), ('0', 'u', 'u', 0, 'K', NULL), ('s', 'u', 'u', 0, 'K', NULL), ('a', 'u', 'u', 0, 'K', NULL), ('u', 'a', 'a', 0, 'K', NULL),
  ('0', NULL, 'u', 3, 'R', 'user'), ('s', NULL, 'u', 3, 'R', 'user'), ('a', NULL, 'u', 3, 'R', 'user'), ('u', NULL, 'a', 3, 'R', 'assistant')),
best AS (
  SELECT DISTINCT k, 0::BIGINT AS nth, '0' AS q, struct_pack(cost := 0::BIGINT, audit := '', lines := '') AS b FROM t
  UNION ALL
  SELECT best.k, best.nth + 1, edits.q, min(struct_pack(cost := b.cost + runs.cost + edits.cost + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, audit := b.audit || run || e,
    lines := b.lines || runs.lines || CASE WHEN e = 'D' THEN '' ELSE coalesce(edits.role, t.role) || ':' || text || chr(10) END))
  FROM best JOIN t ON t.k = best.k AND t.nth = best.nth + 1 JOIN runs ON runs.p = best.q JOIN edits ON edits.m = runs.m
  WHERE (edits.ini IS NULL OR edits.ini = t.ini) AND (e = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY best.k, best.nth, edits.q),
ended AS (
  SELECT best.k, min(struct_pack(cost := b.cost + runs.cost, audit := b.audit || run, lines := b.lines || runs.lines)) AS b
  FROM best JOIN counts ON counts.k = best.k AND counts.last = best.nth JOIN runs ON runs.p = best.q AND (runs.m = 'a' OR runs.m = '0' AND run = '') GROUP BY best.k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(left(b.lines, length(b.lines) - 1), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (k) LEFT JOIN ended USING (k)
"""

OP13 = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, substring(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS h, turn
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id, h, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 64), h) AS nth
  FROM own),
c AS (SELECT conv_id, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS heads FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, nth - 4 AS k, h, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND nth <= heads
  UNION ALL SELECT conv_id, nth AS k, h, words FROM c JOIN t USING (conv_id) WHERE nth > heads),
steps AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY k) AS path, words FROM rebuilt),
p AS (
  SELECT conv_id, depth, path, words, substring(path, 1, greatest(0, length(path) - 33)) AS up FROM steps
  UNION ALL SELECT conv_id, 0, '', 0, NULL FROM c),
nodes AS (SELECT path, any_value(up) AS up, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY path),
children AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.path, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children USING (path) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path),
last AS (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY path)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(nodes.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes LEFT JOIN nodes up ON nodes.up = up.path LEFT JOIN children ON children.path = nodes.path JOIN below ON below.path = nodes.path LEFT JOIN ends ON ends.path = nodes.path
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1, "op3_ngram_join": OP3, "op5_warc": OP5, "op7_chat": OP7, "op8_repeats": OP8, "op9_topk": OP9, "op10_mix": OP10, "op11_repair": OP11, "op13_trie": OP13}
