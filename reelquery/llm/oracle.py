"""SQL (DuckDB) that gives the rows of the operators' queries by plain definitions, for small tables."""

_REACH = """pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
low AS (SELECT a AS id, min(b) AS low FROM reach GROUP BY a)"""

TOPK = """WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.row, q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.row <> v.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""

MULTIINDEX = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), ids AS (SELECT vec_id AS id FROM v),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.9), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, id = low AS kept FROM low LEFT JOIN n USING (id)"""

NGRAMS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), ids AS (SELECT doc_id AS id FROM w),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1 : i + least(5, len(w))], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM g p JOIN g q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, c = s.n AND c = t.n AS same FROM common JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE c >= 0.8::DOUBLE * (s.n + t.n - c) - 1e-9), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a),
e AS (SELECT a AS id, count(*) AS n FROM (SELECT a, b FROM links WHERE same UNION ALL SELECT b, a FROM links WHERE same) GROUP BY 1)
SELECT id AS doc_id, low AS class_id, coalesce(n.n, 0)::BIGINT AS n_links, (coalesce(e.n, 0) + 1)::BIGINT AS n_copies, id = low AS kept FROM low LEFT JOIN n USING (id) LEFT JOIN e USING (id)"""

SUFFIXES = """WITH raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS MATERIALIZED (SELECT r, p, hash(substr(h, 2 * p + 1, 400)) AS s FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM raw)),
hit AS (SELECT r, p FROM win WHERE s IN (SELECT s FROM win GROUP BY 1 HAVING count(*) > 1)),
edge AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS first FROM hit),
runs AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(first) OVER (PARTITION BY r ORDER BY p) AS k FROM edge) GROUP BY r, k),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y, b FROM runs),
kept AS (SELECT r, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) || substr(any_value(h), 2 * max(b) + 1) AS k, count(*) AS n, sum(b - y) AS m FROM gaps JOIN raw USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(m, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM raw LEFT JOIN kept USING (r)"""

# fixed values: blanks, and scripts written without them
_BLANK = "\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_UNSPACED = "\\x{0E00}-\\x{0FFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{2E80}-\\x{2FDF}\\x{3001}-\\x{312F}\\x{31F0}-\\x{31FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF01}-\\x{FF9F}\\x{20000}-\\x{3FFFF}"
LINES = f"""WITH l AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
f AS (SELECT line, min(struct_pack(d := doc_id, n := ln)) AS o FROM l WHERE regexp_matches(line, '[^ \\t\\r]') GROUP BY 1),
u AS (SELECT line, o, regexp_extract_all(lower(line), '[{_UNSPACED}]|[^{_BLANK}{_UNSPACED}]+') AS u, array_to_string(regexp_extract_all(lower(line), '[^{_BLANK}]+'), ' ') AS c FROM f),
w AS (SELECT line, o, 0 AS lv, u AS w FROM u WHERE len(u) >= 8 UNION ALL SELECT line, o, 1, regexp_extract_all(c, '(?s).') FROM u WHERE len(u) <= 9 AND length(c) >= 16),
v AS (SELECT line, o, lv, i, hash(list_concat(w[: i - 1], w[i + 1 :])) AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
put AS (SELECT lv, i, k, min(o) AS o FROM v GROUP BY ALL),
less AS (SELECT lv, k, min(o) AS o FROM v GROUP BY ALL),
whole AS (SELECT lv, hash(w) AS k, min(o) AS o FROM w GROUP BY ALL),
near AS (SELECT v.line FROM v JOIN put USING (lv, i, k) WHERE put.o < v.o UNION SELECT v.line FROM v JOIN whole USING (lv, k) WHERE whole.o < v.o
  UNION SELECT w.line FROM w JOIN less ON less.k = hash(w.w) AND less.lv = w.lv WHERE less.o < w.o UNION SELECT w.line FROM w JOIN whole ON whole.k = hash(w.w) AND whole.lv = w.lv WHERE whole.o < w.o),
judged AS (SELECT l.*, f.o IS NOT NULL AND (f.o <> struct_pack(d := doc_id, n := ln) OR near.line IS NOT NULL) AS gone FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
left_over AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT gone) AS t FROM judged GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN left_over USING (doc_id)"""

_CRC = """crc_table AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """The CRC-32 of a string, by bytes and a table."""
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + "))"
_TREE = "{0} AS (SELECT g, 0 AS lvl, pos, n, d FROM {1} UNION ALL SELECT g, lvl + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY g, lvl, pos // 16)"
_SIDES = """{0} AS (SELECT l.g, l.pos, n.lvl, string_agg(n.d, '' ORDER BY n.pos) FILTER (WHERE n.pos < l.pos >> 4 * n.lvl) AS b, string_agg(n.d, '' ORDER BY n.pos) FILTER (WHERE n.pos > l.pos >> 4 * n.lvl) AS a
FROM {1} l JOIN {2} n ON n.g IS NOT DISTINCT FROM l.g AND n.n > 1 AND n.pos // 16 = l.pos >> 4 * (n.lvl + 1) GROUP BY ALL)"""
MERKLE = f"""WITH RECURSIVE {_CRC},
leaves AS (SELECT doc_id, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, {_LEAF.format("text")} AS d,
  CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format(_LOWER.format("text"))} END AS changed FROM documents, crc_table),
{_TREE.format("low", "leaves")},
subroots AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, d FROM low WHERE n = 1),
{_TREE.format("high", "subroots")}, {_SIDES.format("low_sides", "leaves", "low")}, {_SIDES.format("high_sides", "subroots", "high")},
sides AS (SELECT doc_id, lvl, coalesce(b, '') AS b, coalesce(a, '') AS a FROM leaves JOIN low_sides USING (g, pos)
  UNION ALL SELECT doc_id, lvl + 1000, coalesce(b, ''), coalesce(a, '') FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.g JOIN high_sides h ON h.pos = s.pos),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS k FROM sides),
folded AS (SELECT doc_id, 0 AS k, coalesce(changed, d) AS v FROM leaves UNION ALL SELECT doc_id, s.k, sha256(b || v || a) FROM folded f JOIN steps s USING (doc_id) WHERE s.k = f.k + 1),
ends AS (SELECT doc_id, arg_max(v, k) AS folded_root FROM folded GROUP BY 1),
proofs AS (SELECT doc_id, sha256(string_agg(b || a, '' ORDER BY k)) AS p FROM steps GROUP BY 1)
SELECT doc_id, l.d AS leaf, s.d AS subroot, h.d AS root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = h.d AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.g JOIN (SELECT d FROM high WHERE n = 1) h ON true JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)"""

SPELLING = f"""WITH RECURSIVE {_CRC},
found AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
keyed AS (SELECT run, c, {_crc("doc_id || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS c FROM found WHERE length(run) >= 7 GROUP BY ALL), crc_table),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM keyed),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM less a JOIN v ON v.word = a.k UNION SELECT v.word, a.word, a.n FROM less a JOIN v ON v.word = a.k),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN m END AS form_n,
  CASE WHEN m >= 10 * v.n THEN (SELECT min(near) FROM near x WHERE x.word = v.word AND x.m = best.m) END AS form FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS pos, 0 AS k FROM formed UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN formed f ON f.word = walk.pos WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(pos, k) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
BENCHMARK = f"""WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + k], ' ') AS s, k FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
at_place AS (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS MATERIALIZED (SELECT DISTINCT r, i, p.k, item_id FROM at_place p JOIN win ON win.k = p.k AND win.s = array_to_string(p.w[i + 1 : i + p.k], ' ')),
words AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
named AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN named USING (r)"""
