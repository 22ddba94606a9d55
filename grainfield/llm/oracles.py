"""SQL of the corpus queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
a AS (SELECT doc_id, 'assign' kind, 0 k, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) m,
  regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) held,
  string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') g, 8 least FROM d
 UNION ALL SELECT doc_id, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), string_split_regex(t, 'AKIA[A-Z0-9]+'), 16 FROM d
 UNION ALL SELECT doc_id, 'hex', 2, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0), string_split_regex(t, '[0-9a-f]+'), 32 FROM d),
u AS (SELECT doc_id, kind, k, least, unnest(range(1, len(m) + 1)) i, m, held, g FROM a),
e AS (SELECT doc_id, kind, k, i, length(m[i]) n, length(g[i]) gap, length(held[i]) >= least fits FROM u),
s AS (SELECT doc_id, kind, k, fits, CAST(sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) e, n FROM e),
f AS (SELECT doc_id, k, e - n AS b, kind || ':' || (e - n) || ':' || e span FROM s WHERE fits),
r AS (SELECT doc_id, string_agg(span, ',' ORDER BY b, k) spans, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) n0, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) n1, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) n2 FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) n_assign, CAST(coalesce(n1, 0) AS BIGINT) n_access, CAST(coalesce(n2, 0) AS BIGINT) n_hex, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id query_id, c.vec_id vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""
WITH b AS (SELECT item_id, {_WORDS} w FROM benchmark), i AS (SELECT item_id, w, least(13, len(w)) k FROM b WHERE len(w) > 0),
p AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) a FROM i), win AS (SELECT DISTINCT item_id, k, array_to_string(w[a : a + k - 1], ' ') s FROM p),
d AS (SELECT doc_id, {_WORDS} w FROM documents), kk AS (SELECT DISTINCT k FROM win),
q AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) a FROM d, kk WHERE len(w) >= k), h AS (SELECT doc_id, k, a, array_to_string(w[a : a + k - 1], ' ') s FROM q),
m AS (SELECT h.doc_id, h.k, h.a, win.item_id FROM h JOIN win ON h.k = win.k AND h.s = win.s),
x AS (SELECT DISTINCT doc_id, unnest(range(a, a + k)) pos FROM (SELECT DISTINCT doc_id, k, a FROM m)), n AS (SELECT doc_id, count(*) n_hit FROM x GROUP BY 1),
it AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

SQL = {"op2_secrets": SECRETS, "op4_topk": TOP_K, "op5_decontaminate": CONTAMINATION}
