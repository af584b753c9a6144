"""DuckDB SQL that gives the rows of the queries SQL can express."""

from __future__ import annotations

from lumenscan.llm.quality import CLASSES, VOCABULARY, QualityRules

WORDS = r"[^\x20\x09-\x0D]+"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality_sql(r: QualityRules = QualityRules()) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    k = r.window
    counts = ", ".join(f"coalesce(len(regexp_extract_all(text, {q(x)})), 0) AS {n}" for n, x in CLASSES.items())
    n_classes = len(CLASSES)
    class_bins = " UNION ALL ".join(
        [f"SELECT doc_id, lang, 'classes' kind, {i} i, {n}::DOUBLE c, octets::DOUBLE total FROM f" for i, n in enumerate(CLASSES)]
        + [f"SELECT doc_id, lang, 'classes', {n_classes}, n_chars - word_chars, octets FROM f", f"SELECT doc_id, lang, 'classes', {n_classes + 1}, octets - n_chars, octets FROM f"]
        + [f"SELECT doc_id, lang, 'classes', {n_classes + 2}, word_chars - {' - '.join(CLASSES)}, octets FROM f"]
    )
    vocabulary = ", ".join(f"({q(v)}, {i})" for i, v in enumerate(VOCABULARY))
    return f"""
WITH w AS (SELECT doc_id, lang, text, coalesce(regexp_extract_all(text, {q(WORDS)}), []) ws FROM documents),
f AS (SELECT doc_id, lang, len(ws) n_words, coalesce(length(array_to_string(ws, '')), 0) word_chars, coalesce(length(text), 0) n_chars, coalesce(strlen(text), 0) octets, {counts},
  len(list_filter(coalesce(string_split(text, chr(10)), []), lambda x: regexp_matches(x, {q(WORDS)}))) - len(list_distinct(list_filter(coalesce(string_split(text, chr(10)), []), lambda x: regexp_matches(x, {q(WORDS)})))) n_dup_lines FROM w),
g AS (SELECT doc_id, unnest(range(1, len(ws) - {k} + 2)) p, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i+{k - 1}], ' '))) t FROM w),
two AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT p + o) n_repeat_words FROM two, (SELECT unnest(range(0, {k})) o) GROUP BY doc_id),
voc(v, i) AS (VALUES {vocabulary}),
h AS (SELECT doc_id, voc.i i, count(*)::DOUBLE c FROM (SELECT doc_id, lower(unnest(ws)) v FROM w) JOIN voc USING (v) GROUP BY 1, 2),
bins AS ({class_bins}
  UNION ALL SELECT f.doc_id, lang, 'common', h.i, h.c, n_words FROM h JOIN f USING (doc_id)
  UNION ALL SELECT f.doc_id, lang, 'common', {len(VOCABULARY)}, n_words - coalesce(s, 0), n_words FROM f LEFT JOIN (SELECT doc_id, sum(c) s FROM h GROUP BY 1) USING (doc_id)),
totals AS (SELECT lang, sum(octets) octets, sum(n_words) words FROM f WHERE lang IS NOT NULL GROUP BY 1 HAVING sum(n_words) > 0),
grid AS (SELECT 'classes' kind, unnest(range({n_classes + 3})) i UNION ALL SELECT 'common', unnest(range({len(VOCABULARY) + 1}))),
ref AS (SELECT t.lang, g.kind, g.i, coalesce(s.c, 0) / (CASE WHEN g.kind = 'classes' THEN (SELECT sum(c) FROM bins b WHERE b.lang = t.lang AND b.kind = 'classes') ELSE t.words END) q
  FROM totals t CROSS JOIN grid g LEFT JOIN (SELECT lang, kind, i, sum(c) c FROM bins GROUP BY 1, 2, 3) s ON s.lang = t.lang AND s.kind = g.kind AND s.i = g.i),
d AS (SELECT f.doc_id, r.lang, r.kind, sqrt(greatest(0, sum(
    (CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / 2 - CASE WHEN p + q > 0 THEN (p + q) / 2 * log2((p + q) / 2) ELSE 0 END))) d
  FROM (SELECT f.doc_id, r.lang, r.kind, r.i, r.q, coalesce(b.c, 0) / greatest(1, CASE WHEN r.kind = 'classes' THEN f.octets ELSE f.n_words END) p FROM f CROSS JOIN ref r LEFT JOIN bins b ON b.doc_id = f.doc_id AND b.kind = r.kind AND b.i = r.i) r JOIN f USING (doc_id) GROUP BY 1, 2, 3),
near AS (SELECT doc_id, min(d) FILTER (kind = 'classes') dc, min(d) FILTER (kind = 'common') dw FROM d GROUP BY 1),
o AS (SELECT f.doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, symbol::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, n_chars, dc, dw
  FROM f LEFT JOIN rep USING (doc_id) LEFT JOIN near USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {r.min_words} OR 100 * n_repeat_words > {r.repeat_percent} * n_words AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.repeat_percent} * n_words)
  AND NOT (n_chars >= {r.min_chars_classes} AND coalesce(dc, 0) > {r.max_class_distance}) AND NOT (n_words >= {r.min_words_common} AND coalesce(dw, 0) > {r.max_common_distance}) AS kept
FROM o"""


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 5"""

_escaped = lambda x: rf"replace(replace(replace({x}, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>')"
CHAT_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END)::BIGINT loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) loss_sha256,
  sum(15 + length(replace({_escaped("r")}, chr(10), '\n')) + length({_escaped("t")}))::BIGINT formatted_chars
FROM c GROUP BY conv_id"""

NEAR_DUPLICATE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_AZ}', '{_az}'), '{WORDS}') ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id node, doc_id root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT n_shingles, min(root) component_id, doc_id = min(root) kept
FROM r LEFT JOIN n ON n.doc_id = r.node JOIN (SELECT doc_id FROM documents) d ON d.doc_id = r.node GROUP BY d.doc_id""".replace("SELECT doc_id, coalesce(any_value", "SELECT d.doc_id, coalesce(any_value").replace("doc_id = min(root) kept", "d.doc_id = min(root) kept")
