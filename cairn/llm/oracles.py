"""DuckDB SQL for the queries that SQL can express."""

from cairn.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, span_of
from cairn.llm.urls import ORACLE as URL_FILTER

CHAT = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, contains(text, '<turn:') OR contains(text, '</turn>') OR contains(role, '<turn:') OR contains(role, '</turn>') OR contains(role, chr(10)) AS conflict,
    length(replace(replace(text, '\', '\b'), '<', '\l')) AS text_escaped, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) AS role_escaped FROM own)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + CASE WHEN conflict THEN text_escaped + role_escaped ELSE length(text) + length(role) END) AS BIGINT) AS formatted_chars,
  CAST(max(CASE WHEN conflict THEN 1 ELSE 0 END) AS INTEGER) AS escape_level
FROM marked GROUP BY conv_id
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _phrase(phrase: str, label: str) -> str:
    test = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
    return f"SELECT rid, i - 1 AS p, '{label}' AS label FROM spots WHERE {test}"


LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
spots AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
base AS ({' UNION ALL '.join(_phrase(p, label) for p, label in PHRASES.items())}),
templates(k, label, tokens, span) AS (VALUES {', '.join(f"({k}, '{label}', {sorted(set(t.split()))}, {span_of(t)})" for k, (label, t) in enumerate(TEMPLATES))}),
known AS (SELECT k, unnest(tokens) AS word FROM templates),
found AS (SELECT s.rid, k.k, s.i, k.word FROM (SELECT rid, i, ws[i] AS word FROM spots) s JOIN known k USING (word)),
blocks AS (SELECT a.rid, a.k, a.i, count(DISTINCT b.word) AS n FROM found a JOIN found b ON a.rid = b.rid AND a.k = b.k AND b.i >= a.i AND b.i < a.i + (SELECT span FROM templates x WHERE x.k = a.k) GROUP BY ALL),
hits AS (SELECT b.rid, t.label, b.n / len(t.tokens) AS share FROM blocks b JOIN templates t USING (k) WHERE b.n >= {CONTAINMENT} * len(t.tokens) - 1e-9),
b AS (SELECT rid, count(*) AS n, min(p) AS lo, max(p) AS hi FROM base GROUP BY rid),
every AS (SELECT rid, label FROM base UNION SELECT rid, label FROM hits)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM base x WHERE x.rid = w.rid)), '') AS base_labels,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM every x WHERE x.rid = w.rid), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce((SELECT max(share) FROM hits x WHERE x.rid = w.rid), 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (rid)
"""

TOP_K = """
WITH v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(max(list_dot_product(q.v, c.v)) AS BIGINT) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
sizes AS (SELECT g.lang, count(term) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN kept USING (lang) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT g.lang, g.source, coalesce(sum(own.n), 0) AS n FROM groups g LEFT JOIN own USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(own.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (t.n + 5 * s.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (s.n + 5 * s.v) AS q
  FROM total t JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN own ON own.lang = t.lang AND own.source = t.source AND own.term = k.term),
gaps AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""

LEXICAL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
size AS (SELECT rid, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
whole AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM size),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf GROUP BY term),
part AS (SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size.n * whole.n) // whole.l))) AS s FROM tf JOIN weight USING (term) JOIN size USING (rid), whole),
score AS (SELECT item_id, rid, CAST(sum(s) AS BIGINT) AS score FROM part JOIN item USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM score JOIN size USING (rid) QUALIFY rank <= 10
"""

ORACLES = {"op2_chat": CHAT, "op3_url_filter": URL_FILTER, "op9_licenses": LICENSES, "op10_topk": TOP_K, "op11_lexical": LEXICAL, "op13_divergence": DIVERGENCE}
