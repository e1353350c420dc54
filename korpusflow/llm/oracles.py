"""Oracle SQL (DuckDB) of the operators that SQL can express on whole tables."""

from __future__ import annotations

from korpusflow.llm.divergence import LEAST_DOCS, TERM_RANKS, WHOLE
from korpusflow.llm.licenses import LOWER, NOTICES, PERCENT, PHRASES, STEP, UPPER, notice_words
from korpusflow.llm.secrets import BASE, COPIED_OWNERS, COPIED_REPOSITORIES, KINDS

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest FROM p),
r AS (SELECT payload_digest, max(page_id) AS largest FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM d JOIN r USING (payload_digest)"""


def _kind(kind: str) -> str:
    pattern, group, least = KINDS[kind]
    pattern = pattern.replace("'", "''")
    return f"""SELECT rid, doc_id, owner, repo, '{kind}' AS kind, {list(KINDS).index(kind)} AS no, x.s AS s, x.s + x.n AS e, x.v AS v FROM (
SELECT rid, doc_id, owner, repo, unnest(list_transform(range(1, len(h) + 1), lambda i: {{s: list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0), n: length(h[i]), v: v[i]}})) AS x
FROM (SELECT rid, doc_id, owner, repo, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS h, regexp_extract_all(text, '{pattern}', {group}) AS v FROM t)) WHERE length(x.v) >= {least}"""


_BASE = ", ".join(f"'{k}'" for k in BASE)
SECRETS = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(_kind(k) for k in KINDS)}),
o AS (SELECT v, count(DISTINCT owner) >= {COPIED_OWNERS} OR count(DISTINCT repo) >= {COPIED_REPOSITORIES} AS copied FROM f GROUP BY v), j AS (SELECT f.*, copied, kind || ':' || s || ':' || e AS span FROM f JOIN o USING (v))
SELECT t.doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, sha256(coalesce(string_agg(span, ',' ORDER BY s, no) FILTER (kind IN ({_BASE})), '')) AS base_sha256,
coalesce(string_agg(span, ',' ORDER BY s, no) FILTER (kind IN ({_BASE}) OR NOT copied), '') AS spans, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM t LEFT JOIN j USING (rid) GROUP BY rid, t.doc_id"""

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
o AS (SELECT rid, lang, source, unnest(found) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {WHOLE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS p, 1 + {WHOLE}::HUGEINT * (k.total + 1) // (l.n + l.v) AS q
FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= {TERM_RANKS}"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]::VARCHAR[]"


_NOTICES = ", ".join(f"('{n.label}', {_list(w)}, {_list(n.must)})" for n, w in zip(NOTICES, notice_words(NOTICES, STEP)))
_PHRASES = ", ".join(f"('{label}', [" + ", ".join(f"'{w}'" for w in phrase.split()) + "])" for phrase, label in PHRASES.items())
LICENSES = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS (SELECT rid, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM d, (VALUES {_PHRASES}) ph(label, p)),
b AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY rid),
block AS (SELECT rid, list_distinct(w[k * {STEP} + 1:(k + 2) * {STEP}]) AS words FROM (SELECT rid, w, unnest(range((len(w) + {STEP - 1}) // {STEP})) AS k FROM d)),
m AS (SELECT rid, list(DISTINCT label) AS labels, max(len(list_intersect(words, own)) / len(own)) AS best FROM block, (VALUES {_NOTICES}) n(label, own, must)
WHERE 100 * len(list_intersect(words, own)) >= {PERCENT} * len(own) AND list_has_all(words, must) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)"""

_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(({0})::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_TREE = """SELECT {tree}, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY {tree}, lvl, pos // 2"""
MERKLE = f"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS code FROM documents, crc),
f AS (SELECT rid, doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format(n='n_chars')} AS leaf, CASE WHEN code % 7 = 0 THEN {_LEAF.format(n='(n_chars + 1)')} ELSE {_LEAF.format(n='n_chars')} END AS changed FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f),
v AS (SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l UNION ALL {_TREE.format(tree='tree', name='v')}),
tops AS (SELECT tree, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY tree) - 1 AS place FROM v WHERE n = 1),
tv AS (SELECT 0 AS tree, 0 AS lvl, place AS pos, subroot AS h, count(*) OVER () AS n FROM tops UNION ALL {_TREE.format(tree='tree', name='tv')}),
top AS (SELECT h AS root, lvl AS top_depth FROM tv WHERE n = 1),
j AS (SELECT l.*, subroot, depth, place, root, top_depth FROM l JOIN tops USING (tree), top),
way AS (SELECT j.rid, k AS step, v.h AS sib, (pos_k & 1) = 1 AS is_left FROM (SELECT *, unnest(range(depth)) AS k, pos >> unnest(range(depth)) AS pos_k FROM j) j LEFT JOIN v ON v.tree = j.tree AND v.lvl = k AND v.pos = xor(pos_k, 1)
UNION ALL SELECT j.rid, depth + k, tv.h, (place_k & 1) = 1 FROM (SELECT *, unnest(range(top_depth)) AS k, place >> unnest(range(top_depth)) AS place_k FROM j) j LEFT JOIN tv ON tv.lvl = k AND tv.pos = xor(place_k, 1)),
up AS (SELECT rid, 0 AS step, changed AS h FROM j UNION ALL SELECT up.rid, up.step + 1, sha256(CASE WHEN sib IS NULL THEN h WHEN is_left THEN sib || h ELSE h || sib END) FROM up JOIN way ON way.rid = up.rid AND way.step = up.step),
e AS (SELECT rid, arg_max(h, step) AS folded_root FROM up GROUP BY rid),
p AS (SELECT rid, sha256(coalesce(string_agg(sib, '' ORDER BY step), '')) AS proof_sha256 FROM way GROUP BY rid)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM j JOIN e USING (rid) LEFT JOIN p USING (rid)"""
ORACLES = {"op3_warc": WARC, "op10_secrets": SECRETS, "op11_divergence": DIVERGENCE, "op12_licenses": LICENSES, "op13_merkle": MERKLE}
