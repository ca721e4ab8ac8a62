"""DuckDB SQL that gives the rows of those queries that SQL can express; plain forms, meant for small tables."""

from __future__ import annotations

from .licenses import BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _split(text: str, pattern: str = SPACE) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{pattern}'), lambda x: x <> '')"


_SHINGLES = "list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: w[i + 1:i + 5]))"

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS k FROM d),
w AS (SELECT doc_id, k, x, {_split(LOWER.format(t="x"))} AS w FROM l),
s AS (SELECT doc_id, k, {_SHINGLES} AS s FROM w WHERE len(w) > 0),
u AS (SELECT doc_id, k, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id, a.k, b.doc_id AS bd, b.k AS bk, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM u a JOIN u b ON a.g = b.g AND (b.doc_id, b.k) < (a.doc_id, a.k) GROUP BY ALL),
r AS (SELECT DISTINCT doc_id, k FROM p WHERE 100 * o >= 75 * (n + m - o))
SELECT l.doc_id, count(*) AS n_lines, count(r.k) AS n_removed, sha256(coalesce(string_agg(CASE WHEN r.k IS NULL THEN x END, chr(10) ORDER BY l.k), '')) AS kept_sha256
FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.k = l.k GROUP BY 1
"""

OP7 = f"""
WITH w AS (SELECT doc_id, {_split("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i, unnest(list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1:i + 20], ' '))) AS g FROM w WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE nth > 1),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM w),
y AS (SELECT x.doc_id, count(*) AS n, count(c.k) AS gone, coalesce(string_agg(CASE WHEN c.k IS NULL THEN x END, ' ' ORDER BY x.k), '') AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.k = x.k GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y ON y.doc_id = w.doc_id
"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_split(LOWER.format(t="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE {_SHINGLES} END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * o >= 75 * (n + m - o)),
c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT s.doc_id, len(any_value(s))::BIGINT AS n_shingles, least(s.doc_id, min(c.b)) AS component_id FROM s LEFT JOIN c ON c.a = s.doc_id GROUP BY 1
"""

_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_text = lambda t: "'" + t.replace("'", "''") + "'"
OP3 = f"""
WITH d AS (SELECT doc_id, {LOWER.format(t="coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, t, {_split("t", _WORD)} AS w FROM d),
q(phrase, label) AS (VALUES {", ".join(f"({_text(p)}, {_text(x)})" for p, x in PHRASES.items())}),
ph AS (SELECT string_split(phrase, ' ') AS p, label FROM q),
pl AS (SELECT doc_id, label, unnest(list_filter(range(len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS i FROM w, ph WHERE len(w) >= len(p)),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM pl GROUP BY 1),
tx(id, label, body) AS (VALUES {", ".join(f"({k}, {_text(x)}, {_text(t)})" for k, (x, t) in enumerate((x, t) for x, ts in TEMPLATES.items() for t in ts))}),
tm AS (SELECT id, label, list_distinct({_split(LOWER.format(t="body"), _WORD)}) AS s FROM tx),
tw AS (SELECT id, label, len(s) AS n, unnest(s) AS x FROM tm),
sub AS (SELECT a.id, b.id AS within FROM tm a, tm b WHERE len(a.s) < len(b.s) AND list_has_all(b.s, a.s)),
ln AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS k, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS (SELECT doc_id, k, {_split("x", _WORD)} AS w FROM ln UNION ALL SELECT doc_id, -1, w FROM w WHERE len(string_split(t, chr(10))) > 1),
bl AS (SELECT doc_id, k, unnest(CASE WHEN len(w) <= {BLOCK_WORDS} THEN [0] ELSE range(0, len(w), {BLOCK_WORDS // 2}) END) AS o, w FROM lw),
bw AS (SELECT DISTINCT doc_id, k, o, unnest(w[o + 1:o + {BLOCK_WORDS}]) AS x FROM bl),
m AS (SELECT doc_id, k, o, id, any_value(label) AS label, any_value(n) AS n, count(*) AS c FROM bw JOIN tw ON tw.x = bw.x GROUP BY 1, 2, 3, 4 HAVING count(*) >= ceil({THRESHOLD} * any_value(n) - 1e-9)),
top AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM m z JOIN sub ON sub.within = z.id WHERE sub.id = m.id AND z.doc_id = m.doc_id AND z.k = m.k AND z.o = m.o)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c / n) AS score FROM top GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN found ON found.doc_id = w.doc_id
"""
