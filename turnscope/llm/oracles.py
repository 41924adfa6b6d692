"""DuckDB SQL of operators that SQL can express by brute force on small tables."""

from __future__ import annotations

from .secrets import ASSIGN, ENDPOINT, HEX, SCOPE

_Q = "'"


def _sql(text: str) -> str:
    return _Q + text.replace(_Q, _Q + _Q) + _Q


def _matches(name: str, pattern: str, source: str) -> str:
    """Every match with start, end and text: pieces between matches and matches alternate."""
    p = _sql(pattern)
    place = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return f"""{name} AS (SELECT rid, x.s::BIGINT AS s, x.s::BIGINT + length(x.m) AS e, x.m AS m FROM (SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': {place}, 'm': m[i]}})) AS x
  FROM (SELECT rid, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM {source} WHERE regexp_matches(t, {p}))))"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_matches("a0", ASSIGN, "d")},
{_matches("c0", "AKIA[A-Z0-9]+", "d")},
{_matches("h0", HEX, "d")},
base AS (SELECT rid, 0 AS k, 'assign' AS kind, s, e FROM a0 WHERE length(regexp_extract(m, {_sql("^(?:" + ASSIGN + ")$")}, 2)) >= 8
  UNION ALL SELECT rid, 1, 'access', s, e FROM c0 WHERE length(m) >= 16 UNION ALL SELECT rid, 2, 'hex', s, e FROM h0),
n AS (SELECT * FROM d WHERE rid IN (SELECT rid FROM base WHERE k = 1)),
{_matches("w0", "[A-Za-z0-9+/]+", "n")},
{_matches("p0", ENDPOINT, "n")},
{_matches("b0", SCOPE, "n")},
weak AS (SELECT w0.* FROM w0 JOIN n USING (rid) WHERE length(m) = 40 AND substr(t, e + 1, 1) <> '='),
cand AS (SELECT rid, 3 AS k, 'secret' AS kind, s, e FROM weak UNION ALL SELECT rid, 4, 'endpoint', s, e FROM p0 UNION ALL SELECT rid, k, kind, s, e FROM base WHERE k < 2 AND rid IN (SELECT rid FROM n)),
sc AS (SELECT *, (SELECT count(*) FROM b0 WHERE b0.rid = cand.rid AND b0.e <= cand.s) AS scope FROM cand),
near AS (SELECT x.rid, x.k, x.kind, x.s, x.e, x.scope FROM sc x WHERE k >= 3
  AND EXISTS (SELECT 1 FROM sc y WHERE y.k = 1 AND y.rid = x.rid AND y.scope = x.scope)
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s < x.e AND b.e > x.s)),
parts AS (SELECT rid, scope, s, e FROM near WHERE k = 3 UNION ALL SELECT rid, scope, s, e FROM sc WHERE k = 0),
added AS (SELECT rid, k, kind, s, e FROM near x WHERE k = 3 OR EXISTS (SELECT 1 FROM parts y WHERE y.rid = x.rid AND y.scope = x.scope)),
bs AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM base GROUP BY rid),
al AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs.spans, '')) AS base_sha256, coalesce(al.spans, '') AS spans
FROM d LEFT JOIN bs USING (rid) LEFT JOIN al USING (rid)
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS o, coalesce(text, '') AS text FROM documents),
u AS (SELECT row_number() OVER (ORDER BY o, text) AS rid, o, text, hex(encode(text)) AS h FROM (SELECT DISTINCT o, text FROM d)),
q AS (SELECT rid, k, substr(h, 400 * k + 1, 598) AS part FROM (SELECT rid, h, unnest(range(0, (length(h) // 2 - 100) // 200 + 1)) AS k FROM u WHERE length(h) >= 200)),
w AS (SELECT rid, 200 * k + j AS p, md5_number(substr(part, 2 * j + 1, 200)) AS m FROM (SELECT rid, k, part, unnest(range(0, least(200, length(part) // 2 - 99))) AS j FROM q)),
g AS (SELECT rid, p FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY rid, p) > 1),
i AS (SELECT rid, p, p - lag(p) OVER (PARTITION BY rid ORDER BY p) AS step FROM g),
r AS (SELECT rid, p, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS run FROM i),
z AS (SELECT rid, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY rid, run),
c AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last FROM z GROUP BY rid),
k AS (SELECT rid, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS prev FROM z) JOIN u USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d JOIN u ON u.o = d.o AND u.text = d.text LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""

OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept, 1.0::DOUBLE AS recall
FROM v JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = v.vec_id
"""
