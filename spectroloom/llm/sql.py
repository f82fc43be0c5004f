"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT row_number() OVER () AS id, item_id::VARCHAR AS item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT id, item_id, w, least(10, len(w)) AS m, unnest(range(1, (len(w) - least(10, len(w)) + 2)::BIGINT)) AS i FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, m, w[i:i + m - 1] AS words FROM s),
p AS (SELECT doc_id, w, m, unnest(range(1, (len(w) - m + 2)::BIGINT)) AS i FROM d, (SELECT DISTINCT m FROM k) WHERE len(w) >= m),
h AS (SELECT p.doc_id, p.i, p.m, k.item_id, k.words FROM p JOIN k ON k.m = p.m AND k.words = p.w[p.i:p.i + p.m - 1]),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, (i + m)::BIGINT)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM h GROUP BY doc_id),
o AS (SELECT h.doc_id, h.i, h.m, h.item_id, j.id, j.i - h.i AS shift FROM h JOIN (SELECT id, item_id, m, i, w[i:i + m - 1] AS words FROM s) j ON j.item_id = h.item_id AND j.m = h.m AND j.words = h.words),
l AS (SELECT doc_id, item_id, min(i) - 1 AS place, count(*) + any_value(m) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, id, shift ORDER BY i) AS run FROM o) GROUP BY doc_id, item_id, id, shift, run),
f AS (SELECT doc_id, n, place, item_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place, item_id) AS r FROM l) WHERE r = 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(f.n, 0)::BIGINT AS longest_match, f.place::BIGINT AS longest_at, f.item_id AS longest_item
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN f USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, (len(w) - 18)::BIGINT)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, (i + 20)::BIGINT)) AS i FROM f WHERE r > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, (len(w) + 1)::BIGINT)) AS i FROM d),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, (len(w) - 3)::BIGINT), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 75 * (u.n + v.n - c)),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
k AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN k ON k.node = d.doc_id
"""

OP9 = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
t AS (SELECT host, count(*) AS total FROM d GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM d) WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
b AS (SELECT host, list(line) AS gone FROM c JOIN t USING (host) WHERE n >= 3 AND n > 0.1 * total GROUP BY host),
k AS (SELECT doc_id, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM d LEFT JOIN b USING (host))
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) >= 0.9 * a.n * b.n WHERE a.n > 0 AND b.n > 0),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
k AS (SELECT node, min(low) AS component_id FROM r GROUP BY node),
c AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id JOIN k ON k.node = vec_id
"""

OP11 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_ALNUM} AS w FROM documents),
g AS (SELECT count(*) AS n, sum(len(w)) AS total FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_ALNUM}) AS term FROM benchmark),
f AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY 1, 2),
v AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM f GROUP BY term), g),
m AS (SELECT row, doc_id, 50 + ((50 * len(w) * n) // total)::BIGINT AS m FROM d, g),
s AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN v USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


def _rounds(k: int = 8, rounds: int = 10) -> str:
    """CTEs a0.. (each row's distance * k + cluster) and c0.. (centroids) of k-means over the packed rows ``q``."""
    out = []
    for t in range(rounds + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT row, any_value(q) AS q, any_value(vec_id) AS vec_id, min((list_dot_product(q, q) - 2 * list_dot_product(q, c) + list_dot_product(c, c))::BIGINT * {k} + k) AS best FROM q, c{t} GROUP BY row)")
        if t < rounds:
            out.append(f"m{t} AS (SELECT k, list(v ORDER BY pos) AS c FROM (SELECT k, pos, floor(sum(v) / count(*)) AS v FROM (SELECT best % {k} AS k, unnest(range(0, len(q))) AS pos, unnest(q) AS v FROM a{t}) GROUP BY 1, 2) GROUP BY k)")
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k))")
    return ",\n".join(out)


OP12 = f"""
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c FROM (SELECT q, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM q ORDER BY h, q LIMIT 8)),
{_rounds()},
s AS (SELECT vec_id, best % 8 AS k, best // 8 AS d FROM a10)
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c, lambda v: v::BIGINT), ',')) AS centroid_sha256
FROM s JOIN c10 USING (k)
"""
