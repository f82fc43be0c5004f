"""DuckDB SQL of the queries; iterations are unrolled."""

from __future__ import annotations

from spectroloom.plans.queries import K, MIX, PASSES, SEED, STEPS

V = "v AS (SELECT vec_id AS row_id, list_transform(embedding, lambda q: q::DOUBLE) AS x, label FROM embeddings)"
U = "u AS MATERIALIZED (SELECT row_id, label, list_transform(x, lambda q: q / greatest(sqrt(list_dot_product(x, x)), 1e-6)) AS x FROM v)"
L = "l AS (SELECT row_id, unnest(range(0, len(x)))::INT AS pos, unnest(x) AS v FROM v)"
SNV = "s AS (SELECT row_id, pos, v, avg(v) OVER w AS mu, stddev_samp(v) OVER w + 1e-12 AS sd FROM l WINDOW w AS (PARTITION BY row_id))"


def _r(e: str, places: int = 6) -> str:
    return f"round({e}, {places}) + 0.0"


def _grid(table: str, key: str, channel: str, value: str, size: int | str) -> str:
    """A zero-filled spectrum in long form, as ``l``."""
    return f"""g AS (SELECT {key} AS row_id, ({channel})::INT AS pos, {value} AS v FROM {table} GROUP BY 1, 2),
l AS (SELECT k.row_id, p.pos::INT AS pos, coalesce(g.v, 0.0)::DOUBLE AS v FROM (SELECT DISTINCT row_id FROM g) k CROSS JOIN (SELECT unnest(range(0, {size})) AS pos) p
      LEFT JOIN g ON g.row_id = k.row_id AND g.pos = p.pos)"""


PART = _grid("lineitem", "l_partkey", "month(l_shipdate) - 1", "sum(l_extendedprice)", 12)
_MONTH = "year(l_shipdate) * 12 + month(l_shipdate)"
SUPPLIER = _grid("lineitem", "l_suppkey", f"{_MONTH} - (SELECT min({_MONTH}) FROM lineitem)", "sum(l_extendedprice)", f"(SELECT max({_MONTH}) - min({_MONTH}) + 1 FROM lineitem)")
HOUR = _grid("events", "user_id", "hour(ts)", "count(*)", 24)


def _digest(row: str, slot: str, seed: str = str(SEED)) -> str:
    return f"md5(concat_ws(':', '{seed}', ({row})::VARCHAR, ({slot})::VARCHAR))"


def _uniform(h: str, word: int = 0) -> str:
    return f"(('0x' || substr({h}, {1 + 8 * word}, 8))::BIGINT / 4294967296.0::DOUBLE)"


DELTA = f"(-2.0 + {_uniform(_digest('row_id', repr('delta')))} * 4.0)"


def _shifted(source: str, out: str) -> str:
    """Rows of ``source`` read at i - delta."""
    place = "((i - 1) - delta)"
    at = lambda p: f"x[greatest(0, least(len(x) - 1, {p}))::INT + 1]"
    alpha = f"({place} - floor({place}))"
    return f"""{out}_d AS (SELECT *, {DELTA} AS delta FROM {source}),
{out} AS (SELECT * EXCLUDE (delta, moved), moved AS y FROM (SELECT *, list_transform(range(1, len(x) + 1), lambda i: (1.0 - {alpha}) * {at(f'floor({place})')} + {alpha} * {at(f'floor({place}) + 1')}) AS moved FROM {out}_d))"""


def _center(x: str) -> str:
    return f"list_transform({x}, lambda q: q - list_sum({x}) / len({x}))"


def _reproject(source: str, out: str) -> str:
    """``y`` centred and scaled to the norm of ``x``."""
    return f"""{out}_c AS (SELECT * EXCLUDE (y), {_center('y')} AS c FROM {source}),
{out} AS (SELECT * EXCLUDE (c), list_transform(c, lambda q: q * (sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(c, c)))) AS y FROM {out}_c)"""


def _kmeans(k: int, passes: int, tag: str = "", first: bool = True) -> str:
    """CTEs a{tag}0.. (label and distance) from the first k rows (or from a c{tag}0 that is there); a{tag}N follows N passes."""
    out = [] if not first else [f"c{tag}0 AS MATERIALIZED (SELECT row_id::INT AS k, x AS c FROM u WHERE row_id < {k})"]
    for t in range(passes + 1):
        sim = "list_dot_product(u.x, c.c) / greatest(sqrt(list_dot_product(c.c, c.c)), 1e-6)"
        out.append(f"a{tag}{t} AS MATERIALIZED (SELECT row_id, arg_max(k, s) AS label, 1.0 - max(s) AS dist FROM (SELECT u.row_id, c.k, {sim} AS s FROM u CROSS JOIN c{tag}{t} c) GROUP BY row_id)")
        if t < passes:
            out.append(f"c{tag}{t + 1} AS MATERIALIZED (SELECT k, list(v ORDER BY pos) AS c FROM (SELECT k, pos, sum(v) AS v FROM (SELECT a.label AS k, unnest(range(0, len(u.x))) AS pos, unnest(u.x) AS v FROM a{tag}{t} a JOIN u USING (row_id)) GROUP BY 1, 2) GROUP BY k)")
    return ",\n".join(out)


def _kmeans_fit(k: int) -> str:
    """Seeds by exponential races over all parts, then passes by recursion until the inertia settles."""
    time = lambda t: f"-ln(1.0 - {_uniform(_digest('u.row_id', repr(f'seed{t}')))})"
    out = [f"{PART}, {_LIST}, u AS MATERIALIZED (SELECT row_id, list_transform(x, lambda q: q / greatest(sqrt(list_dot_product(x, x)), 1e-6)) AS x FROM pl)"]
    for t in range(k):
        drawn = ", ".join(f"(SELECT x FROM s{i})" for i in range(t))
        weight = f"greatest(1.0 - list_max(list_transform([{drawn}], lambda c: list_dot_product(u.x, c))), 1e-12)" if t else "1.0"
        out.append(f"s{t} AS MATERIALIZED (SELECT row_id, x FROM u ORDER BY {time(t)} / {weight}, row_id LIMIT 1)")
    sims = "list_transform(cs, lambda c: list_dot_product(u.x, c))"
    return f"""WITH RECURSIVE {', '.join(out)},
r AS (SELECT 0 AS step, [{', '.join(f'(SELECT x FROM s{t})' for t in range(k))}] AS cs, NULL::DOUBLE AS inertia, false AS done
  UNION ALL
  SELECT step + 1, list(list_transform(m, lambda v: v / greatest(sqrt(list_dot_product(m, m)), 1e-6)) ORDER BY label), any_value(j),
         coalesce(abs(any_value(j) - any_value(before)) < 1e-7 OR abs(any_value(j) - any_value(before)) / (abs(any_value(before)) + 1e-12) < 1e-4, false)
  FROM (SELECT step, before, j, label, list(v ORDER BY pos) AS m
        FROM (SELECT step, before, j, label, pos, avg(v) AS v
              FROM (SELECT step, before, avg(gap) OVER () AS j, label, unnest(range(0, len(x))) AS pos, unnest(x) AS v
                    FROM (SELECT step, r.inertia AS before, u.x, list_position({sims}, list_max({sims})) - 1 AS label, 1.0 - list_max({sims}) AS gap FROM r, u WHERE NOT done))
              GROUP BY ALL)
        GROUP BY ALL)
  GROUP BY step)
SELECT label::INT AS label, count(*) AS n, {_r('avg(gap)')} AS mean_dist
FROM (SELECT list_position({sims}, list_max({sims})) - 1 AS label, 1.0 - list_max({sims}) AS gap FROM u, (SELECT cs FROM r ORDER BY step DESC LIMIT 1)) GROUP BY label"""


def _elbow(k_max: int) -> str:
    parts = [_kmeans(k, PASSES - 1, f"k{k}_") for k in range(1, k_max + 1)]
    rows = " UNION ALL ".join(f"SELECT {k} AS k, avg(dist) AS j FROM ak{k}_{PASSES - 1}" for k in range(1, k_max + 1))
    n = k_max
    # a quadratic through five points around m, read at t = i - m
    mid = f"least(greatest(i, 2), {n - 3})"
    y = lambda o: f"y[{mid} + {o} + 1]"
    b = f"(-2 * {y(-2)} - {y(-1)} + {y(1)} + 2 * {y(2)}) / 10.0"
    c = f"(2 * {y(-2)} - {y(-1)} - 2 * {y(0)} - {y(1)} + 2 * {y(2)}) / 14.0"
    return f"""WITH {V}, {U}, {", ".join(parts)},
j AS MATERIALIZED ({rows}),
m AS (SELECT k, j, min(j) OVER (ORDER BY k) AS y FROM j),
z AS (SELECT list((y - lo) / (hi - lo + 1e-12) ORDER BY k) AS y FROM m, (SELECT min(y) AS lo, max(y) AS hi FROM m)),
q AS (SELECT i, ({b} + 2 * ({c}) * (i - {mid})) * {n - 1} AS d1, 2 * ({c}) * {(n - 1) ** 2} AS d2 FROM z, (SELECT unnest(range(1, {n - 1})) AS i)),
e AS (SELECT arg_max(i, abs(d2) / pow(1 + d1 * d1, 1.5)) AS bend FROM q)
SELECT k, {_r('j')} AS inertia, (k - 1 = bend) AS is_elbow FROM j, e"""


def _elbow_by_group() -> str:
    """The bend of each customer's curve: from quadratics through five points, or by differences for three and four."""
    mid = "least(greatest(i, 2), n - 3)"
    y = lambda o: f"y[{mid} + {o} + 1]"
    b = f"(-2 * {y(-2)} - {y(-1)} + {y(1)} + 2 * {y(2)}) / 10.0"
    c = f"(2 * {y(-2)} - {y(-1)} - 2 * {y(0)} - {y(1)} + 2 * {y(2)}) / 14.0"
    slope = lambda v, at: f"CASE WHEN {at} = 0 THEN {v}[2] - {v}[1] WHEN {at} = n - 1 THEN {v}[n] - {v}[n - 1] ELSE ({v}[{at} + 2] - {v}[{at}]) / 2 END"
    return f"""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, o_totalprice::DOUBLE AS s FROM orders),
m AS (SELECT *, min(s) OVER (PARTITION BY o_custkey ORDER BY k) AS r FROM o),
z AS (SELECT o_custkey, count(*) AS n, list((r - lo) / (hi - lo + 1e-12) ORDER BY k) AS y, list(s ORDER BY k) AS s FROM m JOIN (SELECT o_custkey, min(r) AS lo, max(r) AS hi FROM m GROUP BY 1) USING (o_custkey) GROUP BY 1),
g AS (SELECT *, list_transform(range(0, n), lambda i: {slope('y', 'i')}) AS g FROM z WHERE n >= 3),
q AS (SELECT *, CASE WHEN n >= 5 THEN {b} + 2 * ({c}) * (i - {mid}) ELSE g[i + 1] END * (n - 1) AS d1, CASE WHEN n >= 5 THEN 2 * ({c}) ELSE {slope('g', 'i')} END * (n - 1) * (n - 1) AS d2 FROM (SELECT *, unnest(range(1, n - 1)) AS i FROM g)),
e AS (SELECT o_custkey, i, s[i + 1] AS score, abs(d2) / pow(1 + d1 * d1, 1.5) AS bend FROM q)
SELECT o_custkey, (i + 1)::INT AS k, score, {_r('bend')} AS curvature FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY bend DESC, i) AS r FROM e) WHERE r = 1"""


_PAIRS = "d AS (SELECT a.row_id, a.label, b.label AS other, sum(1.0 - list_dot_product(a.x, b.x)) AS d, count(*) AS n FROM {t} a JOIN {t} b ON a.row_id <> b.row_id GROUP BY 1, 2, 3)"
_SIL = """i AS (SELECT row_id, label, coalesce(max(d / n) FILTER (WHERE other = label), 0.0) AS a, bool_or(other = label) AS more, min(d / n) FILTER (WHERE other <> label) AS b FROM d GROUP BY 1, 2),
sil AS (SELECT row_id, label, CASE WHEN more THEN (b - a) / greatest(a, b, 1e-12) ELSE 0.0 END AS s FROM i)"""


def _log_c(kappa: str, d: int) -> str:
    """The normaliser's approximation."""
    nu = d / 2 - 1
    mu = 4 * nu * nu
    small = f"({nu} * ln({kappa} / 2) - lgamma({nu + 1}) + ln(1 + {kappa} * {kappa} / {4 * (nu + 1)} + pow({kappa}, 4) / {32 * (nu + 1) * (nu + 2)}))"
    large = f"({kappa} - 0.5 * ln(2 * pi() * {kappa}) + ln(greatest(1 - {(mu - 1) / 8} / {kappa} + {(mu - 1) * (mu - 9) / 128} / ({kappa} * {kappa}), 1e-12)))"
    w = f"(({kappa} - 2.0) / 10.0)"
    return f"({nu} * ln({kappa}) - {nu + 1} * ln(2 * pi()) - CASE WHEN {kappa} <= 2 THEN {small} WHEN {kappa} >= 12 THEN {large} ELSE (1 - {w}) * {small} + {w} * {large} END)"


def _em(k: int, steps: int, tag: str = "", d: int = 64) -> str:
    """CTEs p{tag}0.. (parameters) and z{tag}0.. (posteriors, ll) of a mixture started at the first k rows."""
    out = [f"p{tag}0 AS MATERIALIZED (SELECT row_id::INT AS k, x AS mu, 10.0::DOUBLE AS kappa, {1 / k}::DOUBLE AS pi, {_log_c('10.0::DOUBLE', d)} AS log_c FROM u WHERE row_id < {k})"]
    for t in range(steps + 1):
        out.append(f"q{tag}{t} AS MATERIALIZED (SELECT u.row_id, p.k, ln(p.pi) + p.log_c + p.kappa * list_dot_product(u.x, p.mu) AS lp FROM u CROSS JOIN p{tag}{t} p)")
        out.append(f"z{tag}{t} AS MATERIALIZED (SELECT row_id, k, lp, ll, exp(lp - ll) AS g FROM q{tag}{t} JOIN (SELECT row_id, max(lp) + ln(sum(exp(lp - top))) AS ll FROM (SELECT *, max(lp) OVER (PARTITION BY row_id) AS top FROM q{tag}{t}) GROUP BY row_id) USING (row_id))")
        if t < steps:
            out.append(f"""m{tag}{t} AS MATERIALIZED (SELECT k, list(v ORDER BY pos) AS s, any_value(nk) AS nk FROM (SELECT k, pos, sum(v) AS v, sum(g) AS nk FROM (SELECT z.k, z.g, unnest(range(0, len(u.x))) AS pos, unnest(list_transform(u.x, lambda q: q * z.g)) AS v FROM z{tag}{t} z JOIN u USING (row_id)) GROUP BY 1, 2) GROUP BY k),
r{tag}{t} AS MATERIALIZED (SELECT k, s, nk, sqrt(list_dot_product(s, s)) AS len, least(greatest(sqrt(list_dot_product(s, s)) / nk, 1e-6), 1 - 1e-6) AS r FROM m{tag}{t}),
n{tag}{t} AS MATERIALIZED (SELECT k, list_transform(s, lambda q: q / len) AS mu, r * ({d} - r * r) / (1 - r * r + 1e-8) AS kappa, nk / sum(nk) OVER () AS pi FROM r{tag}{t}),
p{tag}{t + 1} AS MATERIALIZED (SELECT k, mu, kappa, pi, {_log_c('kappa', d)} AS log_c FROM n{tag}{t})""")
    return ",\n".join(out)


def _vmf_elbow(criterion: str, places: int) -> str:
    """Scores of 1 to 4 components, the least one, and the bend of the negated scores' running minimum by central differences."""
    score = {"bic": lambda k: f"-2 * sum(ll) + {k * 64 + k - 1} * ln(count(*))", "nll": lambda k: "-sum(ll) / count(*)"}[criterion]
    rows = " UNION ALL ".join(f"SELECT {k} AS k, {score(k)} AS s FROM (SELECT DISTINCT row_id, ll FROM zk{k}_{STEPS})" for k in range(1, 5))
    return f"""WITH {V}, {U}, {', '.join(_em(k, STEPS, f'k{k}_') for k in range(1, 5))},
b AS MATERIALIZED ({rows}),
w AS (SELECT k, min(-s) OVER (ORDER BY k) AS y FROM b),
z AS (SELECT list((y - lo) / (hi - lo + 1e-12) ORDER BY k) AS y FROM w, (SELECT min(y) AS lo, max(y) AS hi FROM w)),
g AS (SELECT [(y[2] - y[1]) * 3, (y[3] - y[1]) * 1.5, (y[4] - y[2]) * 1.5, (y[4] - y[3]) * 3] AS d FROM z),
e AS (SELECT i AS bend FROM (SELECT i, abs((d[i + 2] - d[i]) * 1.5) / pow(1 + d[i + 1] * d[i + 1], 1.5) AS c FROM g, (SELECT unnest([1, 2]) AS i)) ORDER BY c DESC, i LIMIT 1)
SELECT k, {_r('s', places)} AS {criterion}, k - 1 = bend AS is_elbow, s = min(s) OVER () AS is_best FROM b, e"""


def _subset_start(k: int, m: int) -> str:
    """Draws from the m rows of least digest: each an exponential race, weighted by the distance to the rows drawn before."""
    time = lambda t: f"-ln(1.0 - {_uniform(_digest('b.row_id', repr(f'seed{t}')))})"
    out = [f"{PART}, {_LIST}, b AS MATERIALIZED (SELECT row_id, list_transform(x, lambda q: q / greatest(sqrt(list_dot_product(x, x)), 1e-6)) AS x FROM pl ORDER BY {_digest('row_id', repr('subset'))}, row_id LIMIT {m})"]
    for t in range(k):
        drawn = ", ".join(f"(SELECT x FROM s{i})" for i in range(t))
        weight = f"greatest(1.0 - list_max(list_transform([{drawn}], lambda c: list_dot_product(b.x, c))), 1e-8)" if t else "1.0"
        out.append(f"s{t} AS MATERIALIZED (SELECT row_id, x FROM b ORDER BY {time(t)} / {weight}, row_id LIMIT 1)")
    return f"WITH {', '.join(out)} {' UNION ALL '.join(f'SELECT {t} AS k, row_id FROM s{t}' for t in range(k))}"


def _fps(k: int) -> str:
    out = ["f0 AS MATERIALIZED (SELECT u.row_id, 1.0 - list_dot_product(u.x, f.x) AS d FROM u, u f WHERE f.row_id = 0 AND u.row_id <> 0)", "s0 AS (SELECT 0::BIGINT AS row_id)"]
    for t in range(1, k):
        out.append(f"s{t} AS MATERIALIZED (SELECT row_id FROM f{t - 1} ORDER BY d DESC, row_id LIMIT 1)")
        out.append(f"f{t} AS MATERIALIZED (SELECT f.row_id, least(f.d, 1.0 - list_dot_product(u.x, w.x)) AS d FROM f{t - 1} f JOIN u USING (row_id), u w WHERE w.row_id = (SELECT row_id FROM s{t}) AND f.row_id <> w.row_id)")
    rows = " UNION ALL ".join(f"SELECT {t} AS rank, row_id FROM s{t}" for t in range(k))
    return f"WITH {V}, {U}, {', '.join(out)} {rows}"


_MASK = f"""h AS (SELECT row_id, p::INT AS patch, row_number() OVER (PARTITION BY row_id ORDER BY {_digest('row_id', 'p')}, p) <= 4 AS masked FROM v, (SELECT unnest(range(0, 16)) AS p))"""
_LOSS = f"""{_shifted('v', 'r')},
{_MASK},
e AS (SELECT row_id, label, pos, (b - a) * (b - a) AS e FROM (SELECT row_id, label, unnest(range(0, len(x))) AS pos, unnest(x) AS a, unnest(y) AS b FROM r)),
o AS (SELECT e.row_id, e.label, sum(e) AS error, count(*) AS n FROM e JOIN h ON h.row_id = e.row_id AND h.patch = e.pos // 4 WHERE masked GROUP BY 1, 2)"""

_NOISE = f"sqrt(-2.0 * ln(1.0 - {_uniform('g')})) * cos(6.283185307179586 * {_uniform('g', 1)})"
_NOISED = f"""n0 AS (SELECT row_id, x, label, list_transform(list_transform(range(0, len(x)), lambda i: {_digest('row_id', 'i', f'{SEED}:noise')}), lambda g: {_NOISE}) AS z FROM v),
n1 AS (SELECT row_id, x, {_center('z')} AS z, radians(0.5 + {_uniform(_digest('row_id', repr('angle')))} * 2.5) AS angle FROM n0),
n2 AS (SELECT row_id, x, angle, list_transform(range(1, len(x) + 1), lambda i: z[i] - list_dot_product(z, x) / list_dot_product(x, x) * x[i]) AS t FROM n1),
n3 AS (SELECT row_id, x, list_transform(range(1, len(x) + 1), lambda i: x[i] * cos(angle) + t[i] * (sqrt(list_dot_product(x, x)) * sin(angle) / sqrt(list_dot_product(t, t)))) AS y FROM n2)"""

_BY_BATCH = f"""w AS (SELECT row_id, row_id % 8 AS batch, CASE WHEN row_id % 8 = 3 OR row_id % 16 = 5 THEN x[1:4] ELSE x END AS x FROM v),
b0 AS (SELECT *, {_uniform(_digest('row_id', repr('noise')))} < 0.5 AS gate, list_transform(list_transform(range(0, len(x)), lambda i: {_digest('row_id', 'i', f'{SEED}:noise')}), lambda g: {_NOISE}) AS z FROM w),
b1 AS (SELECT * EXCLUDE (z), {_center('z')} AS z, radians(0.5 + {_uniform(_digest('row_id', repr('angle')))} * 2.5) AS angle FROM b0),
b2 AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: z[i] - list_dot_product(z, x) / greatest(list_dot_product(x, x), 5.0) * x[i]) AS t FROM b1),
b3 AS (SELECT *, sqrt(list_dot_product(t, t)) > 5.0 AS can FROM b2),
b4 AS (SELECT *, bool_or(can AND gate) OVER (PARTITION BY batch) AS any_can, CASE WHEN can THEN list_transform(range(1, len(x) + 1), lambda i: x[i] * cos(angle) + t[i] * (greatest(sqrt(list_dot_product(x, x)), 5.0) * sin(angle) / sqrt(list_dot_product(t, t)))) ELSE x END AS r FROM b3),
b5 AS (SELECT row_id, CASE WHEN gate AND any_can THEN {_center('r')} ELSE x END AS y FROM b4)"""



def _augmented() -> str:
    """Both operations in the order that each batch draws: ``x`` is the row as it stands, ``o`` the row as it was."""

    def shift(source: str, out: str) -> str:
        place = "((i - 1) - delta)"
        at = lambda p: f"x[greatest(0, least(len(x) - 1, {p}))::INT + 1]"
        alpha = f"({place} - floor({place}))"
        return f"""{out}_a AS (SELECT *, {DELTA} AS delta, {_uniform(_digest('row_id', repr('shift')))} < 0.5 AS gate FROM {source}),
{out}_b AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: (1.0 - {alpha}) * {at(f'floor({place})')} + {alpha} * {at(f'floor({place}) + 1')}) AS y FROM {out}_a),
{_reproject(f'{out}_b', f'{out}_r')}, {out} AS (SELECT row_id, label, o, CASE WHEN gate THEN y ELSE x END AS x FROM {out}_r)"""

    def noise(source: str, out: str) -> str:
        return f"""{out}_a AS (SELECT *, {_uniform(_digest('row_id', repr('noise')))} < 0.5 AS gate, radians(0.5 + {_uniform(_digest('row_id', repr('angle')))} * 2.5) AS angle, list_transform(list_transform(range(0, len(x)), lambda i: {_digest('row_id', 'i', f'{SEED}:noise')}), lambda g: {_NOISE}) AS d FROM {source}),
{out}_z AS (SELECT * EXCLUDE (d), {_center('d')} AS z FROM {out}_a),
{out}_t AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: z[i] - list_dot_product(z, x) / list_dot_product(x, x) * x[i]) AS t FROM {out}_z),
{out}_b AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: x[i] * cos(angle) + t[i] * (sqrt(list_dot_product(x, x)) * sin(angle) / sqrt(list_dot_product(t, t)))) AS y FROM {out}_t),
{_reproject(f'{out}_b', f'{out}_r')}, {out} AS (SELECT row_id, label, o, CASE WHEN gate THEN y ELSE x END AS x FROM {out}_r)"""

    first = f"{_uniform(_digest('(row_id % 16)', repr('order')))} < 0.5"
    return f"""WITH {V}, sf AS (SELECT row_id, label, x AS o, x FROM v WHERE {first}), nf AS (SELECT row_id, label, x AS o, x FROM v WHERE NOT {first}),
{shift('sf', 'sf1')}, {noise('sf1', 'sf2')}, {noise('nf', 'nf1')}, {shift('nf1', 'nf2')}, e AS (SELECT * FROM sf2 UNION ALL SELECT * FROM nf2)
SELECT label, count(*) AS n, {_r('avg(list_dot_product(o, x) / (sqrt(list_dot_product(o, o)) * sqrt(list_dot_product(x, x))))', 4)} AS mean_cosine FROM e GROUP BY label"""


_EMIT = f"SELECT row_id, unnest(range(0, len(y)))::INT AS pos, {_r('unnest(y)')} AS v"
_LIST = "pl AS (SELECT row_id, list(v ORDER BY pos) AS x FROM l GROUP BY row_id)"

ORACLE_SQL: dict[str, str] = {
    "snv": f"WITH {V}, {L}, {SNV} SELECT row_id, pos, {_r('(v - mu) / sd')} AS y FROM s",
    "snv_stats": f"WITH {V}, {L}, {SNV} SELECT row_id, {_r('any_value(mu)')} AS mu, {_r('any_value(sd)')} AS sd FROM s GROUP BY row_id",
    "snv_inverse": f"WITH {V}, {L} SELECT row_id, pos, {_r('v')} AS v FROM l",
    "snv_part_month": f"WITH {PART}, {SNV} SELECT row_id, pos, {_r('(v - mu) / sd')} AS y FROM s",
    "snv_short": f"""WITH {V}, w AS (SELECT row_id, x[1:row_id % 3 + 1] AS x FROM v), m AS (SELECT row_id, x, list_sum(x) / len(x) AS mu FROM w),
d AS (SELECT row_id, list_transform(x, lambda q: q - mu) AS c FROM m), e AS (SELECT row_id, c, sqrt(list_dot_product(c, c) / greatest(len(c) - 1, 1)) + 1e-12 AS sd FROM d)
SELECT row_id, unnest(range(0, len(c)))::INT AS pos, {_r('unnest(list_transform(c, lambda q: q / sd))')} AS y, {_r('sd')} AS sd FROM e""",
    "spectra_part_month": f"WITH {PART} SELECT row_id, pos, {_r('v')} AS v FROM l",
    "spectra_supplier_month": f"WITH {SUPPLIER} SELECT row_id, pos, {_r('v')} AS v FROM l",
    "spectra_user_hour": f"WITH {HOUR} SELECT row_id, pos, {_r('v')} AS v FROM l",
    "l2_normalize": f"WITH {PART} SELECT row_id, pos, {_r('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY row_id)), 1e-6)')} AS v FROM l",
    "cosine_to_first_rows": f"WITH {V}, {U} SELECT a.row_id, b.row_id AS other, {_r('1.0 - list_dot_product(a.x, b.x)')} AS dissimilarity FROM u a, u b WHERE b.row_id < {K}",
    "cosine_assign": f"WITH {V}, {U}, {_kmeans(K, 0)} SELECT row_id, label, {_r('dist')} AS dist FROM a0",
    "kmeans_lloyd_t4": f"WITH {V}, {U}, {_kmeans(K, PASSES)} SELECT row_id, label, {_r('dist')} AS dist FROM a{PASSES}",
    "kmeans_fit": _kmeans_fit(K),
    "kmeans_repair": f"""WITH {V}, {U}, f AS MATERIALIZED (SELECT u.row_id, u.x, row_number() OVER (ORDER BY 1.0 - list_dot_product(u.x, f.x) DESC, u.row_id) AS r FROM u, u f WHERE f.row_id = 0),
l AS (SELECT pos, sum(v) AS v FROM (SELECT unnest(range(0, len(x))) AS pos, unnest(x) AS v FROM u) GROUP BY pos),
cr0 AS MATERIALIZED (SELECT 0 AS k, list(v ORDER BY pos) AS c FROM l UNION ALL SELECT r::INT, x FROM f WHERE r <= 2),
{_kmeans(3, 1, 'r', first=False)} SELECT row_id, label, {_r('dist')} AS dist FROM ar1""",
    "elbow_kmeans": _elbow(8),
    "elbow_by_group": _elbow_by_group(),
    "silhouette_samples": f"WITH {V}, {U}, {_PAIRS.format(t='u')}, {_SIL} SELECT row_id, label::BIGINT AS label, {_r('s')} AS silhouette FROM sil",
    "silhouette_by_label": f"WITH {V}, {U}, {_PAIRS.format(t='u')}, {_SIL} SELECT label::BIGINT AS label, count(*) AS n, {_r('avg(s)')} AS mean_silhouette FROM sil GROUP BY 1",
    "silhouette_part_size": f"WITH {PART}, {_LIST}, w AS MATERIALIZED (SELECT row_id, p_size AS label, list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))) AS x FROM pl JOIN part ON p_partkey = row_id), {_PAIRS.format(t='w')}, {_SIL} SELECT label::BIGINT AS label, count(*) AS n, {_r('avg(s)')} AS mean_silhouette FROM sil GROUP BY 1",
    "silhouette_in_blocks": f"WITH {PART}, {_LIST}, w AS MATERIALIZED (SELECT row_id, p_size AS label, list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))) AS x FROM pl JOIN part ON p_partkey = row_id), {_PAIRS.format(t='w')}, {_SIL} SELECT row_id, label::BIGINT AS label, {_r('s')} AS silhouette FROM sil",
    "fractional_shift": f"WITH {V}, {_shifted('v', 'r')} {_EMIT} FROM r",
    "tangent_noise": f"WITH {V}, {_NOISED}, {_reproject('n3', 'n4')} {_EMIT} FROM n4",
    "shift_augmented": f"WITH {V}, {_shifted('v', 'r')}, {_reproject('r', 'w')}, k AS (SELECT row_id, CASE WHEN {_uniform(_digest('row_id', repr('shift')))} < 0.5 THEN y ELSE x END AS y FROM w) {_EMIT} FROM k",
    "noise_by_batch": f"WITH {V}, {_BY_BATCH} {_EMIT} FROM b5",
    "augmented_angles": _augmented(),
    "patch_masks": f"WITH {V}, {_MASK} SELECT row_id, patch, masked FROM h",
    "visible_patches": f"WITH {V}, {_MASK} SELECT row_id, (4 * count(*) FILTER (WHERE NOT masked))::INT AS n_visible, true AS aligned, min(masked::INT) = max(masked::INT) AS moved_aligned FROM h GROUP BY row_id",
    "fixed_mask_mse": f"WITH {V}, {_shifted('v', 'r')}, e AS (SELECT label, pos, (b - a) * (b - a) AS e FROM (SELECT label, unnest(range(0, len(x))) AS pos, unnest(x) AS a, unnest(y) AS b FROM r)) SELECT label, {_r('avg(e)')} AS loss FROM e WHERE pos // 4 % 2 = 1 GROUP BY label",
    "masked_losses": f"WITH {V}, {_LOSS}, t AS (SELECT label, sum(error) AS s, sum(n) AS n, count(*) AS b FROM o GROUP BY label) SELECT label, 'sum' AS reduction, {_r('s')} AS loss FROM t UNION ALL SELECT label, 'mean', {_r('s / n')} FROM t UNION ALL SELECT label, 'batch_mean', {_r('s / b')} FROM t",
    "masked_mse_by_label": f"WITH {V}, {_LOSS} SELECT label, {_r('sum(error) / sum(n)')} AS loss FROM o GROUP BY label",
    "evaluate_batches": f"WITH {V}, {_LOSS}, t AS (SELECT row_id // 48 AS batch, sum(error) AS s, count(*) AS b FROM o GROUP BY 1) SELECT {_r('sum(s * b) / sum(b)')} AS loss, sum(b)::BIGINT AS n_rows FROM t",
    "lr_schedule": f"WITH s AS (SELECT DISTINCT event_id // 50 AS step FROM events), t AS (SELECT max(step) + 1 AS total, (max(step) + 1) // 10 AS warm FROM s) SELECT step, {_r('CASE WHEN step < warm THEN greatest(1e-8, (step + 1)::DOUBLE / greatest(1, warm)) ELSE 0.1 + 0.45 * (1 + cos(pi() * least(1.0, (step - warm)::DOUBLE / greatest(1, total - warm)))) END', 9)} AS lr_scale FROM s, t",
    "ema_fold": f"WITH {PART}, {_LIST} SELECT row_id, {_r('list_reduce(x, lambda a, b: a * 0.9::DOUBLE + b * (1.0::DOUBLE - 0.9::DOUBLE))', 4)} AS ema FROM pl",
    "ema_by_user": f"SELECT user_id, count(value) AS n, {_r('list_reduce(list(value::DOUBLE ORDER BY ts, event_id) FILTER (WHERE value IS NOT NULL), lambda a, b: a * 0.9::DOUBLE + b * (1.0::DOUBLE - 0.9::DOUBLE))')} AS average FROM events GROUP BY user_id HAVING count(value) > 0",
    "ema_events": f"SELECT count(value) AS n, {_r('list_reduce(list(value::DOUBLE ORDER BY ts, event_id) FILTER (WHERE value IS NOT NULL), lambda a, b: a * 0.999::DOUBLE + b * (1.0::DOUBLE - 0.999::DOUBLE))')} AS average FROM events",
    "positions": "SELECT row_number() OVER () - 1 AS row_id, event_id FROM events",
    "npy_round_trip": f"WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, list_transform(embedding, lambda q: q::DOUBLE) AS x FROM embeddings), {L} SELECT row_id, pos, {_r('v')} AS v FROM l",
    "sql_assign": f"WITH {V}, {U}, {_kmeans(K, 0)} SELECT row_id, label FROM a0",
    "vmf_em_t3": f"WITH {V}, {U}, {_em(MIX, STEPS)} SELECT k, {_r('kappa', 4)} AS kappa, {_r('pi', 4)} AS pi, {_r('log_c', 4)} AS log_c, {_r(f'(SELECT sum(ll) FROM (SELECT DISTINCT row_id, ll FROM z{STEPS - 1}))', 4)} AS loglik FROM p{STEPS}",
    "sql_mixture": f"WITH {V}, {U}, {_em(MIX, STEPS)} SELECT row_id, arg_max(k, lp) AS label, {_r('any_value(ll)', 4)} AS loglik FROM z{STEPS} GROUP BY row_id",
    "vmf_posterior": f"WITH {V}, {U}, {_em(MIX, STEPS)} SELECT row_id, arg_max(k, lp) AS label, {_r('max(g)', 5)} AS gamma, {_r('any_value(ll)', 4)} AS loglik FROM z{STEPS} GROUP BY row_id",
    "vmf_subset_start": _subset_start(6, 300),
    "vmf_elbow": _vmf_elbow("bic", 3),
    "vmf_elbow_nll": _vmf_elbow("nll", 5),
    "fps_k12": _fps(12),
    "fps_by_label": f"""WITH RECURSIVE {V}, w AS MATERIALIZED (SELECT row_id, label, list_transform(x, lambda q: q / (sqrt(list_dot_product(x, x)) + 1e-12)) AS x FROM v),
z AS (SELECT label, least(greatest(1, round_even(count(*) * 0.1::DOUBLE, 0)), count(*)) AS k FROM w GROUP BY label),
s AS (SELECT label, row_id, x, 9.0::DOUBLE AS d, 0 AS rank, row_id = min(row_id) OVER (PARTITION BY label) AS pick FROM w
      UNION ALL
      SELECT label, row_id, x, d, rank, row_number() OVER (PARTITION BY label ORDER BY d DESC, row_id) = 1 AS pick
      FROM (SELECT a.label, a.row_id, a.x, least(a.d, 1.0 - list_dot_product(a.x, b.x)) AS d, a.rank + 1 AS rank FROM s a JOIN s b ON b.label = a.label AND b.pick JOIN z ON z.label = a.label WHERE NOT a.pick AND a.rank + 1 < z.k))
SELECT label, rank::INT AS rank, row_id FROM s WHERE pick""",
    "stream_scores": f"WITH {V}, {U}, {L}, {SNV}, y AS (SELECT row_id, list((v - mu) / sd ORDER BY pos) AS y FROM s GROUP BY row_id) SELECT y.row_id, arg_max(u.row_id::INT, list_dot_product(y.y, u.x)) AS label FROM y, u WHERE u.row_id < {K} GROUP BY y.row_id",
}
