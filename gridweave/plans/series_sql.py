"""SQL for DuckDB that restates whole-series numerics, histogram folds and a pattern, from their definitions.

``c`` has a row for each cell (user_id, i, v), v null where a cell has no value; ``f`` the cells with gaps on a line and
ends held, as y.
"""

from __future__ import annotations

FILLED = """k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS pi, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i DESC) AS ni FROM c),
f AS (SELECT k.user_id, k.i, CASE WHEN k.v IS NOT NULL THEN k.v WHEN p.v IS NULL THEN n.v WHEN n.v IS NULL THEN p.v ELSE p.v + (n.v - p.v) * (CAST(k.i - k.pi AS DOUBLE) / (k.ni - k.pi)) END AS y
 FROM k LEFT JOIN c p ON p.user_id = k.user_id AND p.i = k.pi LEFT JOIN c n ON n.user_id = k.user_id AND n.i = k.ni)"""
#: Cells less a line, means by phase of what is left, centred; then the line through the rest.
PARTS = """l AS (SELECT user_id, coalesce(regr_slope(v, i), 0) AS b, coalesce(regr_intercept(v, i), avg(v)) AS a0 FROM c WHERE v IS NOT NULL GROUP BY user_id),
ph AS (SELECT l.user_id, p, coalesce(avg(c.v - (l.a0 + l.b * c.i)), 0) AS m FROM l CROSS JOIN (SELECT unnest(generate_series(0, {last})) AS p) LEFT JOIN c ON c.user_id = l.user_id AND c.i % {period} = p AND c.v IS NOT NULL GROUP BY ALL),
sea AS (SELECT user_id, p, m - avg(m) OVER (PARTITION BY user_id) AS s FROM ph),
tr AS (SELECT c.user_id, coalesce(regr_slope(c.v - s, c.i), 0) AS b, coalesce(regr_intercept(c.v - s, c.i), avg(c.v - s)) AS a0 FROM c JOIN sea ON sea.user_id = c.user_id AND sea.p = c.i % {period} WHERE c.v IS NOT NULL GROUP BY c.user_id)"""


def _cells(value: str, source: str, digits: int = 5) -> str:
    return f"SELECT user_id, CAST(i AS INTEGER) AS i, round({value}, {digits}) + 0.0 AS value FROM {source}"


def series_sql(daily: str, n: int) -> dict[str, str]:
    """By query, for the cells of CTE ``daily``, ``n`` of each user."""
    filled = f"WITH {daily}, {FILLED}"
    recursive = f"WITH RECURSIVE {daily}"
    ranked = "kn AS (SELECT user_id, i, v, row_number() OVER (PARTITION BY user_id ORDER BY i) AS r FROM c WHERE v IS NOT NULL)"
    spread = "CASE WHEN v > q3 + {k} * (q3 - q1) THEN (v - (q3 + {k} * (q3 - q1))) / (q3 - q1) WHEN v < q1 - {k} * (q3 - q1) THEN (v - (q1 - {k} * (q3 - q1))) / (q3 - q1) WHEN v IS NOT NULL THEN 0 END".format(k=1.5)
    parts = PARTS.format(period=7, last=6)
    out = {}
    out["series_iir"] = f"""{recursive}, {ranked}, e AS (SELECT user_id, i, r, 0.3141 * v AS s FROM kn WHERE r = 1 UNION ALL SELECT kn.user_id, kn.i, kn.r, 0.3141 * kn.v + 0.6859 * e.s FROM e JOIN kn ON kn.user_id = e.user_id AND kn.r = e.r + 1)
SELECT c.user_id, CAST(c.i AS INTEGER) AS i, round(e.s, 6) + 0.0 AS value FROM c LEFT JOIN e USING (user_id, i)"""
    third = "1.0 / 3"
    e1 = f"({third} * kn.v + (1 - {third}) * e.a)"
    e2 = f"({third} * {e1} + (1 - {third}) * e.b)"
    out["series_ema_triple"] = f"""{recursive}, {ranked}, e AS (SELECT user_id, i, r, CAST(v AS DOUBLE) AS a, CAST(v AS DOUBLE) AS b, CAST(v AS DOUBLE) AS d FROM kn WHERE r = 1
 UNION ALL SELECT kn.user_id, kn.i, kn.r, {e1}, {e2}, {third} * {e2} + (1 - {third}) * e.d FROM e JOIN kn ON kn.user_id = e.user_id AND kn.r = e.r + 1)
SELECT c.user_id, CAST(c.i AS INTEGER) AS i, round(3 * a - 3 * b + d, 6) + 0.0 AS value FROM c LEFT JOIN e USING (user_id, i)"""
    out["series_time_decayed"] = f"""WITH {daily} SELECT c.user_id, CAST(c.i AS INTEGER) AS i, round(sum(j.v * pow(0.5, (c.i - j.i) / 3.0)), 5) + 0.0 AS value
FROM c LEFT JOIN c j ON j.user_id = c.user_id AND j.i <= c.i AND j.v IS NOT NULL GROUP BY ALL"""
    out["series_fft"] = f"""{filled}, z AS (SELECT user_id, q AS i, sum(y * cos(2 * pi() * ((q * i) % {n}) / {n})) AS re FROM f CROSS JOIN (SELECT unnest(generate_series(0, {n - 1})) AS q) GROUP BY ALL) {_cells('re', 'z')}"""
    acf = f"""x AS (SELECT user_id, i, y - avg(y) OVER (PARTITION BY user_id) AS x FROM f), lag AS (SELECT unnest(generate_series(0, {n - 1})) AS q),
ac AS (SELECT a.user_id, q AS i, sum(a.x * b.x) AS s FROM x a CROSS JOIN lag JOIN x b ON b.user_id = a.user_id AND b.i = a.i + q GROUP BY ALL),
r AS (SELECT ac.user_id, ac.i, ac.s / z.s AS r FROM ac JOIN ac z ON z.user_id = ac.user_id AND z.i = 0)"""
    out["series_acf"] = f"{filled}, {acf} {_cells('r', 'r')} WHERE i <= 10"
    out["series_periods_validate"] = f"{filled}, {acf} SELECT user_id, CAST(CASE i WHEN 7 THEN 0 ELSE 1 END AS INTEGER) AS i, round(greatest(r, 0), 6) + 0.0 AS value FROM r WHERE i IN (7, 14)"
    out["series_ccf"] = f"""{filled}, x AS (SELECT user_id, i, y - avg(y) OVER (PARTITION BY user_id) AS x FROM f), v AS (SELECT user_id, sum(x * x) AS s FROM x GROUP BY user_id)
SELECT a.user_id, CAST(q + 5 AS INTEGER) AS i, round(sum(a.x * b.x) / any_value(v.s), 6) + 0.0 AS value FROM x a CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS q) JOIN x b ON b.user_id = a.user_id AND b.i = {n - 1} - (a.i - q) AND a.i - q BETWEEN 0 AND {n - 1} JOIN v ON v.user_id = a.user_id GROUP BY ALL"""
    season = f"WITH {daily}, {parts} SELECT c.user_id, CAST(c.i AS INTEGER) AS i, round(s, 5) + 0.0 AS value FROM c JOIN sea ON sea.user_id = c.user_id AND sea.p = c.i % 7"
    out["series_seasonal"] = out["series_decompose_additive"] = season
    out["series_decompose_forecast"] = f"""WITH {daily}, {parts} SELECT tr.user_id, CAST(q - 1 AS INTEGER) AS i, round(a0 + b * ({n - 1} + q) + s, 5) + 0.0 AS value
FROM tr CROSS JOIN (SELECT unnest(generate_series(1, 5)) AS q) JOIN sea ON sea.user_id = tr.user_id AND sea.p = ({n - 1} + q) % 7"""
    quartiles = "qu AS (SELECT user_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM {c} GROUP BY user_id)"
    out["series_outliers_tukey"] = f"WITH {daily}, {quartiles.format(c='c')} SELECT c.user_id, CAST(i AS INTEGER) AS i, round({spread}, 5) + 0.0 AS value FROM c JOIN qu USING (user_id)"
    out["series_decompose_anomalies"] = f"""WITH {daily}, {parts}, d AS (SELECT c.user_id, c.i, c.v - s - (tr.a0 + tr.b * c.i) AS v FROM c JOIN sea ON sea.user_id = c.user_id AND sea.p = c.i % 7 JOIN tr ON tr.user_id = c.user_id),
{quartiles.format(c='d')} SELECT d.user_id, CAST(i AS INTEGER) AS i, round({spread}, 5) + 0.0 AS value FROM d JOIN qu USING (user_id)"""
    out["series_holt_winters"] = f"""WITH RECURSIVE {daily}, {FILLED}, y AS (SELECT user_id, list(y ORDER BY i) AS y FROM f GROUP BY user_id),
st AS (SELECT user_id, y, list_avg(y[1:7]) AS l, (list_avg(y[8:14]) - list_avg(y[1:7])) / 7 AS b FROM y),
h AS (SELECT user_id, y, 0 AS i, l, b, list_transform(y[1:7], lambda x: x - l) AS s FROM st
 UNION ALL SELECT user_id, y, i + 1, l1, 0.1 * (l1 - l) + 0.9 * b, s[: i % 7] || [0.2 * (y[i + 1] - l1) + 0.8 * s[i % 7 + 1]] || s[i % 7 + 2 :] FROM (SELECT *, 0.3 * (y[i + 1] - s[i % 7 + 1]) + 0.7 * (l + b) AS l1 FROM h WHERE i < {n}))
SELECT user_id, CAST(q - 1 AS INTEGER) AS i, round(l + q * b + s[({n - 1} + q) % 7 + 1], 5) + 0.0 AS value FROM h CROSS JOIN (SELECT unnest(generate_series(1, 5)) AS q) WHERE i = {n}"""
    moments = ", ".join(f"sum(pow(x, {p})) AS s{p}" for p in range(5)) + ", " + ", ".join(f"sum(v * pow(x, {p})) AS t{p}" for p in range(3))
    det = lambda a: f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"
    normal = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]
    solved = ", ".join(f"{det([[f't{i}' if j == k else normal[i][j] for j in range(3)] for i in range(3)])} / {det(normal)} AS c{k}" for k in range(3))
    out["series_fit_poly"] = f"""WITH {daily}, x AS (SELECT user_id, i, v, -1 + 2.0 * i / {n - 1} AS x FROM c), m AS (SELECT user_id, {moments} FROM x WHERE v IS NOT NULL GROUP BY user_id), p AS (SELECT user_id, {solved} FROM m)
SELECT x.user_id, CAST(i AS INTEGER) AS i, round(c0 + c1 * x + c2 * x * x, 5) + 0.0 AS value FROM x JOIN p USING (user_id)"""
    out["series_fit_2lines"] = f"""WITH {daily}, {ranked}, sp AS (SELECT user_id, unnest(generate_series(2, CAST(count(*) AS BIGINT) - 2)) AS q FROM kn GROUP BY user_id HAVING count(*) >= 4),
side AS (SELECT sp.user_id, q, kn.r <= q AS low, greatest(0, regr_syy(v, i) - coalesce(pow(regr_sxy(v, i), 2) / nullif(regr_sxx(v, i), 0), 0)) AS sse FROM sp JOIN kn ON kn.user_id = sp.user_id GROUP BY ALL),
t AS (SELECT user_id, var_pop(v) * count(*) AS total FROM kn GROUP BY user_id), b AS (SELECT user_id, q, sum(sse) AS sse FROM side GROUP BY ALL), w AS (SELECT user_id, arg_min(q, sse) AS q, min(sse) AS sse FROM b GROUP BY user_id)
SELECT u.user_id, CAST(coalesce(kn.i, -1) AS INTEGER) AS split, round(1 - w.sse / t.total, 5) AS r2 FROM (SELECT DISTINCT user_id FROM c) u LEFT JOIN w ON w.user_id = u.user_id LEFT JOIN t ON t.user_id = u.user_id LEFT JOIN kn ON kn.user_id = u.user_id AND kn.r = w.q + 1"""
    out["series_ks_test"] = f"""WITH {daily}, d AS (SELECT user_id, i < 15 AS low, v FROM c WHERE v IS NOT NULL), m AS (SELECT user_id, count(*) FILTER (WHERE low) AS n1, count(*) FILTER (WHERE NOT low) AS n2 FROM d GROUP BY user_id),
g AS (SELECT p.user_id, p.v, count(*) FILTER (WHERE q.low) AS a, count(*) FILTER (WHERE NOT q.low) AS b FROM (SELECT DISTINCT user_id, v FROM d) p JOIN d q ON q.user_id = p.user_id AND q.v <= p.v GROUP BY ALL),
s AS (SELECT g.user_id, max(abs(CAST(a AS DOUBLE) / n1 - CAST(b AS DOUBLE) / n2)) AS d, any_value(CAST(n1 * n2 AS DOUBLE) / (n1 + n2)) AS n FROM g JOIN m USING (user_id) WHERE n1 > 0 AND n2 > 0 GROUP BY g.user_id),
z AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS z FROM s),
p AS (SELECT user_id, d, CASE WHEN z < 0.001 THEN 1 ELSE 2 * list_sum(list_transform(generate_series(1, 100), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * z * z))) END AS p FROM z)
SELECT u.user_id, round(d, 6) AS statistic, round(least(1.0, greatest(0.0, p)), 5) AS p_value FROM (SELECT DISTINCT user_id FROM c) u LEFT JOIN p USING (user_id)"""
    cut = 0.6744897501960817  # the normal distribution's third quartile
    out["series_sax"] = f"""WITH {daily}, z AS (SELECT user_id, i, CASE WHEN stddev_pop(v) OVER w = 0 THEN v - v ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS z FROM c WINDOW w AS (PARTITION BY user_id)),
p AS (SELECT user_id, i // {n // 6} AS s, coalesce(avg(z), 0) AS m FROM z GROUP BY ALL) SELECT user_id, string_agg(CASE WHEN m < -{cut} THEN 'a' WHEN m < 0 THEN 'b' WHEN m < {cut} THEN 'c' ELSE 'd' END, '' ORDER BY s) AS value FROM p GROUP BY user_id"""
    out["series_matrix_profile"] = f"""{filled}, y AS (SELECT user_id, list(y ORDER BY i) AS y FROM f GROUP BY user_id), w AS (SELECT user_id, i, list_avg(y[i + 1 : i + 5]) AS m, list_stddev_pop(y[i + 1 : i + 5]) AS sd, y[i + 1 : i + 5] AS x FROM y CROSS JOIN (SELECT unnest(generate_series(0, {n - 5})) AS i)),
d AS (SELECT a.user_id, a.i, CASE WHEN a.sd < 1e-12 AND b.sd < 1e-12 THEN 0 WHEN a.sd < 1e-12 OR b.sd < 1e-12 THEN sqrt(5) ELSE sqrt(greatest(0, 10 * (1 - (list_dot_product(a.x, b.x) - 5 * a.m * b.m) / (5 * a.sd * b.sd)))) END AS d FROM w a JOIN w b ON a.user_id = b.user_id AND abs(a.i - b.i) >= 2),
g AS (SELECT user_id, i, min(d) AS d FROM d GROUP BY ALL) {_cells('d', 'g')}"""
    out["series_dtw"] = f"""WITH RECURSIVE {daily}, {FILLED}, y AS (SELECT user_id, list(y ORDER BY i) AS y, list(y ORDER BY i DESC) AS x FROM f GROUP BY user_id),
h AS (SELECT user_id, y, x, 0 AS s, list_transform(generate_series(0, {n}), lambda j: CASE WHEN j = 0 THEN 0.0 ELSE 'inf'::DOUBLE END) AS a, CAST([] AS DOUBLE[]) AS b FROM y
 UNION ALL SELECT user_id, y, x, s + 1, CASE WHEN j = {n} THEN b || [d] ELSE a END, CASE WHEN j = {n} THEN [] ELSE b || [d] END FROM (
  SELECT *, CASE WHEN j = 0 OR abs(i - j) > 5 THEN 'inf'::DOUBLE ELSE pow(y[i] - x[j], 2) + least(a[j + 1], b[j], a[j]) END AS d FROM (SELECT *, s // {n + 1} + 1 AS i, s % {n + 1} AS j FROM h WHERE s < {n * (n + 1)})))
SELECT user_id, round(sqrt(a[{n + 1}]), 5) AS value FROM h WHERE s = {n * (n + 1)}"""
    # The best cost up to each place and where its last piece begins; then the places, from the end.
    out["series_changepoints"] = f"""WITH RECURSIVE {daily}, {FILLED}, y AS (SELECT user_id, list(y ORDER BY i) AS y FROM f GROUP BY user_id),
z AS (SELECT *, list_transform(generate_series(0, {n}), lambda j: coalesce(list_sum(y[1:j]), 0)) AS s, list_transform(generate_series(0, {n}), lambda j: coalesce(list_sum(list_transform(y[1:j], lambda x: x * x)), 0)) AS q,
  3 * pow(greatest(list_median(list_transform(generate_series(1, {n - 1}), lambda j: abs(y[j + 1] - y[j]))) / 0.6745 / sqrt(2), 1e-12), 2) * ln({n}) AS pen FROM y),
h AS (SELECT user_id, s, q, pen, 0 AS j, [-pen] AS best, [0] AS prev FROM z
 UNION ALL SELECT user_id, s, q, pen, j + 1, best || [list_min(c) + pen], prev || [list_position(c, list_min(c)) - 1] FROM (
  SELECT *, list_transform(generate_series(0, j), lambda i: best[i + 1] + q[j + 2] - q[i + 1] - pow(s[j + 2] - s[i + 1], 2) / (j + 1 - i)) AS c FROM h WHERE j < {n})),
b AS (SELECT user_id, prev, CAST(prev[{n + 1}] AS BIGINT) AS place FROM h WHERE j = {n} UNION ALL SELECT user_id, prev, CAST(prev[place + 1] AS BIGINT) FROM b WHERE place > 0)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS INTEGER) AS i, CAST(place AS INTEGER) AS "at" FROM b WHERE place > 0"""
    # Second derivatives of the natural spline from its system of three diagonals: forward over the known cells, then back.
    out["series_fill_spline"] = f"""WITH RECURSIVE {daily}, {FILLED}, k2 AS (SELECT user_id, list(i ORDER BY i) AS x, list(v ORDER BY i) AS y FROM c WHERE v IS NOT NULL GROUP BY user_id),
a AS (SELECT user_id, x, y, 1 AS j, [0.0::DOUBLE] AS u, [0.0::DOUBLE] AS r FROM k2
 UNION ALL SELECT user_id, x, y, j + 1, u || [(x[j + 2] - x[j + 1]) / d], r || [(6 * ((y[j + 2] - y[j + 1]) / (x[j + 2] - x[j + 1]) - (y[j + 1] - y[j]) / (x[j + 1] - x[j])) - (x[j + 1] - x[j]) * r[j]) / d]
  FROM (SELECT *, 2 * (x[j + 2] - x[j]) - (x[j + 1] - x[j]) * u[j] AS d FROM a WHERE j < len(x) - 1)),
e AS (SELECT user_id, x, y, u, r, j, [0.0::DOUBLE] AS m FROM a WHERE j = greatest(1, len(x) - 1)
 UNION ALL SELECT user_id, x, y, u, r, j - 1, [CASE WHEN j = 1 THEN 0.0 ELSE r[j] - u[j] * m[1] END] || m FROM e WHERE j >= 1),
m AS (SELECT user_id, unnest(x) AS i, unnest(y) AS y, unnest(m) AS m, len(x) AS n FROM e WHERE j = 0),
p AS (SELECT *, lead(i) OVER w AS i1, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT c.user_id, CAST(c.i AS INTEGER) AS i, round(CASE WHEN c.v IS NOT NULL THEN c.v WHEN p.n < 3 THEN p.y + (p.y1 - p.y) * (CAST(c.i - p.i AS DOUBLE) / (p.i1 - p.i))
 ELSE (p.i1 - c.i) / (p.i1 - p.i) * p.y + (c.i - p.i) / (p.i1 - p.i) * p.y1 + pow(p.i1 - p.i, 2) / 6 * ((pow((p.i1 - c.i) / (p.i1 - p.i), 3) - (p.i1 - c.i) / (p.i1 - p.i)) * p.m + (pow((c.i - p.i) / (p.i1 - p.i), 3) - (c.i - p.i) / (p.i1 - p.i)) * p.m1) END, 5) + 0.0 AS value
FROM c LEFT JOIN p ON p.user_id = c.user_id AND c.i >= p.i AND c.i < p.i1"""
    return out


def pattern_sql(within: int) -> str:
    """A view, clicks one after another, a purchase: rows next to each other in their order, within a width."""
    return f"""WITH o AS (SELECT user_id, event_id, ts, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
n AS (SELECT *, min(CASE WHEN k <> 'click' THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM o),
m AS (SELECT n.user_id, n.event_id AS first_id, z.event_id AS last_id, n.e - n.r - 1 AS clicks, n.r FROM n JOIN o z ON z.user_id = n.user_id AND z.r = n.e WHERE n.k = 'view' AND z.k = 'purchase' AND n.e > n.r + 1 AND epoch_us(z.ts) - epoch_us(n.ts) <= {within})
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY r) AS match_number, first_id, last_id, clicks FROM m"""


def hist_sql(days: tuple[int, int], day: int, reach: int, grid: tuple[int, int, int], window: int, lookback: int) -> dict[str, str]:
    """Folds of histograms that each day's end takes of the samples of ``reach`` ticks before it: buckets are powers of two."""
    base = f"""d AS (SELECT unnest(generate_series({days[0]}, {days[1]}, {day})) AS t), s AS (SELECT user_id, epoch_us(ts) AS et, value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
b AS (SELECT s.user_id, d.t, CASE WHEN v = 0 THEN -100000 ELSE sign(v) * 1000 + ceil(log2(abs(v))) END AS k, count(*) AS c, sum(v) AS total FROM s JOIN d ON s.et <= d.t AND s.et > d.t - {reach} GROUP BY ALL),
h AS (SELECT user_id, t, CAST(sum(c) AS DOUBLE) AS n, round(sum(total), 6) AS total FROM b GROUP BY ALL),
o AS (SELECT *, lag(t) OVER w AS pt, lag(n) OVER w AS pn, lag(total) OVER w AS ptotal FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t)),
fell AS (SELECT o.user_id, o.t, bool_or(p.c > coalesce(q.c, 0)) AS reset, bool_or(p.c <> coalesce(q.c, 0)) AS other FROM o JOIN b p ON p.user_id = o.user_id AND p.t = o.pt LEFT JOIN b q ON q.user_id = o.user_id AND q.t = o.t AND q.k = p.k GROUP BY ALL),
x AS (SELECT o.*, reset, other OR n <> pn OR total <> ptotal AS changed, lead(o.t) OVER u AS nt, lead(n) OVER u AS nn, lead(reset) OVER u AS nreset FROM o LEFT JOIN fell ON fell.user_id = o.user_id AND fell.t = o.t WINDOW u AS (PARTITION BY o.user_id ORDER BY o.t)),
g AS (SELECT unnest(generate_series({grid[0]}, {grid[1]}, {grid[2]})) AS a), w AS (SELECT x.*, g.a, pt > g.a - {window} AS pair, pt >= g.a - {window + lookback} AS near, nt <= g.a + {lookback} AS soon FROM x JOIN g ON t > g.a - {window} AND t <= g.a)"""
    change = f"""e AS (SELECT user_id, a, count(*) AS m, min(t) AS t0, max(t) AS t1, arg_max(n, t) - arg_min(n, t) AS d, coalesce(sum(pn) FILTER (WHERE pair AND reset), 0) AS r FROM w GROUP BY ALL HAVING count(*) > 1),
e2 AS (SELECT *, CAST(t1 - t0 AS DOUBLE) AS sp, CAST(t1 - t0 AS DOUBLE) / (m - 1) AS av FROM e),
e3 AS (SELECT *, (sp + CASE WHEN t0 - (a - {window}) <= av * 1.1 THEN t0 - (a - {window}) ELSE av / 2 END + CASE WHEN a - t1 <= av * 1.1 THEN a - t1 ELSE av / 2 END) / sp AS grown FROM e2)"""
    # The first sample of a window knows the one before it, and the last the one after the point.
    ends = f"""e AS (SELECT user_id, a, count(*) AS m, min(t) AS t0, max(t) AS t1, arg_min(n, t) AS n0, arg_max(n, t) AS n1, arg_min(CASE WHEN near THEN pt ELSE -1 END, t) AS bt, arg_min(coalesce(pn, 0), t) AS bn, arg_min(coalesce(reset, FALSE), t) AS breset,
 arg_max(CASE WHEN soon THEN nt ELSE -1 END, t) AS ft, arg_max(coalesce(nn, 0), t) AS fn, arg_max(coalesce(nreset, FALSE), t) AS freset, coalesce(sum(pn) FILTER (WHERE pair AND reset), 0) AS r FROM w GROUP BY ALL),
z AS (SELECT *, bt >= 0 AND bt IS NOT NULL AS hb, ft >= 0 AND ft IS NOT NULL AS hf FROM e)"""

    def edged(counter: bool, smooth: bool) -> str:
        low = "CASE WHEN breset THEN 0 ELSE bn END" if counter else "bn"
        high = "CASE WHEN freset THEN n1 + fn ELSE fn END" if counter else "fn"
        r = ("r" if smooth else "r + CASE WHEN hb AND breset THEN bn ELSE 0 END") if counter else "0"
        left = f"CASE WHEN hb THEN ({low}) + (n0 - ({low})) * (CAST(a - {window} - bt AS DOUBLE) / (t0 - bt)) ELSE n0 END" if smooth else "CASE WHEN hb THEN bn ELSE n0 END"
        right = f"CASE WHEN hf THEN n1 + (({high}) - n1) * (CAST(a - t1 AS DOUBLE) / (ft - t1)) ELSE n1 END" if smooth else "n1"
        return f"({r}) + (({right}) - ({left}))"

    modes = {}
    for mode in ("anchor", "smooth"):
        smooth = mode == "smooth"
        some = f"z WHERE m + hb::INT {'+ hf::INT' if smooth else ''} >= 2"
        for name, value in (("rate", f"({edged(True, smooth)}) / {window / 1e6}"), ("increase", edged(True, smooth)), ("delta", edged(False, smooth))):
            modes[f"hist_{name}_{mode}"] = f"WITH {base}, {ends} SELECT user_id, make_timestamp(a) AS ts, round({value}, 6) + 0.0 AS value FROM {some}"
    say = lambda value, source: f"SELECT user_id, make_timestamp(a) AS ts, round({value}, 6) + 0.0 AS value FROM {source}"
    return modes | {
        "hist_resets_anchor": f"WITH {base} {say('CAST(count(*) FILTER (WHERE near AND reset) AS DOUBLE)', 'w')} GROUP BY ALL",
        "hist_changes_anchor": f"WITH {base} {say('CAST(count(*) FILTER (WHERE near AND changed) AS DOUBLE)', 'w')} GROUP BY ALL",
        "hist_resets": f"WITH {base} {say('CAST(count(*) FILTER (WHERE pair AND reset) AS DOUBLE)', 'w')} GROUP BY ALL",
        "hist_changes": f"WITH {base} {say('CAST(count(*) FILTER (WHERE pair AND changed) AS DOUBLE)', 'w')} GROUP BY ALL",
        "hist_detect_reset": f"WITH {base} SELECT user_id, make_timestamp(t) AS ts, reset FROM x WHERE pt IS NOT NULL",
        "hist_increase": f"WITH {base}, {change} {say('(d + r) * grown', 'e3')}",
        "hist_rate": f"WITH {base}, {change} {say(f'(d + r) * grown / {window / 1e6}', 'e3')}",
        "hist_delta": f"WITH {base}, {change} {say('d * grown', 'e3')}",
    }
