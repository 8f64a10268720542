"""Registered queries for grid, counter, window and carried-value operators, each with its SQL for DuckDB.

Series are the users of ``events``; the grid has a point a day and windows of three days. Values are rounded in the
query, not in the engine, because sums of doubles may differ in the last bits between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import __version__
from ..operators import folds, grids, rate, resample, windows
from ..operators.counter import ResetPolicy
from .grid import Grid
from .roles import Roles

DAY = 86_400_000_000
WINDOW, LOOKBACK = 3 * DAY, 2 * DAY
ROLES = Roles("user_id")
#: The first window begins before the first event and the last ends after the last, so every row is in some window.
GRID = Grid.of("2024-01-03", "2024-01-31", DAY)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "value")


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, digits: int = 6, column: str = "value", by: float = 1.0) -> DataFrame:
    """Rounded; -0.0 becomes 0.0."""
    return df.withColumn(column, F.round(F.col(column) * by, digits) + F.lit(0.0))


# --- SQL: samples, grid points, and the samples of each window with their neighbours in it.
SAMPLES = "s AS (SELECT user_id, epoch_us(ts) AS t, value AS v FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"
POINTS = f"g AS (SELECT unnest(generate_series({GRID.start}, {GRID.end}, {GRID.step})) AS pt_at)"
INSIDE = f"""w0 AS (SELECT s.user_id, g.pt_at AS a, s.t, s.v FROM s JOIN g ON s.t > g.pt_at - {WINDOW} AND s.t <= g.pt_at),
w AS (SELECT *, lag(t) OVER p AS pt, lag(v) OVER p AS pv, lead(t) OVER p AS nt FROM w0 WINDOW p AS (PARTITION BY user_id, a ORDER BY t))"""
EDGES = f"""b AS (SELECT s.user_id, g.pt_at AS a, max(s.t) AS bt, arg_max(s.v, s.t) AS bv FROM s JOIN g ON s.t <= g.pt_at - {WINDOW} AND s.t >= g.pt_at - {WINDOW + LOOKBACK} GROUP BY ALL),
f AS (SELECT s.user_id, g.pt_at AS a, min(s.t) AS ft, arg_min(s.v, s.t) AS fv FROM s JOIN g ON s.t > g.pt_at AND s.t <= g.pt_at + {LOOKBACK} GROUP BY ALL),
wa0 AS (SELECT user_id, a, t, v, 0 AS role FROM w0 UNION ALL SELECT user_id, a, bt, bv, 1 FROM b),
wa AS (SELECT *, lag(t) OVER p AS pt, lag(v) OVER p AS pv, lead(t) OVER p AS nt, a - {WINDOW} AS ws FROM wa0 WINDOW p AS (PARTITION BY user_id, a ORDER BY t))"""


def windowed_sql(value: str, source: str = "w", where: str = "TRUE", digits: int = 6, cast: str = "DOUBLE") -> str:
    said = f"round({value}, {digits}) + 0.0" if cast == "DOUBLE" else value
    return f"""WITH {SAMPLES}, {POINTS}, {INSIDE}, {EDGES}
SELECT user_id, make_timestamp(a) AS ts, CAST({said} AS {cast}) AS value FROM {source} WHERE {where} GROUP BY user_id, a HAVING ({value}) IS NOT NULL"""


# --- grid and version


def _grid(spark, sf_dir):
    return grids.ts_grid(spark, GRID)


def _grid_index(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", grids.ts_grid_index(F.col("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit(7 * 3_600_000_000).cast("long")).alias("idx"))


register("version", lambda spark, sf_dir: spark.range(1).select((F.length(F.lit(__version__)) > 0).alias("has_version")), "SELECT TRUE AS has_version")
register("ts_grid", _grid, f"SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS ts")
register("ts_grid_index", _grid_index, "SELECT event_id, CAST(floor(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10') AS DOUBLE) / 25200000000) AS BIGINT) AS idx FROM events")


# --- counters


def counter_sql(what: str = "rate", edge: str = "EXTRAPOLATE", policy: str = "RESTART", high: float = 0.0, samples: str = SAMPLES, grid: str = POINTS, window: int = WINDOW, lookback: int = LOOKBACK, key: str = "user_id", extra: str = "", digits: int = 9) -> str:
    """Rate, increase or delta restated as CTEs. The result is per second for a rate."""
    inside = f"""w0 AS (SELECT s.*, g.pt_at AS a FROM s JOIN g ON s.t > g.pt_at - {window} AND s.t <= g.pt_at),
w AS (SELECT *, lag(t) OVER p AS pt, lag(v) OVER p AS pv FROM w0 WINDOW p AS (PARTITION BY {key}, a ORDER BY t)),
b AS (SELECT s.{key}, g.pt_at AS a, max(s.t) AS bt, arg_max(s.v, s.t) AS bv FROM s JOIN g ON s.t <= g.pt_at - {window} AND s.t >= g.pt_at - {window + lookback} GROUP BY ALL),
f AS (SELECT s.{key}, g.pt_at AS a, min(s.t) AS ft, arg_min(s.v, s.t) AS fv FROM s JOIN g ON s.t > g.pt_at AND s.t <= g.pt_at + {lookback} GROUP BY ALL)"""
    adjust = {"RESTART": "pv", "ZERO": "pv - v", "NULL": "pv", "WRAP": f"{high}"}[policy] if what != "delta" else "0"
    st = "OR st >= t OR st >= pt" if extra else ""
    sums = f"""q AS (SELECT {key}, a, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS v0, arg_max(v, t) AS v1, {'arg_min_null(st, t)' if extra else 'NULL'} AS st0,
  coalesce(sum(CASE WHEN pt IS NOT NULL AND (v < pv {st}) THEN {adjust} END), 0) AS adj, count(CASE WHEN v < pv {st} THEN 1 END) AS resets FROM w GROUP BY {key}, a)"""
    if edge == "EXTRAPOLATE":
        counter = what != "delta"
        value = f"""e AS (SELECT *, a - {window} AS ws, {'coalesce(a - ' + str(window) + ' < st0 AND st0 < t0, FALSE)' if counter else 'FALSE'} AS z FROM q),
e2 AS (SELECT *, CASE WHEN z THEN st0 ELSE t0 END AS x0, CASE WHEN z THEN 0 ELSE v0 END AS y0, n + CASE WHEN z THEN 1 ELSE 0 END AS m, adj + (v1 - v0) + CASE WHEN z THEN v0 ELSE 0 END AS d FROM e),
e3 AS (SELECT *, CAST(t1 - x0 AS DOUBLE) AS sp, CAST(t1 - x0 AS DOUBLE) / (m - 1) AS av FROM e2 WHERE m >= 2),
e4 AS (SELECT *, CASE WHEN z THEN 0 WHEN x0 - ws > av * 1.1 THEN av / 2 ELSE x0 - ws END AS l0, CASE WHEN a - t1 > av * 1.1 THEN av / 2 ELSE a - t1 END AS r FROM e3),
e5 AS (SELECT *, {'CASE WHEN NOT z AND d > 0 AND y0 >= 0 THEN least(l0, sp * (y0 / d)) ELSE l0 END' if counter else 'l0'} AS l FROM e4),
x AS (SELECT {key}, a, resets, d * ((sp + l + r) / sp) AS value FROM e5)"""
    else:
        left = "CASE WHEN bt IS NULL THEN v0 ELSE bv END"
        right, more, adj = "v1", "CASE WHEN bt IS NULL THEN 0 ELSE 1 END", f"adj + CASE WHEN bt IS NOT NULL AND v0 < bv THEN bv ELSE 0 END" if what != "delta" else "0"
        if edge == "SMOOTH":
            adj = "adj" if what != "delta" else "0"
            low = "CASE WHEN v0 < bv THEN 0 ELSE bv END" if what != "delta" else "bv"
            left = f"CASE WHEN bt IS NULL THEN v0 ELSE ({low}) + (v0 - ({low})) * (CAST(q.a - {window} - bt AS DOUBLE) / (t0 - bt)) END"
            high_ = "CASE WHEN fv < v1 THEN v1 + fv ELSE fv END" if what != "delta" else "fv"
            right = f"CASE WHEN ft IS NULL THEN v1 ELSE v1 + (({high_}) - v1) * (CAST(q.a - t1 AS DOUBLE) / (ft - t1)) END"
            more += " + CASE WHEN ft IS NULL THEN 0 ELSE 1 END"
        value = f"x AS (SELECT q.{key}, q.a, resets, CASE WHEN n + {more} >= 2 THEN ({adj}) + (({right}) - ({left})) END AS value FROM q LEFT JOIN b ON q.{key} = b.{key} AND q.a = b.a LEFT JOIN f ON q.{key} = f.{key} AND q.a = f.a)"
    out = f"value / {float(window)} * 1000000.0" if what == "rate" else "value"
    drop = "AND resets = 0" if policy == "NULL" else ""
    return f"WITH {samples}, {grid}, {inside}, {sums}, {value} SELECT {key}, make_timestamp(a) AS ts, round({out}, {digits}) + 0.0 AS value FROM x WHERE value IS NOT NULL {drop}"


def _counter(what="rate", edge="EXTRAPOLATE", policy=ResetPolicy(), digits=9):
    return lambda spark, sf_dir: rounded(rate.ts_rate(events(spark, sf_dir), GRID, WINDOW, ROLES, what=what, edge=edge, lookback=LOOKBACK, policy=policy, per="second"), digits)


for _what in ("rate", "increase", "delta"):
    _digits = 9 if _what == "rate" else 6
    register(f"ts_{_what}", _counter(_what, digits=_digits), counter_sql(_what, digits=_digits))
    register(f"ts_{_what}_anchor", _counter(_what, "ANCHOR", digits=_digits), counter_sql(_what, "ANCHOR", digits=_digits))
    register(f"ts_{_what}_smooth", _counter(_what, "SMOOTH", digits=_digits), counter_sql(_what, "SMOOTH", digits=_digits))
for _kind, _high in (("ZERO", None), ("NULL", None), ("WRAP", 1000.0)):
    register(f"ts_increase_reset_{_kind.lower()}", _counter("increase", policy=ResetPolicy(_kind, _high), digits=6), counter_sql("increase", policy=_kind, high=_high or 0.0, digits=6))


def counters(spark, sf_dir) -> DataFrame:
    """A true counter per user: the running number of events, with the start of its day as start time."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("value IS NOT NULL AND ts IS NOT NULL")
    return e.select("user_id", "ts", F.row_number().over(by).cast("double").alias("value"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("start_ts"))


register(
    "ts_rate_start_ts",
    lambda spark, sf_dir: rounded(rate.ts_rate(counters(spark, sf_dir), GRID, WINDOW, ROLES, per="second"), 9),
    counter_sql(samples="s AS (SELECT user_id, epoch_us(ts) AS t, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS DOUBLE) AS v, epoch_us(date_trunc('day', ts)) AS st FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)", extra="st"),
)

#: From the first ship date to past the last.
SHIP_GRID = Grid.of("1995-01-31", "2001-11-20", 35 * DAY)
SHIP_ROLES = Roles("l_suppkey", "l_shipdate", "qty")
register(
    "ts_rate_duplicates",
    lambda spark, sf_dir: rounded(rate.ts_rate(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", F.col("l_quantity").cast("double").alias("qty")), SHIP_GRID, 70 * DAY, SHIP_ROLES, per="second"), 9),
    counter_sql(samples="s AS (SELECT l_suppkey, epoch_us(l_shipdate) AS t, max(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY ALL)", grid=f"g AS (SELECT unnest(generate_series({SHIP_GRID.start}, {SHIP_GRID.end}, {SHIP_GRID.step})) AS pt_at)", window=70 * DAY, key="l_suppkey"),
)


def _rate_lists(spark, sf_dir):
    """The list form unpacked: one row per grid point, null without a value."""
    return rounded(rate.ts_rate(events(spark, sf_dir), GRID, WINDOW, ROLES, per="second", shape="dense"), 9)


register(
    "ts_rate_list_form",
    _rate_lists,
    f"WITH r AS ({counter_sql()}) SELECT u.user_id, make_timestamp(g.x) AS ts, r.value FROM (SELECT DISTINCT user_id FROM events WHERE epoch_us(ts) BETWEEN {GRID.start - WINDOW} AND {GRID.end} AND value IS NOT NULL) u CROSS JOIN (SELECT unnest(generate_series({GRID.start}, {GRID.end}, {GRID.step})) AS x) g LEFT JOIN r ON r.user_id = u.user_id AND r.ts = make_timestamp(g.x)",
)


# --- folds: name, parameters, SQL over the window's samples, source of the samples

PAIR = "pt IS NOT NULL"
HELD = f"least(coalesce(nt, a), a) - greatest(t, ws)"
Q7 = "quantile_cont(v, {phi})"
RANGE: list[tuple] = [
    ("irate", {}, "arg_max(CASE WHEN v < pv THEN v ELSE v - pv END / (t - pt) * 1000000.0, t) FILTER (WHERE pt IS NOT NULL)", {"by": 1e6, "digits": 9}),
    ("idelta", {}, "arg_max(v - pv, t) FILTER (WHERE pt IS NOT NULL)", {}),
    ("resets", {}, "CAST(count(CASE WHEN v < pv THEN 1 END) AS DOUBLE)", {}),
    ("changes", {}, "CAST(count(CASE WHEN v <> pv THEN 1 END) AS DOUBLE)", {}),
    ("count_over_time", {}, "CAST(count(*) AS DOUBLE)", {}),
    ("sum_over_time", {}, "sum(v)", {}),
    ("avg_over_time", {}, "avg(v)", {}),
    ("min_over_time", {}, "min(v)", {}),
    ("max_over_time", {}, "max(v)", {}),
    ("first_over_time", {}, "arg_min(v, t)", {}),
    ("last_over_time", {}, "arg_max(v, t)", {}),
    ("stddev_over_time", {}, "stddev_pop(v)", {}),
    ("stdvar_over_time", {}, "var_pop(v)", {"digits": 8}),
    ("quantile_over_time", {"phi": 0.9}, "quantile_cont(v, 0.9)", {}),
    ("mad_over_time", {}, "mad(v)", {}),
    ("present_over_time", {}, "CASE WHEN count(*) > 0 THEN 1.0 END", {}),
    ("ts_of_min_over_time", {}, "arg_min(t, (v, t))", {"cast": "BIGINT"}),
    ("ts_of_max_over_time", {}, "arg_max(t, (v, -t))", {"cast": "BIGINT"}),
    ("ts_of_first_over_time", {}, "min(t)", {"cast": "BIGINT"}),
    ("ts_of_last_over_time", {}, "max(t)", {"cast": "BIGINT"}),
    ("deriv", {}, "CASE WHEN count(*) > 1 THEN regr_slope(v, (t - a) / 1000000.0) END", {"by": 1e6, "digits": 8}),
    ("predict_linear", {"horizon": DAY}, f"CASE WHEN count(*) > 1 THEN regr_intercept(v, CAST(t - a AS DOUBLE)) + regr_slope(v, CAST(t - a AS DOUBLE)) * {DAY} END", {"digits": 4}),
    ("range_over_time", {}, "max(v) - min(v)", {}),
    ("sum2_over_time", {}, "sum(v * v)", {"digits": 4}),
    ("geomean_over_time", {}, "exp(avg(ln(v)))", {}),
    ("mode_over_time", {}, "list_sort(list(v))[1]", {"oracle": "mode"}),
    ("distinct_over_time", {}, "CAST(count(DISTINCT v) AS DOUBLE)", {}),
    ("monotone_over_time", {"kind": "ascent"}, "coalesce(sum(CASE WHEN v > pv THEN v - pv END), 0)", {}),
    ("ts_of_last_change_over_time", {}, "max(CASE WHEN v <> pv THEN t END)", {"cast": "BIGINT"}),
    ("interval_over_time", {}, "quantile_cont(CAST(t - pt AS DOUBLE), 0.5)", {"digits": 1}),
    ("stale_samples_over_time", {}, "0.0", {}),
    ("time_weighted_avg_over_time", {}, "sum(pv * (t - pt)) / sum(t - pt)", {}),
    ("integral_over_time", {"method": "LINEAR"}, "sum((v + pv) / 2 * (t - pt)) / 1000000.0", {"by": 1e-6, "digits": 3}),
    ("active_duration_over_time", {"max_gap": DAY // 2}, f"CAST(coalesce(sum(CASE WHEN t - pt <= {DAY // 2} THEN t - pt END), 0) AS DOUBLE)", {"digits": 0}),
    ("gaps_over_time", {"max_gap": DAY // 2}, f"CAST(count(CASE WHEN t - pt > {DAY // 2} THEN 1 END) AS DOUBLE)", {}),
]


def _range(name, params, options, edge="INSIDE"):
    def run(spark, sf_dir):
        out = folds.over_time(events(spark, sf_dir), name, GRID, WINDOW, ROLES, edge, LOOKBACK, **params)
        return out if options.get("cast") == "BIGINT" else rounded(out, options.get("digits", 6), by=options.get("by", 1.0))

    return run


for _name, _params, _sql, _o in RANGE:
    register(f"ts_{_name}", _range(_name, _params, _o), windowed_sql(_sql, digits=_o.get("digits", 6), cast=_o.get("cast", "DOUBLE")))
ORACLE_SQL["ts_mode_over_time"] = f"""WITH {SAMPLES}, {POINTS}, {INSIDE}, c AS (SELECT user_id, a, v, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, a ORDER BY n DESC, v) AS rn FROM c) SELECT user_id, make_timestamp(a) AS ts, round(v, 6) + 0.0 AS value FROM r WHERE rn = 1"""

ANCHORED: list[tuple] = [
    ("resets", {}, "CAST(count(CASE WHEN v < pv THEN 1 END) AS DOUBLE)", "role = 0", {}),
    ("changes", {}, "CAST(count(CASE WHEN v <> pv THEN 1 END) AS DOUBLE)", "role = 0", {}),
    ("time_weighted_avg_over_time", {}, f"sum(v * ({HELD})) / nullif(sum({HELD}), 0)", f"{HELD} > 0", {}),
    ("integral_over_time", {}, f"sum(v * ({HELD})) / 1000000.0", f"{HELD} > 0", {"by": 1e-6, "digits": 3}),
    ("monotone_over_time", {"kind": "increases"}, "CAST(count(CASE WHEN v > pv THEN 1 END) AS DOUBLE)", "role = 0", {}),
    ("gaps_over_time", {"max_gap": DAY // 2}, f"CAST(count(CASE WHEN t - pt > {DAY // 2} THEN 1 END) AS DOUBLE)", "role = 0", {}),
    ("active_duration_over_time", {"max_gap": DAY // 2}, f"CAST(coalesce(sum(CASE WHEN t - pt <= {DAY // 2} THEN t - greatest(pt, ws) END), 0) AS DOUBLE)", "role = 0", {"digits": 0}),
    ("ts_of_last_change_over_time", {}, "max(CASE WHEN v <> pv THEN t END)", "role = 0", {"cast": "BIGINT"}),
]
for _name, _params, _sql, _where, _o in ANCHORED:
    register(f"ts_{_name}_anchor", _range(_name, _params, _o, "ANCHOR"), windowed_sql(_sql, "wa", _where, _o.get("digits", 6), _o.get("cast", "DOUBLE")))


# From the value on the line to the first sample, at the window's open end, to that on the line to the next one, at the point.
SMOOTHED = f"""{EDGES}, q0 AS (SELECT w.*, w.a - {WINDOW} AS ws, CASE WHEN pt IS NULL THEN bt END AS et, CASE WHEN pt IS NULL THEN bv + (v - bv) * (CAST(w.a - {WINDOW} - bt AS DOUBLE) / (t - bt)) END AS ev,
 CASE WHEN nt IS NULL THEN ft END AS ut, CASE WHEN nt IS NULL THEN v + (fv - v) * (CAST(w.a - t AS DOUBLE) / (ft - t)) END AS uv FROM w LEFT JOIN b ON w.user_id = b.user_id AND w.a = b.a LEFT JOIN f ON w.user_id = f.user_id AND w.a = f.a),
q AS (SELECT *, coalesce(CASE WHEN pt IS NOT NULL THEN t - pt WHEN et IS NOT NULL THEN t - ws END, 0) + coalesce(CASE WHEN ut IS NOT NULL THEN a - t END, 0) AS width,
 coalesce(CASE WHEN pt IS NOT NULL THEN pv * (t - pt) WHEN et IS NOT NULL THEN ev * (t - ws) END, 0) + coalesce(CASE WHEN ut IS NOT NULL THEN v * (a - t) END, 0) AS held,
 coalesce(CASE WHEN pt IS NOT NULL THEN (pv + v) / 2 * (t - pt) WHEN et IS NOT NULL THEN (ev + v) / 2 * (t - ws) END, 0) + coalesce(CASE WHEN ut IS NOT NULL THEN (v + uv) / 2 * (a - t) END, 0) AS area FROM q0 WHERE pt IS NOT NULL OR et IS NOT NULL OR ut IS NOT NULL)"""
for _name, _params, _sql, _o in (
    ("time_weighted_avg_over_time", {}, "sum(held) / nullif(sum(width), 0)", {}), ("time_weighted_avg_over_time", {"method": "LINEAR"}, "sum(area) / nullif(sum(width), 0)", {}),
    ("integral_over_time", {}, "sum(held) / 1000000.0", {"by": 1e-6, "digits": 3}), ("integral_over_time", {"method": "LINEAR"}, "sum(area) / 1000000.0", {"by": 1e-6, "digits": 3}),
):
    register(f"ts_{_name}_smooth" + "_linear" * bool(_params), _range(_name, _params, _o, "SMOOTH"), windowed_sql(_sql, "q", digits=_o.get("digits", 6)).replace(EDGES, SMOOTHED))
for _name, _sql in (("sum", "fsum(v)"), ("avg", "favg(v)")):
    register(f"ts_{_name}_over_time_exact", _range(f"{_name}_over_time", {"exact": True}, {"digits": 9}), windowed_sql(_sql, digits=9))


SF, TF = 0.3141592653, 0.2718281828


def _double_exp(spark, sf_dir):
    return rounded(folds.over_time(events(spark, sf_dir), "double_exp_smoothing", GRID, WINDOW, ROLES, sf=SF, tf=TF), 7)


_level = f"{SF} * {{v}} + (1 - {SF}) * ({{l}} + ({{b}}))"
_trend = f"{TF} * (({{n}}) - {{l}}) + (1 - {TF}) * ({{b}})"
_l2 = _level.format(v="o2.v", l="o1.v", b="o2.v - o1.v")
_ln = _level.format(v="o.v", l="r.l", b="r.b")
register(
    "ts_double_exp_smoothing",
    _double_exp,
    f"""WITH RECURSIVE {SAMPLES}, {POINTS}, {INSIDE}, o AS (SELECT user_id, a, v, row_number() OVER (PARTITION BY user_id, a ORDER BY t) AS i, count(*) OVER (PARTITION BY user_id, a) AS n FROM w),
r AS (SELECT o1.user_id, o1.a, CAST(2 AS BIGINT) AS i, o1.n, CAST({_l2} AS DOUBLE) AS l, CAST({_trend.format(n=_l2, l="o1.v", b="o2.v - o1.v")} AS DOUBLE) AS b FROM o o1 JOIN o o2 ON o1.user_id = o2.user_id AND o1.a = o2.a AND o1.i = 1 AND o2.i = 2
 UNION ALL SELECT r.user_id, r.a, r.i + 1, r.n, {_ln}, {_trend.format(n=_ln, l="r.l", b="r.b")} FROM r JOIN o ON o.user_id = r.user_id AND o.a = r.a AND o.i = r.i + 1)
SELECT user_id, make_timestamp(a) AS ts, round(l, 7) + 0.0 AS value FROM r WHERE i = n""",
)

_M4 = ("t_min", "v_min", "t_max", "v_max", "t_first", "v_first", "t_last", "v_last")
register(
    "ts_m4_over_time",
    lambda spark, sf_dir: folds.over_time(events(spark, sf_dir), "m4_over_time", GRID, WINDOW, ROLES).select("user_id", "ts", *[F.col(f"value.{c}").alias(c) for c in _M4]),
    f"WITH {SAMPLES}, {POINTS}, {INSIDE} SELECT user_id, make_timestamp(a) AS ts, arg_min(t, (v, t)) AS t_min, min(v) AS v_min, arg_max(t, (v, -t)) AS t_max, max(v) AS v_max, min(t) AS t_first, arg_min(v, t) AS v_first, max(t) AS t_last, arg_max(v, t) AS v_last FROM w GROUP BY user_id, a",
)
register(
    "ts_moments_over_time",
    lambda spark, sf_dir: folds.over_time(events(spark, sf_dir), "moments_over_time", GRID, WINDOW, ROLES).select("user_id", "ts", F.round("value.skewness", 4).alias("skewness"), F.round("value.kurtosis", 4).alias("kurtosis")).where("NOT isnan(skewness) AND skewness IS NOT NULL").selectExpr("user_id", "ts", "skewness + 0.0 AS skewness", "kurtosis + 0.0 AS kurtosis"),
    f"""WITH {SAMPLES}, {POINTS}, {INSIDE}, m AS (SELECT user_id, a, avg(v) AS mu FROM w GROUP BY ALL),
c AS (SELECT w.user_id, w.a, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM w JOIN m ON w.user_id = m.user_id AND w.a = m.a GROUP BY ALL)
SELECT user_id, make_timestamp(a) AS ts, round(m3 / m2 ** 1.5, 4) + 0.0 AS skewness, round(m4 / (m2 * m2) - 3, 4) + 0.0 AS kurtosis FROM c WHERE m2 > 0""",
)
register(
    "ts_last_two_samples",
    lambda spark, sf_dir: folds.over_time(events(spark, sf_dir), "last_two_samples", GRID, WINDOW, ROLES).select("user_id", "ts", F.posexplode("value").alias("i", "x")).select("user_id", "ts", "i", F.col("x.t").alias("t"), F.col("x.v").alias("v")),
    f"WITH {SAMPLES}, {POINTS}, {INSIDE}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, a ORDER BY t DESC) - 1 AS i FROM w) SELECT user_id, make_timestamp(a) AS ts, CAST(i AS INTEGER) AS i, t, v FROM o WHERE i < 2",
)


def _states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("value"))
    out = folds.over_time(e, "state_duration_over_time", GRID, WINDOW, ROLES, "ANCHOR", LOOKBACK)
    return out.select("user_id", "ts", F.explode("value").alias("state", "ticks"))


_STATE = "s AS (SELECT user_id, epoch_us(ts) AS t, event_type AS v FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL)"
register(
    "ts_state_duration_over_time",
    _states,
    f"WITH {_STATE}, {POINTS}, {INSIDE}, {EDGES} SELECT user_id, make_timestamp(a) AS ts, v AS state, CAST(sum({HELD}) AS BIGINT) AS ticks FROM wa WHERE {HELD} > 0 GROUP BY user_id, a, v",
)
register(
    "ts_approx_distinct_over_time",
    lambda spark, sf_dir: folds.over_time(events(spark, sf_dir), "approx_distinct_over_time", GRID, WINDOW, ROLES).join(folds.over_time(events(spark, sf_dir), "distinct_over_time", GRID, WINDOW, ROLES).withColumnRenamed("value", "exact"), ["user_id", "ts"]).select("user_id", "ts", (F.abs(F.col("value") - F.col("exact")) <= 0.1 * F.col("exact") + 1).alias("near")),
    f"WITH {SAMPLES}, {POINTS}, {INSIDE} SELECT user_id, make_timestamp(a) AS ts, TRUE AS near FROM w GROUP BY user_id, a",
)


def _top(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("value"))
    out = folds.over_time(e, "approx_top_k_over_time", GRID, WINDOW, ROLES, k=10)
    return out.select("user_id", "ts", F.explode("value").alias("x")).select("user_id", "ts", "x.key", "x.count_lo", "x.count_hi")


register(
    "ts_approx_top_k_over_time",
    _top,
    f"WITH {_STATE}, {POINTS}, {INSIDE} SELECT user_id, make_timestamp(a) AS ts, v AS key, count(*) AS count_lo, count(*) AS count_hi FROM w GROUP BY user_id, a, v",
)

TYPE_ROLES = Roles("event_type", value="user")


def _top_bounds(spark, sf_dir):
    """Users of each type of event, of whom a window has more than the sketch of 64 holds: whether the exact count of each key
    that is returned lies within its bounds, restated over the raw samples."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", "ts", F.col("user_id").cast("string").alias("user"))
    found = folds.over_time(e, "approx_top_k_over_time", GRID, WINDOW, TYPE_ROLES, k=10, most=64).select("event_type", "ts", F.explode("value").alias("x"))
    points = grids.ts_grid(spark, GRID).withColumnRenamed("ts", "at")
    inside = (F.col("s.ts") <= F.col("at")) & (F.col("s.ts") > F.col("at") - F.expr(f"INTERVAL {WINDOW // DAY} DAYS"))
    # Of samples of one series and time the greatest value stays.
    raw = e.groupBy("event_type", "ts").agg(F.max("user").alias("user")).alias("s").join(F.broadcast(points), inside).groupBy("event_type", F.col("at").alias("ts"), "user").agg(F.count(F.lit(1)).alias("n"))
    both = found.select("event_type", "ts", F.col("x.key").alias("user"), "x.count_lo", "x.count_hi").join(raw, ["event_type", "ts", "user"], "left")
    return both.groupBy("event_type", "ts").agg((F.count(F.lit(1)) > 0).alias("some"), F.bool_and(F.coalesce((F.col("n") >= F.col("count_lo")) & (F.col("n") <= F.col("count_hi")), F.lit(False))).alias("bounded"))


register(
    "ts_approx_top_k_over_time_bounds",
    _top_bounds,
    f"WITH s AS (SELECT event_type, epoch_us(ts) AS t, max(CAST(user_id AS VARCHAR)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL), {POINTS}, w AS (SELECT event_type, g.pt_at AS a, s.v FROM s JOIN g ON s.t > g.pt_at - {WINDOW} AND s.t <= g.pt_at) SELECT event_type, make_timestamp(a) AS ts, TRUE AS some, TRUE AS bounded FROM w GROUP BY event_type, a",
)

_MEMBERS = [folds.Member.of("sum_over_time", "total"), folds.Member.of("max_over_time", "top"), folds.Member.of("count_over_time", "n")]


def _fold(spark, sf_dir):
    out = folds.fold(events(spark, sf_dir), GRID, WINDOW, _MEMBERS, ROLES)
    return out.select("user_id", "ts", F.round("value.total", 6).alias("total"), "value.top", "value.n")


register("ts_fold", _fold, f"WITH {SAMPLES}, {POINTS}, {INSIDE} SELECT user_id, make_timestamp(a) AS ts, round(sum(v), 6) AS total, max(v) AS top, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY user_id, a")


def _fold_changes(edge):
    """Rate, increase and delta from one pass with another fold, at each edge mode."""
    changes = [folds.Member.of(n) for n in ("rate", "increase", "delta")]

    def run(spark, sf_dir):
        out = folds.fold(events(spark, sf_dir), GRID, WINDOW, [*changes, folds.Member.of("max_over_time", "top")] if edge == "EXTRAPOLATE" else changes, ROLES, edge, LOOKBACK)
        said = [F.round(F.col("value.rate") * 1e6, 9) + 0.0, F.round("value.increase", 6) + 0.0, F.round("value.delta", 6) + 0.0]
        return out.select("user_id", "ts", *[c.alias(n) for c, n in zip(said, ("rate", "increase", "delta"))], *(["value.top"] if edge == "EXTRAPOLATE" else []))

    return run


def _fold_changes_sql(edge):
    top = ", top" if edge == "EXTRAPOLATE" else ""
    parts = ", ".join(f"{n} AS ({counter_sql(n, edge, digits=9 if n == 'rate' else 6)})" for n in ("rate", "increase", "delta"))
    return f"""WITH {SAMPLES}, {POINTS}, {INSIDE}, p AS (SELECT user_id, make_timestamp(a) AS ts, max(v) AS top FROM w GROUP BY user_id, a), {parts}
SELECT p.user_id, p.ts, rate.value AS rate, increase.value AS increase, delta.value AS delta{top} FROM p LEFT JOIN rate USING (user_id, ts) LEFT JOIN increase USING (user_id, ts) LEFT JOIN delta USING (user_id, ts)"""


for _edge in ("EXTRAPOLATE", "ANCHOR", "SMOOTH"):
    register(f"ts_fold_{_edge.lower()}", _fold_changes(_edge), _fold_changes_sql(_edge))


def _bounded(spark, sf_dir):
    """Calendar months as windows of each user."""
    e = events(spark, sf_dir)
    ends = spark.sql("SELECT timestamp_ntz'2024-01-01' AS window_start, timestamp_ntz'2024-01-15' AS window_end UNION ALL SELECT timestamp_ntz'2024-01-15', timestamp_ntz'2024-02-01'")
    spans = e.select("user_id").distinct().crossJoin(F.broadcast(ends))
    return windows.window_fold(e, spans, _MEMBERS, ROLES).withColumn("total", F.round("total", 6))


register(
    "ts_fold_bounded",
    _bounded,
    """WITH b AS (SELECT TIMESTAMP '2024-01-01' AS window_start, TIMESTAMP '2024-01-15' AS window_end UNION ALL SELECT TIMESTAMP '2024-01-15', TIMESTAMP '2024-02-01')
SELECT u.user_id, b.window_start, b.window_end, round(sum(value), 6) AS total, max(value) AS top, CASE WHEN count(value) > 0 THEN CAST(count(value) AS DOUBLE) END AS n
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN b LEFT JOIN events e ON e.user_id = u.user_id AND e.ts > b.window_start AND e.ts <= b.window_end GROUP BY ALL""",
)


def _anchored_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = e.where("event_type = 'purchase'").select("user_id", "ts")
    return windows.anchor_fold(events(spark, sf_dir), at, DAY, _MEMBERS, ROLES).select("user_id", F.col("window_end").alias("ts"), F.round("total", 6).alias("total"), "top", "n")


register(
    "ts_fold_anchored",
    _anchored_fold,
    "SELECT p.user_id, p.ts, round(sum(e.value), 6) AS total, max(e.value) AS top, CAST(count(e.value) AS DOUBLE) AS n FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase') p JOIN events e ON e.user_id = p.user_id AND e.ts > p.ts - INTERVAL 1 DAY AND e.ts <= p.ts GROUP BY ALL",
)


# --- carried values

_SIDES = f"""p AS (SELECT s.user_id, g.pt_at AS a, max(s.t) AS pt, arg_max(s.v, s.t) AS pv FROM s JOIN g ON s.t <= g.pt_at AND s.t >= g.pt_at - {DAY} GROUP BY ALL),
n AS (SELECT s.user_id, g.pt_at AS a, min(s.t) AS nt, arg_min(s.v, s.t) AS nv FROM s JOIN g ON s.t > g.pt_at AND s.t <= g.pt_at + {DAY} GROUP BY ALL),
x AS (SELECT coalesce(p.user_id, n.user_id) AS user_id, coalesce(p.a, n.a) AS a, pt, pv, nt, nv FROM p FULL JOIN n ON p.user_id = n.user_id AND p.a = n.a)"""


def _resample(mode):
    return lambda spark, sf_dir: rounded(resample.resample(events(spark, sf_dir), GRID, DAY, ROLES, mode), 6)


for _mode, _sql in (
    ("LOOKBACK", "pv"),
    ("NEXT", "nv"),
    ("NEAREST", "CASE WHEN pt IS NOT NULL AND (nt IS NULL OR a - pt <= nt - a) THEN pv ELSE nv END"),
    ("INTERPOLATE", f"CASE WHEN pt = a THEN pv WHEN nt - pt <= {DAY} THEN pv + (nv - pv) * (CAST(a - pt AS DOUBLE) / (nt - pt)) END"),
):
    register(f"ts_resample_{_mode.lower()}", _resample(_mode), f"WITH {SAMPLES}, {POINTS}, {_SIDES} SELECT user_id, make_timestamp(a) AS ts, round({_sql}, 6) + 0.0 AS value FROM x WHERE ({_sql}) IS NOT NULL")
register(
    "ts_resample_ts",
    lambda spark, sf_dir: resample.resample_ts(events(spark, sf_dir), GRID, DAY, ROLES),
    f"WITH {SAMPLES}, {POINTS}, {_SIDES} SELECT user_id, make_timestamp(a) AS ts, make_timestamp(pt) AS value FROM x WHERE pt IS NOT NULL",
)
register(
    "ts_stale_marker",
    lambda spark, sf_dir: rounded(resample.resample(table(spark, sf_dir, "events").select("user_id", "ts", "value", (F.col("event_type") == "signup").alias("stale")), GRID, DAY, ROLES), 6),
    f"""WITH s AS (SELECT user_id, epoch_us(ts) AS t, value AS v, event_type = 'signup' AS stale FROM events), {POINTS},
p AS (SELECT s.user_id, g.pt_at AS a, arg_max(s.v, s.t) AS pv, arg_max(s.stale, s.t) AS st FROM s JOIN g ON s.t <= g.pt_at AND s.t >= g.pt_at - {DAY} GROUP BY ALL)
SELECT user_id, make_timestamp(a) AS ts, round(pv, 6) + 0.0 AS value FROM p WHERE NOT st""",
)
