"""Registered queries for histogram, series and pattern operators, SQL names, sources, streams and compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import sql
from ..operators import compose, hist, pattern, series
from ..operators.rate import ts_rate
from ..sources import grid as grid_source
from ..sources import samples as sample_source
from . import series_sql
from .grid import Grid
from .queries_range import DAY, GRID, LOOKBACK, ROLES, WINDOW, ORACLE_SQL as RANGE_SQL, counter_sql, counters, events, rounded, table
from .roles import Roles

HOUR = 3_600_000_000
DAYS = Grid.of("2024-01-01", "2024-01-30", DAY)
#: Ends of days, and how many of them a sampled histogram looks back on.
ENDS, HELD_DAYS = Grid.of("2024-01-01", "2024-01-31", DAY), 6
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, run, sql_: str | None = None) -> None:
    QUERIES[name] = run
    if sql_ is not None:
        ORACLE_SQL[name] = sql_


# --- SQL names


def _sql_rate(spark, sf_dir):
    sql.register(spark)
    e = table(spark, sf_dir, "events")
    return rounded(
        spark.sql(
            "SELECT * FROM ts_rate(TABLE(SELECT user_id AS series_id, ts, value FROM {e}), timestamp'2024-01-03', timestamp'2024-01-31', 86400000000, 259200000000)", e=e
        ).select(F.col("series_id").alias("user_id"), F.posexplode("values").alias("i", "value")).where("value IS NOT NULL").select("user_id", F.timestamp_micros(F.lit(GRID.start) + F.col("i") * F.lit(GRID.step)).cast("timestamp_ntz").alias("ts"), "value"),
        9, by=1e6,
    )


def _sql_aggregate(spark, sf_dir):
    sql.register(spark)
    e = table(spark, sf_dir, "events")
    out = spark.sql(f"SELECT user_id, ts_rate_agg(unix_micros(CAST(ts AS timestamp)), value, {GRID.start}, {GRID.end}, {GRID.step}, {WINDOW}) AS vs FROM {{e}} GROUP BY user_id", e=e)
    out = out.select("user_id", F.posexplode("vs").alias("i", "value")).where("value IS NOT NULL")
    return rounded(out.select("user_id", F.timestamp_micros(F.lit(GRID.start) + F.col("i") * F.lit(GRID.step)).cast("timestamp_ntz").alias("ts"), "value"), 9, by=1e6)


def _sql_aggregate_starts(spark, sf_dir):
    """The aggregate of seven arguments: counters with the start of their day as start time."""
    sql.register(spark)
    c = counters(spark, sf_dir)
    micros = lambda name: f"unix_micros(CAST({name} AS timestamp))"
    out = spark.sql(f"SELECT user_id, ts_rate_agg_st({micros('ts')}, value, {micros('start_ts')}, {GRID.start}, {GRID.end}, {GRID.step}, {WINDOW}) AS vs FROM {{c}} GROUP BY user_id", c=c)
    out = out.select("user_id", F.posexplode("vs").alias("i", "value")).where("value IS NOT NULL")
    return rounded(out.select("user_id", F.timestamp_micros(F.lit(GRID.start) + F.col("i") * F.lit(GRID.step)).cast("timestamp_ntz").alias("ts"), "value"), 9, by=1e6)


def _sql_grid(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT ts, ts_grid_index(CAST(ts AS timestamp), timestamp'2024-01-05', 172800000000) AS idx FROM ts_grid(timestamp'2024-01-01', timestamp'2024-01-30', 86400000000)")


register("sql_ts_rate_table", _sql_rate, counter_sql())
register("sql_ts_rate_aggregate", _sql_aggregate, counter_sql())
register("sql_ts_rate_aggregate_starts", _sql_aggregate_starts, RANGE_SQL["ts_rate_start_ts"])
register("sql_ts_grid", _sql_grid, "SELECT ts, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-05')) / 172800000000.0) AS BIGINT) AS idx FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS ts)")
register("ts_rate_no_pushdown", lambda spark, sf_dir: rounded(ts_rate(events(spark, sf_dir), GRID, WINDOW, ROLES, per="second", push=False), 9), counter_sql())


def _source_grid(spark, sf_dir):
    grid_source.register(spark)
    return spark.read.format("ts_grid").options(start="2024-01-01", end="2024-01-02", step=str(HOUR)).load()


register("source_ts_grid", _source_grid, "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 1 HOUR)) AS ts")
register(
    "downsample",
    lambda spark, sf_dir: sample_source.downsample(events(spark, sf_dir), DAY, ROLES).withColumn("total", F.round("total", 6)),
    "SELECT user_id, date_trunc('day', ts) AS ts, count(value) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events WHERE value IS NOT NULL GROUP BY ALL",
)


# --- histograms


def _hists(spark, sf_dir, scale=2):
    return hist.from_values(events(spark, sf_dir), GRID, WINDOW, ROLES, scale)


def _hist_long(df: DataFrame) -> DataFrame:
    h = F.col("value")
    both = F.transform(h["pos_counts"], lambda c, i: F.struct((h["pos_offset"] + i).alias("b"), c.alias("c")))
    return df.select("user_id", "ts", F.explode(both).alias("x")).select("user_id", "ts", F.col("x.b").alias("b"), F.col("x.c").alias("c")).where("c > 0")


_W = f"""s AS (SELECT user_id, epoch_us(ts) AS t, value AS v FROM events WHERE value IS NOT NULL), g AS (SELECT unnest(generate_series({GRID.start}, {GRID.end}, {GRID.step})) AS a),
w AS (SELECT s.user_id, g.a, s.t, s.v FROM s JOIN g ON s.t > g.a - {WINDOW} AND s.t <= g.a)"""
_BUCKET = "CAST(ceil(log2(v) * 4) AS INTEGER) - 1"
register("hist_from_values", lambda spark, sf_dir: _hist_long(_hists(spark, sf_dir)), f"WITH {_W} SELECT user_id, make_timestamp(a) AS ts, {_BUCKET} AS b, CAST(count(*) AS DOUBLE) AS c FROM w WHERE v > 0 GROUP BY ALL")
register(
    "hist_downscale",
    lambda spark, sf_dir: _hist_long(_hists(spark, sf_dir).withColumn("value", hist.hist("downscale", "value", scale=0))),
    f"WITH {_W} SELECT user_id, make_timestamp(a) AS ts, CAST(floor(({_BUCKET}) / 4.0) AS INTEGER) AS b, CAST(count(*) AS DOUBLE) AS c FROM w WHERE v > 0 GROUP BY ALL",
)
register("hist_compact", lambda spark, sf_dir: _hist_long(_hists(spark, sf_dir).withColumn("value", hist.hist("compact", "value"))), ORACLE_SQL["hist_from_values"])
register(
    "hist_merge",
    lambda spark, sf_dir: hist.merge(_hists(spark, sf_dir).withColumnRenamed("value", "h"), ["ts"]).select("ts", F.explode(F.transform("value.pos_counts", lambda c, i: F.struct((F.col("value.pos_offset") + i).alias("b"), c.alias("c")))).alias("x")).select("ts", "x.b", "x.c").where("c > 0"),
    f"WITH {_W} SELECT make_timestamp(a) AS ts, {_BUCKET} AS b, CAST(count(*) AS DOUBLE) AS c FROM w WHERE v > 0 GROUP BY ALL",
)
for _name in ("count", "sum", "avg"):
    register(
        f"hist_{_name}",
        lambda spark, sf_dir, n=_name: rounded(_hists(spark, sf_dir).withColumn("value", hist.hist(n, "value")), 6),
        f"WITH {_W} SELECT user_id, make_timestamp(a) AS ts, round(CAST({_name}({'v' if _name != 'count' else '*'}) AS DOUBLE), 6) AS value FROM w GROUP BY ALL",
    )
_MID = f"sqrt(pow(2.0, ({_BUCKET}) / 4.0) * pow(2.0, (({_BUCKET}) + 1) / 4.0))"
_VAR = f"WITH {_W}, m AS (SELECT user_id, a, avg(v) AS mu FROM w GROUP BY ALL) SELECT w.user_id, make_timestamp(w.a) AS ts, round({{f}}(avg(CASE WHEN v > 0 THEN ({_MID} - mu) ** 2 ELSE mu * mu END)), {{d}}) AS value FROM w JOIN m ON w.user_id = m.user_id AND w.a = m.a GROUP BY ALL"
register("hist_stdvar", lambda spark, sf_dir: rounded(_hists(spark, sf_dir).withColumn("value", hist.hist("stdvar", "value")), 4), _VAR.format(f="", d=4))
register("hist_stddev", lambda spark, sf_dir: rounded(_hists(spark, sf_dir).withColumn("value", hist.hist("stddev", "value")), 5), _VAR.format(f="sqrt", d=5))


register(
    "hist_quantile",
    lambda spark, sf_dir: rounded(_hists(spark, sf_dir, 5).withColumn("value", hist.hist("quantile", "value", phi=0.9)), 6),
    f"""WITH {_W}, b AS (SELECT user_id, a, CASE WHEN v > 0 THEN CAST(ceil(log2(v) * 32) AS INTEGER) END AS k, count(*) AS c FROM w GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id, a ORDER BY k NULLS FIRST) AS upto, sum(c) OVER (PARTITION BY user_id, a) AS n FROM b)
SELECT user_id, make_timestamp(a) AS ts, round(coalesce(arg_min(pow(2.0, (k - 1 + (0.9 * n - (upto - c)) / c) / 32), upto), 0), 6) + 0.0 AS value FROM r WHERE upto >= 0.9 * n GROUP BY ALL""",
)
register(
    "hist_fraction",
    lambda spark, sf_dir: rounded(_hists(spark, sf_dir).withColumn("value", hist.hist("fraction", "value", low=0.0, high=16.0)), 6),
    f"WITH {_W} SELECT user_id, make_timestamp(a) AS ts, round(avg(CASE WHEN v <= 16 THEN 1.0 ELSE 0.0 END), 6) AS value FROM w GROUP BY ALL",
)


def _classic(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    bounds = [1.0, 5.0, 10.0, 50.0, 100.0, float("inf")]
    rows = e.select("event_type", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), (F.col("value") <= b).cast("int").alias("hit")) for b in bounds])).alias("x"))
    rows = rows.groupBy("event_type", F.col("x.le").alias("le")).agg(F.sum("x.hit").alias("c"))
    return hist.from_classic(rows, ["event_type"], "le", "c")


register(
    "hist_from_classic",
    lambda spark, sf_dir: _classic(spark, sf_dir).select("event_type", F.posexplode("h.counts").alias("i", "c")),
    """WITH b AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i) SELECT event_type, CAST(i AS INTEGER) AS i, CAST(count(CASE WHEN CASE WHEN value <= 1 THEN 0 WHEN value <= 5 THEN 1 WHEN value <= 10 THEN 2 WHEN value <= 50 THEN 3 WHEN value <= 100 THEN 4 ELSE 5 END = i THEN 1 END) AS DOUBLE) AS c
FROM events CROSS JOIN b WHERE value IS NOT NULL GROUP BY ALL""",
)
register(
    "hist_quantile_classic",
    lambda spark, sf_dir: _classic(spark, sf_dir).select("event_type", F.round(hist.hist("quantile", "h", True, phi=0.5), 6).alias("value")),
    """WITH b AS (SELECT unnest([0.0, 1, 5, 10, 50]) AS lo, unnest([1.0, 5, 10, 50, 100]) AS hi), c AS (SELECT event_type, lo, hi, count(CASE WHEN value <= hi THEN 1 END) AS upto, count(CASE WHEN value > lo AND value <= hi OR (lo = 0 AND value <= hi) THEN 1 END) AS n, count(*) AS total FROM events CROSS JOIN b WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, round(arg_min(lo + (hi - lo) * ((0.5 * total - (upto - n)) / n), hi), 6) AS value FROM c WHERE upto >= 0.5 * total GROUP BY event_type""",
)


def _hist_samples(spark, sf_dir):
    """Histograms of each user's last days, sampled at each day's end: counts of buckets that now and then fall."""
    days = hist.from_values(events(spark, sf_dir), ENDS, HELD_DAYS * DAY, ROLES, 0)
    # Sums of doubles depend on their order, which a change is not to be seen in.
    return days.select("user_id", "ts", F.col("value").withField("sum", F.round("value.sum", 6)).alias("h"))


HIST_ROLES = Roles("user_id", "ts", "h")
_RUN = f"""d AS (SELECT unnest(generate_series({ENDS.start}, {ENDS.end}, {DAY})) AS t), s AS (SELECT user_id, epoch_us(ts) AS et, value AS v FROM events WHERE value IS NOT NULL),
h AS (SELECT s.user_id, d.t, CAST(count(*) AS DOUBLE) AS n, sum(v) AS total FROM s JOIN d ON s.et <= d.t AND s.et > d.t - {HELD_DAYS * DAY} GROUP BY ALL),
g AS (SELECT unnest(generate_series({GRID.start}, {GRID.end}, {GRID.step})) AS a), w AS (SELECT h.*, g.a FROM h JOIN g ON h.t > g.a - {WINDOW} AND h.t <= g.a)"""
for _name, _expr in (("first", "arg_min(n, t)"), ("last", "arg_max(n, t)"), ("sum", "sum(n)"), ("avg", "avg(n)")):
    register(
        f"hist_{_name}_over_time",
        lambda spark, sf_dir, n=_name: rounded(hist.hist_over_time(_hist_samples(spark, sf_dir), n, GRID, WINDOW, HIST_ROLES).withColumn("value", F.col("value.count")), 6),
        f"WITH {_RUN} SELECT user_id, make_timestamp(a) AS ts, round({_expr}, 6) + 0.0 AS value FROM w GROUP BY ALL",
    )
for _name, _expr in (("count", "CAST(count(*) AS DOUBLE)"), ("present", "1.0")):
    register(
        f"hist_{_name}_over_time",
        lambda spark, sf_dir, n=_name: hist.hist_over_time(_hist_samples(spark, sf_dir), n, GRID, WINDOW, HIST_ROLES),
        f"WITH {_RUN} SELECT user_id, make_timestamp(a) AS ts, CAST({_expr} AS DOUBLE) AS value FROM w GROUP BY ALL",
    )
register("hist_changes", lambda spark, sf_dir: hist.hist_over_time(_hist_samples(spark, sf_dir), "changes", GRID, WINDOW, HIST_ROLES))
register("hist_resets", lambda spark, sf_dir: hist.hist_over_time(_hist_samples(spark, sf_dir), "resets", GRID, WINDOW, HIST_ROLES))
for _name in ("rate", "increase", "delta"):
    register(f"hist_{_name}", lambda spark, sf_dir, n=_name: rounded(hist.hist_over_time(_hist_samples(spark, sf_dir), n, GRID, WINDOW, HIST_ROLES, "second").withColumn("value", F.col("value.count")), 6))


for _edge in ("ANCHOR", "SMOOTH"):
    for _name in ("rate", "increase", "delta"):
        register(
            f"hist_{_name}_{_edge.lower()}",
            lambda spark, sf_dir, n=_name, e=_edge: rounded(hist.hist_over_time(_hist_samples(spark, sf_dir), n, GRID, WINDOW, HIST_ROLES, "second", e, LOOKBACK).withColumn("value", F.col("value.count")), 6),
        )
for _name in ("resets", "changes"):
    register(f"hist_{_name}_anchor", lambda spark, sf_dir, n=_name: hist.hist_over_time(_hist_samples(spark, sf_dir), n, GRID, WINDOW, HIST_ROLES, edge="ANCHOR", lookback=LOOKBACK))


def _hist_reset_flags(spark, sf_dir):
    h = _hist_samples(spark, sf_dir)
    by = Window.partitionBy("user_id").orderBy("ts")
    pairs = h.withColumn("before", F.lag("h").over(by)).where("before IS NOT NULL")
    return pairs.select("user_id", "ts", hist.detect_reset("before", "h").alias("reset"))


register("hist_detect_reset", _hist_reset_flags)
ORACLE_SQL.update(series_sql.hist_sql((ENDS.start, ENDS.end), DAY, HELD_DAYS * DAY, (GRID.start, GRID.end, GRID.step), WINDOW, LOOKBACK))


def _hist_resample(spark, sf_dir):
    from ..operators.resample import resample

    return resample(_hist_samples(spark, sf_dir), GRID, DAY, HIST_ROLES).withColumn("value", F.col("value.count"))


register("hist_resample", _hist_resample, f"WITH {_RUN} SELECT user_id, make_timestamp(t) AS ts, n AS value FROM h WHERE t BETWEEN {GRID.start} AND {GRID.end} UNION ALL SELECT p.user_id, make_timestamp(p.t + {DAY}), p.n FROM h p LEFT JOIN h q ON q.user_id = p.user_id AND q.t = p.t + {DAY} WHERE q.t IS NULL AND p.t + {DAY} BETWEEN {GRID.start} AND {GRID.end}")


# --- series: daily sums of each user as one value


def daily(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("ts"), "value", F.col("ts").alias("at"))
    return series.make_series(e, DAYS, ["user_id"], order="at")


_DAILY = f"""c AS (SELECT u.user_id, i, v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(generate_series(0, {DAYS.count - 1})) AS i) g
 LEFT JOIN (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS i, sum(value) AS v FROM events GROUP BY ALL) s USING (user_id, i))"""


def cells(df: DataFrame, column, digits: int = 6) -> DataFrame:
    return df.select("user_id", F.posexplode(column).alias("i", "value")).withColumn("value", F.round("value", digits) + F.lit(0.0))


def _cells(name, field=None, digits=6, second=None, **params):
    def run(spark, sf_dir):
        df = daily(spark, sf_dir)
        out = series.series(name, "values", *([second] if second is not None else []), **params)
        df = df.withColumn("o", out)
        return cells(df, F.col("o") if field is None else F.col(f"o.{field}"), digits)

    return run


def _scalars(name, *fields, digits=6, second=None, **params):
    def run(spark, sf_dir):
        df = daily(spark, sf_dir).withColumn("o", series.series(name, "values", *([second] if second is not None else []), **params))
        picked = [F.round(f"o.{f}", digits).alias(f) for f in fields] if fields else [F.col("o").alias("value")]
        return df.select("user_id", *picked)

    return run


register("make_series", lambda spark, sf_dir: cells(daily(spark, sf_dir), "values"), f"WITH {_DAILY} SELECT user_id, CAST(i AS INTEGER) AS i, round(v, 6) + 0.0 AS value FROM c")
register("series_unnest", lambda spark, sf_dir: rounded(series.unnest(daily(spark, sf_dir), DAYS, ["user_id"]), 6), f"WITH {_DAILY} SELECT user_id, TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS ts, round(v, 6) + 0.0 AS value FROM c")
_FILL = f"WITH {_DAILY} SELECT user_id, CAST(i AS INTEGER) AS i, round({{e}}, 6) + 0.0 AS value FROM c"
register("series_fill_forward", _cells("fill_forward"), _FILL.format(e="last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
register("series_fill_backward", _cells("fill_backward"), _FILL.format(e="first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
register("series_fill_const", _cells("fill_const", value=-1.0), _FILL.format(e="coalesce(v, -1)"))
register(
    "series_fill_linear",
    _cells("fill_linear"),
    f"""WITH {_DAILY}, k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS pi, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i DESC) AS ni FROM c)
SELECT k.user_id, CAST(k.i AS INTEGER) AS i, round(CASE WHEN k.v IS NOT NULL THEN k.v ELSE p.v + (n.v - p.v) * (CAST(k.i - k.pi AS DOUBLE) / (k.ni - k.pi)) END, 6) + 0.0 AS value FROM k LEFT JOIN c p ON p.user_id = k.user_id AND p.i = k.pi LEFT JOIN c n ON n.user_id = k.user_id AND n.i = k.ni""",
)
register(
    "series_znorm",
    _cells("znorm"),
    f"WITH {_DAILY} SELECT user_id, CAST(i AS INTEGER) AS i, round((v - avg(v) OVER p) / stddev_pop(v) OVER p, 6) + 0.0 AS value FROM c WINDOW p AS (PARTITION BY user_id)",
)
_EMA = f"""WITH RECURSIVE {_DAILY}, k AS (SELECT user_id, i, v, row_number() OVER (PARTITION BY user_id ORDER BY i) AS r FROM c WHERE v IS NOT NULL),
e AS (SELECT user_id, i, r, v AS s FROM k WHERE r = 1 UNION ALL SELECT k.user_id, k.i, k.r, {{a}} * k.v + (1 - {{a}}) * e.s FROM e JOIN k ON k.user_id = e.user_id AND k.r = e.r + 1)
SELECT c.user_id, CAST(c.i AS INTEGER) AS i, round(e.s, 6) + 0.0 AS value FROM c LEFT JOIN e ON e.user_id = c.user_id AND e.i = c.i"""
register("series_exp_smooth", _cells("exp_smooth", alpha=0.3141), _EMA.format(a=0.3141))
register("series_ema", _cells("ema", alpha=0.2718), _EMA.format(a=0.2718))
register("series_ema_triple", _cells("ema", span=5.0, order=3))
register("series_iir", _cells("iir", num=[0.3141], den=[1.0, -0.6859]))
register("series_fir", _cells("fir", weights=[1.0, 2.0, 1.0], center=True), f"""WITH {_DAILY}, n AS (SELECT user_id, i, v, lag(v) OVER p AS b, lead(v) OVER p AS f FROM c WINDOW p AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, CAST(i AS INTEGER) AS i, round((coalesce(b, 0) + 2 * coalesce(v, 0) + coalesce(f, 0)) / nullif((CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN v IS NULL THEN 0 ELSE 2 END + CASE WHEN f IS NULL THEN 0 ELSE 1 END), 0), 6) + 0.0 AS value FROM n""")
register("series_paa", _cells("paa", segments=6), f"WITH {_DAILY} SELECT user_id, CAST(i // 5 AS INTEGER) AS i, round(avg(v), 6) + 0.0 AS value FROM c GROUP BY ALL")
for _name, _field, _params in (
    ("fill_spline", None, {}), ("time_decayed", None, {"half_life": 3.0}), ("fft", "re", {}), ("acf", None, {"max_lag": 10}), ("decompose_additive", "seasonal", {"period": 7}),
    ("decompose_stl", "trend", {"period": 7}), ("seasonal", None, {"period": 7}), ("decompose_forecast", None, {"period": 7, "points": 5}),
    ("holt_winters", "forecast", {"alpha": 0.3, "beta": 0.1, "gamma": 0.2, "period": 7, "horizon": 5}), ("fit_poly", "fit", {"degree": 2}), ("fit_robust", "fit", {}),
    ("outliers_tukey", None, {}), ("decompose_anomalies", "score", {"period": 7}), ("asap", "values", {}), ("matrix_profile", "profile", {"m": 5}),
):
    register(f"series_{_name}", _cells(_name, _field, 5, **_params))
for _name in ("lttb", "changepoints"):
    register(f"series_{_name}", lambda spark, sf_dir, n=_name: daily(spark, sf_dir).select("user_id", F.posexplode(series.series(n, "values", **({"points": 8} if n == "lttb" else {}))).alias("i", "at")))
register("series_periods_detect", lambda spark, sf_dir: daily(spark, sf_dir).withColumn("o", series.series("periods_detect", "values")).select("user_id", F.posexplode("o.periods").alias("i", "period")))
register("series_periods_validate", _cells("periods_validate", periods=[7, 14]))
register("series_ifft", lambda spark, sf_dir: cells(daily(spark, sf_dir).withColumn("f", series.series("fft", series.series("fill_const", "values"))).withColumn("o", series.series("ifft", "f.re", "f.im")), "o.re", 4), _FILL.format(e="round(coalesce(v, 0), 4)"))
register("series_ccf", lambda spark, sf_dir: daily(spark, sf_dir).withColumn("o", series.series("ccf", "values", F.reverse("values"), max_lag=5)).select("user_id", F.posexplode("o.values").alias("i", "value")).withColumn("value", F.round("value", 6) + 0.0))
register("series_dtw", lambda spark, sf_dir: daily(spark, sf_dir).select("user_id", F.round(series.series("dtw", "values", F.reverse("values"), band=5), 5).alias("value")))
register("series_ks_test", lambda spark, sf_dir: daily(spark, sf_dir).withColumn("o", series.series("ks_test", F.slice("values", 1, 15), F.slice("values", 16, 15))).select("user_id", F.round("o.statistic", 6).alias("statistic"), F.round("o.p_value", 5).alias("p_value")))
register("series_sax", _scalars("sax", word=6, alphabet=4))
register("series_fit_2lines", _scalars("fit_2lines", "split", "r2", digits=5))
register(
    "series_dot",
    lambda spark, sf_dir: daily(spark, sf_dir).select("user_id", F.round(F.aggregate(F.zip_with("values", "values", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x), 4).alias("value")),
    f"WITH {_DAILY} SELECT user_id, round(sum(coalesce(v * v, 0)), 4) AS value FROM c GROUP BY ALL",
)
ORACLE_SQL.update(series_sql.series_sql(_DAILY, DAYS.count))


# --- patterns


def full(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def _match(spark, sf_dir):
    e = full(spark, sf_dir)
    kinds = {"A": "view", "B": "click", "C": "purchase"}
    return pattern.match_pattern(
        e, ["user_id"], "ts", "A B+? C", {k: F.col("event_type") == v for k, v in kinds.items()}, 3 * DAY,
        {"first_id": ("FIRST", "A", "event_id"), "last_id": ("LAST", "C", "event_id"), "clicks": ("COUNT", "B", None)}, order=["event_id"],
    ).select("user_id", "match_number", "first_id", "last_id", "clicks")


_CODES = "o AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'C' ELSE 'x' END AS k FROM events), q AS (SELECT user_id, string_agg(k, '' ORDER BY ts, event_id) AS s FROM o GROUP BY user_id)"
register("match_pattern", _match, series_sql.pattern_sql(3 * DAY))
register(
    "sequence_match",
    lambda spark, sf_dir: pattern.sequence_match(full(spark, sf_dir), ["user_id"], "ts", "(?1)(?2)(?3)", [F.col("event_type") == k for k in ("view", "click", "purchase")], ["event_id"]),
    f"WITH {_CODES} SELECT user_id, regexp_matches(replace(s, 'x', ''), 'ABC') AS matched FROM q",
)
register(
    "sequence_count",
    lambda spark, sf_dir: pattern.sequence_count(full(spark, sf_dir), ["user_id"], "ts", "(?1).*(?3)", [F.col("event_type") == k for k in ("view", "click", "purchase")], ["event_id"]),
    f"WITH {_CODES} SELECT user_id, CAST(len(regexp_extract_all(replace(s, 'x', ''), 'A.*?C')) AS BIGINT) AS n FROM q",
)
register(
    "window_funnel",
    lambda spark, sf_dir: pattern.window_funnel(full(spark, sf_dir), ["user_id"], "ts", DAY, [F.col("event_type") == k for k in ("view", "click", "purchase")]),
    f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_type AS k FROM events), s1 AS (SELECT user_id, t FROM e WHERE k = 'view'),
s2 AS (SELECT DISTINCT s1.user_id, s1.t AS t0, min(e.t) AS t FROM s1 JOIN e ON e.user_id = s1.user_id AND e.k = 'click' AND e.t > s1.t AND e.t <= s1.t + {DAY} GROUP BY ALL),
s3 AS (SELECT DISTINCT s2.user_id FROM s2 JOIN e ON e.user_id = s2.user_id AND e.k = 'purchase' AND e.t > s2.t AND e.t <= s2.t0 + {DAY})
SELECT u.user_id, CAST(CASE WHEN u.user_id IN (SELECT user_id FROM s3) THEN 3 WHEN u.user_id IN (SELECT user_id FROM s2) THEN 2 WHEN u.user_id IN (SELECT user_id FROM s1) THEN 1 ELSE 0 END AS INTEGER) AS level FROM (SELECT DISTINCT user_id FROM events) u""",
)
register(
    "retention",
    lambda spark, sf_dir: pattern.retention(full(spark, sf_dir), ["user_id"], [F.col("ts") < "2024-01-08", (F.col("ts") >= "2024-01-08") & (F.col("event_type") == "purchase"), F.col("ts") >= "2024-01-22"]).select("user_id", F.col("flags")[0].alias("r0"), F.col("flags")[1].alias("r1"), F.col("flags")[2].alias("r2")),
    """WITH f AS (SELECT user_id, max(CASE WHEN ts < '2024-01-08' THEN 1 ELSE 0 END) AS a, max(CASE WHEN ts >= '2024-01-08' AND event_type = 'purchase' THEN 1 ELSE 0 END) AS b, max(CASE WHEN ts >= '2024-01-22' THEN 1 ELSE 0 END) AS c FROM events GROUP BY user_id)
SELECT user_id, CAST(a AS INTEGER) AS r0, CAST(a * b AS INTEGER) AS r1, CAST(a * c AS INTEGER) AS r2 FROM f""",
)


# --- compositions


def _asof(direction, tolerance=None, strict=False):
    def run(spark, sf_dir):
        e = full(spark, sf_dir)
        left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
        right = e.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("click_value"))
        return compose.asof_join(left, right, ["user_id"], "ts", ["click_value"], direction, tolerance, strict).select("event_id", "click_value")

    return run


_LR = "l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS click_value FROM events WHERE event_type = 'click' GROUP BY ALL)"
register("asof_backward", _asof("backward"), f"WITH {_LR} SELECT l.event_id, r.click_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
register("asof_forward", _asof("forward"), f"WITH {_LR} SELECT l.event_id, r.click_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts")
register("asof_strict", _asof("backward", None, True), f"WITH {_LR} SELECT l.event_id, r.click_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts")
register("asof_tolerance", _asof("backward", DAY), f"WITH {_LR} SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 1 DAY THEN r.click_value END AS click_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
register("asof_nearest", _asof("nearest"), f"WITH {_LR}, b AS (SELECT l.event_id, l.ts AS lt, r.ts AS rt, r.click_value AS v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts), f AS (SELECT l.event_id, r.ts AS rt, r.click_value AS v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts) SELECT b.event_id, CASE WHEN f.rt IS NULL THEN b.v WHEN b.rt IS NULL THEN f.v WHEN b.lt - b.rt <= f.rt - b.lt THEN b.v ELSE f.v END AS click_value FROM b JOIN f USING (event_id)")


def _intervals(spark, sf_dir):
    e = full(spark, sf_dir)
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("p"), F.col("ts").alias("a0"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("a1"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("c"), F.col("ts").alias("b0"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("b1"))
    return compose.interval_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 6 * HOUR).select("p", "c")


register("interval_join", _intervals, "SELECT a.event_id AS p, b.event_id AS c FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND a.ts <= b.ts + INTERVAL 2 HOUR AND b.ts <= a.ts + INTERVAL 6 HOUR")
register("time_bucket", lambda spark, sf_dir: full(spark, sf_dir).groupBy(compose.time_bucket("ts", 6 * HOUR).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")), "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
register("calendar_bucket", lambda spark, sf_dir: full(spark, sf_dir).groupBy(compose.calendar_bucket("ts", "DAY", "UTC").alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
register("last_point", lambda spark, sf_dir: compose.last_points(full(spark, sf_dir), ["user_id"], "ts", ["event_id", "value"]), "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
register("last_n_points", lambda spark, sf_dir: compose.last_n(full(spark, sf_dir), ["user_id", "event_type"], "ts", 3, ["event_id"]).select("event_id", "rn"), "SELECT event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
register("sessions", lambda spark, sf_dir: compose.sessions(full(spark, sf_dir), ["user_id"], "ts", 12 * HOUR).groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1")), "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_id FROM g) SELECT user_id, session_id, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM s GROUP BY ALL")
register("session_window", lambda spark, sf_dir: compose.session_windows(full(spark, sf_dir), ["user_id"], "ts", 43_200, F.count(F.lit(1)).alias("n")), "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 43200000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")


def _gapfill(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("user_id", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("value"), 6).alias("value"))
    return compose.gapfill(d, DAYS, ["user_id"])


register("gapfill", _gapfill, f"WITH {_DAILY} SELECT user_id, TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS ts, round(v, 6) AS value FROM c")


def _rates(spark, sf_dir):
    return ts_rate(events(spark, sf_dir), GRID, WINDOW, ROLES, per="second")


register("topk_per_point", lambda spark, sf_dir: rounded(compose.topk_per_point(_rates(spark, sf_dir), 3, tie=["user_id"]), 9), f"SELECT user_id, ts, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY value DESC, user_id) AS rank FROM ({counter_sql()})) WHERE rank <= 3")
register("across_series", lambda spark, sf_dir: compose.across(rounded(_rates(spark, sf_dir), 9), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("top"), F.count("value").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 10).alias("middle"), F.round(compose.jain(), 5).alias("fairness")), f"SELECT ts, round(sum(value), 6) AS total, max(value) AS top, count(value) AS n, round(quantile_cont(value, 0.5), 10) AS middle, round(sum(value) ** 2 / (count(value) * sum(value * value)), 5) AS fairness FROM ({counter_sql()}) GROUP BY ts")
register("remove_resets", lambda spark, sf_dir: rounded(compose.remove_resets(full(spark, sf_dir).select("user_id", "ts", "event_id", "value"), ["user_id"], "ts").select("event_id", "total"), 6, "total"), "WITH d AS (SELECT event_id, user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) SELECT event_id, round(sum(CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS total FROM d")
register("concurrency", lambda spark, sf_dir: compose.concurrency(full(spark, sf_dir).select("ts", (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("te")), "ts", "te", DAY), "WITH x AS (SELECT epoch_us(ts) AS t, 1 AS d FROM events UNION ALL SELECT epoch_us(ts) + 7200000000, -1 FROM events), s AS (SELECT t, CAST(sum(d) AS BIGINT) AS d FROM x GROUP BY t), r AS (SELECT t, sum(d) OVER (ORDER BY t) AS run, d FROM s), b AS (SELECT t // 86400000000 AS b, max(run) AS top, arg_min(run - d, t) AS open FROM r GROUP BY ALL) SELECT make_timestamp(b * 86400000000) AS ts, CAST(greatest(top, open) AS BIGINT) AS peak FROM b")
register("union_length", lambda spark, sf_dir: compose.union_length(full(spark, sf_dir).select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("te")), ["user_id"], "ts", "te"), "WITH n AS (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nt FROM events) SELECT user_id, CAST(sum(least(28800000000, coalesce(nt - t, 28800000000))) AS BIGINT) AS ticks FROM n GROUP BY user_id")
register("moving_by_count", lambda spark, sf_dir: full(spark, sf_dir).select("event_id", F.round(F.avg("value").over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(-9, 0)), 5).alias("value")), "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 5) AS value FROM events")
register("running_sum", lambda spark, sf_dir: compose.running_sum(full(spark, sf_dir), ["user_id"], "ts").select("event_id", F.round("total", 6).alias("value")), "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM events")
register("cube_by_type", lambda spark, sf_dir: full(spark, sf_dir).withColumn("day", F.to_date("ts")).cube("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")), "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY CUBE (event_type, CAST(ts AS DATE))")
register("equal_width_histogram", lambda spark, sf_dir: full(spark, sf_dir).where("value IS NOT NULL").groupBy(F.width_bucket("value", F.lit(0.0), F.lit(100.0), F.lit(10)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
register("correlation", lambda spark, sf_dir: full(spark, sf_dir).groupBy("event_type").agg(F.round(F.corr(F.col("value"), F.hour("ts").cast("double")), 6).alias("value")), "SELECT event_type, round(corr(value, CAST(hour(ts) AS DOUBLE)), 6) AS value FROM events GROUP BY ALL")
register("absent_points", lambda spark, sf_dir: compose.gapfill(_rates(spark, sf_dir), GRID, ["user_id"]).where("value IS NULL").select("user_id", "ts"), f"WITH r AS ({counter_sql()}) SELECT u.user_id, make_timestamp(g.x) AS ts FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN (SELECT unnest(generate_series({GRID.start}, {GRID.end}, {GRID.step})) AS x) g ANTI JOIN r ON r.user_id = u.user_id AND r.ts = make_timestamp(g.x)")


def _subquery(spark, sf_dir):
    """The largest daily increase of each week: a fold over a fold's output."""
    from ..operators.folds import over_time

    inner = ts_rate(events(spark, sf_dir), GRID, WINDOW, ROLES, what="increase")
    return rounded(over_time(inner, "max_over_time", Grid.of("2024-01-03", "2024-01-31", 7 * DAY), 7 * DAY, ROLES), 6)


register("fold_of_fold", _subquery, f"WITH r AS ({counter_sql('increase', digits=6)}), g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-31', INTERVAL 7 DAY)) AS a) SELECT user_id, a AS ts, max(value) AS value FROM r JOIN g ON r.ts > a - INTERVAL 7 DAY AND r.ts <= a GROUP BY ALL")


# --- TPC-H-like tables, as any relation


def _revenue(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    month = F.date_trunc("MONTH", "l_shipdate").cast("timestamp_ntz")
    return j.groupBy("o_orderpriority", month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"))


register("join_and_bucket", _revenue, "SELECT o_orderpriority, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")


# --- states that are stored and merged


def _states(spark, sf_dir):
    """States of two halves of the samples, merged and finished."""
    from ..operators import states

    e = events(spark, sf_dir).withColumn("half", F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(2)))
    parts = [states.states(e.where(F.col("half") == h).drop("half"), GRID, ROLES) for h in (0, 1)]
    out = states.finished(states.merged(*parts, keys=ROLES.keys), GRID, WINDOW, ROLES.keys)
    return out.select("user_id", "ts", F.col("count_over_time").alias("n"), F.round("sum_over_time", 6).alias("total"), F.col("min_over_time").alias("low"), F.col("max_over_time").alias("high"), F.col("first_over_time").alias("first"), F.col("last_over_time").alias("last"))


register(
    "states_merged_and_finished",
    _states,
    f"WITH {_W} SELECT user_id, make_timestamp(a) AS ts, CAST(count(*) AS DOUBLE) AS n, round(sum(v), 6) AS total, min(v) AS low, max(v) AS high, arg_min(v, t) AS first, arg_max(v, t) AS last FROM w GROUP BY ALL",
)
