"""Registered compositions: what time-series languages offer beside folds, written with Spark's own operators.

Each is a DataFrame expression and its SQL for DuckDB. They show that the fold operators' inputs and outputs are plain
relations: thresholds, shifts, labels, set operations and arithmetic come before or after a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..operators import compose, folds
from ..operators.rate import ts_rate
from .grid import Grid
from .queries_range import DAY, GRID, INSIDE, POINTS, ROLES, SAMPLES, WINDOW, counter_sql, events, rounded, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def by_user():
    return Window.partitionBy("user_id").orderBy("ts")


def register(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


def full(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", "props")


def over(*members, where: str = "TRUE", value, digits: int = 6):
    """Several folds at once and a value from them; ``where`` applies before and the value after."""

    def run(spark, sf_dir):
        e = events(spark, sf_dir).where(where)
        out = folds.fold(e, GRID, WINDOW, [folds.Member.of(m, m, **p) for m, p in members], ROLES)
        return rounded(out.select("user_id", "ts", value().alias("value")).where("value IS NOT NULL"), digits)

    return run


def windows_sql(value: str, where: str = "TRUE", digits: int = 6) -> str:
    samples = SAMPLES.replace("value IS NOT NULL)", f"value IS NOT NULL AND ({where}))")
    return f"WITH {samples}, {POINTS}, {INSIDE} SELECT user_id, make_timestamp(a) AS ts, round({value}, {digits}) + 0.0 AS value FROM w GROUP BY user_id, a HAVING ({value}) IS NOT NULL"


def member(name: str) -> Column:
    return F.col(f"value.{name}")


# --- folds and arithmetic

register("zscore_over_time", over(("last_over_time", {}), ("avg_over_time", {}), ("stddev_over_time", {}), value=lambda: F.when(member("stddev_over_time") > 1e-9, (member("last_over_time") - member("avg_over_time")) / member("stddev_over_time")), digits=5), windows_sql("CASE WHEN stddev_pop(v) > 1e-9 THEN (arg_max(v, t) - avg(v)) / stddev_pop(v) END", digits=5))
register("count_gt_over_time", over(("count_over_time", {}), where="value > 20", value=lambda: member("count_over_time")), windows_sql("CAST(count(*) AS DOUBLE)", "value > 20"))
register("sum_le_over_time", over(("sum_over_time", {}), where="value <= 20", value=lambda: member("sum_over_time")), windows_sql("sum(v)", "value <= 20"))
register("rate_of_counts", over(("count_over_time", {}), value=lambda: member("count_over_time") / (WINDOW / 1e6), digits=9), windows_sql(f"count(*) / {WINDOW / 1e6}", digits=9))
register("throughput", over(("sum_over_time", {}), value=lambda: member("sum_over_time") / (WINDOW / 1e6), digits=9), windows_sql(f"sum(v) / {WINDOW / 1e6}", digits=9))
register("hoeffding_upper", over(("avg_over_time", {}), ("range_over_time", {}), ("count_over_time", {}), value=lambda: member("avg_over_time") + member("range_over_time") * F.sqrt(F.log(F.lit(20.0)) / (2 * member("count_over_time"))), digits=5), windows_sql("avg(v) + (max(v) - min(v)) * sqrt(ln(20.0) / (2 * count(*)))", digits=5))
register("quantiles_over_time", over(("quantile_over_time", {"phi": 0.25}), value=lambda: member("quantile_over_time")), windows_sql("quantile_cont(v, 0.25)"))
register("time_to_zero", over(("last_over_time", {}), ("deriv", {}), value=lambda: F.when(member("deriv") < -1e-12, -member("last_over_time") / (member("deriv") * 1e6)), digits=1), windows_sql("CASE WHEN count(*) > 1 AND regr_slope(v, (t - a) / 1000000.0) < -1e-6 THEN -arg_max(v, t) / regr_slope(v, (t - a) / 1000000.0) END", digits=1))


def _share(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("value", (F.col("value") > 20).cast("double"))
    return rounded(folds.over_time(e, "avg_over_time", GRID, WINDOW, ROLES), 6)


register("share_gt_over_time", _share, windows_sql("avg(CASE WHEN v > 20 THEN 1.0 ELSE 0.0 END)"))


def _vwap(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("w", F.hour("ts") + F.lit(1.137))
    up = folds.over_time(e.select("user_id", "ts", (F.col("value") * F.col("w")).alias("value")), "sum_over_time", GRID, WINDOW, ROLES)
    down = folds.over_time(e.select("user_id", "ts", F.col("w").alias("value")), "sum_over_time", GRID, WINDOW, ROLES).withColumnRenamed("value", "w")
    return rounded(up.join(down, ["user_id", "ts"]).select("user_id", "ts", (F.col("value") / F.col("w")).alias("value")), 6)


register("weighted_average", _vwap, f"WITH s AS (SELECT user_id, epoch_us(ts) AS t, value AS v, hour(ts) + 1.137 AS q FROM events), {POINTS} SELECT user_id, make_timestamp(pt_at) AS ts, round(sum(v * q) / CAST(sum(q) AS DOUBLE), 6) + 0.0 AS value FROM s JOIN g ON s.t > g.pt_at - {WINDOW} AND s.t <= g.pt_at GROUP BY ALL")
register("threshold_on_output", lambda spark, sf_dir: rounded(ts_rate(events(spark, sf_dir), GRID, WINDOW, ROLES, per="second"), 9).where("value > 0.001"), f"SELECT * FROM ({counter_sql()}) WHERE value > 0.001")


def _offset(spark, sf_dir):
    """The rate a week before: the grid is shifted and its points are shifted back."""
    g = Grid.of("2024-01-10", "2024-01-29", DAY)
    old = ts_rate(events(spark, sf_dir), Grid(g.start - 7 * DAY, g.end - 7 * DAY, DAY), WINDOW, ROLES, per="second")
    return rounded(old.withColumn("ts", F.col("ts") + F.expr("INTERVAL 7 DAYS")), 9)


register("offset", _offset, f"SELECT user_id, ts + INTERVAL 7 DAY AS ts, value FROM ({counter_sql()}) WHERE ts <= TIMESTAMP '2024-01-22'")


def _ratio(spark, sf_dir):
    e = full(spark, sf_dir)
    count = lambda k: folds.over_time(e.where(F.col("event_type") == k).select("user_id", "ts", "value"), "count_over_time", GRID, WINDOW, ROLES)
    a, b = count("purchase"), count("view").withColumnRenamed("value", "b")
    return rounded(a.join(b, ["user_id", "ts"]).select("user_id", "ts", (F.col("value") / F.col("b")).alias("value")), 6)


register("ratio_of_series", _ratio, f"WITH s AS (SELECT user_id, epoch_us(ts) AS t, event_type AS k FROM events), {POINTS} SELECT user_id, make_timestamp(pt_at) AS ts, round(count(CASE WHEN k = 'purchase' THEN 1 END) / CAST(count(CASE WHEN k = 'view' THEN 1 END) AS DOUBLE), 6) + 0.0 AS value FROM s JOIN g ON s.t > g.pt_at - {WINDOW} AND s.t <= g.pt_at GROUP BY ALL HAVING count(CASE WHEN k = 'purchase' THEN 1 END) > 0 AND count(CASE WHEN k = 'view' THEN 1 END) > 0")


def _mad_outliers(spark, sf_dir):
    """Points that are further than three scaled deviations from the middle of all series at their time."""
    r = rounded(ts_rate(events(spark, sf_dir), GRID, WINDOW, ROLES, per="second"), 9)
    mid = r.groupBy("ts").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    away = r.join(mid, "ts").withColumn("d", F.abs(F.col("value") - F.col("m")))
    mad = away.groupBy("ts").agg(F.percentile("d", F.lit(0.5)).alias("mad"))
    return away.join(mad, "ts").where(F.col("d") > 3 * 1.4826 * F.col("mad")).select("user_id", "ts", "value")


register("group_outliers", _mad_outliers, f"WITH r AS ({counter_sql()}), m AS (SELECT ts, quantile_cont(value, 0.5) AS m FROM r GROUP BY ts), d AS (SELECT r.*, abs(value - m) AS d FROM r JOIN m USING (ts)), q AS (SELECT ts, quantile_cont(d, 0.5) AS mad FROM d GROUP BY ts) SELECT user_id, ts, value FROM d JOIN q USING (ts) WHERE d > 3 * 1.4826 * mad")
register("count_values", lambda spark, sf_dir: folds.over_time(events(spark, sf_dir), "count_over_time", GRID, WINDOW, ROLES).groupBy("ts", "value").agg(F.count(F.lit(1)).alias("n")), f"WITH r AS ({windows_sql('CAST(count(*) AS DOUBLE)')}) SELECT ts, value, count(*) AS n FROM r GROUP BY ALL")


def _whole_range(spark, sf_dir):
    r = rounded(ts_rate(events(spark, sf_dir), GRID, WINDOW, ROLES, per="second"), 9)
    whole = Window.partitionBy("user_id")
    return r.select("user_id", "ts", F.round(F.avg("value").over(whole), 8).alias("mean"), F.max("value").over(whole).alias("top"))


register("whole_range_statistics", _whole_range, f"SELECT user_id, ts, round(avg(value) OVER (PARTITION BY user_id), 8) AS mean, max(value) OVER (PARTITION BY user_id) AS top FROM ({counter_sql()})")

# --- steps along a series

register("derivative", lambda spark, sf_dir: rounded(full(spark, sf_dir).select("event_id", (F.col("value") - F.lag("value").over(by_user())).alias("value")), 6), "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) + 0.0 AS value FROM events")
register("lag_difference", lambda spark, sf_dir: rounded(full(spark, sf_dir).select("event_id", (F.col("value") - F.lag("value", 5).over(by_user())).alias("value")), 6), "SELECT event_id, round(value - lag(value, 5) OVER (PARTITION BY user_id ORDER BY ts), 6) + 0.0 AS value FROM events")
register("elapsed", lambda spark, sf_dir: full(spark, sf_dir).select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by_user()).cast("timestamp"))).alias("value")), "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS value FROM events")
register("changed", lambda spark, sf_dir: full(spark, sf_dir).select("event_id", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(by_user()))).cast("int").alias("value")), "SELECT event_id, CAST(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS value FROM events")
register("integral_by_interval", lambda spark, sf_dir: rounded(full(spark, sf_dir).select("event_id", F.sum("value").over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).alias("value")), 6), "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS value FROM events")


def _rsi(spark, sf_dir):
    """Relative strength over 14 steps."""
    d = F.col("value") - F.lag("value").over(by_user())
    frame = by_user().rowsBetween(-13, 0)
    e = full(spark, sf_dir).withColumn("up", F.greatest(d, F.lit(0.0))).withColumn("down", F.greatest(-d, F.lit(0.0)))
    up, down = F.avg("up").over(frame), F.avg("down").over(frame)
    return rounded(e.select("event_id", F.when(up + down > 0, 100 * up / (up + down)).alias("value")), 4)


register("relative_strength", _rsi, "WITH d AS (SELECT event_id, user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events), g AS (SELECT event_id, avg(greatest(d, 0)) OVER f AS up, avg(greatest(-d, 0)) OVER f AS down FROM (SELECT event_id, user_id, ts, CASE WHEN d IS NULL THEN 0 ELSE d END AS d FROM d) WINDOW f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) SELECT event_id, round(CASE WHEN up + down > 0 THEN 100 * up / (up + down) END, 4) + 0.0 AS value FROM g")


def _state_runs(spark, sf_dir):
    """Runs of one state: when each began and how many events it has."""
    new = F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(by_user())), 0).otherwise(1)
    runs = full(spark, sf_dir).withColumn("new", new).withColumn("run", F.sum("new").over(by_user().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("state"), F.min("ts").alias("began"), F.count(F.lit(1)).alias("n"))


register("state_runs", _state_runs, "WITH d AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM d) SELECT user_id, run, any_value(event_type) AS state, min(ts) AS began, count(*) AS n FROM r GROUP BY ALL")

# --- buckets, calendars, labels, set operations

register("hour_selection", lambda spark, sf_dir: full(spark, sf_dir).where(F.hour("ts").between(9, 17) & (F.dayofweek("ts").between(2, 6))).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events WHERE hour(ts) BETWEEN 9 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5 GROUP BY ALL")
register("month_bucket", lambda spark, sf_dir: table(spark, sf_dir, "orders").groupBy(compose.calendar_bucket("o_orderdate", "MONTH").alias("month")).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n FROM orders GROUP BY ALL")


def _levels(spark, sf_dir):
    """Every level of a stack of buckets, each from the one below: sums over 1, 2, 4 and 8 hours."""
    e = events(spark, sf_dir)
    level = e.groupBy(compose.time_bucket("ts", DAY // 24).alias("ts")).agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).withColumn("hours", F.lit(1))
    out = level
    for hours in (2, 4, 8):
        level = level.groupBy(compose.time_bucket("ts", hours * DAY // 24).alias("ts")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("hours", F.lit(hours))
        out = out.unionByName(level)
    return out


register("multi_resolution", _levels, "SELECT time_bucket(to_hours(h), ts) AS ts, count(value) AS n, min(value) AS low, max(value) AS high, CAST(h AS INTEGER) AS hours FROM events CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS h) GROUP BY ALL")
register("label_rewrite", lambda spark, sf_dir: full(spark, sf_dir).select(F.regexp_replace("event_type", "^(.)(.*)$", "$1-$2").alias("label"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("joined")).groupBy("label").agg(F.countDistinct("joined").alias("series")), "SELECT regexp_replace(event_type, '^(.)(.*)$', '\\1-\\2') AS label, count(DISTINCT event_type || '/' || user_id) AS series FROM events GROUP BY ALL")
register("metadata_join", lambda spark, sf_dir: full(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")), "SELECT c_mktsegment, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL")
register("users_without_purchase", lambda spark, sf_dir: full(spark, sf_dir).select("user_id").distinct().join(full(spark, sf_dir).where("event_type = 'purchase' AND ts >= '2024-01-27'").select("user_id").distinct(), "user_id", "left_anti"), "SELECT DISTINCT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= '2024-01-27'")
register("set_operations", lambda spark, sf_dir: full(spark, sf_dir).where("event_type = 'click'").select("user_id", F.to_date("ts").alias("day")).intersect(full(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))), "SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' INTERSECT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase'")
register("rollup_totals", lambda spark, sf_dir: full(spark, sf_dir).rollup("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ROLLUP (event_type, hour(ts))")
register("approx_percentile_near", lambda spark, sf_dir: full(spark, sf_dir).groupBy("event_type").agg(F.abs(F.percentile_approx("value", F.lit(0.5), F.lit(10000)) - F.percentile("value", F.lit(0.5))).alias("d")).select("event_type", (F.col("d") < 1).alias("near")), "SELECT event_type, TRUE AS near FROM events GROUP BY event_type")
register("selection_against_baseline", lambda spark, sf_dir: full(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg(F.when(F.hour("ts") < 12, F.col("value"))) - F.avg("value"), 6).alias("lift")), "SELECT event_type, round(avg(CASE WHEN hour(ts) < 12 THEN value END) - avg(value), 6) AS lift FROM events GROUP BY ALL")
register("stationary_users", lambda spark, sf_dir: folds.over_time(events(spark, sf_dir), "avg_over_time", GRID, WINDOW, ROLES).where("value < 5").select("user_id", "ts"), f"SELECT user_id, ts FROM ({windows_sql('avg(v)', digits=12)}) WHERE value < 5")


def _filled_share(spark, sf_dir):
    """Days with a value, where at least half of its hours have one."""
    e = events(spark, sf_dir).groupBy("user_id", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("ts")).agg(F.countDistinct(F.hour("ts")).alias("hours"), F.round(F.avg("value"), 6).alias("value"))
    return e.select("user_id", "ts", F.when(F.col("hours") >= 4, F.col("value")).alias("value"))


register("fill_factor", _filled_share, "SELECT user_id, date_trunc('day', ts) AS ts, CASE WHEN count(DISTINCT hour(ts)) >= 4 THEN round(avg(value), 6) END AS value FROM events GROUP BY ALL")
