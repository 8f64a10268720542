"""Compositions of Spark's own operators that time-series queries need: joins in time, sessions, latest rows, gaps.

What runs along a whole key is cut into stretches of time, so that a hot key is spread over tasks. What a stretch needs of
those before it is a few numbers: they are summed over stretches, not rows, and stand before its rows as a row of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.grid import Grid, width
from .samples import tick_of


#: Ticks of a stretch: a day of microseconds. Choose it so that one key's rows of a stretch fit a task.
STRETCH = 86_400_000_000


def _cut(t: Column, size: int) -> Column:
    return F.call_function("div", t - F.pmod(t, F.lit(size)), F.lit(size))


def time_bucket(ts: str | Column, by, origin: int = 0) -> Column:
    """The start of the bucket of ``by`` ticks that a time falls in."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    t = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(t - F.pmod(t - origin, F.lit(width(by)))).cast("timestamp_ntz")


def calendar_bucket(ts: str, unit: str, zone: str = "UTC") -> Column:
    """The start, in UTC, of the calendar unit that a time falls in by the clocks of ``zone``."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    return F.to_utc_timestamp(F.date_trunc(unit, local), zone).cast("timestamp_ntz")


def last_points(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """The newest row of each key, by a sum that combines before the exchange."""
    newest = df.groupBy(*keys).agg(F.max(F.struct(ts, *columns)).alias("_r"))
    return newest.select(*keys, "_r.*")


def last_n(df: DataFrame, keys: Sequence[str], ts: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tie])
    return df.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], direction: str = "backward", tolerance=None, strict: bool = False, right_ts: str | None = None, stretch=STRETCH) -> DataFrame:
    """Each row of ``left`` with the columns of the nearest row of ``right`` in time: at or before, after, or either.

    Both sides are put in one order and values are carried along it, so no rows are joined. The order is cut into stretches
    of time: as long as the tolerance, rows of ``right`` going to the next stretch too (or to the one before); without one,
    of ``stretch`` ticks, each with the last row of those before it (or the first of those after it). Equal times on the
    right: the greatest of the columns. A row without a time matches nothing.
    """
    right_ts = right_ts or ts
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no direction {direction}")
    limit = None if tolerance is None else width(tolerance)
    r = right.where(F.col(right_ts).isNotNull()).groupBy(*keys, F.col(right_ts).alias("_rt")).agg(F.max(F.struct(*columns)).alias("_r"))
    r = r.withColumn("_t", tick_of(r, "_rt"))
    lt = tick_of(left, ts)
    cut = lambda t: _cut(t, limit or width(stretch))
    if limit:
        near = {"backward": [0, 1], "forward": [-1, 0], "nearest": [-1, 0, 1]}[direction]
        r = r.withColumn("_cut", F.explode(F.array(*[cut(F.col("_t")) + k for k in near])))
    else:
        r = r.withColumn("_cut", cut(F.col("_t")))
        held = F.struct("_t", "_rt", "_r")
        marks = r.groupBy(*keys, "_cut").agg(F.min(held).alias("_lo"), F.max(held).alias("_hi"))
        empty = [F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in ("_lo", "_hi")]
        marks = marks.unionByName(left.select(*keys, cut(lt).alias("_cut"), *empty)).where("_cut IS NOT NULL")
        marks = marks.groupBy(*keys, "_cut").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        along = Window.partitionBy(*keys).orderBy("_cut")
        last = F.last("_hi", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        next_ = F.first("_lo", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
        for carried in {"backward": [last], "forward": [next_], "nearest": [last, next_]}[direction]:
            more = marks.select(*keys, "_cut", carried.alias("_x")).where("_x IS NOT NULL")
            r = r.unionByName(more.select(*keys, "_cut", "_x._t", "_x._rt", "_x._r"))
    # At one time the right row comes first, unless only earlier ones (or, looking forward, later ones) count.
    first = {"backward": 1 if strict else -1, "forward": -1 if strict else 1}
    kinds = ["backward", "forward"] if direction == "nearest" else [direction]
    marked = left.withColumn("_l", F.struct(*left.columns)).select(*keys, lt.alias("_t"), cut(lt).alias("_cut"), "_l").withColumn("_side", F.lit(0))
    out = marked.withColumn("_rt", F.lit(None).cast(r.schema["_rt"].dataType)).withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))
    both = out.unionByName(r.withColumn("_l", F.lit(None).cast(marked.schema["_l"].dataType)).withColumn("_side", F.lit(1)).select(*out.columns))
    picked = []
    for kind in kinds:
        order = F.when(F.col("_side") == 1, F.lit(first[kind])).otherwise(F.lit(0))
        by = Window.partitionBy(*keys, "_cut").orderBy(F.col("_t").asc() if kind == "backward" else F.col("_t").desc(), order if kind == "backward" else -order)
        seen = F.last(F.when(F.col("_side") == 1, F.struct("_t", "_rt", "_r")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        both = both.withColumn(f"_{kind}", seen)
        gap = F.abs(F.col("_t") - F.col(f"_{kind}._t"))
        picked.append(F.when(F.lit(True) if limit is None else gap <= limit, F.col(f"_{kind}")))
    if direction == "nearest":
        a, b = picked
        hit = F.when(b.isNull(), a).when(a.isNull(), b).when(F.col("_t") - a["_t"] <= b["_t"] - F.col("_t"), a).otherwise(b)
    else:
        hit = picked[0]
    rows = both.withColumn("_hit", hit).where("_side = 0")
    return rows.select("_l.*", F.col("_hit._rt").alias("matched_ts"), *[F.col(f"_hit._r.{c}").alias(c) for c in columns])


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bounds: tuple[str, str], other: tuple[str, str], bucket, how: str = "inner") -> DataFrame:
    """Pairs of rows of equal keys whose closed intervals overlap.

    Intervals are cut into buckets of time, which makes the join an equality; a pair is kept in the bucket where its
    overlap begins, so it comes once. Choose ``bucket`` near the usual length of an interval.
    """
    if how != "inner":
        raise ValueError("interval_join is an inner join")
    size = width(bucket)
    cut = lambda t: F.call_function("div", t - F.pmod(t, F.lit(size)), F.lit(size))

    def spread(df: DataFrame, a: str, b: str, side: str) -> DataFrame:
        lo, hi = cut(tick_of(df, a)), cut(tick_of(df, b))
        return df.withColumn(f"_{side}lo", lo).where(F.col(a) <= F.col(b)).withColumn("_b", F.explode(F.sequence(lo, hi)))

    l, r = spread(left, *bounds, "l"), spread(right, *other, "r")  # noqa: E741
    joined = l.join(r, [*keys, "_b"]).where((F.col(bounds[0]) <= F.col(other[1])) & (F.col(other[0]) <= F.col(bounds[1])))
    return joined.where(F.col("_b") == F.greatest("_llo", "_rlo")).drop("_b", "_llo", "_rlo")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap, stretch=STRETCH, out: str = "session_id") -> DataFrame:
    """Rows with ``out``, the session, from 0 up in each key: a new one after more than ``gap`` ticks."""
    t, most = tick_of(df, ts), width(gap)
    rows = df.withColumn("_t", t).withColumn("_cut", _cut(F.col("_t"), width(stretch)))
    inside = Window.partitionBy(*keys, "_cut").orderBy("_t")
    gaps = rows.select(*keys, "_cut", "_t", F.when(F.col("_t") - F.lag("_t").over(inside) > most, 1).otherwise(0).alias("_new"))
    parts = gaps.groupBy(*keys, "_cut").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.sum("_new").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.max("_hi").over(along))
    parts = parts.withColumn("_n", F.col("_n") + F.when(F.col("_lo") - F.col("_before") > most, 1).otherwise(0))
    first = parts.select(*keys, "_cut", F.col("_before").alias("_t"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n"), F.lit(0).alias("_side"))
    both = rows.withColumn("_n", F.lit(None).cast("long")).withColumn("_side", F.lit(1)).unionByName(first, allowMissingColumns=True)
    by = Window.partitionBy(*keys, "_cut").orderBy("_side", "_t")
    new = F.coalesce("_n", F.when(F.col("_t") - F.lag("_t").over(by) > most, 1).otherwise(0))
    told = both.withColumn("_n", new).withColumn(out, F.sum("_n").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return told.where("_side = 1").drop("_t", "_cut", "_n", "_side")


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, value: str = "value", out: str = "total", stretch=STRETCH) -> DataFrame:
    """Rows with the sum of a key's values so far, in order of time; null before the first value."""
    rows = df.withColumn("_t", tick_of(df, ts)).withColumn("_cut", _cut(F.col("_t"), width(stretch))).withColumn("_v", F.col(value))
    parts = rows.groupBy(*keys, "_cut").agg(F.sum("_v").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select(*keys, "_cut", F.sum("_n").over(along).alias("_v"), F.lit(0).alias("_side"))
    both = rows.withColumn("_side", F.lit(1)).unionByName(first, allowMissingColumns=True)
    by = Window.partitionBy(*keys, "_cut").orderBy("_side", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(out, F.sum("_v").over(by)).where("_side = 1").drop("_t", "_cut", "_v", "_side")


def session_windows(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, *aggs: Column) -> DataFrame:
    """One row per session with its bounds, merged as rows arrive: partial sessions combine before the exchange."""
    w = F.session_window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    out = df.groupBy(*keys, w).agg(*aggs)
    return out.select(*keys, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), *[c for c in out.columns if c not in (*keys, "session_window")])


def gapfill(df: DataFrame, grid: Grid, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """A row for every key and grid point; points without a value have null. Each key carries its own points."""
    series = df.select(*keys).distinct()
    points = series.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.count - 1).cast("long"))).alias("gi"))
    points = points.select(*keys, F.timestamp_micros(F.lit(grid.start) + F.col("gi") * grid.step).cast("timestamp_ntz").alias(ts))
    return points.join(df.select(*keys, ts, value), [*keys, ts], "left")


def topk_per_point(df: DataFrame, k: int, value: str = "value", ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    by = Window.partitionBy(ts).orderBy(F.col(value).desc(), *tie)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def across(df: DataFrame, *aggs: Column, ts: str = "ts") -> DataFrame:
    """Aggregates across series at each grid point."""
    return df.groupBy(ts).agg(*aggs)


def jain(value: str = "value") -> Column:
    """Fairness: the square of the sum over n times the sum of squares."""
    return F.pow(F.sum(value), 2) / F.nullif(F.count(value) * F.sum(F.col(value) * F.col(value)), F.lit(0.0))


def remove_resets(df: DataFrame, keys: Sequence[str], ts: str, value: str = "value", stretch=STRETCH) -> DataFrame:
    """The counter as if it had never been reset. Of equal times the lesser value comes first."""

    def step(before: Column, now: Column) -> Column:
        return F.when(before.isNull() | (now < before), now).otherwise(now - before)

    rows = df.withColumn("_t", tick_of(df, ts)).withColumn("_cut", _cut(F.col("_t"), width(stretch))).withColumn("_v", F.col(value))
    inside = Window.partitionBy(*keys, "_cut").orderBy("_t", "_v")
    edges = rows.select(*keys, "_cut", "_v", F.row_number().over(inside).alias("_i"), F.lead(F.lit(1)).over(inside).alias("_more"), F.lag("_v").over(inside).alias("_b"))
    parts = edges.groupBy(*keys, "_cut").agg(
        F.sum(F.when(F.col("_i") > 1, step(F.col("_b"), F.col("_v")))).alias("_n"), F.max(F.when(F.col("_i") == 1, F.col("_v"))).alias("_first"), F.max(F.when(F.col("_more").isNull(), F.col("_v"))).alias("_last")
    )
    order = Window.partitionBy(*keys).orderBy("_cut")
    parts = parts.withColumn("_before", F.lag("_last").over(order))
    whole = F.coalesce("_n", F.lit(0.0)) + F.coalesce(step(F.col("_before"), F.col("_first")), F.lit(0.0))
    sums = F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = parts.select(*keys, "_cut", F.col("_before").alias("_v"), sums.alias("_d"), F.lit(0).alias("_side"))
    both = rows.withColumn("_d", F.lit(None).cast("double")).withColumn("_side", F.lit(1)).unionByName(first, allowMissingColumns=True)
    by = Window.partitionBy(*keys, "_cut").orderBy("_side", "_t", "_v")
    both = both.withColumn("_d", F.when(F.col("_side") == 0, F.col("_d")).otherwise(step(F.lag("_v").over(by), F.col("_v"))))
    out = both.withColumn("total", F.sum("_d").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.where("_side = 1").drop("_t", "_cut", "_v", "_d", "_side")


def concurrency(df: DataFrame, start: str, end: str, by, keys: Sequence[str] = ()) -> DataFrame:
    """The most intervals [start, end) open at once, by bucket of ``by`` ticks.

    Ends are counted as rows in each bucket, and what is open when a bucket begins is a running sum over buckets, not
    over rows, so no task sees all rows.
    """
    ends = df.select(*keys, F.explode(F.array(F.struct(tick_of(df, start).alias("t"), F.lit(1).alias("d")), F.struct(tick_of(df, end).alias("t"), F.lit(-1).alias("d")))).alias("x"))
    size = F.lit(width(by))
    steps = ends.select(*keys, F.col("x.t").alias("t"), F.col("x.d").alias("d")).groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    steps = steps.withColumn("b", F.call_function("div", F.col("t") - F.pmod(F.col("t"), size), size))
    inside = Window.partitionBy(*keys, "b").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.withColumn("run", F.sum("d").over(inside)).groupBy(*keys, "b").agg(F.greatest(F.max("run"), F.lit(0)).alias("top"), F.sum("d").alias("net"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.sum("net").over(upto), F.lit(0))
    return run.select(*keys, F.timestamp_micros(F.col("b") * size).cast("timestamp_ntz").alias("ts"), (open_ + F.col("top")).alias("peak"))


def union_length(df: DataFrame, keys: Sequence[str], start: str, end: str, stretch=STRETCH) -> DataFrame:
    """(keys, ticks): how long a key's intervals are together, overlaps once."""
    rows = df.select(*keys, tick_of(df, start).alias("lo"), tick_of(df, end).alias("hi")).withColumn("_cut", _cut(F.col("lo"), width(stretch)))
    parts = rows.groupBy(*keys, "_cut").agg(F.max("hi").alias("hi"))
    along = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select(*keys, F.lit(None).cast("long").alias("lo"), F.max("hi").over(along).alias("hi"), "_cut")
    both = rows.withColumn("_side", F.lit(1)).unionByName(first.withColumn("_side", F.lit(0)))
    by = Window.partitionBy(*keys, "_cut").orderBy("_side", "lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("seen", F.max("hi").over(by)).where("_side = 1")
    added = F.greatest(F.col("hi") - F.greatest("lo", F.coalesce("seen", F.col("lo"))), F.lit(0))
    return both.groupBy(*keys).agg(F.sum(added).alias("ticks"))
