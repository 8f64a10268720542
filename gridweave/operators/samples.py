"""From a DataFrame in roles to ordered, deduplicated samples dealt to windows.

One exchange serves everything above it. Samples are dealt by series and by chunk, a stretch of grid points; a
sample goes to each chunk whose windows can reach it. A long or hot series is thus spread over tasks by time, and within
a chunk neighbours are exact wherever a window can see them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..plans.grid import INT64, REACH, Grid, scan_bounds
from ..plans.roles import Roles
from ..plans.session import pushes

#: A chunk spans so many times the reach of a window, so at most a ninth of the samples are dealt twice.
CHUNK_REACHES = 8
#: The least points of a chunk, so that grids much coarser than their windows are not cut at every point.
CHUNK_POINTS = 8

INSIDE, BEFORE, AFTER = 0, 1, 2


def tick_of(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.LongType):
        return F.col(column)
    if isinstance(kind, T.TimestampNTZType) and df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "GMT"):
        raise ValueError("timestamps without a zone need spark.sql.session.timeZone=UTC")
    return F.unix_micros(F.col(column).cast("timestamp"))


def time_of(kind: T.DataType, tick: Column) -> Column:
    if isinstance(kind, T.LongType):
        return tick
    return F.timestamp_micros(tick).cast(kind)


def _literal(kind: T.DataType, tick: int) -> Column:
    return F.lit(tick) if isinstance(kind, T.LongType) else F.timestamp_micros(F.lit(tick)).cast(kind)


@dataclass(frozen=True)
class Samples:
    """Columns of ``df``: ``keys``, chunk, t, v, st, stale, and the neighbours' pt, pv, nt, nv (by time, in the chunk)."""

    df: DataFrame
    keys: tuple[str, ...]
    time: T.DataType
    grid: Grid
    window: int
    lookback: int
    edge: str
    per_chunk: int


def prepared(
    df: DataFrame,
    grid: Grid,
    window: int,
    roles: Roles = Roles(),
    edge: str = "INSIDE",
    lookback: int = 0,
    numeric: bool = True,
    extra: Sequence[str] = (),
    push: bool | None = None,
) -> Samples:
    """Rows with a null time or value go; of rows with equal times one stays (see ``ranked``)."""
    roles = roles.resolve(df, numeric)
    kind = df.schema[roles.ts].dataType
    low, high = scan_bounds(grid.start, grid.end, window, lookback, edge)
    low, high = max(low, INT64.start), min(high, INT64.stop - 1)
    if pushes(df.sparkSession) if push is None else push:
        # On the raw column and before anything else, so that it reaches the scan.
        df = df.where(F.col(roles.ts).between(_literal(kind, low), _literal(kind, high)))
    df = df.where(F.col(roles.ts).isNotNull() & F.col(roles.value).isNotNull())
    st = tick_of(df, roles.start_ts) if roles.start_ts else F.lit(None).cast("long")
    stale = F.coalesce(F.col(roles.stale), F.lit(False)) if roles.stale else F.lit(False)
    out = df.select(*roles.keys, tick_of(df, roles.ts).alias("t"), F.col(roles.value).alias("v"), st.alias("st"), stale.alias("stale"), *extra)
    out = out.where(F.col("t").between(low, high))
    before, after = REACH[edge]
    reach = window + (before + after) * lookback
    per_chunk = max(CHUNK_POINTS, -(-CHUNK_REACHES * reach // grid.step))
    if grid.count <= per_chunk:
        per_chunk = grid.count
        out = out.withColumn("chunk", F.lit(0))
    else:
        # Chunk c needs the ticks from its first point less the reach before to its last point plus the reach after.
        last = (grid.count - 1) // per_chunk
        span = per_chunk * grid.step
        t = F.col("t")
        first_c = F.greatest(F.lit(0), _ceil_div(t - F.lit(after * lookback) - F.lit(grid.at(per_chunk - 1)), span))
        last_c = F.least(F.lit(last), _ceil_div(t + F.lit(window + before * lookback) - F.lit(grid.start) + 1, span) - 1)
        out = out.withColumn("_lo", first_c.cast("int")).withColumn("_hi", last_c.cast("int")).where(F.col("_lo") <= F.col("_hi"))
        out = out.withColumn("chunk", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    out = ranked(out, (*roles.keys, "chunk"), numeric)
    by = Window.partitionBy(*roles.keys, "chunk").orderBy("t")
    near = {"pt": F.lag("t"), "pv": F.lag("v"), "pstale": F.lag("stale"), "nt": F.lead("t"), "nv": F.lead("v"), "nstale": F.lead("stale")}
    out = out.select("*", *[c.over(by).alias(n) for n, c in near.items()])
    return Samples(out, roles.keys, kind, grid, window, lookback, edge, per_chunk)


def _ceil_div(x: Column, by: int) -> Column:
    """Ceiling of x / by in whole numbers; nothing here passes through a double."""
    return -_floor_div(-x, by)


def _floor_div(x: Column, by: int) -> Column:
    d = F.lit(by).cast("long")
    return F.call_function("div", x - F.pmod(x, d), d)


def ranked(df: DataFrame, keys: Sequence[str], numeric: bool = True) -> DataFrame:
    """Of the rows of a key with one time, the last by: not stale, not NaN, value (-0 under +0), start (null least)."""
    order = [F.col("t"), F.col("stale").desc()]
    if numeric:
        order += [F.when(F.isnan("v"), 0).otherwise(1), F.col("v"), F.when(F.col("v") == 0, F.atan2("v", F.lit(-1.0)) > 0)]
    else:
        order += [F.col("v")]
    by = Window.partitionBy(*keys).orderBy(*order, F.col("st").asc_nulls_first())
    return df.withColumn("_next", F.lead("t").over(by)).where(F.col("_next").isNull() | (F.col("_next") != F.col("t"))).drop("_next")


def places(lo: Column, hi: Column, role: int) -> Column:
    """Grid indices lo..hi with a role in the two low bits; none where lo > hi, which sequence() would count down."""
    return F.when(lo <= hi, F.sequence(lo * 4 + role, hi * 4 + role, F.lit(4).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def placed(df: DataFrame, *spots: Column) -> DataFrame:
    """A row for each place, with gi and role."""
    out = df.select("*", F.explode(spots[0] if len(spots) == 1 else F.concat(*spots)).alias("_p"))
    return out.select(*df.columns, F.shiftright("_p", 2).alias("gi"), F.col("_p").bitwiseAND(F.lit(3).cast("long")).cast("int").alias("role"))


def fanned(s: Samples, roles: Sequence[int] = (INSIDE,)) -> DataFrame:
    """A row for each grid point that a sample bears on, with gi, at, ws and ``role``.

    INSIDE: the sample is in the point's window. BEFORE: it is the last at or before the window's open end. AFTER: the
    first after the point. Ranges of grid indices come from arithmetic, and empty ones are gone before any sequence.
    """
    g = s.grid
    t, last = F.col("t"), F.lit(g.count - 1)
    first_of = F.col("chunk").cast("long") * s.per_chunk
    last_of = F.least(last, first_of + (s.per_chunk - 1))
    ranges = []
    if INSIDE in roles:
        lo = _ceil_div(t - g.start, g.step)
        hi = _ceil_div(t + s.window - g.start, g.step) - 1
        ranges.append((INSIDE, lo, hi))
    if BEFORE in roles:
        lo = _ceil_div(t + s.window - g.start, g.step)
        hi = F.coalesce(_ceil_div(F.col("nt") + s.window - g.start, g.step) - 1, last)
        ranges.append((BEFORE, lo, hi))
    if AFTER in roles:
        lo = F.coalesce(_ceil_div(F.col("pt") - g.start, g.step), F.lit(0))
        hi = _ceil_div(t - g.start, g.step) - 1
        ranges.append((AFTER, lo, hi))
    # Bounds are columns of their own, so that they are computed once.
    df = s.df.withColumns({f"_{end}{role}": e for role, lo, hi in ranges for end, e in (("lo", F.greatest(lo, first_of)), ("hi", F.least(hi, last_of)))})
    out = placed(df, *[places(F.col(f"_lo{role}"), F.col(f"_hi{role}"), role) for role, _, _ in ranges])
    return out.withColumn("at", F.lit(g.start) + F.col("gi") * g.step).withColumn("ws", F.col("at") - s.window)
