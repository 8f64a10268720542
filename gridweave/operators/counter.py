"""Counter and gauge deltas over windows: rate, increase, delta and their edge modes.

A window's result needs its first and last sample and the pairs in it that are resets, nothing else. So a sample is
not fanned out to every window that holds it: each window gets one row from its first sample, one from its last, and
one from each reset. A series without resets thus costs two rows a grid point, however wide the window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.grid import Grid, checked_width
from ..plans.roles import Roles
from .samples import Samples, _ceil_div, fanned, placed, places, prepared

FIRST, LAST, RESET = 0, 1, 2
#: A gap at an edge is extrapolated over in full up to so many average intervals.
GAP_FACTOR = 1.1


@dataclass(frozen=True)
class ResetPolicy:
    """What a reset contributes. RESTART: the value after it. ZERO: nothing. NULL: no result. DROP: samples under the
    last that was kept are left out. WRAP: the counter went on from ``low`` past ``high``.

    ``reset_value``: a rate per tick above it is given as 0. ``zero_start``: a window whose first sample tells no start
    begins at 0 at its open end.
    """

    kind: str = "RESTART"
    high: float | None = None
    low: float = 0.0
    inclusive: bool = False
    reset_value: float | None = None
    zero_start: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("RESTART", "ZERO", "NULL", "DROP", "WRAP"):
            raise ValueError(f"no reset policy {self.kind}")
        if self.kind == "WRAP" and self.high is None:
            raise ValueError("WRAP needs the counter's highest value")


def below(a: Column, b: Column) -> Column:
    """a < b as IEEE has it: false where either is NaN, which Spark sorts above all numbers."""
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def started(t: Column, st: Column, pt: Column) -> Column:
    """Whether the start time ``st`` says that the counter began anew after ``pt``."""
    return F.coalesce((st >= t) | (st >= pt), F.lit(False))


def summarised(s: Samples, counter: bool, policy: ResetPolicy) -> DataFrame:
    """One row per series and grid point with samples: n, first and last with their times, neighbours, adj, resets."""
    df = s.df
    if counter and policy.kind == "DROP":
        return _dropped(s)
    t, pt, v, pv = F.col("t"), F.col("pt"), F.col("v"), F.col("pv")
    drop, anew = below(v, pv), started(t, F.col("st"), pt)
    if not counter:
        reset, adj = F.lit(False), F.lit(0.0)
    elif policy.kind == "WRAP":
        reset = F.when(pt.isNull(), False).otherwise(drop | anew)
        adj = F.when(drop, F.lit(float(policy.high) - policy.low + (1.0 if policy.inclusive else 0.0))).otherwise(pv)
    else:
        reset = F.when(pt.isNull(), False).otherwise(drop | anew)
        adj = pv - v if policy.kind == "ZERO" else pv
    df = df.withColumn("reset", reset).withColumn("adj", adj)
    df = df.withColumn("rn", F.row_number().over(Window.partitionBy(*s.keys, "chunk").orderBy("t")))
    g, w = s.grid, s.window
    first_of = F.col("chunk").cast("long") * s.per_chunk
    last_of = F.least(F.lit(g.count - 1), first_of + (s.per_chunk - 1))
    at_or_after = lambda x: _ceil_div(x - g.start, g.step)
    # With an edge that is read, the pair before the window counts too, from no further than the lookback.
    reach = w + (s.lookback if s.edge in ("ANCHOR", "SMOOTH") else 0)
    df = df.withColumns({
        "_enters": F.greatest(at_or_after(t), first_of),
        "_leaves": F.least(at_or_after(t + w) - 1, last_of),
        "_since": at_or_after(pt + w),
        "_next": at_or_after(F.col("nt")) - 1,
        "_reset": F.when(F.col("reset"), at_or_after(pt + reach + 1) - 1 if reach > w else at_or_after(pt + w) - 1).otherwise(-1),
    })
    enters, leaves = F.col("_enters"), F.col("_leaves")
    out = placed(
        df,
        places(F.greatest(enters, "_since"), leaves, FIRST),  # greatest() and least() pass over nulls
        places(enters, F.least(leaves, "_next"), LAST),
        places(enters, F.least(leaves, "_reset"), RESET),
    )
    own = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))  # noqa: E731  one row a role
    resets = F.col("role") == RESET
    return out.groupBy(*s.keys, "chunk", "gi").agg(
        (own(LAST, "rn") - own(FIRST, "rn") + 1).alias("n"),
        own(FIRST, "t").alias("first_t"), own(FIRST, "v").alias("first"), own(FIRST, "st").alias("first_st"), own(FIRST, "pt").alias("before_t"), own(FIRST, "pv").alias("before"),
        own(LAST, "t").alias("last_t"), own(LAST, "v").alias("last"), own(LAST, "nt").alias("after_t"), own(LAST, "nv").alias("after"),
        F.coalesce(F.sum(F.when(resets, F.col("adj"))), F.lit(0.0)).alias("adj"),
        F.count_if(resets).alias("resets"),
    )


def _dropped(s: Samples) -> DataFrame:
    """DROP judges each window's samples against the last kept in it, so the window is gathered and walked."""
    kind = "array<struct<t:bigint,v:double,st:bigint>>"
    grouped = fanned(s).groupBy(*s.keys, "chunk", "gi").agg(F.array_sort(F.collect_list(F.struct("t", "v", "st"))).alias("a"))
    kept = F.aggregate("a", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) > 0) & below(x["v"], F.try_element_at(acc, F.lit(-1))["v"]), acc).otherwise(F.concat(acc, F.array(x))))
    grouped = grouped.withColumn("a", kept)
    first, last = F.element_at("a", 1), F.element_at("a", -1)
    none = F.lit(None).cast("long")
    step = lambda i: F.element_at("a", i + 1)
    pairs = F.when(F.size("a") > 1, F.sequence(F.lit(1), F.size("a") - 1)).otherwise(F.array().cast("array<int>"))
    anew = F.filter(pairs, lambda i: started(step(i)["t"], step(i)["st"], F.element_at("a", i)["t"]))
    return grouped.select(
        *s.keys, "chunk", "gi", F.size("a").cast("long").alias("n"),
        first["t"].alias("first_t"), first["v"].alias("first"), first["st"].alias("first_st"), none.alias("before_t"), none.cast("double").alias("before"),
        last["t"].alias("last_t"), last["v"].alias("last"), none.alias("after_t"), none.cast("double").alias("after"),
        F.aggregate(anew, F.lit(0.0), lambda acc, i: acc + F.element_at("a", i)["v"]).alias("adj"), F.size(anew).cast("long").alias("resets"),
    )


def extrapolated(df: DataFrame, window: int, counter: bool, zero_start: bool, keep: bool = False) -> DataFrame:
    """``df`` with the increase projected to both edges as ``value``, for windows with samples enough; with ``keep`` others have null.

    Computed as delta * ((S + d0 + d1) / S) in this order, so that results agree to the bit with other evaluators. It is
    written in steps, each a projection that reads the one below more than once and so stays apart: as one
    expression it would be evaluated over and over and be too long to be compiled.
    """
    c = F.col
    ws = c("at") - window
    known = F.coalesce((ws < c("first_st")) & (c("first_st") < c("first_t")), F.lit(False)) if counter else F.lit(False)
    df = df.withColumn("_known", known).withColumn("_zero", (c("_known") | F.lit(zero_start)) if counter else c("_known"))
    df = df.withColumn("_n", c("n") + F.when(c("_zero"), 1).otherwise(0))
    df = df.withColumn("_n", F.when(c("_n") >= 2, c("_n"))) if keep else df.where(c("_n") >= 2)
    start = F.when(c("_known"), c("first_st")).when(c("_zero"), ws).otherwise(c("first_t"))
    delta = c("adj") + (c("last") - c("first"))
    df = df.withColumns({"_start": start, "_from": F.when(c("_zero"), F.lit(0.0)).otherwise(c("first")), "_delta": F.when(c("_zero"), delta + c("first")).otherwise(delta)})
    df = df.withColumn("_span", (c("last_t") - c("_start")).cast("double"))
    df = df.withColumn("_mean", c("_span") / (c("_n") - 1).cast("double"))
    df = df.withColumns({"_limit": c("_mean") * F.lit(GAP_FACTOR), "_left": (c("_start") - ws).cast("double"), "_right": (c("at") - c("last_t")).cast("double")})
    gap = lambda e: F.when(c(e) > c("_limit"), c("_mean") / 2).otherwise(c(e))
    df = df.withColumns({"_left": F.when(c("_zero"), F.lit(0.0)).otherwise(gap("_left")), "_right": gap("_right")})
    if counter:
        rises = ~c("_zero") & below(F.lit(0.0), c("_delta")) & ~F.isnan("_from") & (c("_from") >= 0)
        to_zero = F.when(rises, c("_span") * (c("_from") / F.nullif(c("_delta"), F.lit(0.0))))
        df = df.withColumn("_to_zero", to_zero)
        df = df.withColumn("_left", F.when(c("_to_zero") < c("_left"), c("_to_zero")).otherwise(c("_left")))
    return df.withColumn("value", c("_delta") * ((c("_span") + c("_left") + c("_right")) / F.nullif(c("_span"), F.lit(0.0))))


def anchored(at: Column, ws: Column, lookback: int, counter: bool, policy: ResetPolicy, smooth: bool) -> Column:
    """The change from the left edge to the right one, without thresholds or clamps.

    ANCHOR begins at the last sample at or before the window's open end, SMOOTH at the value interpolated there and
    ends at the value interpolated at the point. Without a neighbour in reach the outermost sample inside is the edge.
    """
    c = F.col
    adj = c("adj")
    has_left = F.coalesce(c("before_t") >= ws - lookback, F.lit(False))
    left = F.when(has_left, c("before")).otherwise(c("first"))
    right = c("last")
    n = c("n") + F.when(has_left, 1).otherwise(0)
    if smooth:
        along = (ws - c("before_t")).cast("double") / F.nullif((c("first_t") - c("before_t")).cast("double"), F.lit(0.0))
        dropped = below(c("first"), c("before")) if counter else F.lit(False)
        low = F.when(dropped, F.lit(0.0)).otherwise(c("before"))
        edge = low + (c("first") - low) * along
        left = F.when(has_left, edge).otherwise(c("first"))
        if counter and policy.kind == "RESTART":  # that pair's reset is in the edge now
            adj = F.when(has_left & dropped, adj - c("before")).otherwise(adj)
        has_right = F.coalesce(c("after_t") <= at + lookback, F.lit(False))
        part = (at - c("last_t")).cast("double") / F.nullif((c("after_t") - c("last_t")).cast("double"), F.lit(0.0))
        fell = below(c("after"), c("last")) if counter else F.lit(False)
        high = F.when(fell, c("last") + c("after")).otherwise(c("after"))
        right = F.when(has_right, c("last") + (high - c("last")) * part).otherwise(c("last"))
        n = n + F.when(has_right, 1).otherwise(0)
    return F.when(n >= 2, adj + (right - left))


def counter_values(df: DataFrame, grid: Grid, window, roles: Roles = Roles(), what: str = "rate", edge: str = "EXTRAPOLATE", lookback=None, policy: ResetPolicy = ResetPolicy(), push: bool | None = None):
    """(samples, one row per series and grid point that has a ``value``) for what = rate, increase or delta."""
    if edge not in ("EXTRAPOLATE", "ANCHOR", "SMOOTH"):
        raise ValueError(f"{what} has no edge mode {edge}")
    window = checked_width(window)
    lookback = checked_width(lookback, "lookback") if lookback is not None else window
    s = prepared(df, grid, window, roles, edge, lookback if edge != "EXTRAPOLATE" else 0, push=push)
    counter = what != "delta"
    out = summarised(s, counter, policy).withColumn("at", F.lit(grid.start) + F.col("gi") * grid.step)
    if counter and policy.kind == "NULL":
        out = out.where("resets = 0")
    if edge == "EXTRAPOLATE":
        out = extrapolated(out, window, counter, policy.zero_start)
    else:
        at, ws = F.col("at"), F.col("at") - window
        out = out.withColumn("value", anchored(at, ws, lookback, counter, policy, edge == "SMOOTH")).where("value IS NOT NULL")
    value = F.col("value")
    rate = value / F.lit(float(window))
    if counter and policy.reset_value is not None:
        value, rate = (F.when(rate > policy.reset_value, F.lit(0.0)).otherwise(x) for x in (value, rate))
    return s, out.select(*s.keys, "chunk", "gi", (rate if what == "rate" else value).alias("value"))
