"""Values carried to grid points: as-of joins of the grid with each series, without a join.

A sample knows its neighbours, so the grid points to which it is the newest sample, or the next one, are a range of
indices. Each point gets a row from either side, and a sum puts the two together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.grid import Grid, checked_width
from ..plans.roles import Roles
from . import shapes
from .samples import AFTER, BEFORE, Samples, fanned, prepared, time_of

MODES = ("LOOKBACK", "NEXT", "NEAREST", "INTERPOLATE")


def carried(df: DataFrame, grid: Grid, lookback, roles: Roles = Roles(), mode: str = "LOOKBACK", push: bool | None = None) -> tuple[Samples, DataFrame]:
    """(samples, one row per series and grid point with ``value`` and ``value_t``), null where nothing is carried.

    LOOKBACK: the newest sample at or before the point. NEXT: the first after it. NEAREST: the closer, of equals the
    earlier. INTERPOLATE: on the line between the two, if they are no further apart than the lookback; a sample at the
    point is its value. A stale mark on a side that is read means there is no value.
    """
    if mode not in MODES:
        raise ValueError(f"no resample mode {mode}")
    lookback = checked_width(lookback, "lookback")
    numeric = dict(df.dtypes).get(roles.value) == "double"
    if mode == "INTERPOLATE" and not numeric:
        raise ValueError("INTERPOLATE needs numbers")
    # With a window of no width a sample at the point is BEFORE it.
    s = prepared(df, grid, 0, roles, mode, lookback, numeric=numeric, push=push)
    rows = fanned(s, {"LOOKBACK": (BEFORE,), "NEXT": (AFTER,)}.get(mode, (BEFORE, AFTER)))
    side = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    out = rows.groupBy(*s.keys, "chunk", "gi").agg(*[side(role, c).alias(f"{n}_{c}") for role, n in ((BEFORE, "p"), (AFTER, "n")) for c in ("t", "v", "stale")])
    out = out.withColumn("at", F.lit(grid.start) + F.col("gi") * grid.step)
    at, pt, nt, pv, nv = (F.col(c) for c in ("at", "p_t", "n_t", "p_v", "n_v"))
    near = F.coalesce((at - pt <= lookback) & ~F.col("p_stale"), F.lit(False))
    soon = F.coalesce((nt - at <= lookback) & ~F.col("n_stale"), F.lit(False))
    if mode == "LOOKBACK":
        value, when = F.when(near, pv), F.when(near, pt)
    elif mode == "NEXT":
        value, when = F.when(soon, nv), F.when(soon, nt)
    elif mode == "NEAREST":
        absent = F.coalesce(F.col("p_stale"), F.lit(False)) | F.coalesce(F.col("n_stale") & (pt < at), F.lit(False))
        first = near & (~soon | (at - pt <= nt - at))
        value = F.when(absent, None).when(first, pv).when(soon, nv)
        when = F.when(absent, None).when(first, pt).when(soon, nt)
    else:
        both = F.coalesce((nt - pt <= lookback) & ~F.col("p_stale") & ~F.col("n_stale"), F.lit(False))
        part = (at - pt).cast("double") / F.nullif((nt - pt).cast("double"), F.lit(0.0))
        exact = F.coalesce((pt == at) & ~F.col("p_stale"), F.lit(False))
        value = F.when(exact, pv).when(both, pv + (nv - pv) * part)
        when = F.lit(None).cast("long")
    return s, out.select(*s.keys, "chunk", "gi", value.alias("value"), when.alias("value_t"))


def resample(df: DataFrame, grid: Grid, lookback, roles: Roles = Roles(), mode: str = "LOOKBACK", shape: str = "rows", push: bool | None = None) -> DataFrame:
    s, out = carried(df, grid, lookback, roles, mode, push)
    if shape == "rows":
        return shapes.rows(s, out)
    return shapes.dense(s, out) if shape == "dense" else shapes.lists(s, out)


def resample_ts(df: DataFrame, grid: Grid, lookback, roles: Roles = Roles(), mode: str = "LOOKBACK", push: bool | None = None) -> DataFrame:
    """The time of the sample that is carried."""
    if mode == "INTERPOLATE":
        raise ValueError("resample_ts has no mode INTERPOLATE")
    s, out = carried(df, grid, lookback, roles, mode, push)
    return shapes.rows(s, out.select(*s.keys, "chunk", "gi", time_of(s.time, F.col("value_t")).alias("value")))
