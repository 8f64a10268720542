"""Partial states of window folds that can be stored, merged in any order, and finished later.

A state is one row per series and slice, a slice being a step of the grid with its right end included, as windows have
it. Samples are summed into slices before any exchange, so neither a dense series nor a hot one is moved or gathered;
a window whose width is a whole number of steps is then a sum over slices. Times in a series must be distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..plans.grid import Grid, checked_width
from ..plans.roles import Roles
from .samples import _ceil_div, tick_of, time_of

FINAL = ("count_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "first_over_time", "last_over_time", "range_over_time", "ts_of_first_over_time", "ts_of_last_over_time", "present_over_time")


def _combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first_t").alias("first_t"), F.min_by(c("first"), c("first_t")).alias("first"), F.max("last_t").alias("last_t"), F.max_by(c("last"), c("last_t")).alias("last"),
    )


def states(df: DataFrame, grid: Grid, roles: Roles = Roles()) -> DataFrame:
    """(keys, slice, n, total, low, high, first_t, first, last_t, last); slice i ends at grid.at(i). low and high pass over NaN."""
    roles = roles.resolve(df)
    v, t = F.col(roles.value), tick_of(df, roles.ts)
    rows = df.where(v.isNotNull() & F.col(roles.ts).isNotNull()).select(*roles.keys, t.alias("t"), v.alias("v"))
    number = F.when(~F.isnan("v"), F.col("v"))
    rows = rows.select(
        *roles.keys, _ceil_div(F.col("t") - grid.start, grid.step).alias("slice"), F.lit(1).alias("n"), F.col("v").alias("total"), number.alias("low"), number.alias("high"),
        F.col("t").alias("first_t"), F.col("v").alias("first"), F.col("t").alias("last_t"), F.col("v").alias("last"),
    )
    return _combined(rows, [*roles.keys, "slice"])


def merged(*parts: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """One state for each series and slice, from states over the same grid of samples that are apart."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _combined(rows, [*keys, "slice"])


def finished(state: DataFrame, grid: Grid, window, keys: tuple[str, ...] = ("series_id",), time=None) -> DataFrame:
    """(keys, ts, and a column for each of FINAL) at the grid's points that have samples."""
    window = checked_width(window)
    if window % grid.step:
        raise ValueError("window must be a whole number of steps")
    lo, hi = F.greatest(F.col("slice"), F.lit(0)), F.least(F.col("slice") + (window // grid.step - 1), F.lit(grid.count - 1))
    rows = state.where(lo <= hi).withColumn("gi", F.explode(F.sequence(lo, hi))).drop("slice")
    out = _combined(rows, [*keys, "gi"])
    at = time_of(time or T.TimestampNTZType(), F.lit(grid.start) + F.col("gi") * grid.step)
    c = F.col
    values = (c("n").cast("double"), c("total"), c("total") / c("n"), F.coalesce("low", F.lit(float("nan"))), F.coalesce("high", F.lit(float("nan"))), c("first"), c("last"), F.coalesce(c("high") - c("low"), F.lit(float("nan"))), c("first_t"), c("last_t"), F.lit(1.0))
    return out.select(*keys, at.alias("ts"), *[v.alias(n) for n, v in zip(FINAL, values)])
