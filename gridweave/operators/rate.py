"""Rates as a DataFrame operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.grid import Grid
from ..plans.roles import Roles
from . import shapes
from .counter import ResetPolicy, counter_values

SECOND = 1_000_000.0


def ts_rate(
    df: DataFrame,
    grid: Grid,
    window,
    roles: Roles = Roles(),
    *,
    what: str = "rate",
    edge: str = "EXTRAPOLATE",
    lookback=None,
    policy: ResetPolicy = ResetPolicy(),
    shape: str = "rows",
    per: str = "tick",
    keep_empty: bool = False,
    push: bool | None = None,
) -> DataFrame:
    """Rate (or ``what``: increase, delta) of each series over (at - window, at] at each grid point.

    Rates are per tick, a microsecond, unless ``per`` is "second". ``shape``: rows, dense (with nulls) or lists.
    Series without a sample in reach of the grid are absent; with ``keep_empty`` their list is null.
    """
    every = df if keep_empty else None
    s, out = counter_values(df, grid, window, roles, what, edge, lookback, policy, push)
    if per == "second" and what == "rate":
        out = out.withColumn("value", F.col("value") * SECOND)
    if shape == "rows":
        return shapes.rows(s, out, filled=edge == "EXTRAPOLATE")
    return shapes.dense(s, out) if shape == "dense" else shapes.lists(s, out, every=every)
