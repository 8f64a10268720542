"""The grid as a relation, and the index of a time on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.grid import Grid


def ts_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """One row (ts) per grid point, ascending."""
    points = spark.range(grid.count).select((F.lit(grid.start) + F.col("id") * grid.step).alias("t"))
    return points.select(F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"))


def grid_index(t: Column, start: Column, step: Column) -> Column:
    """Floor of (t - start) / step over ticks; null for null, an error for a step of 0 or less or a result beyond BIGINT.

    The difference of two BIGINTs may not fit one, so it is taken in decimals and the result is checked.
    """
    wide = lambda c: c.cast("decimal(20,0)")
    d, s = (wide(t) - wide(start)).cast("decimal(21,0)"), wide(step)
    ok = F.when(step <= 0, F.raise_error(F.lit("ts_grid_index: step must be positive"))).otherwise(s)
    rest = F.pmod(d, ok)
    index = (d - rest) / ok
    low, high = F.lit("-9223372036854775808").cast("decimal(20,0)"), F.lit("9223372036854775807").cast("decimal(20,0)")
    index = index.cast("decimal(22,0)")
    return F.when(t.isNull() | start.isNull() | step.isNull(), F.lit(None).cast("long")).when(
        (index < low) | (index > high), F.raise_error(F.lit("ts_grid_index: result overflows BIGINT")).cast("long")
    ).otherwise(index.cast("long"))


def ts_grid_index(t: Column, start: Column, step: Column) -> Column:
    """grid_index() of timestamps; the step is in microseconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return grid_index(micros(t), micros(start), step)
