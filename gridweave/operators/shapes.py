"""Results as rows (series, ts, value) or as one array per series, aligned to the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .samples import Samples, time_of


def rows(s: Samples, out: DataFrame, value: str = "value", filled: bool = False) -> DataFrame:
    """One row per series and grid point that has a value.

    ``filled`` says that all rows have one: a test for null would be pushed below the projections that make the value,
    and would evaluate it all over again there.
    """
    return (out if filled else out.where(F.col(value).isNotNull())).select(*s.keys, time_of(s.time, F.lit(s.grid.start) + F.col("gi") * s.grid.step).alias("ts"), F.col(value))


def dense(s: Samples, out: DataFrame, value: str = "value") -> DataFrame:
    """One row per series and grid point, null where there is no value; series are those with samples in reach."""
    listed = lists(s, out, value)
    return listed.select(*s.keys, F.posexplode(value + "s").alias("gi", value)).select(*s.keys, time_of(s.time, F.lit(s.grid.start) + F.col("gi") * s.grid.step).alias("ts"), value)


def lists(s: Samples, out: DataFrame, value: str = "value", every: DataFrame | None = None) -> DataFrame:
    """One row per series with ``values``, an element for each grid point in order.

    Series without a sample in reach are absent, or have null for a list if ``every`` names them.
    """
    have = out.groupBy(*s.keys).agg(F.map_from_entries(F.collect_list(F.struct("gi", value))).alias("_m"))
    seen = s.df.select(*s.keys).distinct() if every is None else every.select(*s.keys).distinct()
    on = [seen[k].eqNullSafe(have[k]) for k in s.keys]
    cond: Column = on[0]
    for c in on[1:]:
        cond = cond & c
    both = seen.join(have, cond, "left")
    kind = out.schema[value].dataType
    element = F.transform(F.sequence(F.lit(0), F.lit(s.grid.count - 1)), lambda i: F.try_element_at(F.col("_m"), i.cast("long")).cast(kind))
    empty = F.lit(None) if every is not None else F.transform(F.sequence(F.lit(0), F.lit(s.grid.count - 1)), lambda i: F.lit(None).cast(kind))
    return both.select(*[seen[k] for k in s.keys], F.when(F.col("_m").isNotNull(), element).otherwise(empty).alias(value + "s"))
