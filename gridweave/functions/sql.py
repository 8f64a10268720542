"""Names for SQL: the grid, its index, and rates as a table function and as an aggregate.

The DataFrame operators are the fast way; these are for queries written as text. The table function gets each
series whole and in order from an exchange and a sort, and holds one window; the aggregate gathers a group.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .. import __version__
from ..plans.grid import Grid, checked_width, ticks
from .walk import RateWalk, rates

ARITY = "ts_rate: expected (TABLE relation, grid_start, grid_end, grid_step, window)"


def _constant(arg: AnalyzeArgument, name: str) -> Any:
    if not arg.isConstantExpression:
        raise ValueError(f"ts_rate: {name} must be a constant expression")
    if arg.value is None:
        raise ValueError(f"ts_rate: {name} must not be NULL")
    return arg.value


def _tick(x: Any) -> int:
    return ticks(x.replace(tzinfo=None)) if isinstance(x, datetime) else int(x)


def checked(start: Any, end: Any, step: Any, window: Any) -> tuple[Grid, int]:
    return Grid(_tick(start), _tick(end), int(step)), checked_width(int(window))


class RateOfTable:
    """ts_rate(TABLE(...), grid_start, grid_end, grid_step, window): (series_id, values)."""

    def __init__(self) -> None:
        self.walk: RateWalk | None = None
        self.series: Any = None

    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        if len(args) != 5 or not args[0].isTable:
            raise ValueError(ARITY)
        found = {f.name: f.dataType for f in args[0].dataType.fields}
        if not {"series_id", "ts", "value"} <= set(found):
            raise ValueError("ts_rate: input must project columns named 'series_id', 'ts' and 'value'")
        if not isinstance(found["ts"], (T.TimestampNTZType, T.TimestampType)):
            raise ValueError("ts_rate: 'ts' column must be TIMESTAMP")
        if not isinstance(found["value"], T.DoubleType):
            raise ValueError("ts_rate: 'value' column must be DOUBLE")
        if "start_ts" in found and not isinstance(found["start_ts"], (T.TimestampNTZType, T.TimestampType)):
            raise ValueError("ts_rate: 'start_ts' column must be TIMESTAMP")
        checked(*[_constant(a, n) for a, n in zip(args[1:], ("grid_start", "grid_end", "grid_step", "window"))])
        schema = T.StructType([T.StructField("series_id", found["series_id"]), T.StructField("values", T.ArrayType(T.DoubleType()))])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("series_id")], orderBy=[OrderingColumn("ts")])

    def eval(self, row: T.Row, start: Any, end: Any, step: int, window: int) -> None:
        if row["ts"] is None or row["value"] is None:
            return
        if self.walk is None:
            self.walk, self.series = RateWalk(*checked(start, end, step, window)), row["series_id"]
        st = row["start_ts"] if "start_ts" in row else None
        self.walk.feed(_tick(row["ts"]), row["value"], None if st is None else _tick(st))

    def terminate(self):
        if self.walk is not None:
            yield self.series, self.walk.end()


def _rate_aggregate(with_start: bool):
    def run(t: pd.Series, v: pd.Series, st, g0, g1, step, window) -> list | None:
        grid, width = Grid(int(g0.iloc[0]), int(g1.iloc[0]), int(step.iloc[0])), checked_width(int(window.iloc[0]))
        ok = t.notna() & v.notna()
        if not ok.any():
            return None
        starts = [None] * int(ok.sum()) if st is None else [None if pd.isna(x) else int(x) for x in st[ok]]
        return rates(list(zip(t[ok].astype("int64").tolist(), v[ok].astype(float).tolist(), starts)), grid, width)

    if with_start:

        def seven(t: pd.Series, v: pd.Series, st: pd.Series, g0: pd.Series, g1: pd.Series, step: pd.Series, window: pd.Series) -> list:
            return run(t, v, st, g0, g1, step, window)

        return F.pandas_udf(seven, "array<double>")

    def six(t: pd.Series, v: pd.Series, g0: pd.Series, g1: pd.Series, step: pd.Series, window: pd.Series) -> list:
        return run(t, v, None, g0, g1, step, window)

    return F.pandas_udf(six, "array<double>")


INDEX = """
CREATE OR REPLACE TEMPORARY FUNCTION ts_grid_index(t TIMESTAMP, start TIMESTAMP, step BIGINT) RETURNS BIGINT
RETURN CASE WHEN t IS NULL OR start IS NULL OR step IS NULL THEN NULL
  WHEN step <= 0 THEN CAST(raise_error('ts_grid_index: step must be positive') AS BIGINT)
  ELSE floor((CAST(unix_micros(t) AS DECIMAL(20,0)) - CAST(unix_micros(start) AS DECIMAL(20,0))
    - pmod(CAST(unix_micros(t) AS DECIMAL(20,0)) - CAST(unix_micros(start) AS DECIMAL(20,0)), CAST(step AS DECIMAL(20,0)))) / step) END
"""

GRID = """
CREATE OR REPLACE TEMPORARY FUNCTION ts_grid(g0 TIMESTAMP, g1 TIMESTAMP, step BIGINT) RETURNS TABLE (ts TIMESTAMP_NTZ)
RETURN SELECT CAST(timestamp_micros(unix_micros(g0) + i * step) AS TIMESTAMP_NTZ) FROM (SELECT explode(sequence(CAST(0 AS BIGINT),
  CASE WHEN g0 IS NULL OR g1 IS NULL OR step IS NULL THEN CAST(raise_error('ts_grid: arguments must not be NULL') AS BIGINT)
    WHEN step <= 0 THEN CAST(raise_error('ts_grid: step must be positive') AS BIGINT)
    WHEN g1 < g0 THEN CAST(raise_error('ts_grid: end must be >= start') AS BIGINT)
    WHEN (unix_micros(g1) - unix_micros(g0)) % step <> 0 THEN CAST(raise_error('ts_grid: step must evenly divide end - start') AS BIGINT)
    ELSE (unix_micros(g1) - unix_micros(g0)) div step END)) AS i)
"""


def register(spark: SparkSession) -> None:
    """gridweave_version, ts_grid_index, ts_grid, ts_rate (a table function), and ts_rate_agg / ts_rate_agg_st over ticks."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION gridweave_version() RETURNS STRING RETURN '{__version__}'")
    spark.sql(INDEX)
    spark.sql(GRID)
    spark.udtf.register("ts_rate", F.udtf(RateOfTable))
    spark.udf.register("ts_rate_agg", _rate_aggregate(False))
    spark.udf.register("ts_rate_agg_st", _rate_aggregate(True))
