"""Folds over whole regular series, each an array of doubles aligned to a grid.

What a map or an ordered fold over an array can say is a Spark expression. The rest runs in numpy on Arrow batches; a
series is one value, so these need no exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions import numerics as N

ARRAY = "array<double>"
STRUCTS = {
    "fft": "struct<re:array<double>,im:array<double>>",
    "ifft": "struct<re:array<double>,im:array<double>>",
    "ccf": "struct<values:array<double>,lag:int>",
    "periods_detect": "struct<periods:array<int>,scores:array<double>>",
    "decompose_additive": "struct<seasonal:array<double>,trend:array<double>,residual:array<double>,baseline:array<double>>",
    "decompose_stl": "struct<seasonal:array<double>,trend:array<double>,residual:array<double>>",
    "holt_winters": "struct<forecast:array<double>,lower:array<double>,upper:array<double>,aberration:array<double>>",
    "fit_poly": "struct<coefficients:array<double>,fit:array<double>,r2:double>",
    "fit_robust": "struct<slope:double,intercept:double,fit:array<double>>",
    "fit_2lines": "struct<split:int,r2:double,left_slope:double,right_slope:double>",
    "decompose_anomalies": "struct<flag:array<double>,score:array<double>,baseline:array<double>>",
    "asap": "struct<window:int,values:array<double>>",
    "matrix_profile": "struct<profile:array<double>,index:array<int>>",
    "ks_test": "struct<statistic:double,p_value:double>",
    "lttb": "array<int>",
    "changepoints": "array<int>",
    "periods_validate": "array<double>",
    "dtw": "double",
    "sax": "string",
}
#: Functions that take a second series.
TWO = ("ccf", "dtw", "ks_test", "ifft")
NUMPY = ("fill_linear", "fill_spline", "time_decayed", "fir", "iir", "fft", "ifft", "acf", "ccf", "periods_detect", "periods_validate", "decompose_stl", "decompose_additive", "seasonal", "decompose_forecast", "holt_winters", "fit_poly", "fit_robust", "fit_2lines", "outliers_tukey", "decompose_anomalies", "lttb", "asap", "dtw", "paa", "sax", "matrix_profile", "changepoints", "ks_test")


#: Functions that take series of one length together, as rows, and cells of them at once.
TOGETHER, CELLS = ("decompose_stl",), 100_000


def _cells(x) -> np.ndarray:
    return np.array(x, float)  # None becomes NaN


def _out(x: Any) -> Any:
    """Numpy to what Arrow takes; NaN means no value."""
    if isinstance(x, dict):
        return {k: _out(v) for k, v in x.items()}
    if isinstance(x, np.ndarray) and x.dtype == float:
        return [None if y != y else y for y in x.tolist()]
    if isinstance(x, (np.ndarray, list)):
        return [_out(y) for y in x]
    if isinstance(x, (float, np.floating)):
        return None if np.isnan(x) else float(x)
    return int(x) if isinstance(x, np.integer) else x


def _numpy(name: str, params: dict) -> Callable[..., Column]:
    run = getattr(N, name)
    kind = STRUCTS.get(name, ARRAY)

    def together(column: pd.Series) -> list:
        out: list = [None] * len(column)
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(column):
            if x is not None:
                by_length.setdefault(len(x), []).append(i)
        for n, rows in by_length.items():
            most = max(1, CELLS // max(1, n))
            for at in (rows[i : i + most] for i in range(0, len(rows), most)):
                found = run(np.stack([_cells(column.iloc[i]) for i in at]), **params)
                for j, i in enumerate(at):
                    out[i] = {k: _out(v[j]) for k, v in found.items()}
        return out

    def each(*columns: pd.Series) -> list:
        if name in TOGETHER:
            return together(*columns)
        return [None if any(x is None for x in row) else _out(run(*[_cells(x) for x in row], **params)) for row in zip(*columns)]

    if kind.startswith("struct"):
        names = [f.name for f in T._parse_datatype_string(kind).fields]

        def one(a: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([x or dict.fromkeys(names) for x in each(a)], columns=names, dtype=object)

        def two(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([x or dict.fromkeys(names) for x in each(a, b)], columns=names, dtype=object)
    else:

        def one(a: pd.Series) -> pd.Series:
            return pd.Series(each(a), dtype=object)

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(each(a, b), dtype=object)

    return F.pandas_udf(two if name in TWO else one, kind)


# --- expressions


def _valued(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def fill_forward(a: Column, limit: int | None = None) -> Column:
    """The last value before a null cell, from no further than ``limit`` cells."""
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("age"), F.array().cast(ARRAY).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        age = F.when(x.isNotNull(), F.lit(0)).otherwise(acc["age"] + 1)
        v = F.coalesce(x, acc["v"])
        said = v if limit is None else F.when(age <= limit, v)
        return F.struct(v.alias("v"), age.alias("age"), F.concat(acc["out"], F.array(said)).alias("out"))

    return F.aggregate(a, start, step, lambda acc: acc["out"])


def fill_backward(a: Column, limit: int | None = None) -> Column:
    return F.reverse(fill_forward(F.reverse(a), limit))


def fill_const(a: Column, value: float = 0.0) -> Column:
    return F.transform(a, lambda x: F.coalesce(x, F.lit(float(value))))


def exp_smooth(a: Column, alpha: float = 0.5) -> Column:
    start = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast(ARRAY).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = F.when(acc["s"].isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * acc["s"])
        return F.struct(F.coalesce(s, acc["s"]).alias("s"), F.concat(acc["out"], F.array(s)).alias("out"))

    return F.aggregate(a, start, step, lambda acc: acc["out"])


def ema(a: Column, alpha: float | None = None, span: float | None = None, order: int = 1) -> Column:
    alpha = 2 / (span + 1) if alpha is None else alpha
    e1 = exp_smooth(a, alpha)
    if order == 1:
        return e1
    e2 = exp_smooth(e1, alpha)
    if order == 2:
        return F.zip_with(e1, e2, lambda x, y: 2 * x - y)
    return F.zip_with(F.zip_with(e1, e2, lambda x, y: 3 * x - 3 * y), exp_smooth(e2, alpha), lambda x, y: x + y)


def znorm(a: Column) -> Column:
    """Zero mean and unit deviation; all zeros where the series is flat."""
    v = _valued(a)
    n = F.nullif(F.size(v).cast("double"), F.lit(0.0))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    # The pair is made once, and the lambda below reads it for each cell.
    stats = F.transform(F.array(mean), lambda m: F.struct(m.alias("m"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n).alias("sd")))
    return F.flatten(F.transform(stats, lambda p: F.transform(a, lambda x: F.when(p["sd"] == 0, F.when(x.isNotNull(), 0.0)).otherwise((x - p["m"]) / p["sd"]))))


EXPRESSIONS: dict[str, Callable[..., Column]] = {"fill_forward": fill_forward, "fill_backward": fill_backward, "fill_const": fill_const, "ema": ema, "exp_smooth": exp_smooth, "znorm": znorm}
SERIES = (*EXPRESSIONS, *NUMPY)


def series(name: str, *columns: str | Column, **params: Any) -> Column:
    """ts_series_<name> of one array column, or of two."""
    columns = tuple(F.col(c) if isinstance(c, str) else c for c in columns)
    if len(columns) != (2 if name in TWO else 1):
        raise ValueError(f"{name} takes {2 if name in TWO else 1} series")
    if name in EXPRESSIONS:
        return EXPRESSIONS[name](*columns, **params)
    if name not in NUMPY:
        raise ValueError(f"no series function {name}")
    return _numpy(name, params)(*columns)


def make_series(df: DataFrame, grid, keys: list[str], ts: str = "ts", value: str = "value", order: str | None = None) -> DataFrame:
    """One array per key from values at grid points: the sum of what falls on a point, null where nothing does.

    Doubles of a point are added one after another by ``order`` and value, so the sum is the same to the bit however rows are
    split. Rows stream through a window that spills; they are not gathered.
    """
    from .samples import tick_of

    kept = [] if order is None else [F.col(order).alias("_o")]
    at = df.select(*keys, ((tick_of(df, ts) - grid.start) / grid.step).alias("x"), F.col(value).alias("_v"), *kept).where((F.col("x") >= 0) & (F.col("x") < grid.count) & (F.col("x") == F.floor("x")))
    at = at.withColumn("gi", F.col("x").cast("int"))
    if at.schema["_v"].dataType.typeName() in ("double", "float"):
        by = Window.partitionBy(*keys, "gi").orderBy(*(["_o"] if kept else []), "_v")
        upto = F.sum("_v").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = at.select(*keys, "gi", upto.alias("v"), F.lead("gi").over(by).alias("_next")).where("_next IS NULL").drop("_next")
    else:
        sums = at.groupBy(*keys, "gi").agg(F.sum("_v").alias("v"))
    packed = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("gi", "v"))).alias("m"))
    return packed.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(grid.count - 1)), lambda i: F.try_element_at("m", i)).alias("values"))


def unnest(df: DataFrame, grid, keys: list[str], values: str = "values") -> DataFrame:
    """Arrays back to rows (keys, ts, value)."""
    rows = df.select(*keys, F.posexplode(values).alias("gi", "value"))
    at = F.lit(grid.start) + F.col("gi").cast("long") * grid.step
    return rows.select(*keys, F.timestamp_micros(at).cast("timestamp_ntz").alias("ts"), "value")
