"""Histogram columns: point functions, merges, and folds over windows.

A histogram is one struct value. Point functions run on Arrow batches. A merge across series turns buckets into
rows and sums them, so it combines before the exchange; a fold that needs order gathers one window.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import histograms as H
from ..plans.grid import Grid, checked_width
from ..plans.roles import Roles
from . import shapes
from .samples import AFTER, BEFORE, INSIDE, fanned, prepared

POINT: dict[str, tuple[str, Any]] = {
    "quantile": ("double", lambda h, phi: H.quantile(h, phi)),
    "fraction": ("double", lambda h, low, high: H.fraction(h, low, high)),
    "count": ("double", lambda h: h["count"]),
    "sum": ("double", lambda h: h["sum"]),
    "avg": ("double", lambda h: h["sum"] / h["count"] if h["count"] else None),
    "stddev": ("double", lambda h: H.moments(h)[1] ** 0.5),
    "stdvar": ("double", lambda h: H.moments(h)[1]),
    "downscale": ("hist", lambda h, scale: H.downscale(h, scale)),
    "compact": ("hist", lambda h: H.compact(h)),
}


def _structs(pdf: pd.DataFrame) -> list:
    """Rows of a struct column, which arrives as a frame; a null struct has null in its first field."""
    return [None if pd.isna(r["count"]) else H.unpack(r) for r in pdf.to_dict("records")]


def hist(name: str, column: str | Column, classic: bool = False, **params: Any) -> Column:
    """hist_<name> of a struct column; ``classic`` tells its layout."""
    if name not in POINT:
        raise ValueError(f"no histogram function {name}")
    kind, run = POINT[name]
    column = F.col(column) if isinstance(column, str) else column
    if kind == "double":

        def number(h: pd.DataFrame) -> pd.Series:
            return pd.Series([None if x is None else run(x, **params) for x in _structs(h)], dtype="float64")

        return F.pandas_udf(number, "double")(column)
    if classic:
        raise ValueError(f"{name} is for exponential histograms")
    fields = ["count", "sum", "scale", "zero_count", "zero_threshold", "pos_offset", "pos_counts", "neg_offset", "neg_counts"]

    def struct(h: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([H.pack(run(x, **params)) if x is not None else dict.fromkeys(fields) for x in _structs(h)], columns=fields, dtype=object)

    return F.pandas_udf(struct, H.EXPONENTIAL)(column)


def detect_reset(before: str | Column, now: str | Column) -> Column:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series([None if x is None or y is None else H.detect_reset(x, y) for x, y in zip(_structs(a), _structs(b))], dtype=object)

    columns = [F.col(c) if isinstance(c, str) else c for c in (before, now)]
    return F.pandas_udf(run, "boolean")(*columns)


def from_classic(df: DataFrame, keys: list[str], bound: str, count: str) -> DataFrame:
    """(keys, h): classic histograms from rows of upper bound and cumulative count; without a row for +Inf, null.

    Cumulative counts that fall are raised to the one before; a histogram has few bounds, so its rows are gathered.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(bound).cast("double").alias("le"), F.col(count).cast("double").alias("c")))).alias("r"))
    fixed = F.aggregate("r", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.greatest(x["c"], F.coalesce(F.try_element_at(a, F.lit(-1)), x["c"])))))
    rows = rows.withColumn("f", fixed)
    counts = F.transform("f", lambda c, i: c - F.when(i == 0, 0.0).otherwise(F.try_element_at(F.col("f"), F.greatest(i, F.lit(1)))))
    bounds = F.transform(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0))), lambda x: x["le"])
    h = F.struct(F.element_at("f", -1).alias("count"), F.lit(float("nan")).alias("sum"), bounds.alias("bounds"), counts.alias("counts"))
    return rows.select(*keys, F.when(F.element_at("r", -1)["le"] == float("inf"), h).alias("h"))


def from_values(df: DataFrame, grid: Grid, window, roles: Roles = Roles(), scale: int = 0) -> DataFrame:
    """Exponential histograms of the values in each window, as rows (series, ts, value): bucket counts are sums of rows."""
    s = prepared(df, grid, checked_width(window), roles)
    v = F.col("v")
    near = F.ceil(F.log2(F.abs(v)) * float(2**scale) if scale >= 0 else F.log2(F.abs(v)) / float(2**-scale)).cast("int") - 1
    edge = lambda i: F.pow(F.lit(2.0), (i + 1).cast("double") * float(2.0**-scale))
    bucket = F.when(edge(near) < F.abs(v), near + 1).when(edge(near - 1) >= F.abs(v), near - 1).otherwise(near)
    rows = fanned(s).where(~F.isnan("v")).withColumn("side", F.signum("v").cast("int")).withColumn("b", F.when(v != 0, bucket).otherwise(0))
    return shapes.rows(s, _packed(rows.withColumn("c", F.lit(1.0)), [*s.keys, "chunk", "gi"], F.sum("v"), scale))


def _packed(rows: DataFrame, keys: list[str], total: Column, scale: int) -> DataFrame:
    """Histograms from rows (side, b, c): summed by bucket first, then gathered, a row a bucket."""
    per = rows.groupBy(*keys, "side", "b").agg(F.sum("c").alias("c"), total.alias("s"))
    part = lambda side, c: F.when(F.col("side") == side, c)
    listed = per.groupBy(*keys).agg(
        F.sum("c").alias("count"), F.sum("s").alias("sum"), F.coalesce(F.sum(part(0, F.col("c"))), F.lit(0.0)).alias("zero_count"),
        *[F.map_from_entries(F.collect_list(part(x, F.struct("b", "c")))).alias(n) for x, n in ((1, "pos"), (-1, "neg"))],
        *[F.min(part(x, F.col("b"))).alias(f"{n}_lo") for x, n in ((1, "pos"), (-1, "neg"))], *[F.max(part(x, F.col("b"))).alias(f"{n}_hi") for x, n in ((1, "pos"), (-1, "neg"))],
    )
    dense = lambda n: F.when(F.col(f"{n}_lo").isNull(), F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.coalesce(f"{n}_lo", F.lit(0)), F.coalesce(f"{n}_hi", F.lit(0))), lambda i: F.coalesce(F.try_element_at(F.col(n), i), F.lit(0.0)))
    )
    h = F.struct(
        "count", "sum", F.lit(scale).alias("scale"), "zero_count", F.lit(0.0).alias("zero_threshold"),
        F.coalesce("pos_lo", F.lit(0)).alias("pos_offset"), dense("pos").alias("pos_counts"), F.coalesce("neg_lo", F.lit(0)).alias("neg_offset"), dense("neg").alias("neg_counts"),
    )
    return listed.select(*keys, h.alias("value"))


def merge(df: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    """(keys, value): the sum of exponential histograms of a group, at the coarsest scale in it.

    Zero thresholds must agree. Buckets become rows, so the sums combine on both sides of the exchange.
    """
    coarse = df.groupBy(*keys).agg(F.min(f"{h}.scale").alias("_scale"), F.max(f"{h}.zero_threshold").alias("_zt"), F.min(f"{h}.zero_threshold").alias("_zl"))
    coarse = coarse.withColumn("_zt", F.when(F.col("_zt") != F.col("_zl"), F.raise_error(F.lit("hist_merge: zero thresholds differ")).cast("double")).otherwise(F.col("_zt")))
    rows = df.where(F.col(h).isNotNull()).join(coarse, keys)
    shift = F.col(f"{h}.scale") - F.col("_scale")
    index = lambda n, i: F.call_function("shiftright", F.col(f"{h}.{n}_offset") + i, shift)  # noqa: E731  floor by a power of two
    side = lambda n, x: F.transform(F.col(f"{h}.{n}_counts"), lambda c, i: F.struct(F.lit(x).alias("side"), index(n, i).alias("b"), c.alias("c"), F.lit(0.0).alias("s")))
    whole = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("b"), F.col(f"{h}.zero_count").alias("c"), F.col(f"{h}.sum").alias("s")))
    rows = rows.select(*keys, "_scale", "_zt", F.explode(F.concat(whole, side("pos", 1), side("neg", -1))).alias("x"))
    rows = rows.select(*keys, "_scale", "_zt", "x.side", "x.b", "x.c", "x.s")
    out = _packed(rows, [*keys, "_scale", "_zt"], F.sum("s"), 0)
    fixed = out.withColumn("value", F.col("value").withField("scale", F.col("_scale")).withField("zero_threshold", F.col("_zt")))
    return fixed.select(*keys, "value")


OVER_TIME = ("first", "last", "count", "present", "changes", "resets", "sum", "avg", "rate", "increase", "delta")
#: Edge modes by fold; the others stay inside their windows.
EDGES = dict.fromkeys(("changes", "resets"), ("INSIDE", "ANCHOR")) | dict.fromkeys(("rate", "increase", "delta"), ("EXTRAPOLATE", "ANCHOR", "SMOOTH"))


def hist_over_time(df: DataFrame, name: str, grid: Grid, window, roles: Roles = Roles(value="h"), per: str = "tick", edge: str | None = None, lookback=None) -> DataFrame:
    """A fold of exponential histograms over (at - window, at], as rows (series, ts, value).

    Of equal times the histogram with the greatest count stays. rate, increase and delta project the change to the
    window's edges, or with ANCHOR and SMOOTH begin and end at the samples around it, no further off than ``lookback`` (the
    window); changes and resets with ANCHOR count the pair that the window's open end parts. sum and avg add at the coarsest
    scale.
    """
    if name not in OVER_TIME:
        raise ValueError(f"no histogram fold {name}")
    edges = EDGES.get(name, ("INSIDE",))
    edge = edges[0] if edge is None else edge
    if edge not in edges:
        raise ValueError(f"{name} has no edge mode {edge}")
    window = checked_width(window)
    lookback = checked_width(lookback, "lookback") if lookback is not None else window
    wide = edge in ("ANCHOR", "SMOOTH")
    s = prepared(df, grid, window, roles, edge, lookback if wide else 0, numeric=False)
    keys = [*s.keys, "chunk", "gi"]
    if name in ("rate", "increase", "delta"):
        return shapes.rows(s, _changed(s, keys, name, per, edge, lookback))
    rows = fanned(s)
    t, v = F.col("t"), F.col("v")
    pair = F.coalesce(F.col("pt") >= F.col("ws") - lookback if wide else F.col("pt") > F.col("ws"), F.lit(False))
    simple = {"first": F.min_by(v, t), "last": F.max_by(v, t), "count": F.count(F.lit(1)).cast("double"), "present": F.max(F.lit(1.0)), "changes": F.count_if(pair & ~v.eqNullSafe(F.col("pv"))).cast("double")}
    if name in simple:
        return shapes.rows(s, rows.groupBy(*keys).agg(simple[name].alias("value")))
    if name == "resets":
        rows = rows.withColumn("_r", F.coalesce(detect_reset("pv", "v"), F.lit(False)) & pair)
        return shapes.rows(s, rows.groupBy(*keys).agg(F.count_if("_r").cast("double").alias("value")))
    out = merge(rows.select(*keys, "v"), keys, "v")
    if name == "avg":
        out = out.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n")), keys)
        h, n = F.col("value"), F.col("_n")
        over = {c: h[c] / n for c in ("count", "sum", "zero_count")} | {f"{x}_counts": F.transform(h[f"{x}_counts"], lambda c: c / n) for x in ("pos", "neg")}
        for c, e in over.items():
            h = h.withField(c, e)
        out = out.select(*keys, h.alias("value"))
    return shapes.rows(s, out)


def _changed(s, keys: list[str], name: str, per: str, edge: str, lookback: int) -> DataFrame:
    """Samples of a window are gathered, with those around it where its edge is read."""
    grid, window = s.grid, s.window
    rows = fanned(s, {"EXTRAPOLATE": (INSIDE,), "ANCHOR": (INSIDE, BEFORE), "SMOOTH": (INSIDE, BEFORE, AFTER)}[edge])
    if edge != "EXTRAPOLATE":
        near = (F.col("role") == INSIDE) | ((F.col("role") == BEFORE) & (F.col("t") >= F.col("ws") - lookback)) | ((F.col("role") == AFTER) & (F.col("t") <= F.col("at") + lookback))
        rows = rows.where(near)
    else:
        rows = rows.withColumn("role", F.lit(INSIDE))
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "role", "v"))).alias("a")).withColumn("at", F.lit(grid.start) + F.col("gi") * grid.step)
    by = 1.0 if name != "rate" else (1e6 if per == "second" else 1.0) / window
    is_delta = name == "delta"

    def change(a: pa.Array, at: pa.Array) -> pa.Array:
        return changes(a, at, window, edge, is_delta, by)

    out = gathered.select(*keys, F.arrow_udf(change, H.EXPONENTIAL)("a", "at").alias("value"))
    return out.where("value.count IS NOT NULL")


_LIST = pa.list_(pa.float64())
_STRUCT = pa.struct([("count", pa.float64()), ("sum", pa.float64()), ("scale", pa.int32()), ("zero_count", pa.float64()), ("zero_threshold", pa.float64()), ("pos_offset", pa.int32()), ("pos_counts", _LIST), ("neg_offset", pa.int32()), ("neg_counts", _LIST)])
#: So many bucket counts are held at once, or one window's.
CELLS = 2_000_000


def changes(a: pa.Array, at: pa.Array, window: int, edge: str, is_delta: bool, by: float) -> pa.Array:
    """Changes of windows, each a list of (t, role, histogram) by time. Windows whose histograms have one layout are taken
    together as rows of a matrix of buckets, in the order of additions of ``H.change`` and ``H.increase``; others go to these."""
    ends = at.to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(a).to_numpy(zero_copy_only=False)
    bounds = np.r_[0, np.cumsum(sizes)].astype(int)
    t, role, v = a.flatten().flatten()
    t, role = (x.to_numpy(zero_copy_only=False) for x in (t, role))
    part = dict(zip((f.name for f in v.type), v.flatten()))
    number = {n: pc.fill_null(part[n], 0).to_numpy(zero_copy_only=False) for n in part if not n.endswith("_counts")}
    window_of = np.repeat(np.arange(len(a)), sizes)
    first = bounds[window_of]
    odd = (number["scale"] != number["scale"][first]) | (number["zero_threshold"] != number["zero_threshold"][first]) | part["count"].is_null().to_numpy(zero_copy_only=False)
    slow = np.zeros(len(a), bool)
    slow[window_of[odd]] = True
    sides, columns = {}, 3
    for side in ("pos", "neg"):
        lengths = pc.fill_null(pc.list_value_length(part[f"{side}_counts"]), 0).to_numpy(zero_copy_only=False).astype(int)
        offsets, some = number[f"{side}_offset"].astype(int), lengths > 0
        low, high = (int(offsets[some].min()), int((offsets + lengths)[some].max())) if some.any() else (0, 0)
        sides[side] = (lengths, np.r_[0, np.cumsum(lengths)], part[f"{side}_counts"].flatten().to_numpy(zero_copy_only=False), offsets - low, low, slice(columns, columns + high - low))
        columns += high - low
    found, i = [], 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CELLS // columns, "right")) - 1)
        x = slice(bounds[i], bounds[j])
        m = np.zeros((bounds[j] - bounds[i], columns))
        for k, n in enumerate(("count", "sum", "zero_count")):
            m[:, k] = number[n][x]
        for lengths, starts, counts, offsets, _, where in sides.values():
            rows = np.repeat(np.arange(len(m)), lengths[x])
            own = np.arange(starts[x.start], starts[x.stop])
            m[rows, where.start + offsets[x][rows] + own - starts[x][rows]] = counts[own]
        total, valid = _plain(m, t[x], role[x], bounds[i : j + 1] - bounds[i], ends[i:j], window, edge, is_delta)
        found.append(_structs_of(total * by, valid & ~slow[i:j], number, bounds[i:j], sides))
        i = j
    out = pa.concat_arrays(found) if found else pa.array([], _STRUCT)
    if not slow.any():
        return out
    others = np.flatnonzero(slow)
    one = [_change_of(samples, int(end), window, edge, is_delta) for samples, end in zip(a.take(pa.array(others)).to_pylist(), ends[others])]
    place = np.arange(len(a))
    place[others] = len(a) + np.arange(len(others))
    return pa.concat_arrays([out, pa.array([None if h is None else H.pack(H.scaled(h, by)) for h in one], _STRUCT)]).take(pa.array(place))


def _plain(m: np.ndarray, t: np.ndarray, role: np.ndarray, bounds: np.ndarray, at: np.ndarray, window: int, edge: str, is_delta: bool) -> tuple[np.ndarray, np.ndarray]:
    """Changes of windows of samples ``m``, and which windows have one."""
    start, stop = bounds[:-1], bounds[1:]
    before, after = role[start] == BEFORE, role[stop - 1] == AFTER
    i0, i1 = start + before, stop - 1 - after
    inside, smooth = i1 - i0 + 1, edge == "SMOOTH"
    valid = (inside >= 1) & (inside + before + (after if smooth else 0) >= 2)
    i0, i1 = np.minimum(i0, stop - 1), np.maximum(i1, start)
    fell = np.zeros(len(m) + 1, bool)  # from the row before
    if not is_delta:
        fell[1 : len(m)] = (np.delete(m, 1, 1)[1:] < np.delete(m, 1, 1)[:-1]).any(1)
    left, right = m[np.where(before, start, i0)], m[i1]
    with np.errstate(divide="ignore", invalid="ignore"):
        if smooth:
            low = np.where(fell[i0][:, None], left * 0.0, left)
            on = (at - window - t[start]) / (t[i0] - t[start])
            left = np.where(before[:, None], low + (m[i0] - low) * on[:, None], left)
            next_ = m[stop - 1]
            high = np.where(fell[stop - 1][:, None], right + next_, next_)
            on = (at - t[i1]) / (t[stop - 1] - t[i1])
            right = np.where(after[:, None], right + (high - right) * on[:, None], right)
        total = right - left
        of = np.repeat(np.arange(len(start)), stop - start)
        row = np.arange(len(m))
        resets = row[fell[:-1] & (row > i0[of]) & (row <= i1[of])]
        np.add.at(total, of[resets], m[resets - 1])
        if edge == "ANCHOR":
            cut = before & fell[i0] & valid
            total[cut] += m[start[cut]]
        elif not smooth:
            span = (t[i1] - t[i0]).astype(float)
            mean = span / (inside - 1)
            reach = [np.where(e <= mean * 1.1, e, mean / 2) for e in (t[i0] - (at - window), at - t[i1])]
            total = total * ((span + reach[0] + reach[1]) / span)[:, None]
    return total, valid


def _structs_of(total: np.ndarray, valid: np.ndarray, number: dict[str, np.ndarray], first: np.ndarray, sides: dict) -> pa.Array:
    """Histograms from rows of a matrix, each side from its first bucket that is not empty to its last."""
    total = np.where(valid[:, None], total, 0.0) + 0.0
    out = {n: total[:, k] for k, n in enumerate(("count", "sum", "zero_count"))}
    out["scale"], out["zero_threshold"] = number["scale"][first].astype("int32"), number["zero_threshold"][first]
    for side, (*_, low, where) in sides.items():
        c = total[:, where]
        full = c != 0
        some = full.any(1)
        lo = np.where(some, full.argmax(1), 0) if c.shape[1] else np.zeros(len(c), int)
        hi = np.where(some, c.shape[1] - full[:, ::-1].argmax(1), 0) if c.shape[1] else lo
        place = np.arange(c.shape[1])
        out[f"{side}_offset"] = np.where(some, low + lo, 0).astype("int32")
        out[f"{side}_counts"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(hi - lo)], pa.int32()), pa.array(c[(place >= lo[:, None]) & (place < hi[:, None])]))
    return pa.StructArray.from_arrays([pa.array(out[f.name]).cast(f.type) for f in _STRUCT], fields=list(_STRUCT), mask=pa.array(~valid))


def _change_of(samples: list[dict], end: int, window: int, edge: str, is_delta: bool) -> H.Hist | None:
    """One window's change, whatever the layouts of its histograms."""
    by_role: dict[int, list] = {INSIDE: [], BEFORE: [], AFTER: []}
    for x in samples:
        by_role[x["role"]].append((x["t"], H.unpack(x["v"])))
    inside, before, after = by_role[INSIDE], by_role[BEFORE], by_role[AFTER]
    if edge == "EXTRAPOLATE":
        return H.increase(inside, end, window, is_delta)
    if not inside:
        return None
    return H.change(inside, before[-1] if before else None, after[0] if after else None, end, window, edge == "SMOOTH", is_delta)
