"""Folds over the samples in (at - window, at] at every grid point.

Each fold is a few aggregates over the fanned samples and an expression over their results, so any number of folds
runs in one pass: ``fold`` takes several and returns them as columns. Those that need samples in order gather a
window's samples into a sorted array; the rest are sums, extremes and picks that combine before and after the exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.grid import Grid, checked_width, width
from ..plans.roles import Roles
from . import shapes
from .counter import ResetPolicy, anchored, below, extrapolated, started
from .samples import BEFORE, INSIDE, Samples, fanned, prepared


@dataclass
class Context:
    """What a fold may use: columns of the fanned rows, and ``use`` to ask for an aggregate by name."""

    edge: str
    lookback: int
    window: int
    numeric: bool
    with_before: bool
    aggs: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for c in ("t", "v", "st", "pt", "pv", "nt", "nv", "at", "ws", "stale"):
            setattr(self, c, F.col(c))
        inside = (F.col("role") == INSIDE) if self.with_before else F.lit(True)
        self.row = inside & ~self.stale
        near = F.coalesce(self.pt > self.ws, F.lit(False))
        if self.edge == "ANCHOR":
            near = F.coalesce(self.pt >= self.ws - self.lookback, F.lit(False))
        #: The sample before is in the window too (or is the anchor), so the two make a pair.
        self.pair = self.row & near
        #: The stretch of the window in which this sample is the last one seen.
        since = F.greatest(self.t, self.ws)
        self.held = F.least(F.coalesce(self.nt, self.at), self.at) - since

    def rows(self, c: Column) -> Column:
        return F.when(self.row, c)

    def pairs(self, c: Column) -> Column:
        return F.when(self.pair, c)

    def use(self, name: str, agg: Column) -> Column:
        self.aggs[name] = agg
        return F.col(name)

    @property
    def n(self) -> Column:
        return self.use("_n", F.count(self.rows(F.lit(1))))

    @property
    def sorted(self) -> Column:
        """The window's samples as an array of (t, v), by time."""
        return self.use("_sorted", F.array_sort(F.collect_list(self.rows(F.struct("t", "v")))))

    @property
    def values(self) -> Column:
        """The window's values in order."""
        return F.array_sort(F.transform(self.sorted, lambda x: x["v"]))


def r7(values: Column, phi: float) -> Column:
    """Linear quantile (Hyndman and Fan's seventh) of a sorted array; null if it is empty."""
    if phi < 0 or phi > 1:
        return F.when(F.size(values) > 0, F.lit(-math.inf if phi < 0 else math.inf))
    rank = F.lit(float(phi)) * (F.size(values) - 1)
    low = F.floor(rank).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    part = rank - low
    a, b = F.try_element_at(values, low + 1), F.try_element_at(values, high + 1)
    return F.when(F.size(values) > 0, a * (F.lit(1.0) - part) + b * part)


def r3(values: Column, phi: float) -> Column:
    """The nearest rank, halves to the even one (Hyndman and Fan's third)."""
    rank = F.greatest(F.lit(1), F.least(F.size(values), F.bround(F.lit(float(phi)) * F.size(values), 0).cast("int")))
    return F.when(F.size(values) > 0, F.try_element_at(values, rank))


def _quantile(x: Context, phi: float = 0.5, method: str = "R7") -> Column:
    if method == "R3":
        return r3(x.values, phi)
    if phi < 0 or phi > 1:
        return F.when(x.n > 0, F.lit(-math.inf if phi < 0 else math.inf))
    return x.use(f"_q{phi}".replace(".", "_"), F.percentile(x.rows(x.v), F.lit(float(phi))))


def _number(x: Context, agg: Column, name: str) -> Column:
    """An extreme over numbers; NaN only where the window holds nothing else."""
    return F.when(x.n > 0, F.coalesce(x.use(name, agg), F.lit(math.nan)))


def _min(x: Context) -> Column:
    return _number(x, F.min(x.rows(F.when(~F.isnan(x.v), x.v))), "_min")


def _max(x: Context) -> Column:
    return _number(x, F.max(x.rows(F.when(~F.isnan(x.v), x.v))), "_max")


def _first(x: Context) -> Column:
    return x.use("_first", F.min_by(x.rows(x.v), x.rows(x.t)))


def _last(x: Context) -> Column:
    return x.use("_last", F.max_by(x.rows(x.v), x.rows(x.t)))


def _ts_of(kind: str) -> Callable[[Context], Column]:
    def build(x: Context) -> Column:
        if kind == "first":
            return x.use("_t_first", F.min(x.rows(x.t)))
        if kind == "last":
            return x.use("_t_last", F.max(x.rows(x.t)))
        # Ties go to the earliest.
        if kind == "min":
            return x.use("_t_min", F.min(x.rows(F.struct("v", "t"))))["t"]
        return -x.use("_t_max", F.max(x.rows(F.struct(x.v.alias("v"), (-x.t).alias("t")))))["t"]

    return build


def _stdvar(x: Context) -> Column:
    return x.use("_var", F.var_pop(x.rows(x.v)))


def _stddev(x: Context) -> Column:
    return x.use("_sd", F.stddev_pop(x.rows(x.v)))


def _mad(x: Context) -> Column:
    middle = x.use("_median", F.percentile(x.rows(x.v), F.lit(0.5)))
    away = F.array_sort(F.transform(F.transform(x.sorted, lambda s: s["v"]), lambda y: F.abs(y - middle)))
    return r7(away, 0.5)


def _irate(x: Context) -> Column:
    dv = F.when(below(x.v, x.pv) | started(x.t, x.st, x.pt), x.v).otherwise(x.v - x.pv)
    return x.use("_irate", F.max_by(F.when(x.pair, dv / (x.t - x.pt).cast("double")), x.pairs(x.t)))


def _idelta(x: Context) -> Column:
    return x.use("_idelta", F.max_by(x.pairs(x.v - x.pv), x.pairs(x.t)))


def _resets(x: Context) -> Column:
    hit = below(x.v, x.pv) | started(x.t, x.st, x.pt)
    return F.when(x.n > 0, x.use("_resets", F.count_if(x.pair & hit)).cast("double"))


def _changes(x: Context) -> Column:
    return F.when(x.n > 0, x.use("_changes", F.count_if(x.pair & ~x.v.eqNullSafe(x.pv))).cast("double"))


def _compensated(x: Context) -> Column:
    """The window's sum in order of time with the error of each addition carried along (Neumaier's), which an infinity ends."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, y: Column) -> Column:
        s = y["v"]
        t = a["s"] + s
        low = F.when(F.abs(a["s"]) >= F.abs(s), (a["s"] - t) + s).otherwise((s - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + F.when(F.abs(t) == float("inf"), 0.0).otherwise(low)).alias("c"))

    return F.when(x.n > 0, F.aggregate(x.sorted, zero, add, lambda a: F.when(F.abs(a["s"]) == float("inf"), a["s"]).otherwise(a["s"] + a["c"])))


def _sum(x: Context, exact: bool = False) -> Column:
    """Plain sums combine before the exchange; with ``exact`` the window is gathered and its sum compensated, so that its
    bits do not depend on how rows are dealt."""
    return _compensated(x) if exact else x.use("_sum", F.sum(x.rows(x.v)))


def _avg(x: Context, exact: bool = False) -> Column:
    return _compensated(x) / x.n.cast("double") if exact else x.use("_avg", F.avg(x.rows(x.v)))


def _regression(x: Context) -> tuple[Column, Column]:
    """Slope and intercept at the grid point, over times as distances from it."""
    dt = (x.t - x.at).cast("double")
    return x.use("_slope", F.regr_slope(x.rows(x.v), x.rows(dt))), x.use("_intercept", F.regr_intercept(x.rows(x.v), x.rows(dt)))


def _deriv(x: Context) -> Column:
    return F.when(x.n > 1, _regression(x)[0])


def _predict_linear(x: Context, horizon=0) -> Column:
    slope, intercept = _regression(x)
    return F.when(x.n > 1, intercept + slope * F.lit(float(width(horizon))))


def _double_exp(x: Context, sf: float = 0.5, tf: float = 0.5) -> Column:
    """Holt's linear smoothing: the level after the last sample. The trend starts as the first difference."""
    start = F.struct(F.element_at(x.sorted, 1)["v"].alias("s"), (F.try_element_at(x.sorted, F.lit(2))["v"] - F.element_at(x.sorted, 1)["v"]).alias("b"), F.lit(True).alias("new"))

    def step(a: Column, s: Column) -> Column:
        level = F.lit(sf) * s["v"] + F.lit(1 - sf) * (a["s"] + a["b"])
        trend = F.lit(tf) * (level - a["s"]) + F.lit(1 - tf) * a["b"]
        return F.struct(level.alias("s"), trend.alias("b"), F.lit(False).alias("new"))

    return F.when(F.size(x.sorted) > 1, F.aggregate(F.slice(x.sorted, 2, F.size(x.sorted)), start, step)["s"])


def _smooth(x: Context) -> tuple[Column, Column, Column, Column]:
    """For the sample in a window: whether the edge before it is read, the value there, and the same for the edge after it."""
    first = F.coalesce((x.pt <= x.ws) & (x.pt >= x.ws - x.lookback), F.lit(False))
    last = F.coalesce((x.nt > x.at) & (x.nt <= x.at + x.lookback), F.lit(False))
    part = lambda a, b, c: (a - b).cast("double") / F.nullif((c - b).cast("double"), F.lit(0.0))
    return first, x.pv + (x.v - x.pv) * part(x.ws, x.pt, x.t), last, x.v + (x.nv - x.v) * part(x.at, x.t, x.nt)


def _integral(x: Context, method: str = "LOCF") -> Column:
    """Area under the samples in value times ticks. ANCHOR holds the value before the window from its open end, and with
    LOCF the last one up to the grid point; SMOOTH goes from the value interpolated at the open end to that at the point,
    where there is a neighbour in reach; INSIDE goes from the first sample to the last."""
    if method not in ("LOCF", "LINEAR"):
        raise ValueError(f"no method {method}")
    line = method == "LINEAR"
    area = ((x.v + x.pv) / 2 if line else x.pv) * (x.t - x.pt).cast("double")
    if x.edge == "SMOOTH":
        first, low, last, high = _smooth(x)
        head = F.when(first, ((low + x.v) / 2 if line else low) * (x.t - x.ws).cast("double"))
        tail = F.when(last, ((x.v + high) / 2 if line else x.v) * (x.at - x.t).cast("double"))
        inside = F.when(x.pair, area)
        some = x.row & (x.pair | first | last)
        zero = F.lit(0.0)
        return x.use(f"_area_smooth_{method}", F.sum(F.when(some, F.coalesce(inside, head, zero) + F.coalesce(tail, zero))))
    if line:
        if x.edge == "ANCHOR":
            along = (x.ws - x.pt).cast("double") / (x.t - x.pt).cast("double")
            at_edge = x.pv + (x.v - x.pv) * along
            area = F.when(x.pt < x.ws, (x.v + at_edge) / 2 * (x.t - x.ws).cast("double")).otherwise(area)
        return x.use("_area_linear", F.sum(x.pairs(area)))
    if x.edge == "ANCHOR":
        seen = F.col("role").isin(INSIDE, BEFORE) if x.with_before else x.row
        return x.use("_area_held", F.sum(F.when(seen & (x.held > 0), x.v * x.held.cast("double"))))
    return x.use("_area_locf", F.sum(x.pairs(area)))


def _covered(x: Context, method: str) -> Column:
    if x.edge == "SMOOTH":
        first, _, last, _ = _smooth(x)
        zero = F.lit(0).cast("long")
        head = F.when(x.pair, x.t - x.pt).when(first, x.t - x.ws).otherwise(zero)
        return x.use("_smooth_span", F.sum(F.when(x.row & (x.pair | first | last), head + F.when(last, x.at - x.t).otherwise(zero))))
    if x.edge == "ANCHOR" and method == "LOCF":
        seen = F.col("role").isin(INSIDE, BEFORE) if x.with_before else x.row
        return x.use("_held", F.sum(F.when(seen & (x.held > 0), x.held)))
    gap = x.t - (F.greatest(x.pt, x.ws) if x.edge == "ANCHOR" else x.pt)
    return x.use("_span", F.sum(x.pairs(gap)))


def _time_weighted(x: Context, method: str = "LOCF") -> Column:
    return _integral(x, method) / F.nullif(_covered(x, method).cast("double"), F.lit(0.0))


def _monotone(x: Context, kind: str = "increases") -> Column:
    up, down = below(x.pv, x.v), below(x.v, x.pv)
    if kind in ("increases", "decreases"):
        return F.when(x.n > 0, x.use(f"_{kind}", F.count_if(x.pair & (up if kind == "increases" else down))).cast("double"))
    if kind not in ("ascent", "descent"):
        raise ValueError(f"no kind {kind}")
    hit, by = (up, x.v - x.pv) if kind == "ascent" else (down, x.pv - x.v)
    return F.when(x.n > 0, F.coalesce(x.use(f"_{kind}", F.sum(F.when(x.pair & hit, by))), F.lit(0.0)))


def _last_change(x: Context) -> Column:
    return x.use("_t_change", F.max(F.when(x.pair & ~x.v.eqNullSafe(x.pv), x.t)))


def _interval(x: Context) -> Column:
    return x.use("_interval", F.percentile(x.pairs((x.t - x.pt).cast("double")), F.lit(0.5)))


def _active(x: Context, max_gap=0, tail: str = "NONE") -> Column:
    """Ticks of presence. NONE adds up gaps no longer than ``max_gap``; EXTEND lets each sample last for ``max_gap``."""
    gap = F.lit(width(max_gap)).cast("long")
    if tail == "EXTEND":
        seen = F.col("role").isin(INSIDE, BEFORE) if x.with_before else x.row
        till = F.least(x.t + gap, F.coalesce(x.nt, x.at), x.at)
        return F.when(x.n > 0, x.use("_extended", F.sum(F.when(seen, F.greatest(till - F.greatest(x.t, x.ws), F.lit(0))))).cast("double"))
    since = F.greatest(x.pt, x.ws) if x.edge == "ANCHOR" else x.pt
    return F.when(x.n > 0, F.coalesce(x.use("_active", F.sum(F.when(x.pair & (x.t - x.pt <= gap), x.t - since))), F.lit(0)).cast("double"))


def _gaps(x: Context, max_gap=0) -> Column:
    return F.when(x.n > 0, x.use("_gaps", F.count_if(x.pair & (x.t - x.pt > width(max_gap)))).cast("double"))


def _mode(x: Context) -> Column:
    """The most frequent value; of several the least."""
    counts = F.aggregate(
        x.values,
        F.struct(F.lit(None).cast("double" if x.numeric else "string").alias("v"), F.lit(0).alias("n"), F.lit(None).cast("double" if x.numeric else "string").alias("best"), F.lit(0).alias("most")),
        lambda a, y: F.struct(
            y.alias("v"),
            F.when(y.eqNullSafe(a["v"]), a["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.when(F.when(y.eqNullSafe(a["v"]), a["n"] + 1).otherwise(F.lit(1)) > a["most"], y).otherwise(a["best"]).alias("best"),
            F.greatest(F.when(y.eqNullSafe(a["v"]), a["n"] + 1).otherwise(F.lit(1)), a["most"]).alias("most"),
        ),
    )
    return counts["best"]


def _moments(x: Context) -> Column:
    return F.when(x.n > 0, F.struct(x.use("_skew", F.skewness(x.rows(x.v))).alias("skewness"), x.use("_kurt", F.kurtosis(x.rows(x.v))).alias("kurtosis")))


def _m4(x: Context) -> Column:
    return F.when(
        x.n > 0,
        F.struct(
            _ts_of("min")(x).alias("t_min"), _min(x).alias("v_min"), _ts_of("max")(x).alias("t_max"), _max(x).alias("v_max"),
            _ts_of("first")(x).alias("t_first"), _first(x).alias("v_first"), _ts_of("last")(x).alias("t_last"), _last(x).alias("v_last"),
        ),
    )


def _two_samples(x: Context) -> Column:
    return F.slice(F.reverse(x.sorted), 1, 2)


def _state_duration(x: Context) -> Column:
    """Ticks by state, the last one held up to the grid point; keys in order."""
    seen = F.col("role").isin(INSIDE, BEFORE) if x.with_before else x.row
    if x.edge != "ANCHOR":
        seen = x.row
    parts = x.use("_states", F.array_sort(F.collect_list(F.when(seen & (x.held > 0), F.struct("v", x.held.alias("d"))))))
    states = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["v"])))
    total = lambda k: F.aggregate(F.filter(parts, lambda p: p["v"] == k), F.lit(0).cast("long"), lambda a, p: a + p["d"])
    return F.when(F.size(parts) > 0, F.map_from_arrays(states, F.transform(states, total)))


def _top_k(x: Context, k: int = 5, most: int = 1000) -> Column:
    """The ``k`` most frequent of the values tracked, with bounds of their counts: (key, count_lo, count_hi).

    The sketch counts a value short by no more than its error, a long that it holds in bytes 24 to 31, low byte first, and
    that is 0 while it tracks all values. Its estimate leaves out values counted no higher than the error, all of them where none
    is frequent; so it is asked with that long set to 0, which gives each tracked value's lower bound. A sketch that drops
    values of one count may be left without any, and then forgets its error: samples that it no longer knows of (bytes 16 to 23
    have those it does) are added to the error, and a window without a tracked value gives its last one.
    """
    state = x.use(f"_top_{most}", F.call_function("approx_top_k_accumulate", x.rows(x.v), F.lit(most)))
    sketch = state["sketch"]
    full = F.octet_length(sketch) >= 32  # an empty sketch is its first long alone

    def held(first: int) -> Column:
        high_first = F.concat(*[F.hex(F.substring(sketch, i, 1)) for i in range(first + 8, first, -1)])
        return F.when(full, F.conv(high_first, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))

    error = held(24) + F.greatest(x.n - held(16), F.lit(0).cast("long"))
    bare = F.when(full, F.overlay(sketch, F.lit(bytes(8)), F.lit(25), F.lit(8))).otherwise(sketch)
    found = F.call_function("approx_top_k_estimate", state.withField("sketch", bare), F.lit(k))
    said = F.transform(found, lambda e: F.struct(e["item"].alias("key"), e["count"].alias("count_lo"), (e["count"] + error).alias("count_hi")))
    seen = F.array(F.struct(_last(x).alias("key"), F.lit(1).cast("long").alias("count_lo"), error.alias("count_hi")))
    return F.when((F.size(said) > 0) | (x.n == 0), said).otherwise(seen)


def _approx_distinct(x: Context) -> Column:
    """Distinct values by a sketch of 4,096 registers that holds hashes of 26 bits and more while a window has few values, and is
    then exact but for rare collisions; a window costs what it has seen."""
    return F.when(x.n > 0, F.hll_sketch_estimate(x.use("_hll", F.hll_sketch_agg(x.rows(F.xxhash64(x.v)), F.lit(12)))))


@dataclass(frozen=True)
class Fold:
    build: Callable[..., Column]
    edges: tuple[str, ...] = ("INSIDE",)
    categorical: bool = False
    before: bool = False  # reads the sample before the window even where the window is empty


FOLDS: dict[str, Fold] = {
    "irate": Fold(_irate),
    "idelta": Fold(_idelta),
    "resets": Fold(_resets, ("INSIDE", "ANCHOR")),
    "changes": Fold(_changes, ("INSIDE", "ANCHOR"), True),
    "count_over_time": Fold(lambda x: F.when(x.n > 0, x.n.cast("double"))),
    "sum_over_time": Fold(_sum),
    "avg_over_time": Fold(_avg),
    "min_over_time": Fold(_min),
    "max_over_time": Fold(_max),
    "first_over_time": Fold(_first, categorical=True),
    "last_over_time": Fold(_last, categorical=True),
    "stddev_over_time": Fold(_stddev),
    "stdvar_over_time": Fold(_stdvar),
    "quantile_over_time": Fold(_quantile),
    "mad_over_time": Fold(_mad),
    "present_over_time": Fold(lambda x: F.when(x.n > 0, F.lit(1.0)), categorical=True),
    "ts_of_min_over_time": Fold(_ts_of("min")),
    "ts_of_max_over_time": Fold(_ts_of("max")),
    "ts_of_first_over_time": Fold(_ts_of("first"), categorical=True),
    "ts_of_last_over_time": Fold(_ts_of("last"), categorical=True),
    "deriv": Fold(_deriv),
    "predict_linear": Fold(_predict_linear),
    "double_exp_smoothing": Fold(_double_exp),
    "last_two_samples": Fold(_two_samples, categorical=True),
    "time_weighted_avg_over_time": Fold(_time_weighted, ("INSIDE", "ANCHOR", "SMOOTH"), before=True),
    "integral_over_time": Fold(_integral, ("INSIDE", "ANCHOR", "SMOOTH"), before=True),
    "range_over_time": Fold(lambda x: _max(x) - _min(x)),
    "sum2_over_time": Fold(lambda x: x.use("_sum2", F.sum(x.rows(x.v * x.v)))),
    "geomean_over_time": Fold(lambda x: F.exp(x.use("_log", F.avg(x.rows(F.when(x.v == 0, F.lit(-math.inf)).otherwise(F.ln(x.v))))))),
    "mode_over_time": Fold(_mode, categorical=True),
    "distinct_over_time": Fold(lambda x: F.when(x.n > 0, x.use("_distinct", F.size(F.collect_set(x.rows(x.v)))).cast("double")), categorical=True),
    "moments_over_time": Fold(_moments),
    "monotone_over_time": Fold(_monotone, ("INSIDE", "ANCHOR")),
    "ts_of_last_change_over_time": Fold(_last_change, ("INSIDE", "ANCHOR"), True),
    "interval_over_time": Fold(_interval),
    "stale_samples_over_time": Fold(lambda x: x.use("_stale", F.count_if(x.stale & (F.col("role") == INSIDE))).cast("double")),
    "m4_over_time": Fold(_m4),
    "active_duration_over_time": Fold(_active, ("INSIDE", "ANCHOR"), before=True),
    "gaps_over_time": Fold(_gaps, ("INSIDE", "ANCHOR")),
    "state_duration_over_time": Fold(_state_duration, ("INSIDE", "ANCHOR"), True, before=True),
    "approx_distinct_over_time": Fold(_approx_distinct, categorical=True),
    "approx_top_k_over_time": Fold(_top_k, categorical=True),
}


@dataclass(frozen=True)
class Member:
    """A fold by name with its parameters, under an alias."""

    name: str
    alias: str | None = None
    params: tuple[tuple[str, Any], ...] = ()

    @classmethod
    def of(cls, name: str, alias: str | None = None, **params: Any) -> Member:
        return cls(name, alias or name, tuple(params.items()))


#: Members that EXTRAPOLATE, ANCHOR and SMOOTH judge as counters, or as a gauge.
COUNTERS = {"rate": True, "increase": True, "delta": False}


def _change_sums(x: Context, counter: bool) -> dict[str, Column]:
    """What extrapolated() and anchored() read, as aggregates over the window's samples."""
    near = F.coalesce(x.pt > x.ws, F.lit(False)) if x.edge == "INSIDE" else F.coalesce(x.pt >= x.ws - x.lookback, F.lit(False))
    reset = x.row & near & (below(x.v, x.pv) | started(x.t, x.st, x.pt))
    t = x.rows(x.t)
    out = {"n": F.count(t), "first_t": F.min(t), "last_t": F.max(t), "adj": F.coalesce(F.sum(F.when(reset, x.pv)), F.lit(0.0)) if counter else F.lit(0.0)}
    for name, c in (("first", x.v), ("first_st", x.st), ("before_t", x.pt), ("before", x.pv)):
        out[name] = F.min_by(c, t)
    for name, c in (("last", x.v), ("after_t", x.nt), ("after", x.nv)):
        out[name] = F.max_by(c, t)
    return out


def _with_changes(out: DataFrame, x: Context, edge: str, grid: Grid, counter: bool) -> DataFrame:
    """``out`` with the change of counters (or gauges) at ``edge`` in a column of its own."""
    name = f"_change_{int(counter)}"
    out = out.select("*", F.struct("*").alias("_kept"))  # what follows has names of its own
    out = out.withColumns({n: F.col(f"_c{int(counter)}_{n}") for n in _change_sums(x, counter)} | {"at": F.lit(grid.start) + F.col("gi") * grid.step})
    if edge == "EXTRAPOLATE":
        return extrapolated(out, x.window, counter, False, keep=True).select("_kept.*", F.col("value").alias(name))
    value = anchored(F.col("at"), F.col("at") - x.window, x.lookback, counter, ResetPolicy(), edge == "SMOOTH")
    return out.select("_kept.*", value.alias(name))


def folded(df: DataFrame, grid: Grid, window, members: Sequence[Member], roles: Roles = Roles(), edge: str = "INSIDE", lookback=None, push: bool | None = None) -> tuple[Samples, DataFrame]:
    """(samples, one row per series and grid point with a column for each member).

    With EXTRAPOLATE, rates, increases and deltas are projected to the window's edges and all else stays inside.
    """
    window = checked_width(window)
    lookback = checked_width(lookback, "lookback") if lookback is not None else window
    for m in members:
        if m.name not in FOLDS and m.name not in COUNTERS:
            raise ValueError(f"no fold {m.name}")
        edges = ("EXTRAPOLATE", "ANCHOR", "SMOOTH") if m.name in COUNTERS else (*FOLDS[m.name].edges, "EXTRAPOLATE") if any(o.name in COUNTERS for o in members) else FOLDS[m.name].edges
        if edge not in edges:
            raise ValueError(f"{m.name} has no edge mode {edge}")
    own = [m for m in members if m.name in FOLDS]
    changes = sorted({COUNTERS[m.name] for m in members if m.name in COUNTERS})
    inner = "INSIDE" if edge == "EXTRAPOLATE" else edge
    numeric = bool(changes) or not all(FOLDS[m.name].categorical for m in own) or dict(df.dtypes).get(roles.value) == "double"
    s = prepared(df, grid, window, roles, inner, lookback if inner != "INSIDE" else 0, numeric=numeric, push=push)
    with_before = edge == "ANCHOR" and any(FOLDS[m.name].before for m in own)
    rows = fanned(s, (INSIDE, BEFORE) if with_before else (INSIDE,))
    if with_before:
        rows = rows.where((F.col("role") == INSIDE) | (F.col("t") >= F.col("ws") - lookback))
    x = Context(inner, lookback, window, numeric, with_before)
    finals = {m.alias or m.name: FOLDS[m.name].build(x, **dict(m.params)) for m in own}
    aggs = [c.alias(n) for n, c in x.aggs.items()] + [c.alias(f"_c{int(k)}_{n}") for k in changes for n, c in _change_sums(x, k).items()]
    out = rows.groupBy(*s.keys, "chunk", "gi").agg(*aggs)
    for counter in changes:
        out = _with_changes(out, x, edge, grid, counter)
    for m in members:
        if m.name in COUNTERS:
            value = F.col(f"_change_{int(COUNTERS[m.name])}")
            finals[m.alias or m.name] = value / F.lit(float(window)) if m.name == "rate" else value
    return s, out.select(*s.keys, "chunk", "gi", *[finals[m.alias or m.name].alias(m.alias or m.name) for m in members])


def over_time(df: DataFrame, name: str, grid: Grid, window, roles: Roles = Roles(), edge: str = "INSIDE", lookback=None, shape: str = "rows", push: bool | None = None, **params: Any) -> DataFrame:
    """One fold as rows (series, ts, value), dense rows, or lists."""
    s, out = folded(df, grid, window, [Member.of(name, "value", **params)], roles, edge, lookback, push)
    if shape == "rows":
        return shapes.rows(s, out)
    return shapes.dense(s, out) if shape == "dense" else shapes.lists(s, out)


def fold(df: DataFrame, grid: Grid, window, members: Sequence[Member], roles: Roles = Roles(), edge: str = "INSIDE", lookback=None, push: bool | None = None) -> DataFrame:
    """Several folds from one pass, as the fields of a struct."""
    s, out = folded(df, grid, window, members, roles, edge, lookback, push)
    out = out.select(*s.keys, "chunk", "gi", F.struct(*[m.alias or m.name for m in members]).alias("value"))
    return shapes.rows(s, out)
