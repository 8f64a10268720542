"""All rows of the function surface: what each is, what it keeps, how exact it is, and which query shows it."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Family(Enum):
    RANGE, INSTANT, HIST, GRID, SERIES, PATTERN, META = range(7)


class State(Enum):
    RAW_WINDOW, SLICE, LAST_K, HIST_WINDOW, HIST_MERGE, SKETCH, SERIES, NFA, NONE = range(9)


class Determinism(Enum):
    """D0: equal bits however rows are dealt. D1: within rounding of a reordered sum. D2: within a sketch's bound."""

    D0, D1, D2 = range(3)


class Domain(Enum):
    COUNTER, GAUGE, NONNEG, ANY, HISTOGRAM, CATEGORICAL = range(6)


#: Rows whose partial holds a sum of doubles; only these may be less than exact.
SUMS = frozenset({"sum_over_time", "avg_over_time", "sum2_over_time", "geomean_over_time", "hist_sum_over_time", "hist_avg_over_time", "hist_merge", "hist_from_values"})


@dataclass(frozen=True)
class Row:
    name: str
    family: Family
    state: State
    det: Determinism
    query: str
    edges: tuple[str, ...] = ("INSIDE",)
    domain: Domain = Domain.ANY

    def is_valid(self) -> bool:
        """A partial sum of doubles is not exact; whatever is not a sum or a sketch is."""
        if self.name in SUMS:
            return self.det is Determinism.D1
        return self.det is (Determinism.D2 if self.name == "approx_top_k_over_time" else Determinism.D0)

    def implemented(self) -> bool:
        from ..operators import compose, counter, folds, grids, hist, pattern, rate, resample, series  # noqa: F401

        n = self.name
        if self.family is Family.SERIES:
            return n.removeprefix("series_") in series.SERIES
        if self.family is Family.HIST:
            short = n.removeprefix("hist_")
            if set(self.edges) != set(hist.EDGES.get(short, self.edges)):
                return False
            return short in hist.POINT or short.removesuffix("_over_time") in hist.OVER_TIME or hasattr(hist, short) or short == "resample"
        if self.family is Family.PATTERN:
            return hasattr(pattern, n)
        if n in folds.FOLDS and set(self.edges) != set(folds.FOLDS[n].edges):
            return False
        if n in folds.FOLDS or n in ("rate", "increase", "delta", "fold", "version", "grid", "grid_index", "stale_marker"):
            return True
        return hasattr(resample, n)


def _rows() -> list[Row]:
    R, S, D = Family, State, Determinism
    counter = ("EXTRAPOLATE", "ANCHOR", "SMOOTH")
    edges = dict.fromkeys(("rate", "increase", "delta"), counter) | dict.fromkeys(("resets", "changes"), ("INSIDE", "ANCHOR"))
    out = [
        Row("version", R.META, S.NONE, D.D0, "version", ()),
        Row("grid", R.GRID, S.NONE, D.D0, "ts_grid", ()),
        Row("grid_index", R.GRID, S.NONE, D.D0, "ts_grid_index", ()),
        Row("stale_marker", R.GRID, S.NONE, D.D0, "ts_stale_marker", ()),
        Row("rate", R.RANGE, S.RAW_WINDOW, D.D0, "ts_rate", counter, Domain.COUNTER),
        Row("increase", R.RANGE, S.RAW_WINDOW, D.D0, "ts_increase", counter, Domain.COUNTER),
        Row("delta", R.RANGE, S.RAW_WINDOW, D.D0, "ts_delta", counter, Domain.GAUGE),
        Row("resample", R.INSTANT, S.LAST_K, D.D0, "ts_resample_lookback", ("LOOKBACK", "INTERPOLATE", "NEXT", "NEAREST")),
        Row("resample_ts", R.INSTANT, S.LAST_K, D.D0, "ts_resample_ts", ("LOOKBACK", "NEXT", "NEAREST")),
        Row("fold", R.RANGE, S.RAW_WINDOW, D.D0, "ts_fold", ("INSIDE", *counter)),
    ]
    last = {"irate", "idelta", "last_over_time", "last_two_samples"}
    slices = {"count_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "first_over_time", "present_over_time", "ts_of_min_over_time", "ts_of_max_over_time", "ts_of_first_over_time", "ts_of_last_over_time", "range_over_time", "sum2_over_time", "geomean_over_time", "stale_samples_over_time", "m4_over_time"}
    from ..operators.folds import FOLDS

    for name, fold in FOLDS.items():
        state = S.SKETCH if name.startswith("approx_") else S.LAST_K if name in last else S.SLICE if name in slices else S.RAW_WINDOW
        det = D.D1 if name in SUMS else D.D2 if name == "approx_top_k_over_time" else D.D0
        out.append(Row(name, R.RANGE, state, det, f"ts_{name}", fold.edges, Domain.CATEGORICAL if fold.categorical else Domain.ANY))
    merges = {"hist_sum_over_time", "hist_avg_over_time", "hist_merge", "hist_from_values", "hist_from_classic"}
    for short in ("rate", "increase", "delta", "resets", "sum_over_time", "avg_over_time", "last_over_time", "first_over_time", "count_over_time", "present_over_time", "changes", "resample", "merge", "from_values", "from_classic", "quantile", "fraction", "count", "sum", "avg", "stddev", "stdvar", "downscale", "compact", "detect_reset"):
        name = f"hist_{short}"
        state = S.HIST_MERGE if name in merges else S.HIST_WINDOW if short.endswith(("_over_time", "rate", "increase", "delta", "resets", "changes")) else S.LAST_K if short == "resample" else S.NONE
        out.append(Row(name, R.HIST, state, D.D1 if name in SUMS else D.D0, name, edges.get(short, ("INSIDE",)), Domain.HISTOGRAM))
    from ..operators.series import SERIES

    out += [Row(f"series_{n}", R.SERIES, S.SERIES, D.D0, f"series_{n}", ()) for n in SERIES]
    out += [Row(n, R.PATTERN, S.NFA, D.D0, n, ()) for n in ("match_pattern", "sequence_match", "window_funnel", "retention")]
    return out


ROWS: dict[str, Row] = {r.name: r for r in _rows()}
