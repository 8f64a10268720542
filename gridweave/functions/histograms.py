"""Algebra of histograms: classic ones with upper bounds, and exponential ones with a scale.

A histogram is a dict. Classic: count, sum, bounds (upper, inclusive; the last bucket has none), counts. Exponential:
count, sum, scale, zero_count, zero_threshold, pos and neg as dicts from bucket index to count. Bucket i holds
(base^i, base^(i+1)] with base 2^(2^-scale).
"""

from __future__ import annotations

import math
from typing import Any

Hist = dict[str, Any]

EXPONENTIAL = "struct<count:double,sum:double,scale:int,zero_count:double,zero_threshold:double,pos_offset:int,pos_counts:array<double>,neg_offset:int,neg_counts:array<double>>"
CLASSIC = "struct<count:double,sum:double,bounds:array<double>,counts:array<double>>"
#: Relative dips of cumulative counts up to this are rounding, and larger ones are repaired as well.
SMALL_DIP = 1e-12


def is_classic(h: Hist) -> bool:
    return "bounds" in h


def unpack(row: Any) -> Hist | None:
    """From a struct of either kind."""
    if row is None:
        return None
    r = row if isinstance(row, dict) else row.asDict()
    if "bounds" in r:
        return {"count": float(r["count"]), "sum": float(r["sum"]), "bounds": [float(x) for x in r["bounds"]], "counts": [float(x) for x in r["counts"]]}
    spread = lambda side: {int(r[f"{side}_offset"] or 0) + i: float(c) for i, c in enumerate(r[f"{side}_counts"] if r[f"{side}_counts"] is not None else []) if c}
    return {"count": float(r["count"]), "sum": float(r["sum"]), "scale": int(r["scale"]), "zero_count": float(r["zero_count"] or 0), "zero_threshold": float(r["zero_threshold"] or 0), "pos": spread("pos"), "neg": spread("neg")}


def pack(h: Hist | None) -> dict | None:
    if h is None or is_classic(h):
        return h
    out = {k: h[k] for k in ("count", "sum", "scale", "zero_count", "zero_threshold")}
    for side in ("pos", "neg"):
        b = {i: c for i, c in h[side].items() if c}
        lo, hi = (min(b), max(b)) if b else (0, -1)
        out[f"{side}_offset"], out[f"{side}_counts"] = lo, [b.get(i, 0.0) for i in range(lo, hi + 1)]
    return out


def bucket_index(v: float, scale: int) -> int:
    """The bucket of v > 0: upper-inclusive, so a power of the base is in the bucket below it."""
    i = math.ceil(math.log2(v) * 2.0**scale) - 1
    while upper(i, scale) < v:
        i += 1
    while upper(i - 1, scale) >= v:
        i -= 1
    return i


def upper(i: int, scale: int) -> float:
    try:
        return 2.0 ** ((i + 1) * 2.0**-scale)
    except OverflowError:
        return math.inf


def downscale(h: Hist, scale: int) -> Hist:
    """To a coarser scale: each bucket lies whole in one of the new ones."""
    k = h["scale"] - scale
    if k < 0:
        raise ValueError("a histogram cannot get a finer scale")
    out = dict(h, scale=scale)
    for side in ("pos", "neg"):
        merged: dict[int, float] = {}
        for i, c in h[side].items():
            merged[i >> k] = merged.get(i >> k, 0.0) + c
        out[side] = merged
    return out


def compact(h: Hist) -> Hist:
    """Without empty buckets."""
    return h if is_classic(h) else dict(h, pos={i: c for i, c in h["pos"].items() if c}, neg={i: c for i, c in h["neg"].items() if c})


def _widen(h: Hist, threshold: float) -> tuple[Hist, float]:
    """The zero bucket up to ``threshold``, or as far beyond as a bucket that straddles it reaches."""
    out = dict(h, pos=dict(h["pos"]), neg=dict(h["neg"]))
    for side in ("pos", "neg"):
        for i in sorted(out[side]):
            if upper(i - 1, h["scale"]) < threshold:
                if out[side][i]:
                    threshold = max(threshold, upper(i, h["scale"]))
                out["zero_count"] += out[side].pop(i)
    out["zero_threshold"] = threshold
    return out, threshold


def _matched(a: Hist, b: Hist) -> tuple[Hist, Hist]:
    scale = min(a["scale"], b["scale"])
    a, b = downscale(a, scale), downscale(b, scale)
    while a["zero_threshold"] != b["zero_threshold"]:
        t = max(a["zero_threshold"], b["zero_threshold"])
        a, t = _widen(a, t)
        b, t = _widen(b, t)
    return a, b


def _combine(a: Hist, b: Hist, sign: float) -> Hist:
    if is_classic(a) != is_classic(b):
        raise ValueError("classic and exponential histograms do not mix")
    if is_classic(a):
        if a["bounds"] != b["bounds"]:
            raise ValueError("bounds differ")
        return {"count": a["count"] + sign * b["count"], "sum": a["sum"] + sign * b["sum"], "bounds": a["bounds"], "counts": [x + sign * y for x, y in zip(a["counts"], b["counts"])]}
    a, b = _matched(a, b)
    out = dict(a, count=a["count"] + sign * b["count"], sum=a["sum"] + sign * b["sum"], zero_count=a["zero_count"] + sign * b["zero_count"])
    for side in ("pos", "neg"):
        out[side] = {i: a[side].get(i, 0.0) + sign * b[side].get(i, 0.0) for i in {*a[side], *b[side]}}
    return out


def add(a: Hist, b: Hist) -> Hist:
    return _combine(a, b, 1.0)


def subtract(a: Hist, b: Hist) -> Hist:
    return _combine(a, b, -1.0)


def scaled(h: Hist, by: float) -> Hist:
    if is_classic(h):
        return dict(h, count=h["count"] * by, sum=h["sum"] * by, counts=[c * by for c in h["counts"]])
    return dict(h, count=h["count"] * by, sum=h["sum"] * by, zero_count=h["zero_count"] * by, pos={i: c * by for i, c in h["pos"].items()}, neg={i: c * by for i, c in h["neg"].items()})


def detect_reset(before: Hist, now: Hist) -> bool:
    """Whether any bucket or the count fell, or the layout became finer than it can have by counting on."""
    if now["count"] < before["count"]:
        return True
    if is_classic(now):
        return now["bounds"] != before["bounds"] or any(x < y for x, y in zip(now["counts"], before["counts"]))
    if now["scale"] > before["scale"] or now["zero_threshold"] < before["zero_threshold"]:
        return True
    a, b = _matched(before, now)
    return b["zero_count"] < a["zero_count"] or any(b[s].get(i, 0.0) < c for s in ("pos", "neg") for i, c in a[s].items())


def monotone_repair(cumulative: list[float]) -> list[float]:
    """Cumulative counts that never fall: rates of buckets may, by rounding or where scrapes were missed."""
    out: list[float] = []
    for c in cumulative:
        out.append(c if not out or c >= out[-1] or math.isnan(c) else out[-1])
    return out


def from_values(values: list[float], scale: int | None = None, bounds: list[float] | None = None) -> Hist:
    if bounds is not None:
        counts = [0.0] * (len(bounds) + 1)
        for v in values:
            counts[next((i for i, b in enumerate(bounds) if v <= b), len(bounds))] += 1
        return {"count": float(len(values)), "sum": math.fsum(values), "bounds": list(bounds), "counts": counts}
    h: Hist = {"count": float(len(values)), "sum": math.fsum(values), "scale": scale or 0, "zero_count": 0.0, "zero_threshold": 0.0, "pos": {}, "neg": {}}
    for v in values:
        if v == 0:
            h["zero_count"] += 1
        else:
            side, i = ("pos" if v > 0 else "neg"), bucket_index(abs(v), h["scale"])
            h[side][i] = h[side].get(i, 0.0) + 1
    return h


def from_classic(rows: list[tuple[float, float]], total: float | None = None) -> Hist | None:
    """From (upper bound, cumulative count) rows; the row with bound +Inf is the count, and without it there is none."""
    rows = sorted(rows)
    if not rows or rows[-1][0] != math.inf:
        return None
    fixed = monotone_repair([c for _, c in rows])
    return {"count": fixed[-1], "sum": math.nan if total is None else total, "bounds": [b for b, _ in rows[:-1]], "counts": [c - (fixed[i - 1] if i else 0.0) for i, c in enumerate(fixed)]}


def buckets(h: Hist) -> list[tuple[float, float, float]]:
    """(low, high, count) in order of value."""
    if is_classic(h):
        edges = [-math.inf, *h["bounds"], math.inf]
        return [(edges[i], edges[i + 1], c) for i, c in enumerate(h["counts"])]
    out = [(-upper(i, h["scale"]), -upper(i - 1, h["scale"]), c) for i, c in sorted(h["neg"].items(), reverse=True)]
    if h["zero_count"]:
        low = -h["zero_threshold"] if h["neg"] else 0.0
        out.append((low, h["zero_threshold"] if h["pos"] or not h["neg"] else 0.0, h["zero_count"]))
    return out + [(upper(i - 1, h["scale"]), upper(i, h["scale"]), c) for i, c in sorted(h["pos"].items())]


def _between(h: Hist, low: float, high: float, part: float) -> float:
    """The value that leaves ``part`` of a bucket below: along its logarithm in exponential buckets, else along a line."""
    if is_classic(h) or low <= 0 <= high or low == high:
        return low + (high - low) * part
    if low > 0:
        return low * (high / low) ** part
    return -(-low * (high / low) ** part)


def quantile(h: Hist, phi: float) -> float:
    if math.isnan(phi) or h["count"] <= 0:
        return math.nan
    if phi < 0 or phi > 1:
        return -math.inf if phi < 0 else math.inf
    rank, seen, all_ = phi * h["count"], 0.0, [b for b in buckets(h) if b[2] > 0]
    if is_classic(h):
        all_ = buckets(h)
    for low, high, c in all_:
        if c > 0 and seen + c >= rank:
            if is_classic(h):
                if high == math.inf:
                    return h["bounds"][-1] if h["bounds"] else math.nan
                if low == -math.inf:
                    if high <= 0:
                        return high
                    low = 0.0
            return _between(h, low, high, (rank - seen) / c)
        seen += c
    return all_[-1][1] if all_ else math.nan


def fraction(h: Hist, low: float, high: float) -> float:
    """The share of observations in [low, high], with those that are zero where a bound is zero."""
    if h["count"] <= 0 or math.isnan(low) or math.isnan(high):
        return math.nan
    if low >= high:
        return 0.0

    def rank(x: float, closed: bool) -> float:
        seen = 0.0
        for a, b, c in buckets(h):
            if x > b or (x == b and (closed or a < b)):  # a bucket without width holds observations of x itself
                seen += c
                continue
            if x <= a:
                break
            if is_classic(h):
                if a == -math.inf:
                    a = 0.0 if b > 0 else a
                if math.isinf(a) or math.isinf(b) or x <= a:
                    break
                part = (x - a) / (b - a)
            elif a <= 0 <= b:
                part = (x - a) / (b - a)
            elif a > 0:
                part = math.log(x / a) / math.log(b / a)
            else:
                part = 1 - math.log(-x / -b) / math.log(a / b)
            return seen + c * part
        return seen

    return max(0.0, (rank(high, True) - rank(low, False)) / h["count"])


def moments(h: Hist) -> tuple[float, float]:
    """Mean and variance, a bucket's observations at its geometric middle (its middle where it is classic)."""
    if h["count"] <= 0:
        return math.nan, math.nan
    mean, total = h["sum"] / h["count"], 0.0
    for low, high, c in buckets(h):
        if is_classic(h):
            low = 0.0 if low == -math.inf and high > 0 else low
            at = low if math.isinf(high) else high if math.isinf(low) else (low + high) / 2
        else:
            at = 0.0 if low <= 0 <= high else math.copysign(math.sqrt(low * high), low)
        total += c * (at - mean) ** 2
    return mean, total / h["count"]


def increase(samples: list[tuple[int, Hist]], at: int, window: int, is_delta: bool = False) -> Hist | None:
    """The change over ordered (time, histogram) samples of a window, projected to its edges like a counter's, without the clamp at zero."""
    if len(samples) < 2:
        return None
    total = subtract(samples[-1][1], samples[0][1])
    if not is_delta:
        for (_, a), (_, b) in zip(samples, samples[1:]):
            if detect_reset(a, b):
                total = add(total, a)
    first, last = samples[0][0], samples[-1][0]
    span = float(last - first)
    average = span / (len(samples) - 1)
    edges = [e if e <= average * 1.1 else average / 2 for e in (first - (at - window), at - last)]
    return scaled(total, (span + edges[0] + edges[1]) / span)


def change(samples: list[tuple[int, Hist]], before: tuple[int, Hist] | None, after: tuple[int, Hist] | None, at: int, window: int, smooth: bool, is_delta: bool = False) -> Hist | None:
    """The change from the left edge to the right one, like a counter's without thresholds or clamps. It begins at the sample
    ``before`` the window, or with ``smooth`` at the histogram on the line from it to the first one inside, and then ends at
    that on the line to the one ``after`` the point. A reset between two begins anew at nothing."""
    if len(samples) + (before is not None) + (smooth and after is not None) < 2:
        return None
    fell = lambda a, b: not is_delta and detect_reset(a, b)
    first, last = samples[0], samples[-1]
    left, right = before[1] if before else first[1], last[1]
    resets = [a for (_, a), (_, b) in zip(samples, samples[1:]) if fell(a, b)]
    if before and smooth:
        low = scaled(before[1], 0.0) if fell(before[1], first[1]) else before[1]
        left = add(low, scaled(subtract(first[1], low), (at - window - before[0]) / (first[0] - before[0])))
    elif before and fell(before[1], first[1]):
        resets.append(before[1])
    if after and smooth:
        high = add(last[1], after[1]) if fell(last[1], after[1]) else after[1]
        right = add(last[1], scaled(subtract(high, last[1]), (at - last[0]) / (after[0] - last[0])))
    total = subtract(right, left)
    for h in resets:
        total = add(total, h)
    return total
