"""Folds over plain lists, written apart from the engine and importing nothing from it."""

from __future__ import annotations

import math


def inside(samples, at, window):
    """Samples (t, v, st) in (at - window, at], one a time: numbers before NaN, then the greatest, then the latest start."""
    best = {}
    for t, v, st in samples:
        key = (not math.isnan(v), v if not math.isnan(v) else 0.0, math.copysign(1, v), st is not None, st or 0)
        if at - window < t <= at and (t not in best or key > best[t][0]):
            best[t] = (key, (t, v, st))
    return [best[t][1] for t in sorted(best)]


def rate(samples, at, window):
    w = inside(samples, at, window)
    if not w:
        return None
    ws = at - window
    delta = 0.0
    for (t0, v0, _), (t1, v1, s1) in zip(w, w[1:]):
        if v1 < v0 or (s1 is not None and (s1 >= t1 or s1 >= t0)):
            delta += v0
    delta += w[-1][1] - w[0][1]
    t, v, n = w[0][0], w[0][1], len(w)
    zero = w[0][2] is not None and ws < w[0][2] < t
    if zero:
        delta, t, v, n = delta + v, w[0][2], 0.0, n + 1
    if n < 2:
        return None
    span = float(w[-1][0] - t)
    mean = span / (n - 1)
    left, right = float(t - ws), float(at - w[-1][0])
    left = mean / 2 if left > mean * 1.1 else left
    if delta > 0 and v >= 0:
        left = min(left, span * (v / delta))
    left = 0.0 if zero else left
    right = mean / 2 if right > mean * 1.1 else right
    return delta * ((span + left + right) / span) / window


def equal(a, b, scale=1.0):
    """The one tolerance: rounding of some thousand additions at the scale of what was added."""
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b or (not math.isinf(a) and not math.isinf(b) and abs(a - b) <= 2 * 4095 * 2.0**-53 * abs(scale))
