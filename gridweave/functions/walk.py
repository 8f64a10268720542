"""Rate of one series by a walk over its samples in order, one window resident at a time."""

from __future__ import annotations

import math
from collections import deque

from ..plans.grid import Grid

Sample = tuple[int, float, "int | None"]


def rank(s: Sample) -> tuple:
    """Of samples with one time the greatest stays: NaN under numbers, -0 under +0, no start under any."""
    _, v, st = s
    nan = math.isnan(v)
    return (not nan, 0.0 if nan else v, math.copysign(1.0, v), st is not None, st or 0)


def is_reset(now: Sample, before: Sample) -> bool:
    return now[1] < before[1] or (now[2] is not None and (now[2] >= now[0] or now[2] >= before[0]))


def increase(window: deque[Sample] | list[Sample], at: int, width: int) -> float | None:
    """The extrapolated increase of a counter over (at - width, at] from the samples in it."""
    if not window:
        return None
    first, last, ws = window[0], window[-1], at - width
    delta, before = 0.0, None
    for s in window:
        if before is not None and is_reset(s, before):
            delta += before[1]
        before = s
    delta += last[1] - first[1]
    n, start, value = len(window), first[0], first[1]
    from_start = first[2] is not None and ws < first[2] < first[0]
    if from_start:
        n, start, value, delta = n + 1, first[2], 0.0, delta + first[1]
    if n < 2:
        return None
    span = float(last[0] - start)
    average = span / (n - 1)
    limit = average * 1.1
    left, right = float(start - ws), float(at - last[0])
    if left > limit:
        left = average / 2
    if delta > 0 and value >= 0:
        left = min(left, span * (value / delta))
    if from_start:
        left = 0.0
    if right > limit:
        right = average / 2
    return delta * ((span + left + right) / span)


class RateWalk:
    """Takes samples in order of time and gives a value (or None) for each grid point as soon as it is known."""

    def __init__(self, grid: Grid, width: int):
        self.grid, self.width = grid, width
        self.window: deque[Sample] = deque()
        self.values: list[float | None] = []
        self.waiting: Sample | None = None  # may yet be replaced by a sample of the same time
        self.most = 0

    def feed(self, t: int, v: float, st: int | None = None) -> None:
        s = (t, v, st)
        if self.waiting is not None:
            if t == self.waiting[0]:
                self.waiting = max(self.waiting, s, key=rank)
                return
            if t < self.waiting[0]:
                raise ValueError("samples must be in order of time")
            self._settle()
        self.waiting = s

    def end(self) -> list[float | None]:
        if self.waiting is not None:
            self._settle()
        while len(self.values) < self.grid.count:
            self._emit()
        return self.values

    def _settle(self) -> None:
        s, self.waiting = self.waiting, None
        assert s is not None
        while len(self.values) < self.grid.count and self.grid.at(len(self.values)) < s[0]:
            self._emit()
        if len(self.values) < self.grid.count and s[0] > self.grid.at(len(self.values)) - self.width:
            self.window.append(s)
            self.most = max(self.most, len(self.window))

    def _emit(self) -> None:
        at = self.grid.at(len(self.values))
        while self.window and self.window[0][0] <= at - self.width:
            self.window.popleft()
        total = increase(self.window, at, self.width)
        self.values.append(None if total is None else total / float(self.width))


def rates(samples: list[Sample], grid: Grid, width: int) -> list[float | None]:
    walk = RateWalk(grid, width)
    for s in sorted(samples, key=lambda s: s[0]):
        walk.feed(*s)
    return walk.end()
