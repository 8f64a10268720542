"""The evaluation grid, windows and scan bounds, checked before any plan is built."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

EPOCH = datetime(1970, 1, 1)
INT64 = range(-(1 << 63), 1 << 63)


def ticks(x: int | datetime | str) -> int:
    """Microseconds since the epoch of a naive datetime or ISO text; integers are ticks already."""
    if isinstance(x, str):
        x = datetime.fromisoformat(x)
    return (x - EPOCH) // timedelta(microseconds=1) if isinstance(x, datetime) else x


def width(x: int | timedelta) -> int:
    return x // timedelta(microseconds=1) if isinstance(x, timedelta) else x


@dataclass(frozen=True)
class Grid:
    """Points start, start + step, ..., end, both ends included, in ticks."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        for name in ("start", "end", "step"):
            value = getattr(self, name)
            if value is None:
                raise ValueError(f"grid {name} must not be NULL")
            if isinstance(value, bool) or not isinstance(value, int):
                raise ValueError(f"grid {name} must be a constant expression")
            if value not in INT64:
                raise ValueError(f"grid {name} overflows BIGINT")
        if self.step <= 0:
            raise ValueError("step must be positive")
        if self.end < self.start:
            raise ValueError("end must be >= start")
        if (self.end - self.start) % self.step:
            raise ValueError("step must evenly divide end - start")

    @classmethod
    def of(cls, start: int | datetime | str | None, end: int | datetime | str | None, step: int | timedelta | None) -> Grid:
        """From datetimes, ISO text or ticks."""
        return cls(*(x if x is None else ticks(x) for x in (start, end)), step if step is None else width(step))

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1

    def at(self, i: int) -> int:
        return self.start + i * self.step

    def index_of(self, t: int) -> int:
        """Floor of the distance in steps; not clamped to the grid."""
        return (t - self.start) // self.step

    def __iter__(self) -> Iterator[int]:
        return (self.at(i) for i in range(self.count))


def checked_width(window: int | timedelta | None, name: str = "window") -> int:
    if window is None:
        raise ValueError(f"{name} must not be NULL")
    window = width(window)
    if isinstance(window, bool) or not isinstance(window, int):
        raise ValueError(f"{name} must be a constant expression")
    if window <= 0:
        raise ValueError(f"{name} must be positive")
    return window


def contains(at: int, window: int, t: int) -> bool:
    """The window's only rule: open on the left, closed on the right."""
    return at - window < t <= at


def carries(at: int, lookback: int, t: int, stale: bool = False) -> bool:
    """A sample is carried to ``at`` from no further than ``lookback``, both ends included, and never past a stale mark."""
    return not stale and at - lookback <= t <= at


#: Ticks that an edge mode reads beyond the windows: (before, after), in lookbacks.
REACH = {"INSIDE": (0, 0), "EXTRAPOLATE": (0, 0), "ANCHOR": (1, 0), "SMOOTH": (1, 1), "LOOKBACK": (1, 0), "NEXT": (0, 1), "NEAREST": (1, 1), "INTERPOLATE": (1, 1)}


def scan_bounds(first: int, last: int, window: int, lookback: int, edge: str) -> tuple[int, int]:
    """The ticks, both included, outside of which no sample can matter to the points first..last."""
    before, after = REACH[edge]
    return first - window - before * lookback, last + after * lookback
