"""Folds over streams: windows with watermarks, and rates that are given as soon as a grid point has passed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.walk import increase
from ..plans.grid import checked_width


def windowed(stream: DataFrame, ts: str, late: str, window: str, slide: str | None, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates by event-time window; rows later than ``late`` behind the newest are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = stream.withWatermark(ts, late).groupBy(w, *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def rate_stream(stream: DataFrame, key: str, ts: str, value: str, late: str, window, step) -> DataFrame:
    """(key, at, value): the extrapolated rate over (at - window, at] at multiples of ``step`` ticks, per tick.

    State is one window of samples a key. A point is emitted once the watermark has passed it, so late samples within
    ``late`` count; those later still are dropped.
    """
    window, step = checked_width(window), checked_width(step, "step")
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        times, values, done = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], None)
        for pdf in batches:
            times += (pdf["_t"]).astype("int64").tolist()
            values += pdf["_v"].astype(float).tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        samples: dict[int, float] = {}
        for t, v in sorted(zip(times, values)):
            samples[t] = v
        order = sorted(samples)
        out = []
        if order:
            at = (order[0] // step + 1) * step if done is None else done + step
            if order[0] % step == 0 and done is None:
                at = order[0]
            while at <= mark and at - window < order[-1]:
                total = increase([(t, samples[t], None) for t in order if at - window < t <= at], at, window)
                if total is not None:
                    out.append((k[0], at, total / window))
                done, at = at, at + step
            if done is not None:
                order = [t for t in order if t > done + step - window]
        if order:
            state.update((order, [samples[t] for t in order], done))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, (order[-1] + window) // 1000))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "at", "value"])

    slim = stream.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withWatermark(ts, late).select(key, ts, F.unix_micros(F.col(ts)).alias("_t"), F.col(value).alias("_v"))
    out = slim.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at bigint, value double", "t array<bigint>, v array<double>, done bigint", "append", "EventTimeTimeout")
    return out.select(key, F.timestamp_micros("at").alias("at"), "value")
