"""Folds over windows that are not a grid's: bounds per group, or the time before each of one's own anchors.

Samples and windows of a series meet in buckets of time as wide as the widest window, so a pair is made only of
what is near, and the join is an equality that spreads a hot series over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.grid import checked_width
from ..plans.roles import Roles
from .folds import FOLDS, Context, Member
from .samples import ranked, tick_of, time_of


def window_fold(df: DataFrame, windows: DataFrame, members: Sequence[Member], roles: Roles = Roles(), widest=None) -> DataFrame:
    """Each member over (window_start, window_end] for each row of ``windows`` (keys, window_start, window_end).

    Windows without a sample have null members. ``widest`` bounds the windows' width and is found by a pass over
    them if it is not given. Folds are INSIDE ones.
    """
    roles = roles.resolve(df)
    kind = df.schema[roles.ts].dataType
    for m in members:
        if m.name not in FOLDS or "INSIDE" not in FOLDS[m.name].edges:
            raise ValueError(f"no fold {m.name} over windows")
    spans = windows.select("*", tick_of(windows, "window_start").alias("_ws"), tick_of(windows, "window_end").alias("_at"))
    if widest is None:
        widest = spans.agg(F.max(F.col("_at") - F.col("_ws"))).first()[0] or 1
    bucket = checked_width(max(1, int(widest)), "window")
    spans = spans.withColumn("_id", F.struct(*roles.keys, "_ws", "_at"))
    distinct = spans.select(*roles.keys, "_ws", "_at").distinct()
    to_bucket = lambda c: F.call_function("div", c - F.pmod(c, F.lit(bucket)), F.lit(bucket))
    wide = distinct.withColumn("_b", F.explode(F.sequence(to_bucket(F.col("_ws")), to_bucket(F.col("_at")))))
    st = tick_of(df, roles.start_ts) if roles.start_ts else F.lit(None).cast("long")
    stale = F.coalesce(F.col(roles.stale), F.lit(False)) if roles.stale else F.lit(False)
    rows = df.where(F.col(roles.ts).isNotNull() & F.col(roles.value).isNotNull())
    rows = rows.select(*roles.keys, tick_of(df, roles.ts).alias("t"), F.col(roles.value).alias("v"), st.alias("st"), stale.alias("stale"))
    rows = rows.withColumn("_b", to_bucket(F.col("t")))
    rows = ranked(rows, (*roles.keys, "_b"))
    met = rows.join(wide, [*roles.keys, "_b"]).where((F.col("t") > F.col("_ws")) & (F.col("t") <= F.col("_at"))).drop("_b")
    by = Window.partitionBy(*roles.keys, "_ws", "_at").orderBy("t")
    met = met.select("*", *[f("t").over(by).alias(n + "t") for n, f in (("p", F.lag), ("n", F.lead))], *[f("v").over(by).alias(n + "v") for n, f in (("p", F.lag), ("n", F.lead))])
    met = met.withColumn("role", F.lit(0)).withColumn("at", F.col("_at")).withColumn("ws", F.col("_ws"))
    x = Context("INSIDE", 0, bucket, True, False)
    finals = [FOLDS[m.name].build(x, **dict(m.params)).alias(m.alias or m.name) for m in members]
    out = met.groupBy(*roles.keys, "_ws", "_at").agg(*[c.alias(n) for n, c in x.aggs.items()]).select(*roles.keys, "_ws", "_at", *finals)
    back = distinct.join(out, [*roles.keys, "_ws", "_at"], "left")
    return back.select(*roles.keys, time_of(kind, F.col("_ws")).alias("window_start"), time_of(kind, F.col("_at")).alias("window_end"), *[m.alias or m.name for m in members])


def anchor_fold(df: DataFrame, anchors: DataFrame, window, members: Sequence[Member], roles: Roles = Roles(), anchor: str = "ts") -> DataFrame:
    """Each member over (anchor - window, anchor] for each row of ``anchors`` (keys and a time): a window join."""
    window = checked_width(window)
    kind = anchors.schema[anchor].dataType
    tick = tick_of(anchors, anchor)
    spans = anchors.select(*roles.keys, time_of(kind, tick - window).alias("window_start"), F.col(anchor).alias("window_end"))
    return window_fold(df, spans, members, roles, window)
