"""Connected components by alternating large and small stars, as joins and sums that keep no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node sends its larger neighbours to its least one. Small: its smaller neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where(F.col("v") < F.col("u"))
    near = materialize(near.distinct(), "components-near")
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least.select("u", F.least("u", "m").alias("m")), "components-least")
    joined = near.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v; orderable): root is the least node of its component."""
    now = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "components-edges")
    before = _mark(now)
    if before[0]:
        for _ in range(most_rounds):
            now = materialize(_star(_star(now, True), False), "components-edges")
            after = _mark(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
