"""Connected components by randomised contraction, as joins and map-side aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .durable import cut


def _pick(node: Column, draw: Column, round_: int) -> Column:
    return F.struct(F.xxhash64(draw, F.lit(round_)).alias("h"), draw.alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` for every end of the edges `a`, `b` (longs): nodes of one component share a root, one of them.

    Each round every node joins the neighbour, or itself, that draws the smallest hash, and edges inside a node vanish. A
    hub costs no more than its edges, since minima combine on the map side; a chain shrinks by a constant share however
    it is numbered, so rounds grow with the logarithm of the largest component. Null ends and loops are ignored; no
    edges give no rows.
    """
    live = cut(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    for round_ in range(200):
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(_pick(F.col("a"), F.col("b"), round_)).alias("m"))
        moved = cut(least.select("node", F.least(_pick(F.col("node"), F.col("node"), round_), "m")["v"].alias("root")))
        if labels is None:
            labels = moved
        else:
            step = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a, b = (moved.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        live = live.join(a, "a").join(b, "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        live = cut(live.where("a <> b").distinct())
    else:
        raise RuntimeError("components did not contract")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
