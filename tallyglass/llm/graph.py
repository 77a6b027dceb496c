"""Connected components of an edge table by alternating star contractions, with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.store import materialise

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of ``edges`` with the smallest node it reaches.  Loops and repeated edges are fine.

    Every round hangs the neighbours of a node on the smallest of them, first the larger, then the smaller
    ones; minima combine in the map tasks.  Ends when a round changes nothing."""
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(big.alias("u"), small.alias("v")).distinct()
    now, seen = materialise(now, "edges"), None
    size = now.count()
    for _ in range(MAX_ROUNDS):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m"))
        now = both.join(least, both["u"] == least["u2"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "u2")
        hung = now.join(least, now["u"] == least["u2"])
        now = materialise(hung.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                          .select("e.u", "e.v").filter("u <> v").distinct(), "edges", 2 * size)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        size = state[0]
        if state == seen or state[0] == 0:
            break
        if state[0] == state[2] and not now.join(now.select(F.col("u").alias("v2")).distinct(), now["v"] == F.col("v2"), "left_semi").limit(1).count():
            break  # one parent each, and no parent has a parent: stars
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
