"""Connected components as DataFrame operations: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for the nodes of ``edges`` (``u, v``) that are not
    the smallest of their component themselves.

    Self-links and repeated links do no harm; no edges give no rows. Each step is written to the shared folder
    and takes two shuffles of the edges; the number of steps grows with the logarithm of the longest chain.
    Nothing is collected but the two sums that tell when a step changes nothing.
    """
    now, before = written(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        last, now = now, written(_small_star(_large_star(now)), "edges")
        discard(last)
        if before is None and now.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
