"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, scratch, stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component), the smallest node reachable, of each node of the edges (u, v); nothing is collected but the hot nodes.

    Neighbours are reduced to minima before they are shuffled, and the minimum of a node of many edges goes to as many
    tasks as its edges are dealt over, so that a hub loads no task. Rounds stop when the edges are stars; each round's
    edges are a written table. With fewer ``rounds`` nodes of equal component are connected, but connected nodes may have
    different ones.
    """
    with scratch():
        now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before, done = None, 0
        while rounds is None or done < rounds:
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before or not state[0]:
                break
            before, done = state, done + 1
            ways = _both_ways(now)
            least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
            hot = hot_keys(least.select("u", "n"), 2 * state[0])
            large = dealt_join(ways.filter("v > u"), least.select("u", "m"), ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = dealt_join(large, low, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            now = stage(small.filter("u <> v").distinct(), "edges")
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        return stage(ends, "components", keep=True)
