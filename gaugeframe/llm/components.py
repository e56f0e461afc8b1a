"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: longs); the component is its least node.

    Large-star and small-star steps by turns: each node's neighbours are hung on the least of them, which takes about
    log(n) rounds; a round is two aggregations and two joins, and its result is written before the next one.
    """
    pairs = lambda df: df.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(pairs(edges), "edges")
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the least neighbour
        large = pairs(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: smaller neighbours, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = pairs(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))))
        now = stored(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
