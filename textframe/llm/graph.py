"""Connected components of a large set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframe.llm._common import BROADCAST_BYTES, fits, hot_keys, spread_join, stored


def components(links: DataFrame, a: str = "a", b: str = "b", broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """(node, root) for every node of the links (two columns of one type); root is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label
    of that label, so the rounds grow with the logarithm of a component's width. Labels
    are written below spark.checkpoint.dir after each round, and broadcast while they have at
    most `broadcast` bytes. Beyond that, a node with many links, or a label with many nodes, is
    looked up where its rows are (`spread_join`), not in one task.
    Links with a null, and those of a node with itself, are left out. No links give no rows.
    """
    # written first: links computed twice could differ from each other, and would not be the same both ways
    pairs = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b"), "pairs")
    both = stored(pairs.union(pairs.select("b", "a")).distinct(), "links")
    each = stored(both.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")), "degrees")
    labels = stored(each.select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "labels")
    small = fits(labels, broadcast)  # as many rows in each round
    hubs = None if small else stored(hot_keys(each.select(F.col("a").alias("b"), "n"), "b"), "hubs")
    while True:
        known = labels.withColumnRenamed("node", "b")
        met = both.join(F.broadcast(known), "b") if small else spread_join(both, known, "b", hubs, "inner")
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        if small:
            moved = lower.join(F.broadcast(labels.select(F.col("node").alias("root"), F.col("root").alias("higher"))), "root")
        else:
            lower = stored(lower, "lower")
            sizes = lower.groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("n"))
            up = stored(sizes.join(labels, "node").select(F.col("node").alias("root"), F.col("root").alias("higher"), "n"), "roots")
            moved = spread_join(lower, up, "root", hot_keys(up, "root"), "inner")
        moved = stored(moved.select("node", F.least("root", "higher").alias("root"), "was"), "labels")
        labels = moved.select("node", "root")
        if moved.filter("root <> was").isEmpty():
            return labels
