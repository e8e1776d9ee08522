"""Connected components of a table of links by minimum labels, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by links, for every node that has one.

    Each round a node's root takes the least label among its neighbours and every label is then
    replaced by its own label, so a chain of n nodes needs about log2(n) rounds. A hub's links
    meet in a grouped minimum, which Spark combines before the shuffle; nothing is collected.
    Links with a null end and links of a node to itself count for nothing.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = stored(both.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("node"), F.least("u", "l").alias("l")))
    while True:
        at = label.select(F.col("node").alias("v"), F.col("l").alias("near"))
        near = both.join(at, "v").groupBy("u").agg(F.min("near").alias("near"))
        seen = label.join(near.withColumnRenamed("u", "node"), "node").select("node", "l", F.least("l", "near").alias("near"))
        roots = seen.groupBy(F.col("l").alias("node")).agg(F.min("near").alias("up"))
        took = seen.join(roots, "node", "left").select("node", "l", F.least("near", F.coalesce("up", "near")).alias("m"))
        jump = took.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        step = stored(took.join(jump, "m").select("node", "l", F.least("m", "mm").alias("m")))
        discard(label)
        if step.where("m < l").isEmpty():
            discard(both)
            return step.select("node", F.col("m").alias("component"))
        label = step.select("node", F.col("m").alias("l"))
        label.stored_at = step.stored_at
