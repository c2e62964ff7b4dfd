"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.llm.common import forget, kept


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of edges (a, b), a result of kept().

    Each round a node takes the least root among its own, its neighbours' and that of its root, so paths shrink by
    more than half; it ends when no root has changed. Only that yes or no comes to the driver.
    """
    both = kept(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")).distinct(), "edges")
    roots = kept(both.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("next"), "root"), "next").groupBy("node").agg(F.min("root").alias("near"))
        own = roots.select("node", "root").join(near, "node")
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = kept(own.join(above, "root").select("node", F.least("root", "near", "above").alias("root"), F.col("root").alias("was")), "roots")
        done = step.where("was <> root").isEmpty()
        forget(roots)
        roots = step
        if done:
            forget(both)
            return roots
