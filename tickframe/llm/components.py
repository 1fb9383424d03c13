"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import parts, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b).

    Each round takes the smallest root among a node's neighbours, then the
    root of that root, so chains shorten quickly.  Neighbour lists are only
    ever aggregated with min, so a hub is combined before the shuffle.
    """
    few = max(1, parts(edges.sparkSession) // 8)  # edge tables are far smaller than the data
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .filter("a <> b").distinct().coalesce(few), "edges")
    roots = staged(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("root")).coalesce(few), "roots")
    while True:
        near = (both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("near")))
        step = (roots.join(near, roots.node == near.a, "left")
                .select("node", F.col("root").alias("old"), F.least("root", "near").alias("new")))
        up = roots.select(F.col("node").alias("up"), F.col("root").alias("top"))
        step = staged(step.join(up, step.new == up.up, "left")
                      .select("node", "old", F.least("new", F.coalesce("top", "new")).alias("root")).coalesce(few), "roots")
        changed = step.filter("old <> root").limit(1).count()
        roots = step.select("node", "root")
        if not changed:
            return roots
