"""Connected components of an edge table, by hash-to-min with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges(a, b)`` of any orderable type -> ``(node, component)``: the least node it reaches.

    Each round gives a node the least label among itself, its neighbours and their labels' labels;
    both steps aggregate with a map-side minimum, so hubs cost no large group. Labels are cut by
    checkpoint. Self-loops and repeated edges do no harm; an empty table gives an empty one;
    null ends are dropped.
    """
    both = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut(both.union(both.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        # a node's label tells its own label about the smaller one found (hooking), as in hash-to-min
        least = near.union(labels).groupBy("node").agg(F.min("label").alias("least"))
        old = labels.select("node", "label")
        hook = least.join(old, "node").groupBy(F.col("label").alias("node")).agg(F.min("least").alias("root"))
        new = (
            least.join(hook, "node", "left")
            .select("node", F.least("least", F.coalesce("root", "least")).alias("mid"))
        )
        new = cut(new)
        jump = new.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        new = cut(new.join(jump, "mid", "left").select("node", F.coalesce("far", "mid").alias("label")))
        changed = new.join(old.withColumnRenamed("label", "before"), "node").where("label <> before")
        done = changed.limit(1).count() == 0
        labels = new
        if done:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
