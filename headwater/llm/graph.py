"""Connected components of an undirected graph, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import checkpointed, let_go


def components(edges: DataFrame, saved: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); root is the smallest node that it reaches.

    Each round lets every node point at its smallest neighbour, shortens the
    pointers to their trees' roots by doubling, and contracts the edges to the
    roots.  A round at least halves the nodes that still have edges.  Steps are
    checkpointed, so each join has plain exchanges on both sides and adaptive
    execution can split a hub's rows; ``saved`` is what checkpoints them.  Null
    ends and loops are ignored.
    """
    edges = saved(edges.where(F.col("a") != F.col("b")).select("a", "b"))
    labels = None
    while True:
        let_go(edges.sparkSession)
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        up = saved(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up")))
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            step = saved(up.join(over, "up").select("node", F.col("over").alias("to"), (F.col("over") != F.col("up")).alias("moved")))
            up = step.select("node", F.col("to").alias("up"))
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            labels = saved(labels.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        at_a = saved(edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("to_a")), "a").select("to_a", "b"))
        edges = saved(
            at_a.join(up.select(F.col("node").alias("b"), F.col("up").alias("to_b")), "b")
            .where(F.col("to_a") != F.col("to_b"))
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
        if edges.isEmpty():
            return labels
