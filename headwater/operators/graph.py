"""Directed in-trees as edge tables, traversed by pointer doubling.

A tree is a DataFrame of ``id`` and ``ds``, the next node downstream (null at an
outlet).  Step k holds each node's 2**k-th node downstream, so a path of any
length takes log2(length) joins; steps are checkpointed, which cuts the lineage.
A cycle never runs out of pointers, so more than ``LIMIT`` steps raise.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.steps import saved

LIMIT = 40


class CycleError(ValueError):
    """The edges do not form a forest."""


def jumps(edges: DataFrame) -> Iterator[DataFrame]:
    """``id, to``: each node's 2**k-th node downstream, for k = 0, 1, ... while there is any."""
    nodes = edges.select("id")
    step = saved(edges.where("ds IS NOT NULL").select("id", F.col("ds").alias("to")).join(nodes.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to"))
    for _ in range(LIMIT):
        if step.isEmpty():
            return
        yield step
        step = saved(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("over")), "to").select("id", F.col("over").alias("to")))
    raise CycleError(f"paths longer than 2**{LIMIT} or a cycle")


def closure(edges: DataFrame, destinations: DataFrame | None = None, origins: DataFrame | None = None) -> DataFrame:
    """``origin, destination, hops``: every node with each node downstream of it, itself included.

    With ``destinations`` or ``origins`` (id) only pairs that end or start there
    are formed.  Each round is one join of the pairs found so far with a step,
    and only its new pairs are written.
    """
    if destinations is not None and origins is not None:
        raise ValueError("give destinations or origins")
    wanted = edges.select("id") if destinations is None and origins is None else (destinations if destinations is not None else origins).select("id").distinct().join(edges.select("id"), "id", "left_semi")
    pairs = saved(wanted.select(F.col("id").alias("origin"), F.col("id").alias("destination"), F.lit(0).alias("hops")))
    for k, step in enumerate(jumps(edges)):
        hops = (F.col("hops") + 2**k).alias("hops")
        if origins is None:
            new = step.join(pairs.withColumnRenamed("origin", "to"), "to").select(F.col("id").alias("origin"), "destination", hops)
        else:
            new = pairs.join(step.withColumnRenamed("id", "destination"), "destination").select("origin", F.col("to").alias("destination"), hops)
        pairs = pairs.union(saved(new))
    return pairs


def upstream_sum(nodes: DataFrame, value: str, steps: list[DataFrame] | None = None) -> DataFrame:
    """``id, total``: the sum of ``value`` over each node and all nodes upstream of it, without forming the pairs."""
    total = nodes.select("id", F.col(value).alias("total"))
    for step in steps if steps is not None else jumps(nodes.select("id", "ds")):
        added = step.join(total, "id").groupBy(F.col("to").alias("id")).agg(F.sum("total").alias("added"))
        total = saved(total.join(added, "id", "left").select("id", (F.col("total") + F.coalesce("added", F.lit(0))).alias("total")))
    return total


def longest_upstream(nodes: DataFrame, value: str) -> DataFrame:
    """``id, longest``: the largest sum of ``value`` along any one path that ends above each node; 0 where nothing flows in.

    Each node carries the longest path found so far and the sum up to its next
    jump, so no pairs are formed.
    """
    state = nodes.select("id", F.lit(0).cast(nodes.schema[value].dataType).alias("longest"), F.col(value).alias("way"))
    for step in jumps(nodes.select("id", "ds")):
        ahead = step.join(state, "id")
        over = ahead.groupBy(F.col("to").alias("id")).agg(F.max(F.col("longest") + F.col("way")).alias("found"))
        on = step.join(state.select(F.col("id").alias("to"), F.col("way").alias("more")), "to").select("id", "more")
        state = state.join(over, "id", "left").join(on, "id", "left")
        state = saved(state.select("id", F.greatest("longest", F.coalesce("found", "longest")).alias("longest"), (F.col("way") + F.coalesce("more", F.lit(0))).alias("way")))
    return state.select("id", "longest")


def downstream_sum(nodes: DataFrame, value: str) -> DataFrame:
    """``id, total, outlet``: the sum of ``value`` over each node and all nodes downstream, and the last of these."""
    state = nodes.select("id", F.col(value).alias("total"), F.col("id").alias("outlet"))
    for step in jumps(nodes.select("id", "ds")):
        ahead = state.select(F.col("id").alias("to"), F.col("total").alias("more"), F.col("outlet").alias("end"))
        state = saved(state.join(step, "id", "left").join(ahead, "to", "left").select("id", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), F.coalesce("end", "outlet").alias("outlet")))
    return state


def first_marked(nodes: DataFrame, marked: str) -> DataFrame:
    """``id, first, steps``: the first node downstream, itself included, where ``marked`` holds; null if there is none."""
    cut = nodes.select("id", F.when(~F.coalesce(F.col(marked), F.lit(False)), F.col("ds")).alias("ds"), F.lit(1).alias("one"))
    ends = downstream_sum(cut, "one")
    targets = nodes.where(F.col(marked)).select(F.col("id").alias("outlet"), F.lit(True).alias("hit"))
    return ends.join(targets, "outlet", "left").select("id", F.when(F.col("hit"), F.col("outlet")).alias("first"), F.when(F.col("hit"), F.col("total") - 1).alias("steps"))


def depth(edges: DataFrame) -> DataFrame:
    """``id, depth``: nodes on the way to the outlet, itself included."""
    return downstream_sum(edges.withColumn("one", F.lit(1)), "one").select("id", F.col("total").alias("depth"))


def antichains(edges: DataFrame) -> DataFrame:
    """``id, unn_group, unn_group_size``: groups in which no node lies upstream of another.

    A node's group is the length of the longest chain upstream of it (Mirsky);
    nodes of one group are then never in relation.
    """
    longest = longest_upstream(edges.withColumn("one", F.lit(1)), "one").select("id", F.col("longest").alias("level"))
    named = longest.withColumn("unn_group", F.concat(F.lit("g"), F.lpad(F.col("level").cast("string"), 5, "0")))
    sizes = named.groupBy("unn_group").agg(F.count("*").alias("unn_group_size"))
    return named.join(sizes, "unn_group").select("id", "unn_group", "unn_group_size")


def strahler(edges: DataFrame) -> DataFrame:
    """``id, strahler``: 1 at heads; the largest order upstream, plus 1 where two or more tie at it.

    A node's order exceeds k if somewhere upstream, itself included, two nodes of
    order k or more meet.  So the orders come one by one, each from the meetings
    of the last by a sum over everything upstream; there are at most log2 of the
    nodes' number.
    """
    steps = list(jumps(edges))
    order = saved(edges.select("id", "ds", F.lit(1).alias("strahler")))
    for k in range(1, 64):
        meets = order.where((F.col("strahler") >= k) & F.col("ds").isNotNull()).groupBy(F.col("ds").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(1).alias("meets"))
        meets = saved(meets)
        if meets.isEmpty():
            return order.select("id", "strahler")
        marked = edges.select("id").join(meets, "id", "left").select("id", F.coalesce("meets", F.lit(0)).cast("long").alias("meets"))
        above = upstream_sum(marked, "meets", steps)
        order = saved(order.join(above, "id").select("id", "ds", F.when(F.col("total") > 0, k + 1).otherwise(F.col("strahler")).alias("strahler")))
    raise CycleError("orders beyond any tree's")


def path_max(nodes: DataFrame, value: str) -> DataFrame:
    """``id, top, outlet``: the largest ``value`` over each node and all downstream but the last of these, the outlet; null at outlets."""
    state = nodes.select("id", F.when(F.col("ds").isNotNull(), F.col(value)).alias("top"), F.col("id").alias("outlet"))
    for step in jumps(nodes.select("id", "ds")):
        ahead = state.select(F.col("id").alias("to"), F.col("top").alias("more"), F.col("outlet").alias("end"))
        state = saved(state.join(step, "id", "left").join(ahead, "to", "left").select("id", F.greatest("top", "more").alias("top"), F.coalesce("end", "outlet").alias("outlet")))
    return state
