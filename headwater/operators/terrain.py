"""Grids as cell tables: neighbours, flow directions, accumulation, streams, distances.

A grid has ``row``, ``col``, ``cell_id`` and value columns such as ``elev``.
Neighbours come from dealing each cell to its eight spots and an equi-join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.steps import saved
from headwater.operators import graph
from headwater.operators.tiles import Tile, by_tile

#: Fixed flow-direction codes: row step, column step, code.
D8 = ((-1, 1, 1), (0, 1, 2), (1, 1, 4), (1, 0, 8), (1, -1, 16), (0, -1, 32), (-1, -1, 64), (-1, 0, 128))


def neighbours(cells: DataFrame, *columns: str) -> DataFrame:
    """``cell_id, code, n_cell_id, n_{column}...``: each cell with those around it; the code points from the cell to the other."""
    spots = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(k).alias("code")) for r, c, k in D8]))
    dealt = cells.select("cell_id", "row", "col", spots.alias("o")).select("cell_id", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), "o.code")
    other = cells.select("row", "col", F.col("cell_id").alias("n_cell_id"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return dealt.join(other, ["row", "col"]).drop("row", "col")


def step_length(code: Column, cell: float = 1.0) -> Column:
    """Length of a step in the direction of ``code``."""
    return F.when(code.isin(1, 4, 16, 64), F.sqrt(F.lit(2.0)) * cell).otherwise(F.lit(cell))


def _steepest(tile: Tile) -> pa.Table:
    """``cell_id, d8, ds, around``: code and id of the steepest lower neighbour, and how many neighbours there are."""
    z = np.where(np.isnan(tile["z"]), np.inf, tile["z"])
    known = tile["null"] == 0
    best, code, ds, around = np.zeros(z.shape), np.zeros(z.shape, np.int32), np.zeros(z.shape, np.int64), np.zeros(z.shape, np.int32)
    with np.errstate(invalid="ignore"):
        for dr, dc, k in sorted(D8, key=lambda o: o[2]):
            there = Tile.moved(tile.there, dr, dc)
            drop = (z - Tile.moved(z, dr, dc)) / (math.sqrt(2.0) if dr and dc else 1.0)
            better = known & there & Tile.moved(known, dr, dc) & (drop > best)
            best[better], code[better] = drop[better], k
            ds[better] = Tile.moved(tile["cell_id"], dr, dc)[better]
            around += there
    own = tile.own
    return pa.table({"cell_id": tile["cell_id"][own], "d8": code[own], "ds": pa.array(ds[own], mask=code[own] == 0), "around": around[own]})


def _pointers(cells: DataFrame, elev: str) -> DataFrame:
    some = cells.select("cell_id", "row", "col", F.col(elev).cast("double").alias("z"), F.col(elev).isNull().cast("int").alias("null"))
    return by_tile(some, {"z": math.inf, "null": 1}, _steepest, "cell_id long, d8 int, ds long, around int")


def d8_pointer(cells: DataFrame, elev: str = "elev") -> DataFrame:
    """``cell_id, d8, ds``: code and id of the steepest lower neighbour, ties to the lowest code; 0 and null at pits."""
    return _pointers(cells, elev).select("cell_id", "d8", "ds")


def accumulation(pointers: DataFrame) -> DataFrame:
    """``cell_id, accum``: how many cells flow through each cell, itself not counted."""
    total = graph.upstream_sum(pointers.select(F.col("cell_id").alias("id"), "ds").withColumn("one", F.lit(1).cast("long")), "one")
    return total.select(F.col("id").alias("cell_id"), (F.col("total") - 1).alias("accum"))


def streams(accum: DataFrame, threshold: int) -> DataFrame:
    """The cells whose accumulation exceeds the threshold."""
    return accum.where(F.col("accum") > threshold)


def stream_links(pointers: DataFrame, stream: DataFrame) -> DataFrame:
    """``cell_id, link_id``: stream cells by segment between heads, confluences and outlets; the id is the segment's first cell.

    A cell with other than one inflowing stream cell starts a link, which
    follows the pointers until the next such cell.
    """
    some = saved(pointers.join(stream.select("cell_id"), "cell_id", "left_semi").select("cell_id", "ds"))
    inflow = some.groupBy(F.col("ds").alias("cell_id")).agg(F.count("*").alias("n"), F.min("cell_id").alias("only"))
    back = some.join(inflow, "cell_id", "left").select(F.col("cell_id").alias("id"), F.when(F.col("n") == 1, F.col("only")).alias("ds"), F.lit(1).alias("one"))
    return graph.downstream_sum(back, "one").select(F.col("id").alias("cell_id"), F.col("outlet").alias("link_id"))


def subbasins(pointers: DataFrame, links: DataFrame) -> DataFrame:
    """``cell_id, link_id``: the first stream link that each cell's flow reaches; null where it reaches none."""
    nodes = pointers.join(links.select("cell_id", F.lit(True).alias("stream")), "cell_id", "left").select(F.col("cell_id").alias("id"), "ds", "stream")
    first = graph.first_marked(nodes, "stream")
    return first.select(F.col("id").alias("cell_id"), F.col("first").alias("at")).join(links.select(F.col("cell_id").alias("at"), "link_id"), "at", "left").select("cell_id", "link_id")


def flow_distance(pointers: DataFrame, targets: DataFrame, cell: float = 1.0) -> DataFrame:
    """``cell_id, target, distance``: length of the flow path to the first target cell; null where it reaches none."""
    nodes = pointers.join(targets.select("cell_id", F.lit(True).alias("hit")), "cell_id", "left")
    nodes = nodes.select(F.col("cell_id").alias("id"), F.when(F.col("hit").isNull(), F.col("ds")).alias("ds"), F.when(F.col("hit").isNull() & F.col("ds").isNotNull(), step_length(F.col("d8"), cell)).otherwise(F.lit(0.0)).alias("step"), "hit")
    walked = graph.downstream_sum(nodes, "step")
    ends = nodes.where("hit").select(F.col("id").alias("outlet"), F.lit(True).alias("reached"))
    return walked.join(ends, "outlet", "left").select(F.col("id").alias("cell_id"), F.when(F.col("reached"), F.col("outlet")).alias("target"), F.when(F.col("reached"), F.col("total")).alias("distance"))


#: Label of what drains to the edge of the grid.
OUTSIDE = -1


def _passes(tile: Tile) -> pa.Table:
    """``a, b, h``: the lowest pass from each basin of the tile's cells to each other one beside it."""
    found = []
    for dr, dc, _ in D8:
        other = Tile.moved(tile["basin"], dr, dc)
        met = tile.own & Tile.moved(tile.there, dr, dc) & (tile["basin"] != other)
        found.append((tile["basin"][met], other[met], np.maximum(tile["z"], Tile.moved(tile["z"], dr, dc))[met]))
    a, b, h = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((h, b, a))
    a, b, h = a[order], b[order], h[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table({"a": a[first], "b": b[first], "h": h[first]})


def _way_out(tile: Tile) -> pa.Table:
    """``cell_id, to``: the lowest neighbour that is no higher, then the one with the smallest id; only for cells with one."""
    low, to = np.full(tile.own.shape, np.inf), np.full(tile.own.shape, np.iinfo(np.int64).max)
    for dr, dc, _ in D8:
        z, k = Tile.moved(tile["filled"], dr, dc), Tile.moved(tile["cell_id"], dr, dc)
        better = Tile.moved(tile.there, dr, dc) & (z <= tile["filled"]) & ((z < low) | ((z == low) & (k < to)))
        low[better], to[better] = z[better], k[better]
    has = tile.own & np.isfinite(low)
    return pa.table({"cell_id": tile["cell_id"][has], "to": to[has]})


def fill_depressions(cells: DataFrame, elev: str = "elev") -> DataFrame:
    """``cell_id, filled``: elevations raised to their spill level, so that every cell drains to the edge.

    Cells with fewer than eight neighbours are the edge and keep their elevation.
    Every other cell belongs to the pit that its flow ends in.  Basins spill over
    the lowest pass to another basin; in each round every basin points over its
    lowest pass, those whose pointers lead outside are settled by the highest
    pass on the way, and those that point at each other merge.  A round at least
    halves the basins, so rounds grow with the logarithm of their number.
    """
    pointers = saved(_pointers(cells, elev).withColumn("edge", F.when(F.col("around") < 8, True)))
    edge = pointers.where("edge").select("cell_id", "edge")
    ends = graph.downstream_sum(pointers.select(F.col("cell_id").alias("id"), F.when(F.col("edge").isNull(), F.col("ds")).alias("ds"), F.lit(1).alias("one")), "one")
    ends = ends.join(edge.withColumnRenamed("cell_id", "outlet"), "outlet", "left")
    basin = saved(ends.select(F.col("id").alias("cell_id"), F.when(F.col("edge"), OUTSIDE).otherwise(F.col("outlet")).alias("basin")))
    at = cells.select("cell_id", "row", "col", F.col(elev).cast("double").alias("z")).join(basin, "cell_id")
    passes = by_tile(at, {"z": math.inf, "basin": OUTSIDE}, _passes, "a long, b long, h double")
    passes = saved(passes.groupBy("a", "b").agg(F.min("h").alias("h")))
    levels = saved(basin.select(F.col("basin").alias("id")).distinct().select("id", F.col("id").alias("group"), F.lit(None).cast("double").alias("level")))
    while not passes.where(F.col("a") != OUTSIDE).isEmpty():
        best = passes.where(F.col("a") != OUTSIDE).groupBy("a").agg(F.min(F.struct("h", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")).alias("x"))
        best = saved(best.select(F.col("a").alias("id"), F.col("x.b").alias("ds"), F.col("x.h").alias("h")))
        back = best.select(F.col("id").alias("ds"), F.col("ds").alias("back"))
        mutual = (F.col("back") == F.col("id")) & (F.col("id") < F.col("ds"))
        tree = best.join(back, "ds", "left").select("id", F.when(F.coalesce(mutual, F.lit(False)), None).otherwise(F.col("ds")).alias("ds"), "h")
        outside = cells.sparkSession.range(1).select(F.lit(OUTSIDE).cast("long").alias("id"), F.lit(None).cast("long").alias("ds"), F.lit(None).cast("double").alias("h"))
        ended = saved(graph.path_max(saved(tree.select(F.col("id").cast("long").alias("id"), F.col("ds").cast("long").alias("ds"), F.col("h").cast("double").alias("h")).union(outside)), "h"))
        levels = saved(levels.join(ended.withColumnRenamed("id", "group"), "group", "left").select("id", F.coalesce("outlet", "group").alias("group"), F.greatest("level", "top").alias("level")))
        new = lambda c: ended.select(F.col("id").alias(c), F.col("outlet").alias(f"to_{c}"))
        passes = passes.join(new("a"), "a").join(new("b"), "b").where("to_a <> to_b").groupBy(F.col("to_a").alias("a"), F.col("to_b").alias("b")).agg(F.min("h").alias("h"))
        passes = saved(passes)
    found = cells.select("cell_id", F.col(elev).alias("z")).join(basin, "cell_id").join(levels.select(F.col("id").alias("basin"), "level"), "basin", "left")
    return found.select("cell_id", F.greatest("z", "level").alias("filled"))


def breach_depressions(cells: DataFrame, elev: str = "elev", rounds: int = 10_000) -> DataFrame:
    """``cell_id, breached``: an approximation that lowers, instead of raising.

    Pits of the filled surface's flats are cut: a cell that filling would raise
    keeps its elevation, and every cell on its way out is lowered to at most it.
    The way out follows the filled surface, then the smallest cell id.  Rounds
    double the part of the ways that is done: a cell's level is the least above
    it within 2**k steps, and when a round changes none, none changes any more,
    even where ways run in circles on flats.
    """
    filled = saved(cells.select("cell_id", "row", "col", F.col(elev).alias("z")).join(fill_depressions(cells, elev), "cell_id"))
    way = by_tile(filled.select("cell_id", "row", "col", F.col("filled").cast("double").alias("filled")), {"filled": math.inf}, _way_out, "cell_id long, to long")
    raised = filled.where("filled > z").select(F.col("cell_id").alias("to"))
    step = saved(way.join(raised, "to", "left_semi").select("cell_id", "to"))
    involved = step.select("cell_id").union(step.select("to")).distinct()
    state = saved(filled.join(involved, "cell_id", "left_semi").select("cell_id", F.col("z").alias("low")))
    for _ in range(rounds):
        sent = step.join(state, "cell_id").groupBy(F.col("to").alias("cell_id")).agg(F.min("low").alias("sent"))
        new = saved(state.join(sent, "cell_id", "left").select("cell_id", F.least("low", F.coalesce("sent", "low")).alias("low"), (F.col("sent") < F.col("low")).alias("moved")))
        state = new.select("cell_id", "low")
        if new.where("moved").isEmpty():
            return filled.select("cell_id", "z").join(state, "cell_id", "left").select("cell_id", F.coalesce("low", "z").alias("breached"))
        step = saved(step.join(step.select(F.col("cell_id").alias("to"), F.col("to").alias("over")), "to").select("cell_id", F.col("over").alias("to")))
    raise ValueError("not breached within the rounds given")


def gradients(cells: DataFrame, value: str = "elev", cell: float = 1.0) -> DataFrame:
    """``cell_id, gx, gy``: Horn's gradient over the eight neighbours; cells at the edge have none."""
    east, south = {1: 1, 2: 2, 4: 1, 16: -1, 32: -2, 64: -1}, {4: 1, 8: 2, 16: 1, 64: -1, 128: -2, 1: -1}
    part = lambda by: F.sum(sum((F.when(F.col("code") == k, w * F.col(f"n_{value}")).otherwise(0.0) for k, w in by.items()), F.lit(0.0))) / (8 * cell)
    around = neighbours(cells, value).groupBy("cell_id").agg(part(east).alias("gx"), part(south).alias("gy"), F.count("*").alias("n"))
    return around.where("n = 8").select("cell_id", "gx", "gy")


def smooth(cells: DataFrame, value: str = "elev", degrees: float = 15.0) -> DataFrame:
    """``cell_id, smoothed``: feature-preserving smoothing.

    A neighbour weighs the more the closer its surface normal lies to the cell's,
    and nothing beyond ``degrees``; so slopes are smoothed and breaks are kept.
    Cells at the edge, which have no normal, keep their value.
    """
    least = math.cos(math.radians(degrees))
    known = saved(cells.select("cell_id", "row", "col", value).join(gradients(cells, value), "cell_id", "left"))
    both = neighbours(known, value, "gx", "gy").join(known.select("cell_id", "gx", "gy"), "cell_id")
    dot = F.col("gx") * F.col("n_gx") + F.col("gy") * F.col("n_gy") + 1
    size = lambda p: F.sqrt(F.col(f"{p}gx") * F.col(f"{p}gx") + F.col(f"{p}gy") * F.col(f"{p}gy") + 1)
    weight = F.greatest(dot / (size("") * size("n_")) - least, F.lit(0.0))
    around = both.withColumn("w", weight * weight).groupBy("cell_id").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(f"n_{value}")).alias("s"))
    own = (1 - least) ** 2
    mean = (own * F.col(value) + F.coalesce("s", F.lit(0.0))) / (own + F.coalesce("w", F.lit(0.0)))
    return known.join(around, "cell_id", "left").select("cell_id", mean.alias("smoothed"))


def horn_slope(cells: DataFrame, value: str = "elev", cell: float = 1.0) -> DataFrame:
    """``cell_id, slope``: Horn's gradient over the eight neighbours; cells at the edge have none."""
    return gradients(cells, value, cell).select("cell_id", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("slope"))


def trim_to_reference(chunks: DataFrame, threshold: float, compat: bool = False) -> DataFrame:
    """``line, chunk``: chunks (line, chunk, share) of lines that a reference overlaps by more than ``threshold``.

    With ``compat`` everything from a line's first such chunk on is kept, as far
    as the reference touches it at all; the first one is given by its place among
    the touched chunks, and a line without any keeps all its touched chunks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the overlap threshold lies in (0, 1]")
    if not compat:
        return chunks.where(F.col("share") > threshold).select("line", "chunk")
    touched = chunks.where("share > 0").withColumn("place", F.row_number().over(Window.partitionBy("line").orderBy("chunk")))
    start = F.coalesce(F.min(F.when(F.col("share") > threshold, F.col("place"))).over(Window.partitionBy("line")), F.lit(0))
    return touched.withColumn("start", start).where("chunk >= start").select("line", "chunk")


def nearest_stream(cells: DataFrame, stream: DataFrame, reach: int) -> DataFrame:
    """``cell_id, distance``: straight distance, in cells, to the nearest stream cell within ``reach``; null beyond.

    Stream cells are dealt to the squares around theirs, so the join is by square.
    """
    from headwater.operators.relational import nearest_within

    point = lambda df: df.select(F.col("cell_id").alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return nearest_within(point(cells), point(stream), float(reach)).select(F.col("id").alias("cell_id"), "distance")


def burn(cells: DataFrame, near: DataFrame, depth: float, step: float = 1.0, slope_reach: float | None = None, slope_depth: float = 0.0) -> DataFrame:
    """``cell_id, burned``: elevations lowered by ceil(depth / 3) within each of three nested distances, and along a sloped approach."""
    third, d = F.ceil(F.lit(depth / 3)), F.col("distance")
    graded = third * sum(((d <= k * step).cast("int") for k in (3, 2, 1)), F.lit(0))
    sloped = F.when(d <= slope_reach, (slope_reach - d) / slope_reach * slope_depth).otherwise(0.0) if slope_reach else F.lit(0.0)
    lowered = F.col("elev") - F.coalesce(graded, F.lit(0)) - F.coalesce(sloped, F.lit(0.0))
    return cells.select("cell_id", "elev").join(near, "cell_id", "left").select("cell_id", lowered.alias("burned"))


def one_hot(cells: DataFrame, column: str, values: list) -> DataFrame:
    """``cells`` with a column ``{column}_{value}`` for each value, 1 or null; a layer with one value keeps its own name."""
    if len(values) == 1:
        return cells.withColumn(column, F.when(F.col(column) == F.lit(values[0]), 1))
    return cells.withColumns({f"{column}_{v}": F.when(F.col(column) == F.lit(v), 1) for v in values})


def resample(cells: DataFrame, value: str, factor: int, categorical: bool = False) -> DataFrame:
    """Cells ``factor`` times as wide: the mean of the numeric values, or the commonest category (ties to the smallest)."""
    coarse = cells.select(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), value)
    if not categorical:
        return coarse.groupBy("row", "col").agg(F.avg(value).alias(value))
    counts = coarse.where(F.col(value).isNotNull()).groupBy("row", "col", value).agg(F.count("*").alias("n"))
    return counts.groupBy("row", "col").agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))
