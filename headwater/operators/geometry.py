"""Geometry as sets of grid cells and ordered vertices.

A shape is the set of cells (row, col) that it covers, by a key; a line is a
table of vertices (line_id, seq, x, y).  Overlays are equi-joins on the cell.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.functions.steps import saved
from headwater.operators import graph
from headwater.operators.relational import numbered, paired
from headwater.operators.terrain import D8
from headwater.operators.tiles import Tile, by_tile

CELL = ["row", "col"]


def _offsets(reach: float, cap: str) -> list[tuple[int, int]]:
    if cap not in ("round", "flat"):
        raise ValueError("a cap is round or flat")
    n = int(reach)
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if cap == "flat" or a * a + b * b <= reach * reach]


def buffer(grid: DataFrame, shape: DataFrame, reach: float, cap: str = "round") -> DataFrame:
    """``row, col`` of the cells of ``grid`` within ``reach`` of ``shape``; of a negative reach, those of the shape farther than it from all others.

    ``round`` measures straight distances, ``flat`` along the axes.  A shape's
    cell is dealt to the spots around it, so the join is by cell.
    """
    if reach < 0:
        outside = grid.select(*CELL).join(shape.select(*CELL).distinct(), CELL, "left_anti")
        return shape.select(*CELL).distinct().join(buffer(grid, outside, -reach, cap), CELL, "left_anti")
    spots = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _offsets(reach, cap)]))
    dealt = shape.select(*CELL).distinct().select("row", "col", spots.alias("o")).select((F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col")).distinct()
    return grid.select(*CELL).join(dealt, CELL, "left_semi")


def dissolve(cells: DataFrame, key: str) -> DataFrame:
    """Union of all shapes of one ``key``."""
    return cells.select(key, *CELL).distinct()


def overlap_share(shapes: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``key, share``: the part of each shape's cells that ``other`` covers."""
    hit = dissolve(shapes, key).join(other.select(*CELL).distinct().withColumn("__in", F.lit(1)), CELL, "left")
    return hit.groupBy(key).agg(F.avg(F.coalesce("__in", F.lit(0))).alias("share"))


def centroids(cells: DataFrame, key: str) -> DataFrame:
    return dissolve(cells, key).groupBy(key).agg(F.avg("col").alias("x"), F.avg("row").alias("y"))


def extent(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def near_edge(cells: DataFrame, reach: int) -> DataFrame:
    """Cells within ``reach`` cells of the border of their own extent."""
    e = extent(cells).first()
    if e.r0 is None:
        return cells.limit(0)
    return cells.where(F.least(F.col("row") - e.r0, e.r1 - F.col("row"), F.col("col") - e.c0, e.c1 - F.col("col")) < reach)


def _parts(tile: Tile, steps: list[tuple[int, int]]) -> pa.Table:
    """``cell_id, region, beside``: each cell's part of the tile, named by its least cell; again with each cell beyond the border that it is connected with."""
    place = np.full(tile.own.shape, -1)
    place[tile.own] = np.argsort(np.argsort(tile["cell_id"][tile.own]))  # numbers in the order of ids
    ids, label = np.sort(tile["cell_id"][tile.own]), np.arange(tile.own.sum())
    pairs, out = [], []
    for dr, dc in steps:
        met = tile.own & Tile.moved(tile.there, dr, dc) & (tile["v"] == Tile.moved(tile["v"], dr, dc))
        other = Tile.moved(place, dr, dc, -1)
        inside, beyond = met & (other >= 0), met & (other < 0)
        pairs.append((place[inside], other[inside]))
        out.append((place[beyond], Tile.moved(tile["cell_id"], dr, dc)[beyond]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while len(a):
        np.minimum.at(label, label[a], label[b])
        while not np.array_equal(label, label[label]):
            label = label[label]
        some = label[a] != label[b]
        a, b = a[some], b[some]
    near, beside = (np.concatenate(x) for x in zip(*out))
    own = place[tile.own]
    return pa.table({"cell_id": ids[np.concatenate([own, near])], "region": ids[label[np.concatenate([own, near])]], "beside": pa.array(np.concatenate([np.zeros(len(own), np.int64), beside]), mask=np.arange(len(own) + len(near)) < len(own))})


def regions(cells: DataFrame, value: str | None = None, diagonal: bool = False) -> DataFrame:
    """``cell_id, region``: connected parts of ``cells`` (cell_id, row, col), of equal ``value`` if one is named; named by their least cell.

    Parts are found inside tiles first; only pairs of parts across a tile's
    border go on.  Every part points at its least neighbouring part, pointers are followed by
    doubling and parts contracted; a round at least halves those that can grow.
    """
    some = cells.select("cell_id", "row", "col") if value is None else cells.where(F.col(value).isNotNull()).select("cell_id", "row", "col", F.col(value).alias("v"))
    part = partial(_parts, steps=[(r, c) for r, c, _ in D8 if diagonal or not (r and c)])
    if value is None:
        some = some.withColumn("v", F.lit(0).cast("long"))
    elif not isinstance(some.schema["v"].dataType, (T.IntegralType, T.FractionalType)) or isinstance(some.schema["v"].dataType, T.DecimalType):
        names = saved(some.select("v").distinct())
        some = some.join(numbered(names, [F.col("v")], "k"), "v").select("cell_id", "row", "col", F.col("k").cast("long").alias("v"))
    found = saved(by_tile(some, {"v": 0}, part, "cell_id long, region long, beside long"))
    label = found.where("beside IS NULL").select("cell_id", "region")
    across = found.where("beside IS NOT NULL").select("beside", F.col("region").alias("a")).distinct()
    edges = saved(across.join(label.select(F.col("cell_id").alias("beside"), F.col("region").alias("b")), "beside").select("a", "b").distinct())
    whole = saved(edges.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("region")))
    while not edges.isEmpty():
        least = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"))
        ends = saved(graph.downstream_sum(saved(least.select("id", F.when(F.col("b") < F.col("id"), F.col("b")).alias("ds"), F.lit(1).alias("one"))), "one").select("id", "outlet"))
        whole = saved(whole.join(ends.withColumnRenamed("id", "region"), "region", "left").select("id", F.coalesce("outlet", "region").alias("region")))
        to = lambda c: ends.select(F.col("id").alias(c), F.col("outlet").alias(f"to_{c}"))
        edges = saved(edges.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
    return label.withColumnRenamed("region", "id").join(whole, "id", "left").select("cell_id", F.coalesce("region", "id").alias("region"))


def without_holes(grid: DataFrame, shape: DataFrame) -> DataFrame:
    """``cell_id`` of ``shape`` (cell_id) and of all cells of ``grid`` that it encloses: parts of the rest that do not reach the border."""
    rest = saved(grid.join(shape.select("cell_id").distinct(), "cell_id", "left_anti").select("cell_id", *CELL))
    parts = regions(rest)
    open_ = near_edge(grid.select("cell_id", *CELL), 1).join(parts, "cell_id").select("region").distinct()
    return shape.select("cell_id").distinct().union(parts.join(open_, "region", "left_anti").select("cell_id"))


def pairwise_distances(points: DataFrame, group: str) -> DataFrame:
    """``group, a, b, distance`` of all pairs of ``points`` (id, x, y) within a group."""
    two = paired(points.select(group, "id", "x", "y"), group, "id")
    dx, dy = F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")
    return two.select(group, F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.sqrt(dx * dx + dy * dy).alias("distance"))


def split_lines(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """``line_id, piece, seq, x, y``: lines cut at vertices (line_id, seq); a cut vertex ends one piece and begins the next."""
    at = cuts.select("line_id", "seq").distinct().groupBy("line_id").agg(F.array_sort(F.collect_list("seq")).alias("cuts"))
    first = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<long>")), lambda c: c < F.col("seq")))
    both = F.coalesce(F.array_contains("cuts", F.col("seq")), F.lit(False)) & (F.col("seq") > F.col("lo")) & (F.col("seq") < F.col("hi"))
    ends = Window.partitionBy("line_id")
    held = lines.withColumns({"lo": F.min("seq").over(ends), "hi": F.max("seq").over(ends)}).join(at, "line_id", "left")
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<long>")), lambda c: (c > F.col("lo")) & (c < F.col("hi")))
    first = F.size(F.filter(inner, lambda c: c < F.col("seq")))
    return held.select("line_id", F.explode(F.when(both, F.array(first, first + 1)).otherwise(F.array(first))).alias("piece"), "seq", "x", "y")


def rasterise(points: DataFrame, cell: float, value: str, order: str) -> DataFrame:
    """``row, col, value``: points (x, y) to cells; of several in a cell the last by ``order`` wins."""
    at = points.withColumns({"row": F.floor(F.col("y") / cell), "col": F.floor(F.col("x") / cell)})
    return at.groupBy(*CELL).agg(F.max_by(value, order).alias("value"))


def lines_to_cells(lines: DataFrame, cell: float = 1.0) -> DataFrame:
    """``line_id, row, col``: the cells on the way between successive vertices, a step a cell along the longer axis."""
    order = Window.partitionBy("line_id").orderBy("seq")
    at = lines.withColumns({"x2": F.coalesce(F.lead("x").over(order), F.col("x")), "y2": F.coalesce(F.lead("y").over(order), F.col("y"))})
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x")), F.abs(F.col("y2") - F.col("y"))) / cell), F.lit(1))
    steps = at.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    part = F.col("k") / F.col("n")
    on = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * part) / cell)
    return steps.select("line_id", on("y", "y2").alias("row"), on("x", "x2").alias("col")).distinct()


def to_points(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """``cells`` with the coordinates of their centres."""
    return cells.withColumns({"x": (F.col("col") + 0.5) * cell, "y": (F.col("row") + 0.5) * cell})


def to_polygons(cells: DataFrame, value: str) -> DataFrame:
    """``region, value, n_cells, r0, r1, c0, c1``: connected cells of one value as polygons."""
    found = regions(cells, value).join(cells.select("cell_id", *CELL, value), "cell_id")
    return found.groupBy("region").agg(F.first(value).alias("value"), F.count("*").alias("n_cells"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
