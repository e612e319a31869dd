"""Grids by square tiles: what a cell needs of its neighbours is found inside its tile.

A cell is dealt to its tile, and to a neighbouring tile only where it lies on
their border, so one shuffle of little more than the grid does for all eight
neighbours.  A tile is a dense matrix of fixed size with a frame of one cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a side of a tile.
TILE = 128


class Tile:
    """One tile: ``own`` says which spots are cells of the tile, ``there`` which are cells at all; both have a frame of one."""

    def __init__(self, rows: pa.Table, numbers: dict[str, float]) -> None:
        r, c = rows["row"].to_numpy(), rows["col"].to_numpy()
        tr, tc = rows["tr"][0].as_py(), rows["tc"][0].as_py()
        self.at = (r - tr * TILE + 1, c - tc * TILE + 1)
        side = (TILE + 2, TILE + 2)
        self.there = np.zeros(side, bool)
        self.there[self.at] = True
        self.own = np.zeros(side, bool)
        self.own[1:-1, 1:-1] = self.there[1:-1, 1:-1]
        self.values: dict[str, np.ndarray] = {}
        for name, missing in ({"cell_id": 0} | numbers).items():
            column = rows[name].combine_chunks()
            self.values[name] = np.full(side, missing, np.float64 if pa.types.is_floating(column.type) else np.int64)
            self.values[name][self.at] = column.fill_null(pa.scalar(missing, column.type)).to_numpy(zero_copy_only=False)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[name]

    @staticmethod
    def moved(a: np.ndarray, dr: int, dc: int, fill: float = 0) -> np.ndarray:
        """For every spot inside the frame the value at the spot (dr, dc) away; the frame gets ``fill``."""
        out = np.full_like(a, fill)
        out[1:-1, 1:-1] = a[1 + dr : a.shape[0] - 1 + dr, 1 + dc : a.shape[1] - 1 + dc]
        return out


def by_tile(cells: DataFrame, numbers: dict[str, float], solve: Callable[[Tile], pa.Table], schema: str) -> DataFrame:
    """What ``solve`` returns for every tile of ``cells`` (cell_id, row, col); ``numbers`` are the columns it reads, with what stands for none."""
    row, col = F.pmod("row", F.lit(TILE)), F.pmod("col", F.lit(TILE))
    edge = lambda x, k: F.lit(True) if k == 0 else x == (0 if k < 0 else TILE - 1)
    tr, tc = F.floor(F.col("row") / TILE), F.floor(F.col("col") / TILE)
    spots = [F.when(edge(row, a) & edge(col, b), F.struct((tr + a).alias("tr"), (tc + b).alias("tc"))) for a in (0, -1, 1) for b in (0, -1, 1)]
    dealt = cells.select("cell_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *numbers, F.explode(F.array(*spots)).alias("t")).where("t IS NOT NULL")

    def one(rows: pa.Table) -> pa.Table:
        return solve(Tile(rows, numbers))

    return dealt.select("t.tr", "t.tc", "cell_id", "row", "col", *numbers).groupBy("tr", "tc").applyInArrow(one, schema)
