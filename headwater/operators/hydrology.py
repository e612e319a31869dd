"""From elevations to streams and links in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions import arguments
from headwater.functions.steps import saved
from headwater.operators import streamlinks, terrain


def process_flowdir(cells: DataFrame, threshold: float, depressions: str = "fill", burn_streams: DataFrame | None = None, burn_depth: float | None = None, burn_slope_reach: float | None = None, burn_slope_depth: float | None = None, reach: int = 8) -> dict[str, DataFrame]:
    """Layers by name, from ``cells`` (cell_id, row, col, elev): corrected elevations, pointers, accumulation and streams.

    ``burn_streams`` (cell_id, row, col) lowers the elevations near streams first.
    """
    limit = arguments.threshold(threshold)
    arguments.burning(burn_streams, burn_depth, burn_slope_depth)
    arguments.correction(depressions)
    final = cells.select("cell_id", "row", "col", "elev")
    if burn_streams is not None:
        lowered = terrain.burn(final, terrain.nearest_stream(final, burn_streams, reach), burn_depth or 0.0, 1.0, burn_slope_reach, burn_slope_depth or 0.0)
        final = saved(final.drop("elev").join(lowered.withColumnRenamed("burned", "elev"), "cell_id"))
    if depressions != "none":
        fixed = terrain.fill_depressions(final) if depressions == "fill" else terrain.breach_depressions(final)
        final = saved(final.drop("elev").join(fixed.toDF("cell_id", "elev"), "cell_id"))
    pointers = saved(terrain.d8_pointer(final))
    accum = saved(terrain.accumulation(pointers))
    return {"dem_raw": cells, "dem_final": final, "dem_d8": pointers, "dem_accum_d8": accum, "dem_streams_d8": terrain.streams(accum, limit)}


def generate_vectors(layers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Links, their table and classes, and subbasins, from the layers of ``process_flowdir``."""
    pointers = layers["dem_d8"]
    links = terrain.stream_links(pointers, layers["dem_streams_d8"])
    cells = saved(links.join(layers["dem_accum_d8"], "cell_id").join(layers["dem_final"], "cell_id"))
    length = cells.join(pointers.select("cell_id", "d8", "ds"), "cell_id").groupBy("link_id").agg(F.sum(F.when(F.col("ds").isNull(), 0.0).otherwise(terrain.step_length(F.col("d8")))).alias("link_lngth"))
    basins = saved(terrain.subbasins(pointers, cells.select("cell_id", "link_id")))
    area = basins.where("link_id IS NOT NULL").groupBy("link_id").agg(F.count("*").cast("double").alias("sbbsn_area"))
    table = streamlinks.link_table(pointers, cells).join(length, "link_id").join(area, "link_id", "left")
    return {"stream_cells": cells, "stream_links_attr": table, "stream_points": streamlinks.link_classes(pointers, cells), "Subbasins_poly": basins}
