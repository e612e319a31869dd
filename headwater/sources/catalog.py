"""The catalog of a dataset's layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed groups of layer names; a name that starts with dem_ is hydro, one that holds a weighting scheme iDW, any other loi.
NAMED = {
    "meta": ("site_id_col", "DEM_Extent", "loi_meta", "unnest_catchment"),
    "sample_points": ("snapped_points", "original_points"),
    "hydro": ("Elevation", "stream_links", "stream_lines", "stream_points", "Subbasins_poly", "Catchment_poly", "stream_points_attr", "stream_links_attr"),
    "flow_path": ("ds_flowpaths", "us_flowpaths"),
    "pwise_dist": ("funcon_pwise_dist", "fcon_pwise_dist"),
}


def classify_layers(layers: DataFrame) -> DataFrame:
    """``layer_name, data_type, data_group`` in order of type, group and name."""
    name = F.col("layer_name")
    group = F.when(name.startswith("dem_"), "hydro").when(name.rlike("iFLS|HAiFLS|iFLO|HAiFLO"), "iDW")
    for kind, names in NAMED.items():
        group = group.when(name.isin(*names), kind)
    return layers.select("layer_name", "data_type", group.otherwise("loi").alias("data_group")).orderBy("data_type", "data_group", "layer_name")
