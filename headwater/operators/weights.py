"""Distance weights: outlets, distances above a pour point, layers that are there, and wide group-suffixed columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.stats import WEIGHTS

#: Schemes whose weights depend on the pour point.
TO_OUTLET = ("iFLO", "HAiFLO")
SUFFIXED = re.compile(r"^(iFLO|HAiFLO)_unn_group(.+)$")


def outlet_distance(pairs: DataFrame, cells: DataFrame, distance: str) -> DataFrame:
    """``cells`` (origin among their columns) by every destination of ``pairs``, with ``to_outlet``: the distance less the least in the catchment."""
    nearest = cells.groupBy("origin").agg(F.min(distance).alias("__m"))
    least = pairs.join(nearest, "origin").groupBy("destination").agg(F.min("__m").alias("__least"))
    return pairs.join(least, "destination").join(cells, "origin").withColumn("to_outlet", F.col(distance) - F.col("__least")).drop("__least")


def network_outlets(links: DataFrame, cells: DataFrame, reach: int = 2) -> DataFrame:
    """``link_id``: links without a link downstream that have a cell within ``reach`` cells of the grid's edge.

    ``cells`` has row, col and link_id (null off the network); the grid's extent is that of all its cells.
    """
    ends = links.where("ds_link_id IS NULL").select("link_id")
    extent = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if extent.r0 is None:
        return ends.limit(0)
    near = F.least(F.col("row") - extent.r0, extent.r1 - F.col("row"), F.col("col") - extent.c0, extent.c1 - F.col("col")) < reach
    return cells.where(F.col("link_id").isNotNull() & near).select("link_id").distinct().join(ends, "link_id", "left_semi")


def missing_weights(layers: list[str], schemes: list[str], groups: list[str] = ()) -> list[str]:
    """Layers that the weighting ``schemes`` need and ``layers`` does not hold, one for each group where a scheme has groups."""
    unknown = sorted(set(schemes) - set(WEIGHTS))
    if unknown:
        raise ValueError(f"no weighting scheme {', '.join(unknown)}; there are {', '.join(WEIGHTS)}")
    need = [s for s in schemes if s != "lumped" and s not in TO_OUTLET] + [f"{s}_unn_group{g}" for s in schemes if s in TO_OUTLET for g in groups]
    return [n for n in need if n not in set(layers)]


def require_weights(layers: list[str], schemes: list[str], groups: list[str] = ()) -> None:
    if missing := missing_weights(layers, schemes, groups):
        raise KeyError("missing weight layers: " + ", ".join(missing))


def gather_groups(cells: DataFrame, *keys: str) -> DataFrame:
    """Group-suffixed weight columns (``iFLO_unn_groupX``) as rows: ``keys``, unn_group and a column for each scheme.

    A cell that has no weight in a group has no row for it.
    """
    found = [(c, *m.groups()) for c in cells.columns if (m := SUFFIXED.match(c))]
    schemes, groups = sorted({s for _, s, _ in found}), sorted({g for *_, g in found})
    column = {(s, g): c for c, s, g in found}
    rows = [F.struct(F.lit(g).alias("unn_group"), *[(F.col(column[s, g]) if (s, g) in column else F.lit(None)).cast("double").alias(s) for s in schemes]) for g in groups]
    if not rows:
        raise ValueError("no group-suffixed weight column")
    out = cells.select(*keys, F.explode(F.array(*rows)).alias("__g")).select(*keys, "__g.*")
    return out.where(F.coalesce(*schemes).isNotNull())
