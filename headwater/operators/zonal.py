"""Zonal statistics in two phases, and weighted summaries of whole catchments.

Cells are aggregated once by subbasin; a catchment's summary merges the partials
of its subbasins over the closure, so cells never meet the closure's pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.stats import NUMERIC, WEIGHTED, numeric_partials, weighted_mean, weighted_partials
from headwater.functions.steps import saved


def zone_partials(cells: DataFrame, zone: str, numeric: list[str], categories: dict[str, list], weights: list[str]) -> DataFrame:
    """A row for each zone: partials of numeric columns, category counts, both plain and weighted, and cell counts.

    ``categories`` maps a column to its values; a category's column is
    ``{column}_{value}``.  ``n_cells`` counts null cells too.  Weighted variances
    are about the zone's mean, which a first pass over the cells finds.
    """
    if weights and numeric:
        means = cells.groupBy(zone).agg(*[weighted_mean(x, w).alias(f"__{x}_{w}") for x in numeric for w in weights])
        cells = cells.join(means, zone)
    out = {"n_cells": F.count(F.lit(1))}
    for x in numeric:
        out |= numeric_partials(x)
        for w in weights:
            out |= weighted_partials(x, w, f"__{x}_{w}")
    for c, values in categories.items():
        for v in values:
            hit = F.col(c) == F.lit(v)
            out[f"{c}_{v}_n"] = F.count_if(hit)
            for w in weights:
                out[f"{c}_{v}_{w}_n"] = F.sum(F.when(hit, F.col(w)).otherwise(F.lit(0.0)))
    for w in weights:
        out[f"{w}_total"] = F.sum(w)
    return cells.groupBy(zone).agg(*[c.alias(n) for n, c in out.items()])


def merge_over(pairs: DataFrame, partials: DataFrame, zone: str, numeric: list[str], categories: dict[str, list], weights: list[str], stats: tuple[str, ...] = ("mean", "sd", "min", "max", "sum")) -> DataFrame:
    """Summaries by destination of ``pairs`` (origin, destination), columns ``{var}_{scheme}_{stat}`` and ``{cat}_{scheme}_prop``."""
    out = {}
    for x in numeric:
        for s in stats:
            if s in NUMERIC:
                out[f"{x}_lumped_{s}"] = NUMERIC[s](x)
            for w in weights:
                if s in WEIGHTED:
                    out[f"{x}_{w}_{s}"] = WEIGHTED[s](x, w)
    for c, values in categories.items():
        for v in values:
            out[f"{c}_{v}_lumped_prop"] = F.sum(f"{c}_{v}_n") / F.sum("n_cells")
            for w in weights:
                out[f"{c}_{v}_{w}_prop"] = F.sum(f"{c}_{v}_{w}_n") / F.nullif(F.sum(f"{w}_total"), F.lit(0.0))
    joined = pairs.join(partials.withColumnRenamed(zone, "origin"), "origin")
    # variances are about the mean of the catchment's lowest zone, or of all zones where that has none
    means = [*(x for x in numeric), *(f"{x}_{w}" for x in numeric for w in weights)]
    if means:
        over = partials.agg(*[F.avg(f"{m}_mean").alias(m) for m in means]).first()
        pivots = partials.select(F.col(zone).alias("destination"), *[F.col(f"{m}_mean").alias(f"{m}_pivot") for m in means])
        joined = joined.join(pivots, "destination", "left").fillna({f"{m}_pivot": over[m] for m in means if over[m] is not None})
    return joined.groupBy(F.col("destination").alias("link_id")).agg(*[c.alias(n) for n, c in out.items()])


def summarise(pairs: DataFrame, cells: DataFrame, zone: str, numeric: list[str], categories: dict[str, list] | None = None, weights: list[str] | None = None, stats: tuple[str, ...] = ("mean", "sd", "min", "max", "sum"), quantiles: tuple[float, ...] = ()) -> DataFrame:
    """Summaries of catchments by the names of statistics; ``median`` and ``quantiles`` need the cells, all others only the zones' partials."""
    unknown = [s for s in stats if s not in NUMERIC and s != "median"]
    if unknown:
        raise ValueError(f"no statistic {', '.join(unknown)}; there are {', '.join(NUMERIC)}, median")
    categories, weights = categories or {}, weights or []
    partials = saved(zone_partials(cells, zone, numeric, categories, weights))
    out = merge_over(pairs, partials, zone, numeric, categories, weights, stats)
    at = sorted({*quantiles, *([0.5] if "median" in stats else [])})
    for x in numeric if at else []:
        out = out.join(catchment_quantiles(pairs, cells, zone, x, at), "link_id", "left")
    return out


def catchment_quantiles(pairs: DataFrame, cells: DataFrame, zone: str, x: str, at: list[float]) -> DataFrame:
    """Exact quantiles over whole catchments, which no merge of partials gives: values are counted by zone first."""
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles lie in [0, 1]")
    counted = cells.where(F.col(x).isNotNull()).groupBy(F.col(zone).alias("origin"), x).agg(F.count("*").alias("n"))
    joined = pairs.join(counted, "origin").groupBy("destination", x).agg(F.sum("n").alias("n"))
    cols = [F.percentile(x, F.lit(q), F.col("n")).alias(f"{x}_lumped_" + ("median" if q == 0.5 else f"q{int(100 * q)}")) for q in at]
    return joined.groupBy(F.col("destination").alias("link_id")).agg(*cols)
