"""Targets, catchments and their cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.operators.relational import split_cached


def resolve_targets(links: DataFrame, site_ids: list | DataFrame | None = None, link_ids: list | DataFrame | None = None) -> DataFrame:
    """``link_id`` of the sites and links named, in a list or a table of one column, distinct; of all links if none is."""
    named = lambda c, ids: links.join(ids.toDF(c), c, "left_semi") if isinstance(ids, DataFrame) else links.where(F.col(c).isin(ids))
    chosen = [named(c, ids).select("link_id") for c, ids in (("site_id", site_ids), ("link_id", link_ids)) if isinstance(ids, DataFrame) or ids]
    if not chosen:
        return links.select("link_id").distinct()
    return (chosen[0].union(chosen[1]) if len(chosen) > 1 else chosen[0]).distinct()


def catchments(pairs: DataFrame, wanted: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``link_id, origin`` of all wanted catchments, and the part of it that was not cached and is to be appended."""
    known, missing = split_cached(wanted.select("link_id"), cached, "link_id")
    new = pairs.select(F.col("destination").alias("link_id"), "origin").join(missing, "link_id", "left_semi")
    return cached.join(known, "link_id", "left_semi").select("link_id", "origin").unionByName(new), new
