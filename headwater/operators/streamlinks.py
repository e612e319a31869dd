"""Stream links: link tables and classes, optional attributes, sites on links, and subbasins split at sites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.operators import graph, terrain
from headwater.operators.relational import nearest_within

#: Fixed class numbers and labels.
CLASSES = {1: "Exterior Link", 2: "Interior Link", 3: "Source Node", 4: "Link Node", 5: "Sink Node", 6: "Sample Point"}


def pour_points(cells: DataFrame) -> DataFrame:
    """``link_id, cell_id``: each link's last cell, the one with the largest accumulation, of ``cells`` (cell_id, link_id, accum)."""
    return cells.groupBy("link_id").agg(F.max_by("cell_id", F.struct("accum", "cell_id")).alias("cell_id"))


def link_table(pointers: DataFrame, cells: DataFrame) -> DataFrame:
    """``link_id, ds_link_id``: the link that each link's last cell flows into, null at outlets."""
    last = pour_points(cells).join(pointers.select("cell_id", "ds"), "cell_id")
    return last.join(cells.select(F.col("cell_id").alias("ds"), F.col("link_id").alias("ds_link_id")), "ds", "left").select("link_id", "ds_link_id")


def link_classes(pointers: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell_id, link_class, link_type`` of stream cells (cell_id, link_id).

    A cell that nothing flows into is a source, one that flows on into no stream
    cell a sink, one with several inflows a link node; others are exterior where
    their link starts at a source, and interior.
    """
    on = pointers.select("cell_id", "ds").join(cells.select("cell_id", "link_id"), "cell_id")
    inflow = on.groupBy(F.col("ds").alias("cell_id")).agg(F.count("*").alias("n"))
    heads = on.select("cell_id").join(inflow, "cell_id", "left_anti").select(F.col("cell_id").alias("link_id"), F.lit(True).alias("outer"))
    ends = on.join(cells.select(F.col("cell_id").alias("ds"), F.lit(True).alias("on")), "ds", "left").join(inflow, "cell_id", "left").join(heads, "link_id", "left")
    kind = F.when(F.col("n").isNull(), 3).when(F.col("on").isNull(), 5).when(F.col("n") > 1, 4).when(F.col("outer"), 1).otherwise(2)
    label = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])
    return ends.select("cell_id", kind.alias("link_class")).withColumn("link_type", label[F.col("link_class")])


def main_stem(links: DataFrame) -> DataFrame:
    """``link_id, main``: each link's main upstream link: of those flowing into it the one with the greatest us_len, then the smallest id."""
    best = F.max_by("link_id", F.struct("us_len", (-F.col("link_id")).alias("k"))).alias("main")
    return links.where("ds_link_id IS NOT NULL").groupBy(F.col("ds_link_id").alias("link_id")).agg(best)


def tributaries(links: DataFrame) -> DataFrame:
    """``link_id, trib_id``: links of one unbroken main channel share a tributary, named by its lowest link."""
    main = main_stem(links).select(F.col("main").alias("link_id"), F.lit(True).alias("goes_on"))
    nodes = links.join(main, "link_id", "left").select(F.col("link_id").alias("id"), F.when(F.col("goes_on"), F.col("ds_link_id")).alias("ds"), F.lit(1).alias("one"))
    return graph.downstream_sum(nodes, "one").select(F.col("id").alias("link_id"), F.col("outlet").alias("trib_id"))


def hack(links: DataFrame) -> DataFrame:
    """``link_id, hack``: tributaries on the way down that are entered from."""
    main = main_stem(links).select(F.col("main").alias("link_id"), F.lit(0).alias("turn"))
    nodes = links.join(main, "link_id", "left").select(F.col("link_id").alias("id"), F.col("ds_link_id").alias("ds"), F.coalesce("turn", F.lit(1)).alias("turn"))
    return graph.downstream_sum(nodes, "turn").select(F.col("id").alias("link_id"), F.col("total").cast("long").alias("hack"))


def strahler(links: DataFrame) -> DataFrame:
    return graph.strahler(links.select(F.col("link_id").alias("id"), F.col("ds_link_id").alias("ds"))).withColumnRenamed("id", "link_id")


def horton(links: DataFrame) -> DataFrame:
    """``link_id, horton``: the largest Strahler order of the link's tributary."""
    joined = strahler(links).join(tributaries(links), "link_id")
    return joined.join(joined.groupBy("trib_id").agg(F.max("strahler").alias("horton")), "trib_id").select("link_id", "horton")


def shreve(links: DataFrame) -> DataFrame:
    """``link_id, shreve``: heads upstream, itself included."""
    heads = links.select("link_id").join(links.select(F.col("ds_link_id").alias("link_id")).distinct(), "link_id", "left_anti").withColumn("head", F.lit(1))
    nodes = links.join(heads, "link_id", "left").select(F.col("link_id").alias("id"), F.col("ds_link_id").alias("ds"), F.coalesce("head", F.lit(0)).cast("long").alias("head"))
    return graph.upstream_sum(nodes, "head").select(F.col("id").alias("link_id"), F.col("total").alias("shreve"))


def upstream_length(links: DataFrame) -> DataFrame:
    nodes = links.select(F.col("link_id").alias("id"), F.col("ds_link_id").alias("ds"), "link_lngth")
    return graph.upstream_sum(nodes, "link_lngth").select(F.col("id").alias("link_id"), F.col("total").alias("upstream_length"))


def _of_cells(column: Callable[[], Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda links, cells: cells.groupBy("link_id").agg(column().alias("value"))


def _of_links(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda links, cells: (out := f(links)).select("link_id", F.col(out.columns[-1]).alias("value"))


#: Optional link attributes by name, from links (link_id, ds_link_id, link_lngth, us_len) and their cells (link_id, elev, cont_slope).
EXTRA: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "link_slope": _of_cells(lambda: (F.max("elev") - F.min("elev")) / F.count("*")),
    "cont_slope": _of_cells(lambda: F.avg("cont_slope")),
    "USChnLn_To": _of_links(upstream_length),
    "Elevation": _of_cells(lambda: F.avg("elev")),
    "StOrd_Hack": _of_links(hack),
    "StOrd_Str": _of_links(strahler),
    "StOrd_Hort": _of_links(horton),
    "StOrd_Shr": _of_links(shreve),
}


def with_attributes(links: DataFrame, names: list[str], cells: DataFrame | None = None) -> DataFrame:
    """``links`` with the optional attributes named; an unknown name is an error."""
    unknown = [n for n in names if n not in EXTRA]
    if unknown:
        raise ValueError(f"no attribute {', '.join(unknown)}; there are {', '.join(EXTRA)}")
    out = links
    for n in names:
        out = out.join(EXTRA[n](links, cells).withColumnRenamed("value", n), "link_id", "left")
    return out


def snap_sites(sites: DataFrame, cells: DataFrame, classes: DataFrame, reach: float, break_on_missing: bool = False) -> DataFrame:
    """``site_id, cell_id, link_id, link_class``: sites (id, x, y) at the nearest cell of a link within ``reach``, links renumbered.

    Sources, link nodes, sinks and the links' pour points take no site.  Of
    sites at one cell the smallest id stays.  A link's sites are numbered from
    its lower end as decimals of its id.  Sites without a cell are left out, or
    an error with ``break_on_missing``.
    """
    free = cells.join(classes.where("link_class IN (1, 2)").select("cell_id"), "cell_id", "left_semi").join(pour_points(cells).select("cell_id"), "cell_id", "left_anti")
    found = nearest_within(sites, free.select(F.col("cell_id").alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y")), reach)
    if break_on_missing and not found.where("near_id IS NULL").isEmpty():
        raise ValueError("some sites lie farther from any link than the snap distance")
    on = found.where("near_id IS NOT NULL").join(cells.select(F.col("cell_id").alias("near_id"), "link_id", "accum"), "near_id")
    one = on.groupBy("link_id", "near_id", "accum").agg(F.min("id").alias("site_id"))
    w = Window.partitionBy("link_id")
    one = one.withColumn("rn", F.row_number().over(w.orderBy(F.col("accum").desc(), "near_id")))
    decimal = F.lpad(F.col("rn").cast("string"), F.length(F.max("rn").over(w).cast("string")), "0")
    return one.select("site_id", F.col("near_id").alias("cell_id"), F.concat_ws(".", F.col("link_id").cast("string"), decimal).alias("link_id"), F.lit(6).alias("link_class"))


def split_subbasins(pointers: DataFrame, cells: DataFrame, snapped: DataFrame) -> DataFrame:
    """``cell_id, link_id``: each cell's first pour point downstream, a site (its decimal id) or its link's own; null where it reaches none.

    A link without a site keeps its subbasin; one with sites is split at them.
    """
    own = pour_points(cells).select("cell_id", F.col("link_id").cast("string").alias("link_id"))
    return terrain.subbasins(pointers, own.join(snapped.select("cell_id"), "cell_id", "left_anti").union(snapped.select("cell_id", "link_id")))
