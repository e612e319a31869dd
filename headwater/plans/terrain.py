"""Queries of grid, raster and geometry operators over the embeddings' grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from headwater.functions.steps import saved
from headwater.operators import geometry, streamlinks, terrain, weights
from headwater.plans.views import GRID, WIDTH, grid, table

THRESHOLD = 5


def flow(spark, d):
    cells = saved(grid(spark, d))
    pointers = saved(terrain.d8_pointer(cells))
    return cells, pointers


def stream_of(pointers):
    return saved(terrain.streams(terrain.accumulation(pointers), THRESHOLD))


def jn14(s, d):
    return terrain.neighbours(grid(s, d), "elev").groupBy("cell_id").agg(F.count("*").alias("n"), F.min("n_elev").alias("lo"))


def ras3(s, d):
    return terrain.d8_pointer(grid(s, d)).select("cell_id", F.col("d8").cast("int").alias("d8"), "ds")


def net5(s, d):
    cells, pointers = flow(s, d)
    return pointers.where("ds IS NOT NULL").select(F.col("ds").alias("cell_id"), F.col("cell_id").alias("us"))


def net6(s, d):
    """The pointers themselves, which are found in the cells' tiles."""
    return terrain.d8_pointer(grid(s, d)).where("ds IS NOT NULL").select("cell_id", "ds")


def ras4(s, d):
    return terrain.accumulation(flow(s, d)[1])


def ras5(s, d):
    return ras4(s, d).select("cell_id", ((F.col("accum") + 1) * 900 / 30).alias("sca"))


def ras6(s, d):
    return terrain.streams(ras4(s, d), THRESHOLD)


def ras13(s, d):
    pointers = flow(s, d)[1]
    return terrain.stream_links(pointers, stream_of(pointers))


def ras7(s, d):
    """Links without inflow and shorter than two cells are dropped."""
    pointers = flow(s, d)[1]
    stream = stream_of(pointers)
    links = saved(terrain.stream_links(pointers, stream))
    fed = pointers.join(stream.select("cell_id"), "cell_id", "left_semi").select(F.col("ds").alias("link_id")).distinct()
    short = links.groupBy("link_id").agg(F.count("*").alias("n")).where("n < 2").join(fed, "link_id", "left_anti")
    return links.join(short, "link_id", "left_anti").select("cell_id", "link_id")


def ras15(s, d):
    pointers = flow(s, d)[1]
    links = terrain.stream_links(pointers, stream_of(pointers))
    return links.join(pointers, "cell_id").groupBy("link_id").agg(F.round(F.sum(F.when(F.col("ds").isNull(), 0.0).otherwise(terrain.step_length(F.col("d8")))), 6).alias("link_lngth"))


def ras19(s, d):
    cells, pointers = flow(s, d)
    links = terrain.stream_links(pointers, stream_of(pointers)).join(cells.select("cell_id", "elev"), "cell_id")
    return links.groupBy("link_id").agg(F.round((F.max("elev") - F.min("elev")) / F.count("*"), 8).alias("link_slope"))


def ras20(s, d):
    cells, pointers = flow(s, d)
    z = cells.select("cell_id", "elev")
    below = pointers.join(z, "cell_id").join(z.select(F.col("cell_id").alias("ds"), F.col("elev").alias("e2")), "ds")
    return below.select("cell_id", F.round((F.col("elev") - F.col("e2")) / terrain.step_length(F.col("d8")), 8).alias("cont_slope"))


def ras25(s, d):
    pointers = flow(s, d)[1]
    accum = terrain.accumulation(pointers)
    links = terrain.stream_links(pointers, stream_of(pointers)).join(accum, "cell_id")
    chain = F.transform(F.array_sort(F.collect_list(F.struct("accum", "cell_id"))), lambda x: x["cell_id"])
    return links.groupBy("link_id").agg(F.array_join(chain.cast("array<string>"), ",").alias("cells"))


def ras28(s, d):
    pointers = flow(s, d)[1]
    return terrain.subbasins(pointers, saved(terrain.stream_links(pointers, stream_of(pointers))))


def ras29(s, d):
    """Cells by the first pour point on their way, the pour points being every seventh stream cell."""
    pointers = flow(s, d)[1]
    points = stream_of(pointers).where("cell_id % 7 = 0").select("cell_id", F.col("cell_id").alias("link_id"))
    return terrain.subbasins(pointers, points).where("link_id IS NOT NULL")


def ras30(s, d):
    pointers = flow(s, d)[1]
    return terrain.flow_distance(pointers, stream_of(pointers)).select("cell_id", "target", F.round("distance", 6).alias("distance"))


def ras9(s, d):
    cells = saved(grid(s, d))
    stream = cells.where("row % 40 = 0 AND col % 16 = 0")
    return terrain.burn(cells, terrain.nearest_stream(cells, stream, 8), 5.0, 1.0, 8.0, 2.0).select("cell_id", F.round("burned", 6).alias("burned"))


def ras11(s, d):
    cells = grid(s, d)
    return terrain.nearest_stream(cells, cells.where("row % 40 = 0 AND col % 16 = 0"), 8).select("cell_id", F.round("distance", 6).alias("distance"))


def stream_cells(s, d):
    """Pointers and stream cells with their link, accumulation and place on the grid."""
    cells, pointers = flow(s, d)
    accum = saved(terrain.accumulation(pointers))
    links = terrain.stream_links(pointers, saved(terrain.streams(accum, THRESHOLD)))
    return pointers, saved(links.join(accum, "cell_id").join(cells.select("cell_id", "row", "col", "elev"), "cell_id"))


def ras8(s, d, compat=False):
    """Stream links in chunks of three cells, kept where over half a chunk lies within 3 cells of a reference line, every 16th column."""
    _, cells = stream_cells(s, d)
    place = F.row_number().over(Window.partitionBy("link_id").orderBy(F.col("accum").desc(), "cell_id"))
    within = geometry.buffer(cells, cells.select("row", (F.floor(F.col("col") / 16) * 16).alias("col")).union(cells.select("row", (F.floor(F.col("col") / 16) * 16 + 16).alias("col"))), 3.0, "flat").withColumn("hit", F.lit(1))
    chunks = cells.withColumn("chunk", F.floor((place - 1) / 3) + 1).join(within, ["row", "col"], "left")
    share = chunks.groupBy(F.col("link_id").alias("line"), "chunk").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return terrain.trim_to_reference(share, 0.5, compat)


def classes(s, d):
    pointers, cells = stream_cells(s, d)
    return streamlinks.link_classes(pointers, cells)


def snapped(s, d):
    """Every 53rd cell is a site, snapped within 4 cells."""
    pointers, cells = stream_cells(s, d)
    sites = grid(s, d).where("cell_id % 53 = 0").select(F.col("cell_id").alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return pointers, cells, saved(streamlinks.snap_sites(sites, cells, streamlinks.link_classes(pointers, cells), 4.0))


def ana7(s, d):
    """Sites on a link merged by the link that their decimal id belongs to."""
    found = snapped(s, d)[2]
    return found.groupBy(F.floor(F.col("link_id").cast("double")).alias("base_id")).agg(F.count("*").alias("n"), F.min("site_id").alias("first_site"))


def wgt6(s, d):
    pointers, cells = stream_cells(s, d)
    every = grid(s, d).select("cell_id", "row", "col").join(cells.select("cell_id", "link_id"), "cell_id", "left")
    return weights.network_outlets(streamlinks.link_table(pointers, cells), every)


def vec12(s, d):
    return streamlinks.split_subbasins(*snapped(s, d)).where("link_id IS NOT NULL")


def zones(s, d):
    """Cells with the subbasin that they are rasterised from."""
    return ras28(s, d).where("link_id IS NOT NULL")


def jn12(s, d):
    """Points in subbasins, found by the cell that they fall into."""
    points = table(s, d, "customer").select("c_custkey", F.pmod(F.col("c_custkey") * 37, F.lit(500)).alias("row"), F.pmod(F.col("c_custkey") * 11, F.lit(WIDTH)).alias("col"))
    return points.select("c_custkey", (F.col("row") * WIDTH + F.col("col")).alias("cell_id")).join(zones(s, d), "cell_id").select("c_custkey", "link_id")


def jn16(s, d):
    return zones(s, d).join(grid(s, d).select("cell_id", "elev"), "cell_id").groupBy("link_id").agg(F.count("*").alias("n"), F.round(F.avg("elev"), 7).alias("elev"))


def vec3(s, d):
    """The part of each subbasin that a buffer of 2 cells around the streams covers."""
    _, cells = stream_cells(s, d)
    shapes = zones(s, d).join(grid(s, d).select("cell_id", "row", "col"), "cell_id")
    return geometry.overlap_share(shapes, geometry.buffer(grid(s, d), cells, 2.0), "link_id").select("link_id", F.round("share", 7).alias("share"))


def high(s, d):
    return grid(s, d).where("elev > 0.05")


def customers(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.pmod(F.col("c_custkey") * 37, F.lit(1000)).cast("double").alias("x"), (F.round(F.abs("c_acctbal")) % 1000).alias("y"), F.col("c_nationkey").alias("g"), "c_acctbal")


def river_lines(s, d):
    """Lines of up to a customer's orders, as vertices in order of the order key."""
    some = table(s, d, "orders").select(F.col("o_custkey").alias("line_id"), F.col("o_orderkey").alias("seq"), F.pmod(F.col("o_orderkey") * 7, F.lit(101)).cast("double").alias("x"), F.pmod(F.col("o_orderkey") * 13, F.lit(97)).cast("double").alias("y"))
    return some


def hot(s, d):
    some = grid(s, d).withColumn("lu", F.pmod("cell_id", F.lit(3)).cast("int"))
    return terrain.one_hot(some, "lu", [0, 1, 2]).select("cell_id", "lu_0", "lu_1", "lu_2")


def rasterised(s, d):
    """Points to cells by floor division; of several in a cell the last wins."""
    points = table(s, d, "orders").select(F.pmod("o_custkey", F.lit(100)).alias("y"), F.pmod("o_orderkey", F.lit(77)).alias("x"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"))
    return geometry.rasterise(points, 10, "v", "seq")


def vec5(s, d):
    some = table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return some.select("l_partkey", "l_orderkey", F.floor(F.sum("q").over(w) / 100).alias("chunk"))


def simple(*columns, where=None):
    return lambda s, d: (grid(s, d).where(where) if where else grid(s, d)).selectExpr("cell_id", *columns)


CODES = "(VALUES " + ", ".join(f"({r}, {c}, {k})" for r, c, k in terrain.D8) + ") o(dr, dc, code)"
NEAR = f'{GRID}, near AS (SELECT a.cell_id, o.code, b.cell_id AS n_cell_id, a.elev AS elev, b.elev AS n_elev FROM grid a CROSS JOIN {CODES} JOIN grid b ON b."row" = a."row" + o.dr AND b.col = a.col + o.dc)'
STEP = "CASE WHEN code IN (1, 4, 16, 64) THEN sqrt(2) ELSE 1 END"
PTR = f"{NEAR}, best AS MATERIALIZED (SELECT * FROM near WHERE elev > n_elev QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY (elev - n_elev) / ({STEP}) DESC, code) = 1), ptr AS MATERIALIZED (SELECT g.cell_id, coalesce(b.code, 0) AS d8, b.n_cell_id AS ds FROM grid g LEFT JOIN best b ON g.cell_id = b.cell_id)"
ACC = f"WITH RECURSIVE {PTR}, up(origin, spot) AS (SELECT cell_id, ds FROM ptr WHERE ds IS NOT NULL UNION ALL SELECT u.origin, p.ds FROM up u JOIN ptr p ON u.spot = p.cell_id WHERE p.ds IS NOT NULL), acc AS MATERIALIZED (SELECT cell_id, coalesce(n, 0) AS accum FROM grid LEFT JOIN (SELECT spot, count(*) AS n FROM up GROUP BY 1) ON cell_id = spot), stream AS MATERIALIZED (SELECT * FROM acc WHERE accum > {THRESHOLD}), sp AS (SELECT p.* FROM ptr p JOIN stream s ON p.cell_id = s.cell_id), inf AS (SELECT ds AS k, count(*) AS n FROM sp WHERE ds IS NOT NULL GROUP BY 1)"
LNK = ACC + ", lk(cell_id, link_id) AS (SELECT cell_id, cell_id FROM sp WHERE cell_id NOT IN (SELECT k FROM inf WHERE n = 1) UNION ALL SELECT p.ds, l.link_id FROM lk l JOIN sp p ON l.cell_id = p.cell_id JOIN inf ON inf.k = p.ds AND inf.n = 1)"
FIRST = "{0}, fm(cell_id, spot) AS (SELECT cell_id, cell_id FROM grid UNION ALL SELECT f.cell_id, p.ds FROM fm f JOIN ptr p ON f.spot = p.cell_id WHERE p.ds IS NOT NULL AND f.spot NOT IN (SELECT cell_id FROM {1}))"
NEAREST = f'WITH {GRID}, ref AS (SELECT * FROM grid WHERE "row" % 40 = 0 AND col % 16 = 0), ed AS (SELECT g.cell_id, g."row", g.col, g.elev, min(sqrt((g."row" - r."row") * (g."row" - r."row") + (g.col - r.col) * (g.col - r.col))) AS dist FROM grid g LEFT JOIN ref r ON (g."row" - r."row") * (g."row" - r."row") + (g.col - r.col) * (g.col - r.col) <= 64 GROUP BY 1, 2, 3, 4)'

CLASS = LNK + ", kind AS MATERIALIZED (SELECT l.cell_id, CASE WHEN i.n IS NULL THEN 3 WHEN sp.ds IS NULL OR sp.ds NOT IN (SELECT cell_id FROM stream) THEN 5 WHEN i.n > 1 THEN 4 WHEN l.link_id NOT IN (SELECT k FROM inf) THEN 1 ELSE 2 END AS link_class FROM lk l JOIN sp USING (cell_id) LEFT JOIN inf i ON i.k = l.cell_id), pour AS MATERIALIZED (SELECT link_id, cell_id FROM lk JOIN acc USING (cell_id) QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY accum DESC, cell_id DESC) = 1)"
SNAP = CLASS + f""", free AS (SELECT l.cell_id, l.link_id, a.accum, g."row", g.col FROM lk l JOIN kind k USING (cell_id) JOIN acc a USING (cell_id) JOIN grid g USING (cell_id) WHERE k.link_class IN (1, 2) AND l.cell_id NOT IN (SELECT cell_id FROM pour)),
    near1 AS (SELECT s.cell_id AS site, f.* FROM grid s JOIN free f ON (s."row" - f."row") * (s."row" - f."row") + (s.col - f.col) * (s.col - f.col) <= 16 WHERE s.cell_id % 53 = 0
              QUALIFY row_number() OVER (PARTITION BY s.cell_id ORDER BY (s."row" - f."row") * (s."row" - f."row") + (s.col - f.col) * (s.col - f.col), f.cell_id) = 1),
    one AS (SELECT min(site) AS site_id, cell_id, link_id, accum FROM near1 GROUP BY 2, 3, 4),
    rn AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY accum DESC, cell_id) AS rn FROM one),
    snap AS MATERIALIZED (SELECT site_id, cell_id, link_id AS base, link_id || '.' || lpad(CAST(rn AS VARCHAR), CAST(length(CAST(max(rn) OVER (PARTITION BY link_id) AS VARCHAR)) AS INTEGER), '0') AS link_id FROM rn)"""
ZONES = FIRST.format(LNK, "stream") + ", zn AS MATERIALIZED (SELECT f.cell_id, l.link_id FROM fm f JOIN lk l ON f.spot = l.cell_id)"
CHUNKED = LNK + """, pl AS (SELECT l.link_id AS line, (row_number() OVER (PARTITION BY l.link_id ORDER BY a.accum DESC, l.cell_id) - 1) // 3 + 1 AS chunk, least(g.col % 16, 16 - g.col % 16) <= 3 AS hit FROM lk l JOIN acc a USING (cell_id) JOIN grid g USING (cell_id)),
    sh AS (SELECT line, chunk, avg(CAST(hit AS INTEGER)) AS share FROM pl GROUP BY 1, 2)"""
NORMAL = f"""WITH {NEAR}, h AS (SELECT cell_id, count(*) AS n, """ + ", ".join(f"max(n_elev) FILTER (code = {k}) AS z{k}" for *_, k in terrain.D8) + """ FROM near GROUP BY 1),
    gr AS (SELECT cell_id, (z1 + 2 * z2 + z4 - z16 - 2 * z32 - z64) / 8 AS gx, (z4 + 2 * z8 + z16 - z64 - 2 * z128 - z1) / 8 AS gy FROM h WHERE n = 8),
    wt AS (SELECT near.cell_id, near.n_elev, pow(greatest((a.gx * b.gx + a.gy * b.gy + 1) / (sqrt(a.gx * a.gx + a.gy * a.gy + 1) * sqrt(b.gx * b.gx + b.gy * b.gy + 1)) - cos(radians(15)), 0), 2) AS w FROM near JOIN gr a ON near.cell_id = a.cell_id JOIN gr b ON near.n_cell_id = b.cell_id),
    ag AS (SELECT cell_id, sum(w) AS w, sum(w * n_elev) AS s FROM wt GROUP BY 1)"""
CUST = "c AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, round(abs(c_acctbal)) % 1000 AS y, c_nationkey AS g, c_acctbal FROM customer)"
HIGH = f"{GRID}, hi AS (SELECT * FROM grid WHERE elev > 0.05)"

QUERIES = {
    "SRC5_raster_scan": (lambda s, d: grid(s, d), f"WITH {GRID} SELECT * FROM grid"),
    "JN14_queen_neighbours": (jn14, f"WITH {NEAR} SELECT cell_id, count(*) AS n, min(n_elev) AS lo FROM near GROUP BY 1"),
    "JN15_cell_lookup": (lambda s, d: grid(s, d).where("cell_id % 10 = 0").select("cell_id").join(grid(s, d).select("cell_id", "elev"), "cell_id"), f"WITH {GRID} SELECT cell_id, elev FROM grid WHERE cell_id % 10 = 0"),
    "RAS3_d8_pointer": (ras3, f"WITH {PTR} SELECT cell_id, d8, ds FROM ptr"),
    "NET5_upstream_adjacency": (net5, f"WITH {PTR} SELECT ds AS cell_id, cell_id AS us FROM ptr WHERE ds IS NOT NULL"),
    "NET6_downstream_adjacency": (net6, f"WITH {PTR} SELECT cell_id, ds FROM ptr WHERE ds IS NOT NULL"),
    "RAS4_accumulation": (ras4, f"{ACC} SELECT * FROM acc"),
    "RAS5_contributing_area": (ras5, f"{ACC} SELECT cell_id, (accum + 1) * 900 / 30 AS sca FROM acc"),
    "RAS6_streams": (ras6, f"{ACC} SELECT * FROM stream"),
    "RAS7_short_streams": (ras7, f"{LNK} SELECT cell_id, link_id FROM lk WHERE link_id NOT IN (SELECT link_id FROM lk WHERE link_id NOT IN (SELECT ds FROM sp WHERE ds IS NOT NULL) GROUP BY 1 HAVING count(*) < 2)"),
    "RAS9_burn": (ras9, f"{NEAREST} SELECT cell_id, round(elev - 2 * (CAST(coalesce(dist, 9) <= 3 AS INTEGER) + CAST(coalesce(dist, 9) <= 2 AS INTEGER) + CAST(coalesce(dist, 9) <= 1 AS INTEGER)) - CASE WHEN dist <= 8 THEN (8 - dist) / 8 * 2 ELSE 0 END, 6) AS burned FROM ed"),
    "RAS11_distance_transform": (ras11, f"{NEAREST} SELECT cell_id, round(dist, 6) AS distance FROM ed"),
    "RAS13_stream_links": (ras13, f"{LNK} SELECT * FROM lk"),
    "RAS15_link_length": (ras15, f"{LNK} SELECT link_id, round(sum(CASE WHEN ds IS NULL THEN 0 WHEN d8 IN (1, 4, 16, 64) THEN sqrt(2) ELSE 1 END), 6) AS link_lngth FROM lk JOIN ptr USING (cell_id) GROUP BY 1"),
    "RAS19_link_slope": (ras19, f"{LNK} SELECT link_id, round((max(elev) - min(elev)) / count(*), 8) AS link_slope FROM lk JOIN grid USING (cell_id) GROUP BY 1"),
    "RAS20_continuous_slope": (ras20, f"WITH {PTR} SELECT p.cell_id, round((a.elev - b.elev) / (CASE WHEN d8 IN (1, 4, 16, 64) THEN sqrt(2) ELSE 1 END), 8) AS cont_slope FROM ptr p JOIN grid a ON p.cell_id = a.cell_id JOIN grid b ON p.ds = b.cell_id"),
    "RAS25_stream_lines": (ras25, f"{LNK} SELECT link_id, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY accum, cell_id) AS cells FROM lk JOIN acc USING (cell_id) GROUP BY 1"),
    "RAS28_subbasins": (ras28, FIRST.format(LNK, "stream") + " SELECT g.cell_id, x.link_id FROM grid g LEFT JOIN (SELECT f.cell_id, l.link_id FROM fm f JOIN lk l ON f.spot = l.cell_id) x ON g.cell_id = x.cell_id"),
    "RAS29_nested_basins": (ras29, FIRST.format(ACC + ", pp AS (SELECT cell_id FROM stream WHERE cell_id % 7 = 0)", "pp") + " SELECT f.cell_id, f.spot AS link_id FROM fm f JOIN pp ON f.spot = pp.cell_id"),
    "RAS30_flow_distance": (ras30, ACC + ", fd(cell_id, spot, dist) AS (SELECT cell_id, cell_id, CAST(0 AS DOUBLE) FROM grid UNION ALL SELECT f.cell_id, p.ds, f.dist + CASE WHEN d8 IN (1, 4, 16, 64) THEN sqrt(2) ELSE 1 END FROM fd f JOIN ptr p ON f.spot = p.cell_id WHERE p.ds IS NOT NULL AND f.spot NOT IN (SELECT cell_id FROM stream)) SELECT g.cell_id, x.spot AS target, round(x.dist, 6) AS distance FROM grid g LEFT JOIN (SELECT f.* FROM fd f JOIN stream s ON f.spot = s.cell_id) x ON g.cell_id = x.cell_id"),
    "RAS31_slope": (lambda s, d: terrain.horn_slope(grid(s, d)).select("cell_id", F.round("slope", 7).alias("slope")), f"WITH {NEAR}, h AS (SELECT cell_id, count(*) AS n, " + ", ".join(f"max(n_elev) FILTER (code = {k}) AS z{k}" for *_, k in terrain.D8) + " FROM near GROUP BY 1) SELECT cell_id, round(sqrt(pow((z1 + 2 * z2 + z4 - z16 - 2 * z32 - z64) / 8, 2) + pow((z4 + 2 * z8 + z16 - z64 - 2 * z128 - z1) / 8, 2)), 7) AS slope FROM h WHERE n = 8"),
    "RAS32_map_algebra": (simple("round(elev * 2 + col, 6) AS v"), f"WITH {GRID} SELECT cell_id, round(elev * 2 + col, 6) AS v FROM grid"),
    "RAS33_mask": (simple("CASE WHEN elev > 0 THEN elev END AS v"), f"WITH {GRID} SELECT cell_id, CASE WHEN elev > 0 THEN elev END AS v FROM grid"),
    "RAS34_classify": (simple("CASE WHEN elev < -0.1D THEN 1 WHEN elev < 0.1D THEN 2 ELSE 3 END AS v"), f"WITH {GRID} SELECT cell_id, CASE WHEN elev < -0.1 THEN 1 WHEN elev < 0.1 THEN 2 ELSE 3 END AS v FROM grid"),
    "RAS35_clamp": (simple("greatest(least(elev, 0.1D), -0.1D) AS v"), f"WITH {GRID} SELECT cell_id, greatest(least(elev, 0.1::DOUBLE), -0.1::DOUBLE) AS v FROM grid"),
    "RAS36_crop": (simple("elev", where="row BETWEEN 5 AND 90 AND col BETWEEN 3 AND 40"), f'WITH {GRID} SELECT cell_id, elev FROM grid WHERE "row" BETWEEN 5 AND 90 AND col BETWEEN 3 AND 40'),
    "RAS37_resample": (lambda s, d: terrain.resample(grid(s, d), "elev", 4).select("row", "col", F.round("elev", 7).alias("elev")), f'WITH {GRID} SELECT "row" // 4 AS "row", col // 4 AS col, round(avg(elev), 7) AS elev FROM grid GROUP BY 1, 2'),
    "RAS37_resample_categories": (lambda s, d: terrain.resample(grid(s, d).withColumn("lu", F.pmod(F.col("row") * 7 + F.col("col") * 3, F.lit(5))), "lu", 4, True), f'WITH {GRID}, k AS (SELECT "row" // 4 AS "row", col // 4 AS col, ("row" * 7 + col * 3) % 5 AS lu, count(*) AS n FROM grid GROUP BY 1, 2, 3) SELECT "row", col, lu FROM k QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY n DESC, lu) = 1'),
    "RAS39_one_hot": (hot, f"WITH {GRID} SELECT cell_id, " + ", ".join(f"CASE WHEN cell_id % 3 = {k} THEN 1 END AS lu_{k}" for k in range(3)) + " FROM grid"),
    "VEC5_line_chunks": (vec5, "WITH a AS (SELECT l_partkey, l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_partkey, l_orderkey, CAST(floor(sum(q) OVER (PARTITION BY l_partkey ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) / 100) AS BIGINT) AS chunk FROM a"),
    "JN12_points_in_zones": (jn12, f"{ZONES} SELECT c_custkey, link_id FROM customer JOIN zn ON cell_id = (c_custkey * 37) % 500 * {WIDTH} + (c_custkey * 11) % {WIDTH}"),
    "JN13_near_edge": (lambda s, d: geometry.near_edge(grid(s, d), 2).select("cell_id"), f'WITH {GRID} SELECT cell_id FROM grid WHERE "row" < 2 OR "row" > (SELECT max("row") FROM grid) - 2 OR col < 2 OR col >= {WIDTH - 2}'),
    "JN16_cells_in_zones": (jn16, f"{ZONES} SELECT link_id, count(*) AS n, round(avg(elev), 7) AS elev FROM zn JOIN grid USING (cell_id) GROUP BY 1"),
    "RAS1_fill_depressions": (lambda s, d: terrain.fill_depressions(grid(s, d)), None),
    "RAS2_breach_depressions": (lambda s, d: terrain.breach_depressions(grid(s, d)), None),
    "RAS8_overlap_trimming": (ras8, f"{CHUNKED} SELECT line, chunk FROM sh WHERE share > 0.5"),
    "RAS8_overlap_trimming_compat": (lambda s, d: ras8(s, d, True), f"{CHUNKED}, tc AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY chunk) AS place FROM sh WHERE share > 0), st AS (SELECT *, coalesce(min(place) FILTER (share > 0.5) OVER (PARTITION BY line), 0) AS start FROM tc) SELECT line, chunk FROM st WHERE chunk >= start"),
    "RAS12_smoothing": (lambda s, d: terrain.smooth(grid(s, d)).select("cell_id", F.round("smoothed", 7).alias("smoothed")), f"{NORMAL} SELECT g.cell_id, round((pow(1 - cos(radians(15)), 2) * elev + coalesce(s, 0)) / (pow(1 - cos(radians(15)), 2) + coalesce(w, 0)), 7) AS smoothed FROM grid g LEFT JOIN ag ON g.cell_id = ag.cell_id"),
    "RAS14_link_class": (classes, f"{CLASS} SELECT cell_id, link_class, CASE link_class WHEN 1 THEN 'Exterior Link' WHEN 2 THEN 'Interior Link' WHEN 3 THEN 'Source Node' WHEN 4 THEN 'Link Node' ELSE 'Sink Node' END AS link_type FROM kind"),
    "RAS26_points_to_raster": (rasterised, "SELECT o_custkey % 100 // 10 AS \"row\", o_orderkey % 77 // 10 AS col, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2"),
    "RAS27_lines_to_raster": (lambda s, d: geometry.lines_to_cells(river_lines(s, d), 10.0), "WITH l AS (SELECT o_custkey AS line_id, CAST((o_orderkey * 7) % 101 AS DOUBLE) AS x, CAST((o_orderkey * 13) % 97 AS DOUBLE) AS y, o_orderkey AS seq FROM orders), n AS (SELECT *, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y) OVER w, y) AS y2 FROM l WINDOW w AS (PARTITION BY line_id ORDER BY seq)), k AS (SELECT *, greatest(CAST(ceil(greatest(abs(x2 - x), abs(y2 - y)) / 10) AS BIGINT), 1) AS n FROM n), e AS (SELECT *, unnest(range(0, n + 1)) AS k FROM k) SELECT DISTINCT line_id, CAST(floor((y + (y2 - y) * (k / n)) / 10) AS BIGINT) AS \"row\", CAST(floor((x + (x2 - x) * (k / n)) / 10) AS BIGINT) AS col FROM e"),
    "RAS38_rasterise_numeric": (lambda s, d: geometry.rasterise(customers(s, d), 25, "c_acctbal", "id"), f'WITH {CUST} SELECT CAST(floor(y / 25) AS BIGINT) AS "row", CAST(floor(x / 25) AS BIGINT) AS col, max_by(c_acctbal, id) AS value FROM c GROUP BY 1, 2'),
    "RAS42_to_points": (lambda s, d: geometry.to_points(grid(s, d).select("cell_id", "row", "col"), 30.0).select("cell_id", "x", "y"), f'WITH {GRID} SELECT cell_id, (col + 0.5) * 30 AS x, ("row" + 0.5) * 30 AS y FROM grid'),
    "RAS42_to_polygons": (lambda s, d: geometry.to_polygons(grid(s, d).withColumn("v", (F.col("elev") > 0.05).cast("int")), "v"), None),
    "WGT6_network_outlets": (wgt6, f'{CLASS}, nx AS (SELECT p.link_id, l2.link_id AS ds_link FROM pour p JOIN ptr USING (cell_id) LEFT JOIN lk l2 ON ptr.ds = l2.cell_id) SELECT DISTINCT l.link_id FROM lk l JOIN grid g USING (cell_id) JOIN nx ON nx.link_id = l.link_id AND nx.ds_link IS NULL WHERE g."row" < 2 OR g."row" > (SELECT max("row") FROM grid) - 2 OR g.col < 2 OR g.col >= {WIDTH - 2}'),
    "VEC1_buffer": (lambda s, d: geometry.buffer(grid(s, d), high(s, d), 2.0), f'WITH {HIGH} SELECT DISTINCT g."row", g.col FROM hi JOIN grid g ON g."row" BETWEEN hi."row" - 2 AND hi."row" + 2 AND g.col BETWEEN hi.col - 2 AND hi.col + 2 WHERE pow(g."row" - hi."row", 2) + pow(g.col - hi.col, 2) <= 4'),
    "VEC1_buffer_inwards": (lambda s, d: geometry.buffer(grid(s, d), high(s, d), -1.0, "flat"), f'WITH {HIGH}, lo AS (SELECT * FROM grid WHERE NOT elev > 0.05) SELECT "row", col FROM hi WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo."row" BETWEEN hi."row" - 1 AND hi."row" + 1 AND lo.col BETWEEN hi.col - 1 AND hi.col + 1)'),
    "VEC2_dissolve": (lambda s, d: geometry.dissolve(geometry.to_points(high(s, d)).withColumns({"g": F.floor(F.col("row") / 50), "row": F.floor(F.col("row") / 5), "col": F.floor(F.col("col") / 4)}), "g"), f'WITH {HIGH} SELECT DISTINCT "row" // 50 AS g, "row" // 5 AS "row", col // 4 AS col FROM hi'),
    "VEC3_area_ratio": (vec3, f'{ZONES}, bf AS (SELECT DISTINCT g.cell_id FROM stream s JOIN grid a USING (cell_id) JOIN grid g ON g."row" BETWEEN a."row" - 2 AND a."row" + 2 AND g.col BETWEEN a.col - 2 AND a.col + 2 WHERE pow(g."row" - a."row", 2) + pow(g.col - a.col, 2) <= 4) SELECT link_id, round(avg(CAST(cell_id IN (SELECT cell_id FROM bf) AS INTEGER)), 7) AS share FROM zn GROUP BY 1'),
    "VEC4_centroid": (lambda s, d: geometry.centroids(zones(s, d).join(grid(s, d).select("cell_id", "row", "col"), "cell_id"), "link_id").select("link_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")), f'{ZONES} SELECT link_id, round(avg(col), 6) AS x, round(avg("row"), 6) AS y FROM zn JOIN grid USING (cell_id) GROUP BY 1'),
    "VEC6_split_lines": (lambda s, d: geometry.split_lines(river_lines(s, d), river_lines(s, d).where("seq % 9 = 0")).select("line_id", F.col("piece").cast("long").alias("piece"), "seq"), "WITH l AS (SELECT o_custkey AS line_id, o_orderkey AS seq, min(o_orderkey) OVER w AS lo, max(o_orderkey) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey)), c AS (SELECT *, seq % 9 = 0 AND seq > lo AND seq < hi AS cut FROM l), n AS (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT line_id, CAST(before AS BIGINT) AS piece, seq FROM n UNION ALL SELECT line_id, CAST(before + 1 AS BIGINT), seq FROM n WHERE cut"),
    "VEC7_pairwise_distances": (lambda s, d: geometry.pairwise_distances(customers(s, d), "g").withColumn("distance", F.floor(F.col("distance") * 1e6 + 0.5) / 1e6), f"WITH {CUST} SELECT a.g, a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM c a JOIN c b ON a.g = b.g AND a.id < b.id"),
    "VEC8_without_holes": (lambda s, d: geometry.without_holes(grid(s, d), high(s, d)), None),
    "VEC9_extent": (lambda s, d: geometry.extent(grid(s, d)), f'WITH {GRID} SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM grid'),
    "VEC11_snap_sites": (lambda s, d: snapped(s, d)[2], f"{SNAP} SELECT site_id, cell_id, link_id, 6 AS link_class FROM snap"),
    "VEC12_split_subbasins": (vec12, FIRST.format(SNAP + ", pp AS MATERIALIZED (SELECT cell_id, CAST(link_id AS VARCHAR) AS link_id FROM pour WHERE cell_id NOT IN (SELECT cell_id FROM snap) UNION ALL SELECT cell_id, link_id FROM snap)", "pp") + " SELECT f.cell_id, pp.link_id FROM fm f JOIN pp ON f.spot = pp.cell_id"),
    "ANA7_base_link_merge": (ana7, f"{SNAP} SELECT CAST(floor(CAST(link_id AS DOUBLE)) AS BIGINT) AS base_id, count(*) AS n, min(site_id) AS first_site FROM snap GROUP BY 1"),
}
