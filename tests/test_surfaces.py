"""Filling, shapes, statistics and weights against plain Python."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from headwater.functions.stats import compat_var_samp, merged_var_pop
from headwater.operators import geometry, hydrology, streamlinks, terrain, weights, zonal


def surface(rows=12, cols=11, seed=3, levels=9):
    rng = random.Random(seed)
    return {(r, c): float(rng.randrange(levels)) for r in range(rows) for c in range(cols)}


def cells_of(spark, z, cols=11):
    return spark.createDataFrame([(r * cols + c, r, c, v) for (r, c), v in z.items()], "cell_id long, row long, col long, elev double")


def flood(z, rows=12, cols=11):
    """Priority flood from the edge."""
    edge = [p for p in z if p[0] in (0, rows - 1) or p[1] in (0, cols - 1)]
    out, heap = {p: z[p] for p in edge}, [(z[p], p) for p in edge]
    heapq.heapify(heap)
    while heap:
        level, (r, c) = heapq.heappop(heap)
        for p in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
            if p in z and p not in out:
                out[p] = max(z[p], level)
                heapq.heappush(heap, (out[p], p))
    return out


@pytest.mark.parametrize(("seed", "levels"), [(3, 9), (4, 4), (5, 1000)])
def test_filling_as_by_priority_flood(spark, seed, levels):
    z = surface(seed=seed, levels=levels)
    got = {r.cell_id: r.filled for r in terrain.fill_depressions(cells_of(spark, z)).collect()}
    assert got == {r * 11 + c: v for (r, c), v in flood(z).items()}


def test_breaching_only_lowers(spark):
    z = surface(seed=6)
    got = {r.cell_id: r.breached for r in terrain.breach_depressions(cells_of(spark, z)).collect()}
    assert len(got) == len(z) and all(got[r * 11 + c] <= v for (r, c), v in z.items())


def test_holes_and_regions(spark):
    ring = [(r, c) for r in range(2, 7) for c in range(2, 7) if r in (2, 6) or c in (2, 6)]
    grid = cells_of(spark, surface())
    shape = spark.createDataFrame([(r * 11 + c,) for r, c in ring], "cell_id long")
    assert {r.cell_id for r in geometry.without_holes(grid, shape).collect()} == {r * 11 + c for r in range(2, 7) for c in range(2, 7)}
    value = grid.withColumn("v", (F.col("elev") > 4).cast("int"))
    label, z = {}, surface()
    for p in sorted(z):
        if p not in label:
            todo = [p]
            label[p] = p
            while todo:
                r, c = todo.pop()
                for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if q in z and q not in label and (z[q] > 4) == (z[p] > 4):
                        label[q] = p
                        todo.append(q)
    assert {r.cell_id: r.region for r in geometry.regions(value, "v").collect()} == {r * 11 + c: a * 11 + b for (r, c), (a, b) in label.items()}
    assert geometry.to_polygons(value, "v").agg(F.sum("n_cells")).first()[0] == len(z)


def test_variances_of_far_means(spark):
    """Two zones of two cells about 1e9: nothing cancels."""
    rows = spark.createDataFrame([(1, 2.0, 1e9 + 0.5, 0.25), (1, 2.0, 1e9 + 2.5, 0.25)], "g long, n double, m double, v double").withColumn("p", F.lit(1e9 + 0.5))
    assert rows.groupBy("g").agg(merged_var_pop("n", "m", "v", "p").alias("v")).first().v == 1.25
    cells = spark.createDataFrame([(1, 1e9 + x, 1.0 + x) for x in (0.0, 1.0, 2.0, 3.0)], "zone long, x double, w double")
    got = zonal.zone_partials(cells, "zone", ["x"], {}, ["w"]).first()
    mu = sum((1 + x) * x for x in range(4)) / 10
    assert math.isclose(got.x_w_var, sum((1 + x) * (x - mu) ** 2 for x in range(4)) / 10, rel_tol=1e-6)
    pairs = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "origin long, destination long")
    two = spark.createDataFrame([(1, 1e9, 1.0), (1, 1e9 + 1, 1.0), (2, 1e9 + 2, 1.0), (2, 1e9 + 3, 3.0)], "zone long, x double, w double")
    merged = {r.link_id: r for r in zonal.merge_over(pairs, zonal.zone_partials(two, "zone", ["x"], {}, ["w"]), "zone", ["x"], {}, ["w"], ("sd",)).collect()}
    assert math.isclose(merged[1].x_lumped_sd, math.sqrt(5 / 3), rel_tol=1e-9) and math.isclose(merged[1].x_w_sd, math.sqrt(sum(w * (x - 2) ** 2 for x, w in ((0, 1), (1, 1), (2, 1), (3, 3))) / 6), rel_tol=1e-9)


def test_older_convention(spark):
    """Sample variances of the parts, rescaled once more; parts of one cell are left out."""
    parts = [(4.0, 2.0, 1.5), (3.0, 5.0, 0.5), (1.0, 90.0, None)]
    rows = spark.createDataFrame([(1, *p) for p in parts], "g long, n double, m double, v double").withColumn("p", F.lit(2.0))
    mu = (8 + 15) / 7
    want = (3 * 1.5 * 4 / 3 + 2 * 0.5 * 3 / 2 + 4 * (2 - mu) ** 2 + 3 * (5 - mu) ** 2) / 6
    assert math.isclose(rows.groupBy("g").agg(compat_var_samp("n", "m", "v", "p").alias("v")).first().v, want)


def test_weight_layers():
    assert weights.missing_weights(["iFLS", "iFLO_unn_groupa"], ["lumped", "iFLS", "HAiFLS", "iFLO"], ["a", "b"]) == ["HAiFLS", "iFLO_unn_groupb"]
    with pytest.raises(KeyError):
        weights.require_weights([], ["iFLS"])
    with pytest.raises(ValueError):
        weights.missing_weights([], ["iFLX"])


def test_wide_groups_to_rows(spark):
    wide = spark.createDataFrame([(1, 0.5, None, 0.1), (2, None, 0.7, None)], "cell_id long, iFLO_unn_groupa double, iFLO_unn_groupb double, HAiFLO_unn_groupa double")
    got = sorted((r.cell_id, r.unn_group, r.iFLO, r.HAiFLO) for r in weights.gather_groups(wide, "cell_id").collect())
    assert got == [(1, "a", 0.5, 0.1), (2, "b", 0.7, None)]
    with pytest.raises(ValueError):
        weights.gather_groups(wide.select("cell_id"), "cell_id")


def test_overlap_conventions(spark):
    rows = [("a", 1, 0.2), ("a", 2, 0.9), ("a", 3, 0.0), ("a", 4, 0.3), ("b", 1, 0.1), ("b", 2, 0.0)]
    chunks = spark.createDataFrame(rows, "line string, chunk int, share double")
    kept = lambda compat: sorted((r.line, r.chunk) for r in terrain.trim_to_reference(chunks, 0.5, compat).collect())
    assert kept(False) == [("a", 2)] and kept(True) == [("a", 2), ("a", 4), ("b", 1)]
    with pytest.raises(ValueError):
        terrain.trim_to_reference(chunks, 0)


def test_from_elevations_to_links(spark):
    z = {(r, c): float(20 - r + abs(c - 5)) for r in range(12) for c in range(11)}
    z[6, 5] = 3.0
    layers = hydrology.process_flowdir(cells_of(spark, z), 8, "fill")
    out = hydrology.generate_vectors(layers)
    table = out["stream_links_attr"].collect()
    assert table and all(r.link_lngth is not None and r.sbbsn_area > 0 for r in table)
    kinds = {r.link_class for r in out["stream_points"].collect()}
    assert kinds <= set(streamlinks.CLASSES) and {3, 5} <= kinds
    assert out["Subbasins_poly"].count() == len(z)
    with pytest.raises(ValueError):
        hydrology.process_flowdir(cells_of(spark, z), 8, burn_streams=cells_of(spark, z))
