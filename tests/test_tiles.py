"""Grids across the borders of tiles, against plain Python, and what is moved for it."""

import math
import random

from pyspark.sql import functions as F

from headwater.operators import terrain


def surface(seed, levels, rows=range(122, 135), cols=range(-6, 6)):
    rng = random.Random(seed)
    return {(r, c): float(rng.randrange(levels)) for r in rows for c in cols if rng.random() < 0.95}


def cells_of(spark, z):
    return spark.createDataFrame([((r << 20) + c, r, c, v) for (r, c), v in z.items()], "cell_id long, row long, col long, elev double")


def operators(df, *names):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [plan.count(n) for n in names]


def test_f19_pointers_across_tiles(spark):
    """The steepest way as in plain Python, by one shuffle of the cells and without joins; null elevations take no part."""
    z = surface(3, 6) | {(128, 0): None, (125, -1): None}
    found = terrain.d8_pointer(cells_of(spark, z))
    assert operators(found, "Exchange", "Join") == [1, 0]
    want = {}
    for (r, c), v in z.items():
        around = [((v - z[r + a, c + b]) / (math.sqrt(2) if a and b else 1), -k, (r + a << 20) + c + b) for a, b, k in terrain.D8 if v is not None and z.get((r + a, c + b)) is not None]
        drop, k, to = max(around, default=(0, 0, None))
        want[(r << 20) + c] = (-k, to) if drop > 0 else (0, None)
    assert {r.cell_id: (r.d8, r.ds) for r in found.collect()} == want


def test_f15_filling_across_tiles(spark):
    z = surface(4, 9)
    found = terrain.fill_depressions(cells_of(spark, z))
    edge = {p for p in z if sum((p[0] + a, p[1] + b) in z for a, b, _ in terrain.D8) < 8}
    want = {p: v if p in edge else math.inf for p, v in z.items()}
    while (new := {(r, c): v if (r, c) in edge else max(z[r, c], min(want[r + a, c + b] for a, b, _ in terrain.D8)) for (r, c), v in want.items()}) != want:
        want = new
    assert {r.cell_id: r.filled for r in found.collect()} == {(r << 20) + c: v for (r, c), v in want.items()}


def test_f14_rounds_of_breaching_double(spark):
    """A ditch of 60 cells below one rim cell is cut in seven rounds at most, to the level of its deepest cell upstream."""
    z = {(r, c): 9.0 if r == 1 else 20.0 for r in range(3) for c in range(66)} | {(1, c): 3.0 - c / 100 for c in range(2, 62)}
    got = {r.cell_id: r.breached for r in terrain.breach_depressions(cells_of(spark, z), rounds=8).collect()}
    filled = {r.cell_id: r.filled for r in terrain.fill_depressions(cells_of(spark, z)).collect()}
    way = {}
    for (r, c) in z:
        around = [(filled[(r + a << 20) + c + b], (r + a << 20) + c + b) for a, b, _ in terrain.D8 if (r + a, c + b) in z]
        low = [x for x in around if x[0] <= filled[(r << 20) + c]]
        if low:
            way[(r << 20) + c] = min(low)[1]
    want = {(r << 20) + c: v for (r, c), v in z.items()}
    start = dict(want)
    for _ in range(200):
        for k, to in way.items():
            if filled[to] > start[to]:
                want[to] = min(want[to], want[k])
    assert got == want and sum(want[k] < start[k] for k in want) > 20


def test_f20_regions_across_tiles(spark):
    """Parts of equal names over four tiles, in plain Python and by tables of no more than the borders."""
    from headwater.operators import geometry

    z = {p: "ab"[int(v)] for p, v in surface(9, 2).items()}
    cells = spark.createDataFrame([((r << 20) + c, r, c, v) for (r, c), v in z.items()], "cell_id long, row long, col long, v string")
    label = {}
    for p in sorted(z, key=lambda p: (p[0] << 20) + p[1]):
        todo = [] if p in label else [p]
        while todo:
            q = todo.pop()
            label[q] = p
            todo += [n for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (n := (q[0] + a, q[1] + b)) in z and n not in label and z[n] == z[q]]
    want = {(r << 20) + c: (a << 20) + b for (r, c), (a, b) in label.items()}
    assert {r.cell_id: r.region for r in geometry.regions(cells, "v").collect()} == want
    assert {r.cell_id: r.region for r in geometry.regions(cells.withColumn("v", F.ascii("v")), "v").collect()} == want
