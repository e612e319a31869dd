import random
import statistics

import pytest
from pyspark.sql import functions as F

from headwater.functions.stats import WEIGHTS, merged_mean, merged_var_pop, merged_var_samp
from headwater.operators.zonal import catchment_quantiles, merge_over, zone_partials


def test_merge_law(spark):
    rng = random.Random(1)
    rows = [(k % 3, rng.choice([None, rng.gauss(5, 2)]), rng.choice([None, rng.random()]), rng.choice("ab")) for k in range(200)]
    cells = spark.createDataFrame(rows, "z long, x double, w double, c string")
    parts = zone_partials(cells, "z", ["x"], {"c": ["a", "b"]}, ["w"])
    pairs = spark.createDataFrame([(z, 9) for z in range(3)] + [(0, 0)], "origin long, destination long")
    got = {r.link_id: r for r in merge_over(pairs, parts, "z", ["x"], {"c": ["a", "b"]}, ["w"], ("mean", "sd", "variance", "min", "max", "sum")).collect()}
    xs = [x for _, x, _, _ in rows if x is not None]
    both = [(x, w) for _, x, w, _ in rows if x is not None and w is not None]
    total = sum(w for _, w in both)
    mean = sum(x * w for x, w in both) / total
    r = got[9]
    assert r.x_lumped_mean == pytest.approx(statistics.fmean(xs), abs=1e-7)
    assert r.x_lumped_sd == pytest.approx(statistics.stdev(xs), abs=1e-7)
    assert r.x_lumped_variance == pytest.approx(statistics.variance(xs), abs=1e-7)
    assert r.x_w_mean == pytest.approx(mean, abs=1e-7)
    assert r.x_w_sd == pytest.approx((sum(w * (x - mean) ** 2 for x, w in both) / total) ** 0.5, abs=1e-7)
    assert r.c_a_lumped_prop == pytest.approx(sum(c == "a" for *_, c in rows) / len(rows))
    assert r.c_a_w_prop + r.c_b_w_prop == pytest.approx(1)


def test_nulls(spark):
    none = spark.createDataFrame([(1.0, None, None), (0.0, 1.0, 1.0)], "n double, m double, v double")
    r = none.agg(merged_mean("n", "m").alias("a"), merged_var_pop("n", "m", "v").alias("b"), merged_var_samp("n", "m", "v").alias("c")).first()
    assert (r.a, r.b, r.c) == (None, None, None)


def test_quantiles_and_weights(spark):
    cells = spark.createDataFrame([(1, float(v)) for v in (1, 2, 2, 9)], "z long, x double")
    pairs = spark.createDataFrame([(1, 1)], "origin long, destination long")
    assert catchment_quantiles(pairs, cells, "z", "x", [0.5]).first()[1] == 2.0
    with pytest.raises(ValueError):
        catchment_quantiles(pairs, cells, "z", "x", [1.5])
    one = lambda n, stream: spark.range(1).select(WEIGHTS[n](F.lit(1000.0), F.lit(0.0), F.lit(4), F.lit(stream))).first()[0]
    assert [one(n, False) for n in WEIGHTS] == [1.0, 0.5, 2.5, 1.0, 4.0] and one("HAiFLS", True) is None
