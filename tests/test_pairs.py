"""Pairs by blocks, sums over pairs without pairs, and queries over tables larger than those of the checks."""

import random

import pytest
from pyspark.sql import functions as F

from headwater.operators import distance, geometry, relational
from headwater.plans import network

SCHEMA = "link_id long, ds_link_id long, link_lngth long, sbbsn_area double, us_len long, site_id long"


@pytest.fixture(scope="module")
def links(spark):
    """Two trees, one with 70 links that flow into its outlet."""
    rng = random.Random(5)
    ds = {0: None, 1: None} | {i: 0 for i in range(2, 72)} | {i: rng.randrange(max(1, i - 40), i) for i in range(72, 200)}
    return spark.createDataFrame([(i, d, 1 + i % 5, 1.0 + i, -i, i if i % 3 else None) for i, d in ds.items()], SCHEMA).cache()


def part(spark, tmp_path, keys):
    rows = [(k, "a", "b", "c", k % 50 + 1, 900.0) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def moved(df):
    """The last plan's operators from the generated pairs on."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Generate explode")]


def test_f1_differences_of_rows_without_a_common_column(spark, monkeypatch):
    """All pairs, by several lists."""
    monkeypatch.setattr(distance, "SIDE", 4)
    rng = random.Random(1)
    rows = {i: {k: rng.random() for k in rng.sample(range(30), 5)} for i in range(25)} | {90: {99: 1.5}}
    frame = spark.createDataFrame([(i, k, v) for i, some in rows.items() for k, v in some.items()], "origin long, destination long, v double")
    got = {(r.origin, r.other): r.manhattan for r in distance.manhattan(frame).collect()}
    want = {(i, j): sum(abs(a.get(k, 0) - b.get(k, 0)) for k in {*a, *b}) for i, a in rows.items() for j, b in rows.items() if i < j}
    assert got == pytest.approx(want) and len(got) == 26 * 25 // 2


def test_f2_f4_no_pair_is_joined_or_moved(spark, links):
    """Of lists of unlike branches: the same pairs as by brute force, and nothing but projections after them."""
    connected = distance.flow_connected(links).cache()
    found = distance.flow_unconnected(connected, links)
    assert not {w for w in ("Join", "Exchange", "Sort") if w in moved(found)}
    paths = {}
    for r in connected.collect():
        paths.setdefault(r.origin, {})[r.destination] = r.directed_path_length
    want = {(i, j): min(a[m] + b[m] for m in a if m in b) for i, a in paths.items() for j, b in paths.items() if i not in b and j not in a and set(a) & set(b)}
    rows = found.collect()
    assert {(r.origin, r.destination): r.undirected_path_length for r in rows} == want and len(rows) == len(want)


def test_f3_meetings_counted_without_pairs(links):
    connected = distance.flow_connected(links).cache()
    want = distance.flow_unconnected(connected, links).groupBy("origin").agg(F.count("*").alias("n"), F.min("undirected_path_length").alias("nearest"))
    got = distance.meeting_paths(connected, links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_f6_torgegram_moves_no_pair(spark, tmp_path):
    found = network.ana5(spark, part(spark, tmp_path, range(300)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not {w for w in ("Join", "Exchange", "Aggregate") if w in plan[: plan.index("Union")]}
    assert found.count() == found.distinct().count()


def test_f7_pairs_of_points_once(spark):
    points = spark.createDataFrame([(k % 3, k, float(k % 7), float(k % 11)) for k in range(1300)], "g long, id long, x double, y double")
    found = geometry.pairwise_distances(points, "g")
    assert not {w for w in ("Join", "Exchange", "Sort") if w in moved(found)}
    rows = found.collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) == sum(n * (n - 1) // 2 for n in (434, 433, 433)) and all(r.a < r.b for r in rows)


def test_f8_columns_that_the_sql_names(spark):
    """Ten sites or a thousand: a hundred columns, zeros where there is no such site."""
    got = network.ana2(spark, "/root/testdata/sf0.001")
    assert got.columns == ["origin", *map(str, range(100))] and got.count() == 10


def test_f9_targets_beyond_a_list(spark, tmp_path):
    got = network.net13(spark, part(spark, tmp_path, [0, 100, 110, 200_000, 1_234_500, 1_234_510]))
    assert sorted(r.link_id for r in got.collect()) == [0, 100, 200_000, 1_234_500]


def test_f13_nearest_among_crowds(spark, monkeypatch):
    """Four hundred spots within one reach, some at one place: as by brute force, and a place meets few of them."""
    rng = random.Random(2)
    spots = [(k, float(rng.randrange(40)), float(rng.randrange(40))) for k in range(400)] + [(400, 95.0, 20.0)]
    sites = [(k, float(rng.randrange(45)), float(rng.randrange(45))) for k in range(300)] + [(300, 70.0, 20.0), (301, 300.0, 0.0), (302, 35.0, 20.0)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    joined, save = [], relational.saved
    monkeypatch.setattr(relational, "saved", lambda df: joined.append(df) or save(df))
    got = {r.id: (r.near_id, r.distance) for r in relational.nearest_within(frame(sites), frame(spots), 60.0).collect()}
    near = lambda x, y: min(((d, k) for k, a, b in spots if (d := ((x - a) * (x - a) + (y - b) * (y - b)) ** 0.5) <= 60), default=(None, None))
    assert got == {k: near(x, y)[::-1] for k, x, y in sites}
    assert len(joined) > 6  # several widths of squares
