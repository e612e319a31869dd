"""Closures, orders and distances on long chains and random trees, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from headwater.operators import distance, graph, streamlinks
from headwater.operators.relational import numbered


def frame(spark, ds):
    return spark.createDataFrame(list(ds.items()), "id long, ds long")


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_long_chain(spark):
    """Two thousand links in a row: the final plan has no join, and pairs from or to one node are found alone."""
    edges = frame(spark, {i: i + 1 if i < 2000 else None for i in range(1, 2001)})
    one = spark.createDataFrame([(1500,)], "id long")
    up, down = graph.closure(edges, destinations=one), graph.closure(edges, origins=one)
    assert joins(up) == joins(down) == 0
    assert sorted((r.origin, r.hops) for r in up.collect()) == [(i, 1500 - i) for i in range(1, 1501)]
    assert sorted((r.destination, r.hops) for r in down.collect()) == [(i, i - 1500) for i in range(1500, 2001)]
    assert {r.id: r.longest for r in graph.longest_upstream(edges.withColumn("one", F.lit(1)), "one").collect()} == {i: i - 1 for i in range(1, 2001)}


@pytest.fixture(scope="module")
def tree():
    rng = random.Random(7)
    return {i: None if i in (0, 1) else rng.randrange(max(0, i - 9), i) for i in range(160)}


def upstream(tree):
    above = {i: set() for i in tree}
    for i in tree:
        j = i
        while j is not None:
            above[j].add(i)
            j = tree[j]
    return above


def test_closure_and_orders(spark, tree):
    edges, above = frame(spark, tree), upstream(tree)
    pairs = graph.closure(edges)
    assert joins(pairs) == 0
    assert {(r.origin, r.destination) for r in pairs.collect()} == {(i, j) for j, some in above.items() for i in some}
    kids = {i: [k for k in tree if tree[k] == i] for i in tree}
    order, longest = {}, {}
    for i in sorted(tree, reverse=True):
        tops = sorted((order[k] for k in kids[i]), reverse=True)
        order[i] = 1 if not tops else tops[0] + (len(tops) > 1 and tops[0] == tops[1])
        longest[i] = max((longest[k] + 1 for k in kids[i]), default=0)
    assert {r.id: r.strahler for r in graph.strahler(edges).collect()} == order and max(order.values()) >= 4
    groups = {r.id: r.unn_group for r in graph.antichains(edges).collect()}
    assert groups == {i: f"g{n:05d}" for i, n in longest.items()}
    assert all(groups[i] != groups[j] for j, some in above.items() for i in some if i != j)


def test_unconnected_distances(spark, tree):
    rows = [(i, d, 1 + i % 5, 1.0 + i, -i, i if i % 3 else None) for i, d in tree.items()]
    links = spark.createDataFrame(rows, "link_id long, ds_link_id long, link_lngth long, sbbsn_area double, us_len long, site_id long")
    got = {(r.origin, r.destination): r.undirected_path_length for r in distance.flow_unconnected(distance.flow_connected(links), links).collect()}

    def path(i):
        out, total = {}, 0
        while i is not None:
            total += 1 + i % 5
            out[i] = total
            i = tree[i]
        return out

    paths = {i: path(i) for i in tree if i % 3}
    want = {(i, j): min(a[m] + b[m] for m in a if m in b) for i, a in paths.items() for j, b in paths.items() if i not in b and j not in a and set(a) & set(b)}
    assert got == want and len(want) > 1000


def test_attributes_by_name(spark, tree):
    rows = [(i, d, 2, -i) for i, d in tree.items()]
    links = spark.createDataFrame(rows, "link_id long, ds_link_id long, link_lngth long, us_len long")
    cells = spark.createDataFrame([(i, float(k), 0.5) for i in tree for k in range(3)], "link_id long, elev double, cont_slope double")
    out = streamlinks.with_attributes(links, list(streamlinks.EXTRA), cells)
    assert out.columns == [*links.columns, *streamlinks.EXTRA] and out.count() == len(tree)
    first = out.where("link_id = 0").first()
    assert (first.USChnLn_To, first.Elevation, first.link_slope) == (2 * len(upstream(tree)[0]), 1.0, 2 / 3)
    with pytest.raises(ValueError):
        streamlinks.with_attributes(links, ["StOrd_Other"])


def test_numbers_without_one_task(spark):
    some = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(5)
    assert all(r.row == r.k + 1 for r in numbered(some, [F.col("k")]).collect())
