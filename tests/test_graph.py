import pytest

from headwater.operators import distance, graph

# 0 is the outlet; 3 and 4 meet in 1, 5 flows into 2, 1 and 2 meet in 0
TREE = [(0, None), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]


@pytest.fixture
def tree(spark):
    return spark.createDataFrame(TREE, "id long, ds long")


def test_closure_is_reflexive_and_transitive(tree):
    pairs = {(r.origin, r.destination): r.hops for r in graph.closure(tree).collect()}
    assert all(pairs[i, i] == 0 for i, _ in TREE)
    assert len(pairs) == 1 + 2 + 2 + 3 + 3 + 3
    assert all((a, d) in pairs for a, b in pairs for c, d in pairs if b == c)


def test_sums(tree, spark):
    nodes = tree.withColumn("v", tree["id"] + 1)
    assert {r.id: r.total for r in graph.upstream_sum(nodes, "v").collect()} == {0: 21, 1: 11, 2: 9, 3: 4, 4: 5, 5: 6}
    assert {r.id: (r.total, r.outlet) for r in graph.downstream_sum(nodes, "v").collect()} == {0: (1, 0), 1: (3, 0), 2: (4, 0), 3: (7, 0), 4: (8, 0), 5: (10, 0)}
    marked = nodes.withColumn("m", nodes["id"] == 1)
    assert {r.id: (r.first, r.steps) for r in graph.first_marked(marked, "m").collect()} == {0: (None, None), 1: (1, 0), 2: (None, None), 3: (1, 1), 4: (1, 1), 5: (None, None)}


def test_orders_and_antichains(tree):
    assert {r.id: r.strahler for r in graph.strahler(tree).collect()} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    group = {r.id: r.unn_group for r in graph.antichains(tree).collect()}
    pairs = [(r.origin, r.destination) for r in graph.closure(tree).collect()]
    assert all(group[a] != group[b] for a, b in pairs if a != b)


def test_cycle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIMIT", 4)
    with pytest.raises(graph.CycleError):
        graph.closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, ds long")).count()


def test_distances(spark):
    links = spark.createDataFrame([(i, d, 10 + i, 100.0, -i, i) for i, d in TREE], "link_id long, ds_link_id long, link_lngth long, sbbsn_area double, us_len long, site_id long")
    connected = distance.flow_connected(links).cache()
    at = {(r.origin, r.destination): r for r in connected.collect()}
    assert at[3, 0].directed_path_length == 13 + 11 + 10
    assert at[3, 1].prop_shared_catchment == pytest.approx(1 / 3)
    apart = {(r.origin, r.destination): r.undirected_path_length for r in distance.flow_unconnected(connected, links).collect()}
    assert apart[3, 4] == (13 + 11) + (14 + 11) and apart[3, 5] == apart[5, 3]
    assert not set(apart) & set(at)
    shares = {r.link_id: r for r in distance.additive_function(links).collect()}
    assert shares[3].influence == pytest.approx(0.5) and shares[3].afv == pytest.approx(0.5 * 0.6)
