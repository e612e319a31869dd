import pytest

from headwater.operators import terrain

# a valley that runs south along the middle column
DEM = [[9, 8, 7, 8, 9], [9, 7, 6, 7, 9], [9, 6, 5, 6, 9], [9, 5, 4, 5, 9], [9, 4, 3, 4, 9]]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(r, c, 5 * r + c, float(z)) for r, line in enumerate(DEM) for c, z in enumerate(line)]
    return spark.createDataFrame(rows, "row long, col long, cell_id long, elev double").cache()


def test_pointers_accumulation_streams(cells):
    pointers = terrain.d8_pointer(cells).cache()
    d8 = {r.cell_id: r.d8 for r in pointers.collect()}
    assert d8[2] == 8 and d8[22] == 0 and d8[1] == 4 and d8[5] == 4
    accum = terrain.accumulation(pointers).cache()
    got = {r.cell_id: r.accum for r in accum.collect()}
    assert got[22] == 24 and got[0] == 0
    stream = terrain.streams(accum, 4)
    links = terrain.stream_links(pointers, stream)
    assert {r.link_id for r in links.collect()} <= {r.cell_id for r in stream.collect()}
    basins = terrain.subbasins(pointers, links).collect()
    assert len(basins) == 25 and all(r.link_id is not None for r in basins)
    far = {r.cell_id: (r.target, r.distance) for r in terrain.flow_distance(pointers, stream).collect()}
    assert all(far[r.cell_id][1] == 0 for r in stream.collect())


def test_fill_and_breach(spark, cells):
    pit = [(r.row, r.col, r.cell_id, -1.0 if r.cell_id == 12 else 5.0) for r in cells.collect()]
    frame = spark.createDataFrame(pit, "row long, col long, cell_id long, elev double")
    assert {r.filled for r in terrain.fill_depressions(frame).collect()} == {5.0}
    assert {r.cell_id: r.breached for r in terrain.breach_depressions(frame).collect()}[12] == -1.0


def test_map_algebra(cells):
    hot = terrain.one_hot(cells.selectExpr("cell_id", "cell_id % 2 AS k"), "k", [0, 1])
    assert hot.columns == ["cell_id", "k", "k_0", "k_1"]
    assert terrain.one_hot(cells.selectExpr("cell_id", "1 AS k"), "k", [1]).columns == ["cell_id", "k"]
    near = terrain.nearest_stream(cells, cells.where("cell_id = 12"), 2)
    assert {r.cell_id: r.distance for r in near.collect()}[10] == 2.0
    burned = terrain.burn(cells, near, 5.0)
    assert {r.cell_id: r.burned for r in burned.collect()}[12] == 5.0 - 6
