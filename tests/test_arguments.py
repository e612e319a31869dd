"""The rules for arguments, one test each."""

import pytest

from headwater.functions import arguments as a


def test_threshold_is_whole():
    assert a.threshold(5) == 5
    with pytest.warns(UserWarning):
        assert a.threshold(5.7) == 5


def test_burning_needs_a_depth():
    a.burning(None, None, None)
    a.burning("streams", None, 2.0)
    with pytest.raises(ValueError):
        a.burning("streams", None, None)


@pytest.mark.parametrize("value", [0, -0.1, 1.1])
def test_overlap(value):
    assert a.overlap(1) == 1
    with pytest.raises(ValueError):
        a.overlap(value)


def test_correction_can_be_none():
    assert a.correction("none") == "none"
    with pytest.raises(ValueError):
        a.correction("other")


def test_new_output():
    assert a.new_output(False, "/data/x") == "/data/x"
    with pytest.raises(FileExistsError):
        a.new_output(True, "/data/x")
    with pytest.raises(ValueError):
        a.new_output(False, "/tmp/run/x", "/tmp/run")


def test_site_column():
    assert a.site_column("site", ["site", "x"]) == "site"
    for name in (None, "", ["a", "b"], "link_id"):
        with pytest.raises(ValueError):
            a.site_column(name, ["site"])
    with pytest.raises(KeyError):
        a.site_column("other", ["site"])


def test_snap_distance():
    assert a.snap_distance(None) == float("inf") and a.snap_distance(3) == 3.0
    with pytest.raises(ValueError):
        a.snap_distance(0)


def test_layer_lists():
    assert a.layer_lists({"slope": 1}, None) == ({"slope": 1}, {})
    for bad in ((None, None), (["slope"], None), ({"a": 1}, {"a": 2}), ({"": 1}, None)):
        with pytest.raises(ValueError):
            a.layer_lists(*bad)


def test_one_of():
    assert a.one_of(dataset=None, dem=1) == "dem"
    for bad in ({"dataset": None, "dem": None}, {"dataset": 1, "dem": 1}):
        with pytest.raises(ValueError):
            a.one_of(**bad)


def test_known_variables():
    assert a.known_variables(["b"], ["a", "b"]) == ["b"]
    with pytest.raises(KeyError):
        a.known_variables(["c"], ["a", "b"])


def test_quantiles_and_memory():
    assert a.quantiles([0, 0.5, 1]) == [0, 0.5, 1] and a.memory_fraction(0.5) == 0.5
    with pytest.raises(ValueError):
        a.quantiles([1.2])
    for value in (0.1, 0.9):
        with pytest.raises(ValueError):
            a.memory_fraction(value)


def test_input_kinds(spark, tmp_path):
    from headwater.sources.inputs import POINTS, read_layer

    frame = spark.createDataFrame([(1, 2.0, 3.0)], POINTS)
    frame.write.parquet(f"{tmp_path}/p.parquet")
    frame.write.option("header", True).csv(f"{tmp_path}/p.csv")
    frame.write.json(f"{tmp_path}/p.json")
    for source in (frame, f"{tmp_path}/p.parquet", f"{tmp_path}/p.csv", f"{tmp_path}/p.json"):
        assert [tuple(r) for r in read_layer(spark, source, POINTS).select("id", "x", "y").collect()] == [(1, 2.0, 3.0)]
    with pytest.raises(ValueError):
        read_layer(spark, "points.xyz")
    with pytest.raises(ValueError):
        read_layer(spark, f"{tmp_path}/p.csv")


def test_geometries():
    one = a.Geometry(10, 20, 30.0, crs="EPSG:3161")
    assert a.same_geometry(one, a.Geometry(10, 20, 30.0, crs="EPSG:3161")) and not a.same_geometry(one, a.Geometry(10, 20, 25.0, crs="EPSG:3161"))
    assert a.coordinate_system(one) == "EPSG:3161"
    with pytest.raises(ValueError):
        a.coordinate_system(a.Geometry(1, 1, 1.0))
