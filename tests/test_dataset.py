import pytest

from headwater.operators.relational import nearest_within
from headwater.operators.sites import resolve_targets
from headwater.sources.dataset import Dataset
from headwater.streaming.incremental import keep_catchments


def test_write_read_replace_drop(spark, tmp_path):
    data = Dataset.create(spark, str(tmp_path / "d"))
    with pytest.raises(FileExistsError):
        Dataset.create(spark, str(tmp_path / "d"))
    with pytest.raises(FileNotFoundError):
        Dataset.open(spark, str(tmp_path / "none"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "link_id long, v string")
    data.write("stream_links_attr", rows, sort_by="link_id")
    data.write("stream_links_attr", spark.createDataFrame([(3, "c")], rows.schema), mode="append")
    data.replace("stream_links_attr", spark.createDataFrame([(2, "B")], rows.schema), ["link_id"])
    again = Dataset.open(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, again.table("stream_links_attr").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert [r.v for r in again.select("stream_links_attr", rows.where("link_id = 1"), "link_id").collect()] == ["a"]
    assert [tuple(r) for r in again.layers().collect()] == [("stream_links_attr", "Table", "hydro")]
    assert again.table("site_id_col").count() == 0
    with pytest.raises(KeyError):
        again.table("absent")
    with pytest.raises(KeyError):
        again.require("stream_links_attr", "absent")
    with pytest.raises(ValueError):
        again.write("x", rows, "Picture")
    again.to_csv("stream_links_attr", str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    again.drop("stream_links_attr")
    assert again.layers().count() == 0


def test_stream_adds_missing_catchments_once(spark, tmp_path):
    data = Dataset.create(spark, str(tmp_path / "d"))
    pairs = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 3)], "origin long, destination long")
    data.write("Catchment_poly", spark.createDataFrame([(3, 3)], "link_id long, origin long"), "Vector")
    for part in range(2):
        spark.createDataFrame([(1,), (3,)], "link_id long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("link_id long").parquet(str(tmp_path / "in"))
        query = keep_catchments(stream, pairs, data, str(tmp_path / "state"))
        query.awaitTermination(60)
    assert sorted(map(tuple, data.table("Catchment_poly").collect())) == [(1, 1), (1, 2), (3, 3)]


def test_targets_and_snapping(spark):
    links = spark.createDataFrame([(1, None), (2, 7), (3, 8)], "link_id long, site_id long")
    ids = lambda *a: sorted(r.link_id for r in resolve_targets(links, *a).collect())
    assert ids() == [1, 2, 3] and ids([7], [2, 3]) == [2, 3] and ids([8]) == [3]
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "id long, x double, y double")
    spots = spark.createDataFrame([(5, 3.0, 4.0), (4, 4.0, 3.0)], "id long, x double, y double")
    assert [tuple(r) for r in nearest_within(sites, spots, 6.0).orderBy("id").collect()] == [(1, 4, 5.0), (2, None, None)]
