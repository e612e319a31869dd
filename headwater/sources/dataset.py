"""A dataset: a folder of Parquet layers with a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators.relational import replace_by_key
from headwater.sources.catalog import classify_layers

CATALOG = "_catalog"
KINDS = ("Raster", "Vector", "Table")
OPTIONAL = "site_id_col"


class Dataset:
    """Layers below ``root``, any folder that Spark reads; a layer is a Parquet table named in the catalog."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Dataset:
        """A new dataset; one that exists is an error."""
        out = cls(spark, root)
        if out._exists(f"{out.root}/{CATALOG}"):
            raise FileExistsError(f"a dataset exists at {root}")
        spark.createDataFrame([], "layer_name string, data_type string").write.parquet(f"{out.root}/{CATALOG}")
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Dataset:
        out = cls(spark, root)
        if not out._exists(f"{out.root}/{CATALOG}"):
            raise FileNotFoundError(f"no dataset at {root}")
        return out

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _entries(self) -> list[tuple[str, str]]:
        return [tuple(r) for r in self.spark.read.schema("layer_name string, data_type string").parquet(f"{self.root}/{CATALOG}").distinct().collect()]

    def layers(self) -> DataFrame:
        """``layer_name, data_type, data_group``."""
        return classify_layers(self.spark.createDataFrame(self._entries(), "layer_name string, data_type string"))

    def table(self, name: str) -> DataFrame:
        """A layer, lazily; an absent ``site_id_col`` is an empty table, any other an error."""
        if name in {n for n, _ in self._entries()}:
            return self.spark.read.parquet(f"{self.root}/{name}")
        if name == OPTIONAL:
            return self.spark.createDataFrame([], "site_id_col string")
        raise KeyError(f"no layer {name}")

    def require(self, *names: str) -> None:
        """An error that names the layers that are missing."""
        missing = [n for n in names if n != OPTIONAL and n not in {x for x, _ in self._entries()}]
        if missing:
            raise KeyError("missing layers: " + ", ".join(missing))

    def select(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows of a layer whose ``key`` is among ``keys``."""
        return self.table(name).join(keys.select(key).distinct(), key, "left_semi")

    def write(self, name: str, df: DataFrame, kind: str = "Table", mode: str = "overwrite", sort_by: str | None = None) -> DataFrame:
        """Write or append a layer and list it; rows are clustered by ``sort_by`` so that its filters skip row groups."""
        if kind not in KINDS:
            raise ValueError(f"a layer is one of {KINDS}")
        if sort_by:
            df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
        df.write.mode(mode).parquet(f"{self.root}/{name}")
        if name not in {n for n, _ in self._entries()}:
            self.spark.createDataFrame([(name, kind)], "layer_name string, data_type string").coalesce(1).write.mode("append").parquet(f"{self.root}/{CATALOG}")
        return self.table(name)

    def register(self, entries: list[tuple[str, str]]) -> None:
        """List layers (name, kind) that are, or are to be, written below the root."""
        if bad := [k for _, k in entries if k not in KINDS]:
            raise ValueError(f"a layer is one of {KINDS}, not {bad}")
        known = {n for n, _ in self._entries()}
        new = [e for e in entries if e[0] not in known]
        if new:
            self.spark.createDataFrame(new, "layer_name string, data_type string").coalesce(1).write.mode("append").parquet(f"{self.root}/{CATALOG}")

    def replace(self, name: str, new: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of a layer replaced by key; the result is saved in the shared folder before the layer is overwritten."""
        from headwater.functions.steps import saved

        return self.write(name, saved(replace_by_key(self.table(name), new, keys)))

    def drop(self, name: str) -> None:
        """Remove a layer; an absent one is no error."""
        entries = [e for e in self._entries() if e[0] != name]
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.spark.createDataFrame(entries, "layer_name string, data_type string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{CATALOG}")

    def to_csv(self, name: str, path: str) -> None:
        self.table(name).write.mode("overwrite").option("header", True).csv(path)
