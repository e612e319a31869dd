"""Layers from files or tables, by kind of file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.functions.arguments import input_path

POINTS = "id long, x double, y double"


def read_layer(spark: SparkSession, source: DataFrame | str, schema: str | None = None) -> DataFrame:
    """A table itself, or a Parquet, CSV (with a header) or JSON file; other kinds are an error.

    A CSV file needs a ``schema``, so that its types do not depend on its rows.
    """
    if isinstance(source, DataFrame):
        return source
    path = input_path(source)
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.lower().rstrip("/").endswith(".json"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if not schema:
        raise ValueError("a CSV file needs a schema")
    return spark.read.schema(schema).option("header", True).csv(path)
