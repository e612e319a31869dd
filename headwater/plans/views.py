"""Network, cell and grid inputs derived from the test tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the grid that the embeddings make, one row of cells for each vector.
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large network: link k flows into (k - 1) div 2, link 0 is the outlet."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS link_id", "CASE WHEN p_partkey > 0 THEN (p_partkey - 1) div 2 END AS ds_link_id", "CAST(p_size AS BIGINT) AS link_lngth", "p_retailprice AS sbbsn_area", "-p_partkey AS us_len", "CASE WHEN p_partkey % 10 = 0 THEN p_partkey END AS site_id"
    )


def few_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small network of the same shape in which every link is a site."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS link_id", "CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) div 2 END AS ds_link_id", "1 + s_suppkey % 50 AS link_lngth", "abs(s_acctbal) + 1 AS sbbsn_area", "-s_suppkey AS us_len", "s_suppkey AS site_id"
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag of raster cells, each in the subbasin of a link."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS link_id", "l_quantity AS num_a", "nullif(l_discount, 0D) AS num_b", "l_returnflag AS cat", "l_extendedprice AS dist", "1D / (0.001D * l_extendedprice + 1D) AS w", "CAST(l_linenumber AS DOUBLE) AS accum"
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An elevation grid with unique cells."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "e")).select("row", F.col("col").cast("long").alias("col"), F.col("e").cast("double").alias("elev"), (F.col("row") * WIDTH + F.col("col")).alias("cell_id"))


LINKS = """links AS (
    SELECT p_partkey AS link_id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS ds_link_id, CAST(p_size AS BIGINT) AS link_lngth,
           p_retailprice AS sbbsn_area, -p_partkey AS us_len, CASE WHEN p_partkey % 10 = 0 THEN p_partkey END AS site_id FROM part)"""
FEW = """links AS (
    SELECT s_suppkey AS link_id, CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) // 2 END AS ds_link_id, 1 + s_suppkey % 50 AS link_lngth,
           abs(s_acctbal) + 1 AS sbbsn_area, -s_suppkey AS us_len, s_suppkey AS site_id FROM supplier)"""
CLOSURE = """cl(origin, destination, hops) AS (
    SELECT link_id, link_id, 0 FROM links
    UNION ALL SELECT c.origin, l.ds_link_id, c.hops + 1 FROM cl c JOIN links l ON c.destination = l.link_id WHERE l.ds_link_id IS NOT NULL)"""
CELLS = """cells AS (
    SELECT l_partkey AS link_id, l_quantity AS num_a, nullif(l_discount, 0) AS num_b, l_returnflag AS cat, l_extendedprice AS dist,
           1 / (0.001::DOUBLE * l_extendedprice + 1) AS w, CAST(l_linenumber AS DOUBLE) AS accum FROM lineitem)"""
GRID = f"""grid AS (
    SELECT "row", col, elev, "row" * {WIDTH} + col AS cell_id FROM (
        SELECT vec_id AS "row", CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS col, CAST(unnest(embedding) AS DOUBLE) AS elev FROM embeddings))"""
