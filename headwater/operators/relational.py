"""Small relational building blocks of the analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.steps import saved


def all_min(df: DataFrame, keys: list[str]) -> DataFrame:
    """The least of every other column by ``keys``."""
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in df.columns if c not in keys])


def keep_extreme(df: DataFrame, keys: list[str], column: str, largest: bool = True) -> DataFrame:
    """Rows that hold their group's extreme of ``column``, ties kept."""
    top = (F.max if largest else F.min)(column).over(Window.partitionBy(*keys))
    return df.withColumn("__top", top).where(F.col(column) == F.col("__top")).drop("__top")


def replace_by_key(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the rows whose keys ``new`` has replaced by ``new``."""
    return df.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def split_cached(wanted: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The wanted rows whose key is cached, and the others."""
    known = cached.select(key).distinct()
    return wanted.join(known, key, "left_semi"), wanted.join(known, key, "left_anti")


#: Most times that squares are halved, and how many spots may share one, as a spot sees it.
HALVES, CROWD = 20, 4


def nearest_within(sites: DataFrame, spots: DataFrame, reach: float) -> DataFrame:
    """``id, near_id, distance``: for each of ``sites`` (id, x, y) the nearest of ``spots`` (id, x, y) within ``reach``.

    Points fall into squares; a spot is dealt to its square and the eight around
    it, so the join is by square.  Squares are halved from the reach until a
    spot shares its own with few others; what is found nearer than a square's
    side is final, and only places without are looked for in squares twice as
    wide.  So a place meets few spots however dense they lie.  Places and spots
    are looked for once, however many lie there.  Ties go to the smaller id;
    sites without a spot get nulls.
    """
    spots = saved(spots.groupBy("x", "y").agg(F.min("id").alias("near_id")).where("x IS NOT NULL AND y IS NOT NULL"))
    square = lambda c, k: F.floor(F.col(c) / F.lit(reach / 2**k)).alias(f"b{c}")
    level = next(k for k in range(HALVES + 1) if k == HALVES or spots.groupBy(square("x", k), square("y", k)).count().agg(F.coalesce(F.sum(F.col("count") * F.col("count")) <= CROWD * F.sum("count"), F.lit(True))).first()[0])
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    gap = F.sqrt((F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny")))
    left, found = saved(sites.select("x", "y").distinct()), []
    for k in range(level, -1, -1):
        near = spots.select("near_id", F.col("x").alias("nx"), F.col("y").alias("ny"), square("x", k), square("y", k), around.alias("o"))
        near = near.select("near_id", "nx", "ny", (F.col("bx") + F.col("o.a")).alias("bx"), (F.col("by") + F.col("o.b")).alias("by"))
        met = left.select("x", "y", square("x", k), square("y", k)).join(near, ["bx", "by"]).withColumn("distance", gap)
        met = met.where(F.col("distance") < reach / 2**k if k else F.col("distance") <= reach)
        found.append(saved(met.groupBy("x", "y").agg(F.min(F.struct("distance", "near_id")).alias("best"))))
        left = saved(left.join(found[-1].select("x", "y"), ["x", "y"], "left_anti")) if k else left
    return sites.select("id", "x", "y").join(reduce(DataFrame.union, found), ["x", "y"], "left").select("id", "best.near_id", "best.distance")


#: About as many rows as a side of one block of pairs has.
BLOCK = 512


def blocks(df: DataFrame, key: str, name: str, size: int = BLOCK) -> DataFrame:
    """``key, {name}_block, {name}``: the rows of each key dealt by their hash to lists of about ``size``."""
    rest = [c for c in df.columns if c != key]
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / size).alias("__n"))
    dealt = df.join(sizes, key).withColumn(f"{name}_block", F.pmod(F.xxhash64(*rest), F.col("__n")))
    return dealt.groupBy(key, f"{name}_block").agg(F.collect_list(F.struct(*rest)).alias(name))


def spread(units: DataFrame, *keys: str) -> DataFrame:
    """``units``, few rows with much work in each, dealt to all cores; a number that is given is not coalesced."""
    spark = units.sparkSession
    return units.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def pairs_of(units: DataFrame, *keep: str) -> DataFrame:
    """``keep, l, r``: every element of the list ``l`` with every one of ``r``; pairs are made where they are used and never moved."""
    return units.select(*keep, "r", F.explode("l").alias("l")).select(*keep, "l", F.explode("r").alias("r"))


def block_pairs(df: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """``key, l_block, l, r_block, r``: each two lists of one ``key``, and each list with itself."""
    one = saved(blocks(df, key, "l", size))
    two = one.withColumnsRenamed({"l": "r", "l_block": "r_block"})
    return spread(one.join(two, key).where("l_block <= r_block"), key, "l_block", "r_block")


def paired(df: DataFrame, key: str, id_: str) -> DataFrame:
    """``key, l, r``: structs of each two rows of one ``key``, once, the smaller ``id_`` first.

    Only lists of rows are joined and dealt out, so a key's work is as many
    blocks as it has pairs of lists, and what is moved is a small part of what
    comes out.
    """
    every = pairs_of(block_pairs(df, key), key, "l_block", "r_block")
    turned = F.col(f"l.{id_}") > F.col(f"r.{id_}")
    every = every.where((F.col(f"l.{id_}") < F.col(f"r.{id_}")) | (turned & (F.col("l_block") < F.col("r_block"))))
    return every.select(key, F.when(turned, F.col("r")).otherwise(F.col("l")).alias("l"), F.when(turned, F.col("l")).otherwise(F.col("r")).alias("r"))


def numbered(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """``df`` with row numbers from 1 in the given order, without one task for the table.

    Rows are split by ranges and numbered within them; a range's numbers start
    behind the rows of the ranges before it, whose counts are all that is
    gathered.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    inside = saved(ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order))))
    counts = inside.groupBy("__part").agg(F.count("*").alias("__c"))
    before = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__b"))
    return inside.join(F.broadcast(before), "__part").withColumn(name, F.col("__n") + F.col("__b")).drop("__part", "__n", "__b")
