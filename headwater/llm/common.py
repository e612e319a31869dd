"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark's own reader."""
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def make_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver's own path names it, as when it was not installed.

    On a cluster without a shared copy the package is shipped with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, have)))


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable.

    The folder is the cluster's shared one, named by ``spark.checkpoint.dir``.
    Only where that is unset on one machine (tests) a temporary one is taken,
    which goes when the driver ends; unset on a cluster, it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
            folder = tempfile.mkdtemp(prefix="headwater-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared checkpoint folder and read back, which cuts its lineage.

    Later plans see the table's true size and read only the columns that they use.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    make_importable(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, for tables whose joins shuffle at any size.

    The plan knows no size of it beforehand, so no join turns from a broadcast
    into a shuffle as the input grows.
    """
    use_checkpoints(df.sparkSession)
    make_importable(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect what nothing refers to any more, so that Spark's cleaner drops old shuffles and broadcasts at once.

    Left to itself, a driver with a large heap keeps their files and its own memory for long.
    """
    spark._jvm.System.gc()


#: What drops the caches that operators keep in a Python worker from task to task.
WORKER_CACHES: list[Callable[[], None]] = []


def light_worker() -> None:
    """Drop what earlier operators keep in this Python worker; Spark hands workers on from stage to stage."""
    for drop in WORKER_CACHES:
        drop()
