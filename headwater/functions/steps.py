"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset on one machine a temporary one, which goes when the driver ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
            folder = tempfile.mkdtemp(prefix="headwater-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Rows above which a saved table is not broadcast: encoded on disk it is many times smaller than in the driver's memory.
WIDE = 300_000


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared folder and read back; later plans see its true size and read only the columns that they use.

    By the size of its files a table of over a million rows may look small
    enough for the driver to collect; with more than ``WIDE`` rows it is merged.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if rows.get["n"] > WIDE else out
