"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master, whose tasks see the driver's disk, may do without."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="memloom-")
        sc.setCheckpointDir(found)
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    """The path of a folder, not made yet, for one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
