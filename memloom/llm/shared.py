"""What the operators of this subpackage share: lineage cuts and reading a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cut table of narrow rows has at most so many partitions for each core of the cluster.
TASKS_A_CORE = 4
#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    Where that is unset, as in local tests, a temporary folder serves, but only
    with a local master, whose tasks all see it; on a cluster the missing
    setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="memloom-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """df in at most TASKS_A_CORE partitions for each core, merged without a shuffle.

    All cores stay busy, and chains of small joins write a few files for each
    core instead of one for each pair of partitions and steps.
    """
    return df.coalesce(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def cut_narrow(df: DataFrame) -> DataFrame:
    """cut() for tables of narrow rows: ids, links, counts."""
    return cut(merged(df))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a Parquet table of its own in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a Parquet table in the shared folder, in buckets by `key`: later joins by it do not shuffle this side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def is_training(doc_id: str = "doc_id") -> "F.Column":
    """Rows from which labels may be learnt: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def held_out(doc_id: str = "doc_id") -> "F.Column":
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
