"""Session-level helpers shared by every operator."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Enough tasks that none gets more than about `rows_per_task` rows."""
    return max(shuffle_partitions(spark), math.ceil(rows / rows_per_task), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in `spark.checkpoint.dir`.

    A local folder is used only where none is named and the master is a local one.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        where = os.path.join(tempfile.gettempdir(), "draftlake-checkpoints")
    return where


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Have a folder of this session, on whatever file system, removed when the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and cut its lineage there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        remove_at_end(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)
