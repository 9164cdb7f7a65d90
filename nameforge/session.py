"""Session helpers shared by every operator: settings, checkpoints, shipping of code."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on; safe to call again and again.

    Map keys are last-wins as in a Python dict, time zone is UTC. The package is
    pickled by value, so executors need no copy of it on their path.
    """
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship("nameforge")
    return spark


def ship(package: str) -> None:
    import importlib

    cloudpickle.register_pickle_by_value(importlib.import_module(package))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is a plain ``local`` one (tests)
    is a temporary folder made; on a cluster the absence is an error.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"nameforge-{os.getpid()}")
    os.makedirs(folder, exist_ok=True)
    return folder


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of df in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=eager)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer pieces than there are cores (a few small files); else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Scratch:
    """Tables written to the shared folder, for loops: unlike a checkpoint, a table read back
    carries no constraints of the plan that made it, so plans stay small round after round."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/nameforge-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:05d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._nameforge_path = path  # for drop()
        return out

    def write_counting(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """The written table and how many of its rows meet a condition, counted while they are written."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count_if(condition).alias("n")))
        return out, seen.get["n"]

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._nameforge_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
