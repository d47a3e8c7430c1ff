"""Intermediate tables that several plans read: Parquet in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir() was given; a temporary folder where neither is set and Spark runs on this machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        at = tempfile.mkdtemp(prefix="overscribe-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where a scan has fewer partitions than there are cores: a file of few row groups, read for costly work on its texts.

    A scan of many files has more partitions than that, and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, worked out once and kept as a file: later plans read it, with its size known, and lost executors cost no more than a read."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
