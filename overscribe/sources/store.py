"""The section store as a table, and the pointer to the latest run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunk import upsert
from .cache import exists
from .scratch import written

#: Columns of the store of sections.
POINT = "id string, source_file string, idx int, content string, vector array<float>"

#: Folders of the store; a file is in the one that its name's hash says.
BUCKETS = 64


def ensure(spark: SparkSession, path: str, reset: bool = False) -> DataFrame:
    """The store at ``path``, made empty where there is none, or where it is to be reset."""
    if reset or not exists(spark, path):
        spark.createDataFrame([], POINT).write.mode("overwrite").parquet(path)
    return spark.read.schema(POINT).parquet(path)


def _bucketed(points: DataFrame) -> DataFrame:
    return points.withColumn("bucket", F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int"))


def create(points: DataFrame, path: str) -> DataFrame:
    """The store of ``points`` at ``path``, in buckets of whole files."""
    _bucketed(points).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return points.sparkSession.read.parquet(path)


def upsert_files(spark: SparkSession, path: str, new: DataFrame, prune: bool = False) -> DataFrame:
    """The bucketed store after an upsert of the points of some files: only buckets that have one of these are read and written.

    A file's old tail stays if its new version is shorter, unless ``prune``. The
    new buckets are staged as a whole before they take the old ones' place.
    """
    new = written(_bucketed(new), "points")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    if touched:
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        merged = written(upsert(old, new, "id", "source_file" if prune else None), "merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path)


def merge_latest(spark: SparkSession, path: str, rows: DataFrame, key: str, at: str = "at") -> None:
    """Rows into a table that keeps, of each key, the row with the largest ``at``: only the buckets of their keys are read and written.

    Merging the same rows again changes nothing, so a batch can be run again.
    """
    new = written(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), "latest")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    if not touched:
        return
    if exists(spark, path):
        new = new.unionByName(spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)))
    order = Window.partitionBy("bucket", key).orderBy(F.desc(at))
    kept = written(new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n"), "merged")
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def publish(df: DataFrame, root: str, run: str) -> None:
    """Write a run, then point ``latest`` to it: readers see the old run until the new one is whole."""
    df.write.mode("overwrite").parquet(f"{root}/{run}")
    df.sparkSession.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(f"{root}/latest")


def latest(spark: SparkSession, root: str) -> DataFrame:
    run = spark.read.schema("run string").json(f"{root}/latest").first().run
    return spark.read.parquet(f"{root}/{run}")
