"""Results that are kept from one run to the next, by the content that they were worked out from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dense


def content_key(*columns: str) -> Column:
    """MD5 of the values; a null differs from an empty text."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns)))


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def topped_up(rows: DataFrame, key: str, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what the table at ``path`` holds for their keys; what it lacks is computed, once a key, and appended.

    compute: rows -> (key, ...). Two runs at once may both append a key; reading takes one of them.
    """
    spark = rows.sparkSession
    missing = rows.dropDuplicates([key])
    if exists(spark, path):
        missing = missing.join(spark.read.parquet(path).select(key), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return rows.join(spark.read.parquet(path).dropDuplicates([key]), key, "left")


def vectors(docs: DataFrame, path: str, make: Callable[[], dense.Embedder] = dense.HashedEmbedder, prefix: str = "passage") -> DataFrame:
    """doc_id, vector of documents (doc_id, title, text): embedded only where the table lacks their content."""
    rows = docs.select("doc_id", F.concat_ws("\n", "title", "text").alias("_t")).withColumn("key", content_key("doc_id", "_t"))
    found = topped_up(rows, "key", path, lambda m: m.select("key", dense.embed(F.col("_t"), make, prefix).alias("vector")))
    return found.select("doc_id", "vector")
