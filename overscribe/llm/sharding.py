"""Sharding by extendible hashing, in Spark's own functions.

A row's address is the bits of the MD5 of its doc_id. The directory starts with
one bucket; a bucket over the byte limit is split on its next address bit, and
only such a bucket, until all fit. The sizes of many levels come from one
grouped sum: bytes are summed by the address prefix of a depth DEEPER levels
below that at which even buckets would fit, and these sums, few next to the
rows, are summed again for each level above. A prefix's shard is then its
shallowest ancestor that fits. Prefixes that do not fit even at that depth go
another round on their own.

Rows with one doc_id have one address. For them the second half of the address,
from the number that the row got when it was read, goes on where the first one
ends, so that a doc_id with more rows than fit is split in the same way.
A row that is larger than the limit by itself is a shard by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Bytes of a shard at most.
SHARD_BYTES = 1 << 20
#: Levels summed at once, and bits of each half of an address.
DEEPER, HALF = 6, 60


def _bits(hexdigest: Column) -> Column:
    return F.conv(F.substring(hexdigest, 1, HALF // 4), 16, 10).cast("long")


def prefix(depth: int) -> Column:
    """The first bits of an address, as text of zeros and ones."""
    first = F.lpad(F.bin(F.shiftright("a", HALF - min(depth, HALF))), min(depth, HALF), "0") if depth else F.lit("")
    if depth <= HALF:
        return first
    return F.concat(first, F.lpad(F.bin(F.shiftright("b", 2 * HALF - depth)), depth - HALF, "0"))


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (address prefix), depth (its bits) of every row.

    n_bytes is the length of the text in UTF-8, 0 for a null one; a row without
    a doc_id has the address of the empty text. The empty table has no shards.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"a": _bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "b": _bits(F.md5(F.concat(F.lit("row "), F.col("row").cast("string"))))})
    rest = materialize(rows.drop("row"), "addresses")
    total, n = rest.agg(F.sum("n_bytes"), F.count("*")).first()
    if not n:
        return rest.select("doc_id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"))
    out, low = None, 0
    high = min(HALF, max(0, math.ceil(math.log2(max(1, total / limit)))) + DEEPER)
    while True:
        fine = rest.groupBy(prefix(high).alias("fine")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("shard", F.expr("substring(fine, 1, depth)"))
        fit = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("_bytes"), F.sum("rows").alias("_rows"))
        fit = fit.where((F.col("_bytes") <= limit) | (F.col("_rows") == 1))
        fit = materialize(fit, "fitting")
        # Above the shallowest prefix that fits nothing can match; there all of them would have a few prefixes as their key.
        least = fit.agg(F.coalesce(F.min("depth"), F.lit(high + 1))).first()[0]
        of = levels.where(F.col("depth") >= least).join(fit, ["depth", "shard"]).groupBy("fine").agg(F.min("depth").alias("depth"))
        of = materialize(of, "directory")
        release(fit)
        placed = rest.withColumn("fine", prefix(high)).join(of, "fine", "left")
        done = placed.where("depth is not null").select("doc_id", "n_bytes", F.expr("substring(fine, 1, depth)").alias("shard"), "depth")
        out = done if out is None else out.union(done)
        over = fine.join(of, "fine", "left_anti").limit(1).count()
        if not over or high == 2 * HALF:
            left = placed.where("depth is null").select("doc_id", "n_bytes", F.col("fine").alias("shard"), F.lit(high).alias("depth"))
            return out.union(left) if over else out
        rest = materialize(placed.where("depth is null").select("doc_id", "n_bytes", "a", "b"), "oversized")
        low, high = high + 1, min(2 * HALF, high + DEEPER + (HALF // 2 if high < HALF else 0))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Write documents with unique ids as one folder a shard under ``path``; returns the directory: shard, depth, n_docs, n_bytes."""
    of = materialize(shards(docs, limit), "shards")
    rows = docs.join(of.select(F.col("doc_id").alias("_id"), F.concat(F.lit("b"), "shard").alias("shard")), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    rows.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
    return of.groupBy("shard", "depth").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
