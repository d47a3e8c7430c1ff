"""Shared plumbing: tables, intermediate results, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of ``documents``; what every filtering stage hands on.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows up to which a table of a few numbers a row is broadcast (about 32 MB).
BROADCAST_ROWS = 500_000


#: Rows that are handed to Python at once. Texts are long: Spark's own 10,000 would be many megabytes, several times over.
ARROW_ROWS = 1_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame, run, schema, rows: int = ARROW_ROWS) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of so many rows. Python cuts them, as a plan that is not written by materialize() has the session's own."""

    def cut(batches):
        def parts():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)

        return run(parts())

    return df.mapInArrow(cut, schema)


def id_type(docs: DataFrame) -> str:
    """The type of doc_id, for schemas of results."""
    return docs.schema["doc_id"].dataType.simpleString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what setCheckpointDir() was given.

    Where neither is set a temporary one is made, but only with a local master, which has no other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="overscribe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets later plans see the
    size of the table, which decides how they join it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/overscribe/{name}-{uuid.uuid4().hex}"
    # While this is written, Spark hands few rows to Python as well: its buffers, on both sides, hold a batch of each task.
    rows = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(int(rows), ARROW_ROWS) if int(rows) > 0 else ARROW_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._overscribe_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_overscribe_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialized table for broadcast if it has at most ``rows`` rows.

    Beyond that the join stays a shuffled one, with the same result.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_hash(text="text"):
    """With ``doc_id`` this names a row by its content, the same on every scan."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, row_hash); a null doc_id equals a null doc_id."""
    right = right.withColumnsRenamed({"doc_id": "_doc_id", "row_hash": "_row_hash"})
    on = (left["row_hash"] == right["_row_hash"]) & left["doc_id"].eqNullSafe(right["_doc_id"])
    return left.join(right, on, how).drop("_doc_id", "_row_hash")
