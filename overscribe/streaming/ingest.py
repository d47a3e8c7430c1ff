"""Structured Streaming over the library's log and over a drop folder of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.library import facts, settled, with_changes
from ..sources.cache import exists
from ..sources.scratch import written
from ..sources.store import merge_latest


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT).json(path)


def follow(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the facts of the log at ``path``: each batch of events reads and writes the buckets of its own keys.

    A batch that is run again after a failure gives the same facts, so each event
    counts once. :func:`library_of` reads the library that they make.
    """

    def apply(batch: DataFrame, n: int) -> None:
        seen = written(batch, "batch")
        for name, (key, rows) in facts(seen).items():
            merge_latest(batch.sparkSession, f"{path}/{name}", rows, key)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def library_of(library: DataFrame, path: str) -> DataFrame:
    """The library after all events that :func:`follow` has seen."""
    spark = library.sparkSession
    none = facts(spark.createDataFrame([], schemas.EVENT))
    known = {name: (spark.read.schema(rows.schema).parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else rows) for name, (_, rows) in none.items()}
    return with_changes(library, *settled(known))


def routed(documents: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of arriving documents to the section router or any other function of (rows, batch number)."""
    return documents.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
