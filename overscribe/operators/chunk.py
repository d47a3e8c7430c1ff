"""Splitting texts into sections, and the upsert of sections into a store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as tx

SIZE, OVERLAP = 800, 200
#: Where a text may be cut, the best place first.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", "!", "?", ";", " ", ""]


def _pieces(text: str, sep: str) -> list[str]:
    """Cut after each separator, which stays with what it ends."""
    if not sep:
        return list(text)
    parts = text.split(sep)
    return [p for p in [x + sep for x in parts[:-1]] + parts[-1:] if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces together up to size; each section begins with the last pieces of the one before, up to overlap."""
    out, held, n = [], [], 0
    for p in pieces:
        if held and n + len(p) > size:
            out.append("".join(held))
            while held and (n > overlap or n + len(p) > size):
                n -= len(held.pop(0))
        held.append(p)
        n += len(p)
    return out + ["".join(held)] if held else out


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] | None = None) -> list[str]:
    """Sections of at most ``size`` characters where a separator allows it, stripped, none empty."""
    separators = SEPARATORS if separators is None else separators
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out, fitting = [], []
    for p in _pieces(text, separators[at]):
        if len(p) < size:
            fitting.append(p)
            continue
        out += _packed(fitting, size, overlap)
        fitting = []
        out += split_text(p, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [p]
    out += _packed(fitting, size, overlap)
    return [s for s in (x.strip() for x in out) if s]


def sections(docs: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, idx, content): page furniture goes first. A null or empty text has no sections.

    The splitter is a plan node of its own: as a column under a generator it
    could be drawn into filters, where a Python function can't be evaluated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):  # so that the sections of few texts are in memory at once
                batch = whole.slice(at, 200)
                found = [split_text(t or "", size, overlap) for t in batch.column(1).to_pylist()]
                rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                idx = pa.array([j for x in found for j in range(len(x))], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), idx, pa.array([s for x in found for s in x], pa.string())], [key, "idx", "content"])

    rows = docs.select(key, tx.strip_furniture(text).alias("_t"))
    schema = StructType([rows.schema[key], StructField("idx", IntegerType()), StructField("content", StringType())])
    return rows.mapInArrow(run, schema)


def with_point_id(rows: DataFrame, name: str = "source_file", idx: str = "idx") -> DataFrame:
    return rows.withColumn("id", tx.uuid5_url(F.concat_ws(":", F.col(name), F.col(idx).cast("string"))))


def upsert(store: DataFrame, new: DataFrame, key: str | list[str], prune: str | None = None) -> DataFrame:
    """``new`` replaces rows with the same key. What a shorter new version leaves over stays, unless ``prune`` names the column by which it goes."""
    kept = store.join(new.select(prune).distinct(), prune, "left_anti") if prune else store.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
