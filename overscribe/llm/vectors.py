"""Vectors as rows of blocks: what takes part, one row an id, and matrices packed into binary columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: what meets in one matrix product.
BLOCK = 1024
#: Kinds of numbers that blocks are packed in, the narrowest first.
KINDS = ("<i2", "<i4", "<f8")


def finite(vector: str = "embedding", scale: float = 1.0) -> Column:
    """True for vectors that have components, none of them null, NaN or infinite, nor when multiplied by ``scale``."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & good


def one_per_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows that share an id, the first in the order of the other columns. Each task cuts an id to one row before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_one", F.row_number().over(w)).where("_one = 1").drop("_one")


def norm2(vector: str, scale: float = 1.0) -> Column:
    """Squared length as a double, to sort by; blocks hold bounds of their own."""
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") * scale, 2))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A list array whose rows all have ``dim`` components, as float64."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def narrow(x: np.ndarray) -> tuple[bytes, int]:
    """(bytes, place in KINDS) of a matrix of whole numbers."""
    most = np.abs(x).max(initial=0.0)
    kind = 0 if most < 2**15 else 1 if most < 2**31 else 2
    return np.ascontiguousarray(x, dtype=KINDS[kind]).tobytes(), kind


def wide(data: bytes, kind: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, KINDS[kind]).reshape(-1, dim).astype(np.float64)


def runs(batches: Iterator[pa.RecordBatch], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` neighbouring rows that agree in ``columns``; short ones are only at the end of a run."""
    held: list[pa.RecordBatch] = []
    key = None

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.zeros(batch.num_rows - 1, bool)
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        for v in values:
            codes |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(codes) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(v[a] for v in values)
            if held and now != key:
                yield joined()
                held = []
            key = now
            while a < b:
                take = min(b - a, rows - sum(x.num_rows for x in held))
                held.append(batch.slice(a, take))
                a += take
                if sum(x.num_rows for x in held) == rows:
                    yield joined()
                    held = []
    if held:
        yield joined()


def blocks(rows: DataFrame, columns: list[str], pack: Callable[[pa.RecordBatch], dict], schema: str, size: int = BLOCK) -> DataFrame:
    """Sorted rows, packed: ``part`` is the partition, ``at`` the place of the block's first row in its run there; ``pack`` makes the rest."""

    def run(batches):
        part, key, at = TaskContext.get().partitionId(), None, 0
        for batch in runs(batches, columns, size):
            now = tuple(batch.column(c)[0].as_py() for c in columns)
            at = at if now == key else 0
            key = now
            yield pa.RecordBatch.from_pylist([{"part": part, "at": at, "n": batch.num_rows, **dict(zip(columns, now, strict=True)), **pack(batch)}], schema=arrow)
            at += batch.num_rows

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spec = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spec)
    return rows.mapInArrow(run, spec)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one after the other: a row is a block, and few are held at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Firsts:
    """For each key the first ``k`` (score, id) found so far, smallest score first, ties to the smaller id.

    A task keeps it while rows pass and emits it at the end, or when it holds
    ``most`` keys: what is emitted is merged by Spark, so nothing is lost.
    """

    def __init__(self, k: int, most: int = 100_000) -> None:
        self.k, self.most, self.kept = k, most, {}

    def bound(self, key) -> float:
        """No score above it can get in."""
        got = self.kept.get(key)
        return got[0][-1] if got is not None and len(got[0]) >= self.k else np.inf

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        got = self.kept.get(key)
        if got is not None:
            scores, ids = np.concatenate([got[0], scores]), np.concatenate([got[1], ids])
        order = np.lexsort((ids, scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (scores[i], ids[i])), dtype=np.int64)
        scores, ids = scores[order], ids[order]
        if len(ids) > 1:  # the same one can come by several ways
            new = np.r_[True, (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])]
            scores, ids = scores[new], ids[new]
        self.kept[key] = scores[: self.k], ids[: self.k]

    def full(self) -> bool:
        return len(self.kept) >= self.most

    def drain(self) -> dict:
        out, self.kept = self.kept, {}
        return out
