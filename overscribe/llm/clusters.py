"""Centroid clustering in whole numbers: blocked matrix products assign, treeAggregate sums.

Squared distances are |x|^2 - 2 x.c + |c|^2 in float64, which is exact as long
as no number that comes up can reach 2^53; the magnitudes of a block and of the
centroids tell. Blocks that could reach it are worked out in Python's integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import BLOCK, blocks, finite, matrix, narrow, wide

SCALE, DIM, K, ROUNDS, SEED = 256.0, 64, 40, 5, 2
#: Below it every whole number is a float64.
EXACT = 2.0**53
LONG = 2**63


def _pack(batch: pa.RecordBatch) -> dict:
    x = np.floor(SCALE * matrix(batch.column("vector"), batch.column("dim")[0].as_py()))
    data, kind = narrow(x)
    return {"ids": batch.column("vec_id").to_pylist(), "data": data, "kind": kind}


def packed(rows: DataFrame, vector: str = "embedding", dim: int = DIM, size: int = BLOCK) -> DataFrame:
    """Blocks of vectors with ``dim`` components, none null or non-finite, as whole numbers floor(256 x)."""
    good = rows.where(finite(vector, SCALE) & (F.size(vector) == dim)).select(F.col("vec_id"), F.col(vector).alias("vector"), F.lit(dim).alias("dim"))
    of_id = rows.schema["vec_id"].dataType.simpleString()
    return blocks(good, ["dim"], _pack, f"part int, at long, n int, dim int, ids array<{of_id}>, data binary, kind int", size)


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of all rows to all centroids: float64 where that is exact, else Python's integers."""
    most_x, most_c = np.abs(x).max(initial=0.0), max((abs(v) for c in centroids for v in c), default=0)
    if x.shape[1] * (float(most_x) + float(most_c)) ** 2 < EXACT:
        c = np.array(centroids, dtype=np.float64)
        return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
    whole, c = _whole(x), np.array(centroids, dtype=object)
    return np.stack([((whole - row) ** 2).sum(1) for row in c], 1)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """(number of each row's nearest centroid, the smaller one on ties; its squared distance as an integer)."""
    d = distances(x, centroids)
    best = d.argmin(1) if d.dtype != object else np.array([min(range(d.shape[1]), key=lambda j: (row[j], j)) for row in d], dtype=np.int64)
    return best, [int(v) for v in d[np.arange(len(d)), best]]


def _sums(x: np.ndarray, best: np.ndarray, k: int) -> tuple[list[int], list[list[int]]]:
    """(rows, componentwise sums) of each cluster."""
    counts = np.bincount(best, minlength=k)
    if len(x) * float(np.abs(x).max(initial=0.0)) < EXACT:
        one = np.zeros((k, len(x)))
        one[best, np.arange(len(x))] = 1.0
        total = (one @ x).astype(np.int64).tolist()
    else:
        whole = _whole(x)
        total = [[int(v) for v in whole[best == j].sum(0)] if counts[j] else [0] * x.shape[1] for j in range(k)]
    return counts.tolist(), total


def _add(a, b):
    if a is None or b is None:
        return a if b is None else b
    return [p + q for p, q in zip(a[0], b[0], strict=True)], [[p + q for p, q in zip(r, s, strict=True)] for r, s in zip(a[1], b[1], strict=True)], [p + q for p, q in zip(a[2], b[2], strict=True)]


def _gathered(rdd, centroids: list[list[int]]):
    """(counts, sums, inertia) by cluster over all blocks, in Python's integers; None without vectors. K rows reach the driver."""
    held = rdd.context.broadcast(centroids)  # K * dim integers

    def of_block(state, row):
        x = wide(row.data, row.kind, row.dim)
        best, d = nearest(x, held.value)
        counts, sums = _sums(x, best, len(held.value))
        inertia = [0] * len(held.value)
        for j, v in zip(best, d, strict=True):
            inertia[j] += v
        return _add(state, (counts, sums, inertia))

    out = rdd.treeAggregate(None, of_block, _add, depth=2)
    held.unpersist()
    return out


def starts(rows: DataFrame, vector: str, dim: int, k: int, seed: int) -> list[list[int]]:
    """The k kept vectors with the least sha256 of ``seed:vec_id``; repeated rows are vectors each, those without an id come last."""
    good = rows.where(finite(vector, SCALE) & (F.size(vector) == dim))
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("vec_id"), F.col(vector)]
    return [[int(np.floor(SCALE * float(v))) for v in row[0]] for row in good.orderBy(*order).limit(k).select(vector).collect()]


def cluster(rows: DataFrame, vector: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly ``dim`` components, none null or non-finite;
    components become floor(256 x). Every round assigns each vector to its
    nearest centroid, the smaller number on ties, and replaces every centroid
    that has vectors by the floor of their mean; one without stays. Repeated
    rows count and come back as often as they are there. Fewer than k vectors
    are all centroids; an empty table gives no rows. Distances and sums are
    exact whatever their size; those that no long can hold come back as null.
    Columns other than vec_id and the vector are not read.
    """
    table = materialize(packed(rows, vector, dim), "clusters")
    centroids = starts(rows, vector, dim, k, seed)
    of_id = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {of_id}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return rows.sparkSession.createDataFrame([], schema)
    rdd = table.select("data", "kind", "dim").rdd.persist(StorageLevel.DISK_ONLY)  # lost parts are read again from the shared folder
    for _ in range(rounds):
        counts, sums, _ = _gathered(rdd, centroids)
        centroids = [[v // n for v in total] if n else old for n, total, old in zip(counts, sums, centroids, strict=True)]
    _, _, inertia = _gathered(rdd, centroids)
    rdd.unpersist()
    return assigned(table, centroids, inertia, schema)


def assigned(table: DataFrame, centroids: list[list[int]], inertia: list[int], schema: str) -> DataFrame:
    """Every vector with its cluster, its distance and the sums of its cluster and of all."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(inertia)

    def long(v: int) -> int | None:
        return v if v < LONG else None

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                best, d = nearest(wide(row["data"], row["kind"], row["dim"]), centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], type=of_id), pa.array(best.astype(np.int32)), pa.array([long(v) for v in d], pa.int64()), pa.array([long(inertia[j]) for j in best], pa.int64()),
                        pa.array([long(total)] * len(best), pa.int64()), pa.array([names[j] for j in best], pa.string()),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    from pyspark.sql.pandas.types import to_arrow_type

    of_id = to_arrow_type(table.schema["ids"].dataType.elementType)
    return table.select("ids", "data", "kind", "dim").mapInArrow(run, schema)
