"""An inverted file over vectors: cells around centroids, of which a query probes the nearest few.

The search is exact within the cells that it probes. How many that takes is
measured when the index is made: for a sample of the queries the true neighbours
are found by brute force, and the index probes as many cells as it takes
for the stated share of them to lie in one. :func:`.dense.knn` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .dense import top_k

#: Rows that the centroids are fitted on, for each of them; sample of queries; the share of their neighbours that is to be found.
FIT, SAMPLE, TARGET = 64, 64, 0.95
#: Base rows, and queries, that meet in one matrix product.
BLOCK, TOGETHER = 1024, 256


@dataclass
class VectorIndex:
    """``blocks`` (cell, keys, data) holds every row of the base; written."""

    blocks: DataFrame
    centroids: np.ndarray
    key: str

    def probed(self, queries: DataFrame, query_key: str, vector: str, probes: int) -> DataFrame:
        """(query_key, vector, cell), a row for each of the ``probes`` cells nearest to a query."""
        c = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = _order(_matrix(batch.column(vector)), c)[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(first), pa.list_(pa.int32()))], names=[*batch.schema.names, "_cells"])

        rows = queries.select(query_key, vector)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{ddl}, _cells array<int>").select(query_key, vector, F.explode("_cells").alias("cell"))

    def search(self, queries: DataFrame, query_key: str, vector: str, k: int, probes: int, own: bool = True) -> DataFrame:
        """(query_key, key, cosine, rank) of unit vectors: the k nearest rows within the probed cells, ties by key.

        ``own`` false leaves out the row whose key is the query's. Queries of a
        cell meet its blocks in packs, so that a cell that most rows are in is
        many rows of bounded size; each task keeps k rows a query.
        """
        q = self.probed(queries, query_key, vector, probes)
        n = q.groupBy("cell").agg(F.count("*").alias("_n"))
        packs = q.join(n, "cell").withColumn("_pack", F.pmod(F.xxhash64(query_key), F.ceil(F.col("_n") / TOGETHER)))
        packs = packs.groupBy("cell", "_pack").agg(F.collect_list(F.struct(F.col(query_key).alias("k"), F.col(vector).alias("v"))).alias("qs")).drop("_pack")
        met = packs.join(self.blocks, "cell").select("qs", "keys", "data")
        q_type, key_type = queries.schema[query_key].dataType.simpleString(), self.blocks.schema["keys"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    qs, keys = [x["k"] for x in row["qs"]], row["keys"]
                    x = np.array([x["v"] for x in row["qs"]], dtype=np.float64)
                    s = x @ np.frombuffer(row["data"], np.float64).reshape(len(keys), -1).T
                    out = []
                    for j, name in enumerate(qs):
                        at = np.flatnonzero(s[j] >= np.partition(s[j], -k - 1)[-k - 1]) if len(keys) > k + 1 else range(len(keys))
                        out += [(name, keys[a], float(s[j][a])) for a in at if own or keys[a] != name]
                    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(types)], names=[query_key, self_key, "cosine"])

        from pyspark.sql.pandas.types import to_arrow_type

        self_key = self.key
        types = [to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(self.blocks.schema["keys"].dataType.elementType), pa.float64()]
        found = met.mapInArrow(run, f"`{query_key}` {q_type}, `{self_key}` {key_type}, cosine double")
        return top_k(found, query_key, k, F.desc("cosine"), F.col(self_key))

    def measured_probes(self, queries: DataFrame, query_key: str, vector: str, k: int, sample: int = SAMPLE, target: float = TARGET, own: bool = True) -> int:
        """Cells to probe so that ``target`` of the k true neighbours are in them, by a sample of the queries of bounded size."""
        few = written(queries.orderBy(F.xxhash64(query_key), query_key).limit(sample).select(query_key, vector), "sample")
        truth = self.search(few, query_key, vector, k, len(self.centroids), own)
        c = self.centroids

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = _order(_matrix(batch.column(vector)), c)
                yield pa.RecordBatch.from_arrays([batch.column(query_key), pa.array(list(order.argsort(1).astype(np.int32)), pa.list_(pa.int32()))], names=[query_key, "_ranks"])

        ranks = few.mapInArrow(cells, f"`{query_key}` {few.schema[query_key].dataType.simpleString()}, _ranks array<int>")
        where = self.blocks.select("cell", F.explode("keys").alias(self.key))
        got = truth.join(where, self.key).join(ranks, query_key).select(F.col("_ranks")[F.col("cell")].alias("r"))
        last = got.agg(F.percentile("r", F.lit(target))).first()[0]
        return 1 if last is None else min(len(c), int(np.ceil(last)) + 1)


def _matrix(vectors: pa.Array) -> np.ndarray:
    n = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _order(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cells in the order of their centroids' nearness, for each row."""
    return np.argsort(-(x @ centroids.T), axis=1, kind="stable") if len(x) else np.zeros((0, len(centroids)), int)


def _fitted(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit length; the first ones are the sample's first rows, as its order is random."""
    c = sample[:cells].copy()
    for _ in range(rounds):
        at = _order(sample, c)[:, 0]
        for j in range(len(c)):
            mean = sample[at == j].sum(0)
            if (length := np.linalg.norm(mean)) > 0:
                c[j] = mean / length
    return c


def build(base: DataFrame, key: str, vector: str, cells: int) -> VectorIndex | None:
    """The index of a base of unit vectors of one length; None if it has no rows.

    Centroids are fitted on a sample of FIT rows for each, taken by the hash of
    the key; every row is indexed. A cell is dealt into blocks of about BLOCK
    rows by the hash of the key, however many rows it has.
    """
    sample = base.orderBy(F.xxhash64(key), key).limit(FIT * cells).select(vector).collect()
    if not sample:
        return None
    centroids = _fitted(np.array([r[0] for r in sample], dtype=np.float64), cells)
    empty = VectorIndex(base, centroids, key)
    rows = written(empty.probed(base, key, vector, 1), "cells")
    n = rows.groupBy("cell").agg(F.count("*").alias("_n"))
    dealt = rows.join(n, "cell").withColumn("_b", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / BLOCK)))
    lists = dealt.groupBy("cell", "_b").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell, own = batch.column(0)[i], batch.column(1)[i].values
                yield pa.RecordBatch.from_arrays([pa.array([cell.as_py()], pa.int32()), pa.array([own.field("k").to_pylist()], keys), pa.array([_matrix(own.field("v")).tobytes()])], names=["cell", "keys", "data"])

    from pyspark.sql.pandas.types import to_arrow_type

    keys = pa.list_(to_arrow_type(base.schema[key].dataType))
    blocks = lists.select("cell", "rows").mapInArrow(run, f"cell int, keys array<{base.schema[key].dataType.simpleString()}>, data binary")
    return VectorIndex(written(blocks, "blocks"), centroids, key)
