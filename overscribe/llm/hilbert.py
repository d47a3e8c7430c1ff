"""Nearest neighbours along shifted space-filling curves.

Vectors are projected at random to a few dimensions, several times, and each
projection is shifted and put in the order of a Hilbert curve. Rows of a
curve are range-partitioned by their key and packed into blocks; a query meets
the blocks within a window of places around its own, on every curve, and what
it meets is ranked by the true distance.

How wide the windows are is measured: for a sample of the queries the true
neighbours are looked up, and the window is as wide as it takes for the stated
share of them to be inside it on one curve at least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .vectors import BLOCK, Firsts, blocks, each, finite, matrix, one_per_id

EVERY, NEIGHBOURS = 100, 10
#: Curves, dimensions of a projection, bits of a dimension: a key has DIMS * BITS of 62 bits.
CURVES, DIMS, BITS = 16, 4, 15
#: Vectors that set the range of the projections, queries that set the window, the share of their neighbours that it holds.
FIT, SAMPLE, TARGET = 2048, 128, 0.95
#: Query blocks that meet a candidate block in one row.
TOGETHER = 32


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates below 2^bits: Gray codes undone axis by axis, bits interleaved."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, axis in enumerate(x):
            set_ = (axis >> level) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ axis) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = axis ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> level) & 1 == 1, flip ^ ((1 << level) - 1), flip)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> level) & 1)
    return key


class Curves:
    """Projections, shifts and ranges for vectors of one length, drawn from a seed."""

    def __init__(self, dim: int, seed: int, curves: int = CURVES, dims: int = DIMS) -> None:
        rng = np.random.default_rng([seed, dim])
        self.turn = rng.normal(size=(curves, dim, min(dim, dims))) / np.sqrt(dim)
        self.shift = rng.uniform(0, 0.5, size=(curves, 1, min(dim, dims)))
        self.low, self.span = np.zeros((curves, 1, 1)), np.ones((curves, 1, 1))

    def fit(self, sample: np.ndarray) -> Curves:
        """Ranges that hold the sample; what is outside of them goes to the edge."""
        if len(sample):
            p = sample @ self.turn
            self.low = p.min(1, keepdims=True)
            self.span = np.maximum((p.max(1, keepdims=True) - self.low).max(2, keepdims=True), 1e-300)  # one width for all, so that distances stay
        return self

    def keys(self, x: np.ndarray, bits: int = BITS) -> np.ndarray:
        """A row for each vector, a column for each curve."""
        p = np.clip((x @ self.turn - self.low) / self.span, 0, 1) / 2 + self.shift
        return np.stack([hilbert((q * (2**bits - 1)).astype(np.int64), bits) for q in np.nan_to_num(p)], 1)


def near(q: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (rows of x, their distances): at least those that can be among its first k and are not beyond its bound.

    A matrix product says which rows are worth it; their distances come from
    the differences themselves, so that they do not depend on what else is there.
    """
    with np.errstate(all="ignore"):  # what overflows is looked at in full
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        rough = qq[:, None] - 2.0 * (q @ x.T) + xx[None, :]
        slack = 1e-12 * (qq + xx.max(initial=0.0))
        out = []
        for i in range(len(q)):
            if np.isfinite(rough[i]).all() and np.isfinite(slack[i]):
                most = bound[i] ** 2
                if len(x) > k:
                    most = min(most, np.partition(rough[i], k - 1)[k - 1])
                at = np.flatnonzero(rough[i] <= most + 2 * slack[i])
            else:
                at = np.arange(len(x))
            d = x[at] - q[i]
            out.append((at, np.sqrt((d * d).sum(1))))
    return out


def _pack(dtype: str):
    def run(batch: pa.RecordBatch) -> dict:
        x = matrix(batch.column("vector"), batch.column("dim")[0].as_py()).astype(dtype)
        asked = np.array(batch.column("asked").to_pylist(), dtype=bool)
        uids = batch.column("uid").to_numpy()
        return {"uids": uids.tobytes(), "ids": batch.column("ids").to_pylist(), "data": x.tobytes(), "q_uids": uids[asked].tobytes(), "q_data": x[asked].tobytes(), "q_n": int(asked.sum())}

    return run


def distinct_vectors(good: DataFrame, k: int, every: int) -> DataFrame:
    """(uid, ids, vector, dim, asked) of each different vector: its least id, its first k + 1 ids, and whether a query has it.

    Rows of a vector are cut to k + 1 in each task before they are shuffled: no
    query can have more of them, as the others of the same vector come first.
    """
    w = Window.partitionBy("vector").orderBy("vec_id")
    few = good.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    groups = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = good.where(F.col("vec_id") % every == 0).select("vector").distinct().withColumn("asked", F.lit(True))
    return groups.join(asked, "vector", "left").select(F.col("ids")[0].alias("uid"), "ids", "vector", F.size("vector").alias("dim"), F.coalesce("asked", F.lit(False)).alias("asked"))


def ordered(vectors: DataFrame, curves: dict[int, Curves], seed: int) -> tuple[DataFrame, DataFrame, str]:
    """(blocks along all curves, the table that holds them, the type of their numbers). Blocks have ``start``, the place of
    their first vector on the curve."""

    def keyed(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            keys = np.zeros((batch.num_rows, CURVES), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                keys[at] = (curves.get(int(dim)) or Curves(int(dim), seed)).keys(matrix(batch.column("vector").take(pa.array(at)), int(dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    schema = StructType([*vectors.schema.fields, StructField("keys", ArrayType(LongType()))])
    rows = vectors.mapInArrow(keyed, schema).select("uid", "ids", "vector", "dim", "asked", F.posexplode("keys").alias("curve", "key"))
    order = ["curve", "dim", "key", "uid"]
    kind = "<f4" if vectors.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    packed = blocks(rows.repartitionByRange(*order).sortWithinPartitions(*order), ["curve", "dim"], _pack(kind), "part int, at long, n int, curve int, dim int, uids binary, ids array<array<long>>, data binary, q_uids binary, q_data binary, q_n int")
    packed = materialize(packed, "curves")
    parts = packed.groupBy("curve", "dim", "part").agg(F.sum("n").alias("_n"))  # as many rows as Spark made partitions
    w = Window.partitionBy("curve", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("curve", "dim", "part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return packed.join(base, ["curve", "dim", "part"]).withColumn("start", F.col("_base") + F.col("at")).drop("_base"), packed, kind


def measured_window(vectors: DataFrame, placed: DataFrame, k: int, sample: int, target: float) -> int:
    """Places to either side that hold ``target`` of the true neighbours of a sample of the queries on one curve at least.

    The sample is of bounded size, by hash; its neighbours are found among all
    vectors by brute force, and looked up in the blocks of all curves.
    """
    asked = vectors.where("asked").orderBy(F.xxhash64("uid"), "uid").limit(sample).select("uid", "vector", "dim").collect()
    if not asked:
        return 0
    by_dim: dict[int, tuple[list[int], np.ndarray]] = {}
    for dim in {r.dim for r in asked}:
        own = [r for r in asked if r.dim == dim]
        by_dim[dim] = [r.uid for r in own], np.array([r.vector for r in own], dtype=np.float64)

    def scan(batches):
        best = Firsts(k + 1)
        for batch in batches:
            dims, uids = batch.column("dim").to_numpy(), batch.column("uid").to_numpy()
            for dim, (own, q) in by_dim.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    x = matrix(batch.column("vector").take(pa.array(at)), dim)
                    for u, (i, d) in zip(own, near(q, x, np.array([best.bound(u) for u in own]), k + 1), strict=True):
                        best.add(u, d, uids[at[i]])
        yield from _emitted(best.drain())

    found = _firsts(vectors.mapInArrow(scan, "query_id long, vec_id long, score double"), k + 1)
    pairs = [(r.query_id, r.vec_id) for r in found.where("query_id <> vec_id").select("query_id", "vec_id").collect()]  # sample * (k + 1) at most
    wanted = np.array(sorted({u for p in pairs for u in p}), dtype=np.int64)

    def look_up(batches):
        for r in each(batches):
            uids = np.frombuffer(r["uids"], np.int64)
            at = np.flatnonzero(np.isin(uids, wanted))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["curve"], np.int32)), pa.array(uids[at]), pa.array(r["start"] + at)], names=["curve", "uid", "place"])

    places: dict[int, dict[int, int]] = {}
    for r in placed.select("curve", "uids", "start").mapInArrow(look_up, "curve int, uid long, place long").collect():  # wanted * CURVES
        places.setdefault(r.uid, {})[r.curve] = r.place
    gaps = [min(abs(places[a][c] - places[b][c]) for c in places[a]) for a, b in pairs]
    return int(np.quantile(gaps, target, method="higher")) if gaps else 0


def _emitted(kept: dict):
    n = [len(v[1]) for v in kept.values()]
    many = lambda j, t: np.concatenate([v[j] for v in kept.values()]) if kept else np.array([], t)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.fromiter(kept, np.int64, len(kept)), n)), pa.array(many(1, np.int64)), pa.array(many(0, np.float64))], names=["query_id", "vec_id", "score"])


def _firsts(found: DataFrame, k: int) -> DataFrame:
    """The first k different ones of each query; one shuffle by query does for both steps."""
    once = found.repartition("query_id").dropDuplicates(["query_id", "vec_id"])
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("_n") <= k).drop("_n")


def searched(placed: DataFrame, window: int, k: int, kind: str, size: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score): the first k + 1 ids of each asked vector among the blocks within the window."""
    # Bins of BLOCK places: a block is in the bin of its first place, and begins at most BLOCK - 1 places before its end.
    q = placed.where("q_n > 0").select("curve", "dim", F.col("start").alias("q_start"), F.col("n").alias("q_len"), "q_uids", "q_data")
    first, last = F.floor((F.col("q_start") - window) / size) - 1, F.floor((F.col("q_start") + F.col("q_len") + window) / size)
    q = q.withColumn("bin", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    q = q.groupBy("curve", "dim", "bin", F.floor(F.col("q_start") / (size * TOGETHER)).alias("_g")).agg(F.collect_list(F.struct("q_start", "q_len", "q_uids", "q_data")).alias("qs")).drop("_g")
    met = q.join(placed.select("curve", "dim", F.floor(F.col("start") / size).alias("bin"), "start", "n", "ids", "data"), ["curve", "dim", "bin"])

    def run(batches):
        best = Firsts(k + 1)
        for r in each(batches):
            own = [b for b in r["qs"] if b["q_start"] - window < r["start"] + r["n"] and r["start"] < b["q_start"] + b["q_len"] + window]
            if not own:
                continue
            uids = np.concatenate([np.frombuffer(b["q_uids"], np.int64) for b in own])
            q = np.concatenate([np.frombuffer(b["q_data"], kind).reshape(-1, r["dim"]) for b in own]).astype(np.float64)
            x = np.frombuffer(r["data"], kind).reshape(-1, r["dim"]).astype(np.float64)
            for u, (at, d) in zip(uids.tolist(), near(q, x, np.array([best.bound(u) for u in uids.tolist()]), k + 1), strict=True):
                if len(at):
                    ids = [r["ids"][i] for i in at]
                    best.add(u, np.repeat(d, [len(g) for g in ids]), np.array([v for g in ids for v in g], dtype=np.int64))
            if best.full():
                yield from _emitted(best.drain())
        yield from _emitted(best.drain())

    return _firsts(met.mapInArrow(run, "query_id long, vec_id long, score double"), k + 1)


def nearest_neighbours(rows: DataFrame, vector: str = "embedding", k: int = NEIGHBOURS, every: int = EVERY, sample: int = SAMPLE, target: float = TARGET, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id ``every`` divides, by Euclidean distance.

    Rows with a null id or vector, an empty or zero vector, or any null or
    non-finite component take no part; of rows that share an id the first in
    the order of vectors counts, so repeated rows count once. Different rows
    of one vector are all candidates, the smallest ids first. Only vectors of
    equal length are compared. Fewer candidates than k are all returned; no
    queries, or an empty table, give no rows. Distances of components beyond
    1e150 may be infinite. Columns other than vec_id and the vector are not read.
    """
    good = rows.where(F.col("vec_id").isNotNull() & finite(vector) & F.exists(vector, lambda x: x != 0))
    good = one_per_id(good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector")), "vec_id", "vector")
    vectors = materialize(distinct_vectors(good, k, every), "vectors")
    curves: dict[int, Curves] = {}
    fit = vectors.orderBy(F.xxhash64("uid"), "uid").limit(FIT).select("dim", "vector").collect()
    for dim in {r.dim for r in fit}:
        curves[dim] = Curves(dim, seed).fit(np.array([r.vector for r in fit if r.dim == dim], dtype=np.float64))
    placed, packed, kind = ordered(vectors, curves, seed)
    window = measured_window(vectors, placed, k, sample, target)
    found = materialize(searched(placed, window, k, kind), "neighbours")
    release(packed)
    near_ = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 rows each
    asked = vectors.where("asked").select(F.col("uid").alias("query_id"), "vector").join(near_, "query_id").select("vector", "near")
    out = good.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").join(asked, "vector")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("_at", "_x"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), "_x.vec_id", "_x.score")
