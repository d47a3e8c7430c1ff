"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm and packed into blocks, the buckets. An anchor's
score with any row of a block is at most |anchor| * (largest norm of the
block): where that is below the lower end of the anchor's window, or below
its running tenth score, the block is passed over. What is left meets in blocked
matrix products of whole numbers, which are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .vectors import Firsts, blocks, each, finite, matrix, narrow, norm2, one_per_id, wide

SCALE = 256.0
#: Anchors are rows whose id it divides; rows whose id MOVED divides get the next of CLASSES labels first.
EVERY, MOVED, CLASSES = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 30, 90
ANCHORS, CANDIDATES = 512, 2048

_BLOCK = "part int, at long, n int, dim int, ids binary, labels binary, data binary, kind int, most double"


def _pack(batch: pa.RecordBatch) -> dict:
    x = np.floor(SCALE * matrix(batch.column("vector"), batch.column("dim")[0].as_py()))
    data, kind = narrow(x)
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("vec_id", "label"))
    return {"ids": ids, "labels": labels, "data": data, "kind": kind, "most": _norms(x).max()}


def _norms(x: np.ndarray) -> np.ndarray:
    """Not below the lengths of the rows."""
    return np.sqrt((x * x).sum(1)) * (1 + 1e-9)


def _packed(rows: DataFrame, by: list[str], size: int, schema: str = _BLOCK) -> DataFrame:
    """Blocks of rows that agree in ``by``, longest vectors first: ranges of the sort order, so that no key is too large for a task."""
    order = [*map(F.col, by), F.desc("norm2"), F.col("vec_id")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return blocks(sorted_, by, _pack, schema, size)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole numbers, exact: no partial sum is above ``bound``, which tells the type that holds them all."""
    if bound < 2.0**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if bound < 2.0**53:
        return a @ b.T
    whole = [np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (a, b)]
    return whole[0] @ whole[1].T


def _met(anchors: DataFrame, candidates: DataFrame, reach, keys: list[str]) -> DataFrame:
    """Anchor blocks beside candidate blocks: anchors go to the partitions of the candidates' order that they can reach.

    The table of partitions has as many rows as Spark made partitions (and
    keys in them). The join is on partition and key, of which each holds a
    bounded share of the candidates, so a frequent label is spread out.
    """
    parts = candidates.groupBy("part", *keys).agg(F.max("most").alias("p_most"))
    a = anchors.select(*keys, *(F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in keys))
    to = a.join(parts, keys).where(reach(F.col("a_most"), F.col("p_most"))).drop("p_most")
    return to.join(candidates, ["part", *keys]).where(reach(F.col("a_most"), F.col("most")))


def positives(anchors: DataFrame, candidates: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(vec_id, p_id, p_score): of each anchor the first k other rows of its label; blocks are of one label each."""

    def run(batches):
        best = Firsts(k)
        for r in each(batches):
            a, c = wide(r["a_data"], r["a_kind"], r["dim"]), wide(r["data"], r["kind"], r["dim"])
            a_ids, ids = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            running = [-best.bound(int(i)) for i in a_ids]  # the kth score so far
            alive = np.flatnonzero(_norms(a) * r["most"] >= np.array(running, dtype=float))
            if not len(alive):
                continue
            s = products(a[alive], c, r["a_most"] * r["most"])
            for row, i in zip(s, alive, strict=True):
                ok = np.flatnonzero((row >= running[i]) & (ids != a_ids[i]))
                if len(ok):
                    best.add(int(a_ids[i]), -row[ok], ids[ok])
            if best.full():
                yield from emitted(best.drain())
        yield from emitted(best.drain())

    def emitted(kept):
        n = [len(v[1]) for v in kept.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.fromiter(kept, np.int64, len(kept)), n)), _ids(kept), _scores(kept)], names=["vec_id", "p_id", "p_score"])

    found = _met(anchors, candidates, lambda a, c: F.lit(True), ["dim", "label"]).mapInArrow(run, "vec_id long, p_id long, p_score string")
    return _first(found.withColumn("p_score", F.expr("try_cast(p_score as decimal(38,0))")), ["vec_id"], "p_score", "p_id", k, "p_rank")


def _ids(kept: dict) -> pa.Array:
    return pa.array(np.concatenate([v[1] for v in kept.values()]) if kept else np.array([], np.int64), pa.int64())


def _scores(kept: dict) -> pa.Array:
    """As decimal text: a score of large components is beyond a double's whole numbers."""
    return pa.array([str(-int(s)) for v in kept.values() for s in v[0]], pa.string())


def _first(found: DataFrame, by: list[str], score: str, key: str, k: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return found.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def negatives(windows: DataFrame, candidates: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """(vec_id, p_rank, n_id, n_score): of each window the first k rows of another label whose scores are in it.

    windows: blocks of anchors, each with the ranks and scores of its positives.
    """

    def run(batches):
        best = Firsts(k)
        for r in each(batches):
            a, c = wide(r["a_data"], r["a_kind"], r["dim"]), wide(r["data"], r["kind"], r["dim"])
            a_ids, ids = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            a_labels, labels = np.frombuffer(r["a_labels"], np.int64), np.frombuffer(r["labels"], np.int64)
            reach = _norms(a) * r["most"]
            # Windows that this block can add to: its bound reaches the window's lower end and the running kth score.
            todo: dict[int, list[tuple[int, float, int]]] = {}
            for i, own in enumerate(r["a_windows"]):
                for w in own:
                    least = max(-(-LOW * int(w["score"]) // 100), -best.bound((int(a_ids[i]), w["j"])))
                    if reach[i] >= least:
                        todo.setdefault(i, []).append((w["j"], least, HIGH * int(w["score"]) // 100))
            if not todo:
                continue
            alive = np.fromiter(todo, np.int64, len(todo))
            s = products(a[alive], c, r["a_most"] * r["most"])
            for row, i in zip(s, alive, strict=True):
                other = np.flatnonzero((row >= min(x[1] for x in todo[i])) & (labels != a_labels[i]))
                got, got_ids = row[other], ids[other]
                for j, least, high in todo[i]:
                    ok = np.flatnonzero((got >= least) & (got <= high))
                    if len(ok) > k:
                        ok = ok[got[ok] >= -np.sort(-got[ok])[k - 1]]
                    if len(ok):
                        best.add((int(a_ids[i]), j), -got[ok], got_ids[ok])
            if best.full():
                yield from emitted(best.drain())
        yield from emitted(best.drain())

    def emitted(kept):
        n = [len(v[1]) for v in kept.values()]
        keys = [pa.array(np.repeat(np.array([x[i] for x in kept], dtype=t), n)) for i, t in ((0, np.int64), (1, np.int32))]
        yield pa.RecordBatch.from_arrays([*keys, _ids(kept), _scores(kept)], names=["vec_id", "p_rank", "n_id", "n_score"])

    met = _met(windows, candidates, lambda a, c: a * c >= F.col("a_least"), ["dim"])
    found = met.mapInArrow(run, "vec_id long, p_rank int, n_id long, n_score string")
    return _first(found.withColumn("n_score", F.expr("try_cast(n_score as decimal(38,0))")), ["vec_id", "p_rank"], "n_score", "n_id", k, "rank")


def _windowed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Anchors with an array of their positives' (rank, score); no score is in the window of one below zero."""
    w = found.where("p_score >= 0").groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct(F.col("p_rank").alias("j"), F.col("p_score").alias("score")))).alias("windows"))  # POSITIVES at most
    return rows.join(w, "vec_id")


def _pack_windows(batch: pa.RecordBatch) -> dict:
    own = batch.column("windows").to_pylist()
    return _pack(batch) | {"windows": own, "least": LOW / 100 * min(float(x["score"]) for w in own for x in w) * (1 - 1e-9)}


def hard_negatives(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector, an empty vector, or any null or
    non-finite component take no part; of rows that share an id the first in
    the order of label and vector counts, so repeated rows count once. Only
    vectors of equal length are compared. An anchor without positives, and a
    window without rows, give no rows; neither does an empty table. Ties go to
    the smaller id. Scores are exact; those beyond a long come back
    as null, and those of 39 digits and more take no part.
    Columns other than vec_id, label and the vector are not read.
    """
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")).cast("long")
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(vector, SCALE))
    good = one_per_id(good.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(vector).alias("vector")), "vec_id", "label", "vector")
    good = materialize(good.withColumns({"dim": F.size("vector"), "norm2": norm2("vector", SCALE)}), "negatives")
    anchors = good.where(F.col("vec_id") % EVERY == 0)
    by_label = materialize(_packed(good, ["dim", "label"], CANDIDATES, _BLOCK.replace("dim int", "dim int, label long")), "by-label")
    own = materialize(positives(_packed(anchors, ["dim", "label"], ANCHORS, _BLOCK.replace("dim int", "dim int, label long")), by_label), "positives")
    release(by_label)
    order = [F.col("dim"), F.desc("norm2"), F.col("vec_id")]
    windows = _windowed(anchors, own).repartitionByRange(*order).sortWithinPartitions(*order)
    windows = blocks(windows, ["dim"], _pack_windows, _BLOCK + ", windows array<array<struct<j:int,score:decimal(38,0)>>>, least double", ANCHORS)
    found = negatives(windows, materialize(_packed(good, ["dim"], CANDIDATES), "by-norm"))
    out = found.join(own.select("vec_id", "p_rank", "p_id", "p_score"), ["vec_id", "p_rank"])
    return out.select(
        F.col("vec_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("n_id").alias("negative_id"), F.expr("try_cast(p_score as long)").alias("positive_score"), F.expr("try_cast(n_score as long)").alias("negative_score")
    )
