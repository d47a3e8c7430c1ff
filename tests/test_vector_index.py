"""The inverted file against all pairs."""

import numpy as np

from overscribe.operators import vector_index
from overscribe.plans import REGISTRY


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"{name} int, v array<float>")


def nearest(x, q, k, own):
    s = q.astype(float) @ x.astype(float).T
    if not own:
        s[np.arange(len(q)), np.arange(len(q))] = -9
    return {i: np.lexsort((np.arange(len(x)), -row))[:k].tolist() for i, row in enumerate(s)}


def hits(got, want):
    found = {}
    for r in got:
        found.setdefault(r.q, []).append((r["rank"], r.id))
    return sum(len(set(want[q]) & {i for _, i in sorted(rows)}) for q, rows in found.items()), sum(map(len, want.values()))


def test_all_cells_are_exact_and_few_reach_the_recall(spark):
    """Groups of all sizes, one of which has a third of all rows, so that its cell is several blocks."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    at = np.where(rng.random(4000) < 0.33, 0, rng.integers(30, size=4000))
    x = unit(centres[at] + rng.normal(size=(4000, 24)) * 0.3)
    base, q = frame(spark, x), frame(spark, x[:100], "q")
    index = vector_index.build(base, "id", "v", 16)
    assert index.blocks.selectExpr("explode(keys) k").distinct().count() == 4000  # every row is in it
    assert max(r.n for r in index.blocks.selectExpr("size(keys) n").collect()) < 2 * vector_index.BLOCK
    want = nearest(x, x[:100], 10, own=False)
    whole = index.search(q, "q", "v", 10, 16, own=False).collect()
    assert {(r.q, r["rank"]): r.id for r in whole} == {(i, n + 1): j for i, ids in want.items() for n, j in enumerate(ids)}
    probes = index.measured_probes(q, "q", "v", 10, own=False)
    found, of = hits(index.search(q, "q", "v", 10, probes, own=False).collect(), want)
    assert found >= 0.9 * of and probes < 16


def test_ties_and_few_rows(spark):
    x = unit(np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]))
    index = vector_index.build(frame(spark, x), "id", "v", 8)
    got = index.search(frame(spark, x[:1], "q"), "q", "v", 2, 8).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in got] == [(0, 1), (1, 2)]
    assert vector_index.build(frame(spark, x).where("id < 0"), "id", "v", 8) is None
    assert index.search(frame(spark, x, "q").where("q < 0"), "q", "v", 2, 8).collect() == []
    assert index.measured_probes(frame(spark, x, "q").where("q < 0"), "q", "v", 2) == 1


def test_s17_recall(spark, data):
    import duckdb

    x = np.array([list(r[0]) for r in duckdb.sql(f"select embedding from '{data}/embeddings.parquet' order by vec_id").fetchall()])
    s = x @ x.T
    np.fill_diagonal(s, -9)
    got = {(r.q_id, r.vec_id) for r in REGISTRY["s17_vector_index"](spark, data).collect()}
    want = {(q, j) for q in range(0, len(x), 50) for j in np.argsort(-s[q])[:5].tolist()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
