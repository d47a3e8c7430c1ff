"""The operators over vectors against brute force: in plain Python's integers, or every pair in numpy."""

import hashlib
import math

import numpy as np
import pytest

from overscribe.llm import clusters, hilbert, negatives, vectors
from overscribe.llm import queries as llm

SCHEMA = "note string, vec_id long, embedding array<float>, label int, distance double, rank int, at int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """Rows (vec_id, vector, label) with further columns, some named as the operators' own."""
    return spark.createDataFrame([("x", i, v, c, 0.5, 9, 9) for i, v, c in rows], SCHEMA)


def plain(rows, columns=None):
    return sorted(tuple(r) if columns is None else tuple(r[c] for c in columns) for r in rows)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [math.floor(256 * x) for x in np.array(v, np.float32).astype(float).tolist()]


def clustered(rows, dim, k=40, rounds=5):
    kept = [(i, whole(v)) for i, v, _ in rows if usable(v) and len(v) == dim]
    cents = [q for _, _, q in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, q) for i, q in kept)[:k]]

    def assign():
        out = []
        for i, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in cents]
            out.append((i, q, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [q for _, q, c, _ in got if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = assign()
    inertia = [sum(d for _, _, c, d in got if c == j) for j in range(len(cents))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i, c, d, inertia[c], sum(inertia), names[c]) for i, _, c, d in got)


def mined(rows):
    byid = {}
    for i, v, c in rows:
        if i is not None and c is not None and usable(v):
            c = (c + 1) % 10 if i % 7 == 0 else c
            byid[i] = min(byid.get(i, (c, v)), (c, v))
    kept = {i: (c, whole(v)) for i, (c, v) in byid.items()}
    out = []
    for a, (la, qa) in kept.items():
        if a % 100:
            continue
        s = [(-sum(x * y for x, y in zip(qa, q, strict=True)), i, c) for i, (c, q) in kept.items() if i != a and len(q) == len(qa)]
        for p, i, _ in sorted(x for x in s if x[2] == la)[:5]:
            fit = sorted(x for x in s if x[2] != la and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j, _) in enumerate(fit)]
    return sorted(out)


def neighbours(rows, k=10, every=100):
    kept = {}
    for i, v, _ in rows:
        if i is not None and usable(v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for a, v in kept.items():
        if a % every == 0:
            x = np.array(v, np.float32).astype(float)
            d = [(float(np.sqrt(((np.array(w, np.float32).astype(float) - x) ** 2).sum())), i) for i, w in kept.items() if i != a and len(w) == len(v)]
            out[a] = sorted(d)[:k]
    return out


def awkward(rng, n=700, dim=64):
    """Vectors with ties, repeated rows, a vector that a third of all rows have, and all kinds of unusable ones."""
    hot = rng.normal(size=dim).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=dim).astype(np.float32).tolist(), int(rng.integers(10))) for i in range(n)]
    rows += [rows[5], rows[100], rows[100], (900, None, 1), (1000, [], 2), (1100, [NAN] * dim, 3), (1200, [1.0] * (dim - 1) + [INF], 4), (1300, [None] + [1.0] * (dim - 1), 5)]
    return rows + [(1400, [0.0] * dim, 6), (1500, [1.0] * 3, 7), (1501, [2.0] * 3, 7), (1502, [-1.0, 0.5, 0.5], 8), (1503, [1.5] * 3, 8), (1600, hot, None), (-100, hot, 3)]


def test_clusters_against_integers(spark):
    rows = awkward(np.random.default_rng(1))
    want = clustered(rows, 64)
    assert plain(clusters.cluster(frame(spark, rows)).collect()) == want
    assert len(want) > 700  # repeated rows count and come back


def test_clusters_of_few_and_of_large_numbers(spark):
    few = [(3, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (5, [-1.0, 0.5], 0), (6, None, 0)]
    assert plain(clusters.cluster(frame(spark, few), dim=2).collect()) == clustered(few, 2)
    large = [(i, [float(x) for x in row], 0) for i, row in enumerate(np.random.default_rng(2).normal(size=(60, 3)).astype(np.float32) * np.float32(3e5))]
    large.append((99, [1e30, 0.0, 0.0], 0))  # beyond 2^53: Python's integers
    got, want = plain(clusters.cluster(frame(spark, large), dim=3, k=5).collect()), clustered(large, 3, k=5)
    long = lambda v: v if v < 2**63 else None
    assert got == [(i, c, long(d), long(x), long(t), h) for i, c, d, x, t, h in want]


def test_clusters_empty(spark):
    assert clusters.cluster(frame(spark, [])).collect() == []
    assert clusters.cluster(frame(spark, [(1, None, 1), (2, [1.0], 1)])).collect() == []


def test_distances_are_exact_at_the_bound():
    x = np.array([[2.0**25, 1.0], [2.0**30, -(2.0**30)]])
    c = [[2**25, 0], [-(2**30), 2**30]]
    assert [[int(v) for v in r] for r in clusters.distances(x, c)] == [[sum((int(a) - b) ** 2 for a, b in zip(r, q, strict=True)) for q in c] for r in x]


def test_negatives_against_integers(spark):
    rows = awkward(np.random.default_rng(3))
    want = mined(rows)
    assert plain(negatives.hard_negatives(frame(spark, rows)).collect()) == want
    assert len(want) > 100 and len({r[0] for r in want}) > 5


def test_negatives_with_buckets_that_are_passed_over(spark):
    """Lengths from 1 to 1000, so that bounds do cut, and labels of which one has a third of the rows."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 10 ** rng.uniform(0, 3)).astype(np.float32).tolist(), 1 if i % 3 else int(rng.integers(2, 9))) for i in range(900)]
    assert plain(negatives.hard_negatives(frame(spark, rows)).collect()) == mined(rows)


def test_negatives_of_few_rows_and_large_numbers(spark):
    few = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 1.0], 2), (4, [0.95, 0.0], 2)]
    assert plain(negatives.hard_negatives(frame(spark, few)).collect()) == mined(few) == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 3, 65536, 32768)]
    large = [(i, [float(x) for x in r], i % 3) for i, r in enumerate((np.random.default_rng(5).normal(size=(150, 4)) * 1e6).astype(np.float32))]
    assert plain(negatives.hard_negatives(frame(spark, large)).collect()) == mined(large)
    assert negatives.hard_negatives(frame(spark, [])).collect() == []
    assert negatives.hard_negatives(frame(spark, [(100, [1.0], 1), (101, None, 1)])).collect() == []


def test_products_are_exact_for_every_type():
    rng = np.random.default_rng(6)
    for most in (100, 10**5, 10**12):
        a, b = (rng.integers(-most, most, size=(5, 4)).astype(float) for _ in range(2))
        bound = float(np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max()) * 1.01
        assert [[int(x) for x in r] for r in negatives.products(a, b, bound)] == [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]


def found(spark, rows, **kind):
    out = {}
    for r in hilbert.nearest_neighbours(frame(spark, rows), **kind).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_neighbours_of_awkward_rows(spark):
    """So few rows are all within the windows: the same as brute force, ties by id, equal vectors included."""
    rows = awkward(np.random.default_rng(7))
    got, want = found(spark, rows, target=1.0), neighbours(rows)
    assert set(got) == {k for k, v in want.items() if v}
    held = sum(len(set(got[k]) & set(want[k])) for k in got)
    assert held >= 0.98 * sum(map(len, want.values()))
    assert got[0] == want[0] and got[0][0] == (0.0, -100) and got[300] == want[300]
    assert got[1500] == want[1500] and len(got[1500]) == 3


def test_neighbours_recall(spark):
    """Near copies of one vector by the hundreds beside rows without structure, and groups."""
    rng = np.random.default_rng(8)
    base, groups = rng.normal(size=32), rng.normal(size=(20, 32))
    x = np.concatenate([base + rng.normal(size=(1500, 32)) * 0.01, rng.normal(size=(1500, 32)), groups[rng.integers(20, size=1500)] + rng.normal(size=(1500, 32)) * 0.2]).astype(np.float32)
    rng.shuffle(x)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    got, want = found(spark, rows), neighbours(rows)
    assert sum(len({i for _, i in got[k]} & {i for _, i in want[k]}) for k in want) >= 0.9 * sum(map(len, want.values()))
    assert all(g[j][0] >= want[k][j][0] for k, g in got.items() for j in range(10))


def test_neighbours_of_none(spark):
    assert found(spark, []) == {} == found(spark, [(100, None, 1), (1, [1.0], 1)])
    assert found(spark, [(100, [1.0], 1), (1, [3.0], 1), (2, [0.0], 1)]) == {100: [(2.0, 1)]}
    assert found(spark, [(100, [1.0], 1)]) == {}


def test_hilbert_neighbours_on_the_curve_are_neighbours():
    """Every place once, and each step of the curve goes to an adjoining cell."""
    for dims, bits in ((1, 4), (2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert.hilbert(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_near_keeps_all_that_can_be_among_the_first():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(300, 5)), rng.normal(size=(4, 5))
    for (at, d), y in zip(hilbert.near(q, x, np.full(4, INF), 10), q, strict=True):
        want = np.sqrt(((x - y) ** 2).sum(1))
        assert set(np.argsort(want)[:10]) <= set(at.tolist()) and (d == want[at]).all()
    big = x * 1e300
    assert all(len(at) == 300 for at, _ in hilbert.near(big[:1], big, np.full(1, INF), 10))


def test_firsts_merges_in_any_order():
    rng = np.random.default_rng(10)
    d, ids = rng.integers(0, 5, 200).astype(float), rng.integers(0, 60, 200)
    best = vectors.Firsts(10)
    for at in np.array_split(rng.permutation(200), 7):
        best.add("q", d[at], ids[at])
    assert list(zip(*best.kept["q"], strict=True)) == sorted(set(zip(d, ids, strict=True)))[:10]


@pytest.mark.parametrize("name", ["op11_hilbert_neighbours", "op12_hard_negatives", "op13_centroid_clusters"])
def test_queries(spark, data, name):
    import duckdb

    rows = duckdb.sql(f"select vec_id, embedding, label from '{data}/embeddings.parquet'").fetchall()
    rows = [(i, list(v), c) for i, v, c in rows]
    got = llm.queries()[name](spark, data).collect()
    if name[:4] == "op12":
        assert plain(got) == mined(rows)
    elif name[:4] == "op13":
        assert plain(got) == clustered(rows, 64)
    else:
        want = {(k, i) for k, v in neighbours(rows).items() for _, i in v}
        assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want) and len(got) == len(want)
