"""Bootstrap by cells against a plain version with the same draws, and against draws of rows; the bucketed store."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from overscribe.operators import stats
from overscribe.plans import REGISTRY
from overscribe.plans.common import METHODS, answers
from overscribe.schemas import LABELS
from overscribe.sources import store


def f1(pairs):
    out = 0.0
    for x in LABELS:
        hit, either = sum(g == p == x for g, p in pairs), sum(g == x for g, _ in pairs) + sum(p == x for _, p in pairs)
        out += 2 * hit / either if either else 0.0
    return out / len(LABELS)


def test_replicates_are_those_of_the_same_draws(spark):
    rng = random.Random(1)
    rows = [(m, f"c{i}", rng.choice(LABELS), rng.choice(LABELS[:2]), rng.choice(LABELS)) for m in ("a", "b") for i in range(70)]
    got = stats.bootstrap_cells(spark.createDataFrame(rows, "method string, case_id string, gold_label string, label string, other string"), "method", 1100, ["label", "other"])
    got = {(r.method, r.replicate): (r.f1_label, r.f1_other) for r in got.collect()}
    assert len(got) == 2200
    for m in ("a", "b"):
        cells = sorted(Counter((g, p, o) for x, _, g, p, o in rows if x == m).items())
        for r in (1, 500, 501, 1100):
            times = stats.cell_draws(m, [n for _, n in cells], range(r, r + 1), 7)[0]
            drawn = [c for (c, _), n in zip(cells, times, strict=True) for _ in range(n)]
            assert len(drawn) == 70 and got[m, r] == pytest.approx((f1([(g, p) for g, p, _ in drawn]), f1([(g, o) for g, _, o in drawn])))


def test_cells_and_rows_have_one_distribution():
    rng = np.random.default_rng(2)
    gold, pred = (rng.choice(LABELS, 200) for _ in range(2))
    cells = sorted(Counter(zip(gold, pred, strict=True)).items())
    a = stats.drawn_f1(stats.cell_draws("m", [n for _, n in cells], range(4000), 1), *(np.array([c[i] for c, _ in cells], dtype=object) for i in range(2)))
    at = rng.integers(200, size=(600, 200))
    b = np.array([f1(list(zip(gold[i], pred[i], strict=True))) for i in at])
    assert abs(a.mean() - b.mean()) < 0.005 and abs(a.std() - b.std()) < 0.003 and np.abs(np.quantile(a, [0.025, 0.975]) - np.quantile(b, [0.025, 0.975])).max() < 0.015


def test_r03_and_r04_by_cells(spark, data):
    rows = [(r.method, r.case_id, r.gold_label, r.label) for r in answers(spark, data).collect()]
    other = {c: p for m, c, _, p in rows if m == METHODS[1]}
    got = {r.method: (r.low, r.high) for r in REGISTRY["r03_bootstrap_cells"](spark, data).collect()}
    paired = {r.method: (r.low, r.high, r.p_le_0) for r in REGISTRY["r04_paired_cells"](spark, data).collect()}
    assert set(got) == set(METHODS) and set(paired) == set(METHODS) - {METHODS[1]}

    def drawn(m, keys):
        cells = sorted(Counter(keys).items())
        times = stats.cell_draws(m, [n for _, n in cells], range(1, 10_001), 7)
        return [stats.drawn_f1(times, *(np.array([c[i] for c, _ in cells], dtype=object) for i in (0, j))) for j in range(1, len(cells[0][0]))]

    m = METHODS[3]
    (one,) = drawn(m, [(g, p) for x, _, g, p in rows if x == m])
    assert got[m] == pytest.approx(tuple(np.quantile(one, [0.025, 0.975]).round(6)))
    mine, base = drawn(m, [(g, p, other[c]) for x, c, g, p in rows if x == m])
    d = (mine - base).round(9)
    assert paired[m] == pytest.approx((*np.quantile(d, [0.025, 0.975]).round(6), round(float((d <= 0).mean()), 6)))


def points(spark, rows):
    return spark.createDataFrame([(f"{f}:{i}", f, i, c, [1.0]) for f, i, c in rows], store.POINT)


def test_an_upsert_writes_the_buckets_of_its_files_only(spark, tmp_path):
    path = str(tmp_path / "store")
    files = [f"f{i}" for i in range(40)]
    old = [(f, i, f"{f} {i}") for f in files for i in range(3)]
    store.create(points(spark, old), path)
    stamp = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    before = stamp()
    new = [("f7", 0, "new 0"), ("f7", 1, "new 1")]
    got = {(r.source_file, r.idx): r.content for r in store.upsert_files(spark, path, points(spark, new)).collect()}
    assert got == {(f, i): c for f, i, c in old} | {(f, i): c for f, i, c in new}  # f7's third section stays
    assert sum(before[d] != x for d, x in stamp().items()) == 1
    got = {(r.source_file, r.idx): r.content for r in store.upsert_files(spark, path, points(spark, [*new, ("g", 0, "g")]), prune=True).collect()}
    assert ("f7", 2) not in got and got["g", 0] == "g" and len(got) == 120
    assert store.upsert_files(spark, path, points(spark, [])).count() == 120
