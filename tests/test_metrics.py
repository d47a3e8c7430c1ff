import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from overscribe.operators import library, methods, metrics, stats

U, N, R = "UPDATE", "NEW", "REDUNDANT"


def answers(spark, rows):
    return spark.createDataFrame([("m", str(i), *r) for i, r in enumerate(rows)], "method string, case_id string, gold_label string, gold_target string, label string, target string")


def test_macro_f1(spark):
    df = answers(spark, [(U, "a", U, "a"), (N, "", N, None), (R, "b", R, "b")])
    assert df.agg(metrics.macro_f1()).first()[0] == 1.0
    df = answers(spark, [(U, "a", U, None), (N, "", U, None)])
    assert df.agg(metrics.macro_f1()).first()[0] == pytest.approx((2 / 3) / 3)


def test_targets(spark):
    df = answers(spark, [(U, "a|b", U, "b"), (U, "a", U, "c"), (U, "a", N, None), (N, "", U, "a")])
    row = metrics.target_accuracy(df, "method").first()
    assert (row.n, row.conditional, row.joint) == (3, 0.5, pytest.approx(1 / 3))
    assert [r[0] for r in df.orderBy("case_id").select(metrics.correct()).collect()] == [True, False, False, False]


def test_confusion(spark):
    df = answers(spark, [(U, "a", U, None), (U, "a", N, None), (N, "", N, None)])
    got = {(r.gold, r.predicted): r.n for r in metrics.confusion(df, "method").collect()}
    assert got[U, U] == got[U, N] == got[N, N] == 1 and sum(got.values()) == 3 and len(got) == 9


def test_mcnemar(spark):
    df = spark.createDataFrame([(0, 10), (0, 0), (3, 7), (400, 350)], "a long, b long")
    got = [r[0] for r in df.select(stats.mcnemar_p(F.col("a"), F.col("b"))).collect()]
    want = [min(1.0, 2 * sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b)) if a + b else 1.0 for a, b in ((0, 10), (0, 0), (3, 7), (400, 350))]
    assert got == pytest.approx(want)


def test_holm(spark):
    df = spark.createDataFrame([("x", 0.04, "f"), ("y", 0.01, "f"), ("z", 0.02, "f")], "k string, p double, f string")
    got = {r.k: r.p_adj for r in stats.holm(df, "p", "f").collect()}
    assert got == pytest.approx({"x": 0.04, "y": 0.03, "z": 0.04})


def test_kappa(spark):
    a = spark.createDataFrame([("1", U), ("2", N)], "case_id string, label string")
    assert metrics.kappa(a, a).first().kappa == 1.0


def test_first_wins_on_ties(spark):
    df = spark.createDataFrame([("c", "x", 0.5, "2"), ("c", "y", 0.5, "1")], "case_id string, doc_id string, s double, pos string")
    assert methods.best_document(df, "s").first().doc_id == "y"


def test_new_cut_keeps_the_last_prefix(spark):
    rows = [(0.1, N), (0.2, U), *((0.3 + i / 100, N) for i in range(18)), (0.9, U), (0.95, U)]
    df = spark.createDataFrame(rows, "score double, gold_label string")
    assert methods.new_cut(df).first().t_new == pytest.approx(0.9 + 1e-9)


EVENTS = st.lists(st.tuples(st.sampled_from(["add", "replace", "undo"]), st.integers(0, 2), st.integers(0, 3)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EVENTS)
def test_replay_like_a_loop(spark, log):
    rows, added, replaced = [], [], {}
    for seq, (action, batch, k) in enumerate(log):
        b, by = f"b{batch}", f"f{k}"
        if action == "add":
            added.append((b, by))
            rows.append((seq, action, b, {"doc_id": by, "title": "t", "date": "2020"}, None, None, None))
        elif action == "replace":
            replaced[f"d{batch}"] = by
            rows.append((seq, action, b, None, f"d{batch}", by, None))
        else:
            added = [a for a in added if a[0] != b]
            replaced = {t: x for t, x in replaced.items() if x != by}
            rows.append((seq, action, b, None, None, None, [by]))
    schema = "seq long, action string, batch string, doc struct<doc_id:string,title:string,date:string>, target string, by string, doc_ids array<string>"
    base = spark.createDataFrame([(f"d{i}", "t", "2019", f"2019|d{i}") for i in range(3)], "doc_id string, title string, date string, pos string")
    got = sorted((r.doc_id, r.replaced_by or "") for r in library.replay(base, spark.createDataFrame(rows, schema)).collect())
    assert got == sorted((d, replaced.get(d, "")) for d in [f"d{i}" for i in range(3)] + [a[1] for a in added])
