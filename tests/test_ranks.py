"""Distributed places and running sums against sorting in one list."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from overscribe.operators import methods, ranks, sampling


def made(n=3000, seed=1):
    """A group with two thirds of all rows, a null one, ties in what is ordered by."""
    rng = random.Random(seed)
    return [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.randint(0, 40) / 4, rng.randint(-3, 3)) for i in range(n)]


def test_running_sums_and_places(spark):
    rows = made()
    df = spark.createDataFrame(rows, "id int, g string, x double, v int").repartition(7)
    groups = defaultdict(list)
    for i, g, x, v in rows:
        groups[g].append((x, i, v))
    want = {}
    for g in groups.values():
        total = 0
        for at, (_, i, v) in enumerate(sorted(g)):
            total += v
            want[i] = (at + 1, total)
    got = ranks.running(df, ["g"], [F.col("x"), F.col("id")], place=F.lit(1), total=F.col("v"))
    assert got.columns == ["id", "g", "x", "v", "place", "total"]
    assert {r.id: (r.place, r.total) for r in got.collect()} == want
    order = [i for _, i in sorted((-x, i) for i, _, x, _ in rows)]
    assert {r.id: r.place for r in ranks.place(df, [], [-F.col("x"), F.col("id")]).collect()} == {i: at + 1 for at, i in enumerate(order)}
    assert ranks.place(df.where("id < 0"), ["g"], [F.col("id")]).collect() == []


def test_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame(made(200), "id int, gold_label string, x double, v int")
    plan = sampling.stratified_split(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and all("_part" in w for w in windows)


def test_cut_is_that_of_the_last_good_prefix(spark):
    for seed in range(6):
        rng = random.Random(seed)
        rows = [(rng.randint(0, 30) / 10, "NEW" if rng.random() < 0.9 else rng.choice(["UPDATE", "REDUNDANT"])) for _ in range(150)] + [(None, "NEW")] * 5
        known = sorted(r for r in rows if r[0] is not None)
        right, want = 0, None
        for at, (score, label) in enumerate(known):
            right += label == "NEW"
            if right >= 0.9 * (at + 1) - 1e-9:
                want = score
        got = methods.new_cut(spark.createDataFrame(rows, "score double, gold_label string")).first().t_new
        assert got == (None if want is None else want + 1e-9)
    assert methods.new_cut(spark.createDataFrame([], "score double, gold_label string")).first().t_new is None


def test_pools_of_every_size(spark):
    import hashlib

    rows = [(i, random.Random(i).choice(["title", "semantic", "random", None])) for i in range(400)]
    by = lambda i: (hashlib.md5(f"13:{i}".encode()).hexdigest(), i)
    for sizes in ({"title": 5, "semantic": 500, "random": 10}, {"title": 90, "semantic": 60, "random": 50}, {"title": 1000, "semantic": 0, "random": 0}):
        want = {i: p for p in ("title", "semantic") for i, _ in sorted((r for r in rows if r[1] == p), key=lambda r: by(r[0]))[: sizes[p]]}
        rest = sorted((i for i, p in rows if p and i not in want), key=by)[: sum(sizes.values()) - len(want)]
        got = sampling.sample_pools(spark.createDataFrame(rows, "id int, pool string"), "id", sizes=sizes).collect()
        assert {r.id: r.pool for r in got} == want | dict.fromkeys(rest, "random")
