"""Steps that no task has a whole group of: results against plain ones, and what their plans may not have."""

import hashlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from overscribe.operators import lexical, signals, stats
from overscribe.plans import REGISTRY, SQL
from overscribe.schemas import LABELS

from .oracle import rows


def test_quick_ratios_whole(spark, monkeypatch):
    monkeypatch.setattr(signals, "PACKED", 3)
    monkeypatch.setattr(signals, "PAIRS", 5)
    a = ["", "abc", "abcd", "aabbcc", "海洋學院", "x" * 50, "x" * 49 + "y"]
    b = [*a, "cba", "dcbe", "海學洋院", "x" * 55, "yxx" * 17, "q"]
    want = {}
    for x in a:
        for y in b:
            n = len(x) + len(y)
            if n and 2 * min(len(x), len(y)) / n >= 0.9:
                want[x, y] = 2 * sum((Counter(x) & Counter(y)).values()) / n
    for sent in (signals.SENT, 0):
        monkeypatch.setattr(signals, "SENT", sent)
        got = signals.quick_ratios(spark.createDataFrame([(x,) for x in a], "a string").repartition(2), spark.createDataFrame([(x,) for x in b], "b string").repartition(3), 0.9)
        got = {(r.a, r.b): r.quick for r in got.collect()}
        assert got.pop(("", "")) == float("inf") and got == pytest.approx(want)


def test_m02_with_empty_titles_as_sql_has_it(spark, tmp_path):
    texts = ["#\nbody", "Title\nbody", "Titel\nother", "#\nbody two", "Some other title\nx"]
    c = duckdb.connect()
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = REGISTRY["m02_quick_ratio"](spark, str(tmp_path))
    assert rows(got.toPandas()) == rows(c.sql(SQL["m02_quick_ratio"]).df())


def test_bootstrap_has_no_window_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(stats, "DRAWS", 7)
    label = lambda *x: LABELS[int(hashlib.md5(repr(x).encode()).hexdigest(), 16) % 3]
    data = [(g, f"c{i:03d}", label(i), label(g, i)) for g, n in (("a", 40), ("b", 40), ("c", 23)) for i in range(n)]
    out = stats.bootstrap(spark.createDataFrame(data, "g string, case_id string, gold_label string, label string").repartition(4), "g", 6, ["label"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    got = {(r.g, r.replicate): r.f1_label for r in out.collect()}
    want = {}
    for g in "abc":
        own = sorted(x for x in data if x[0] == g)
        for r in range(1, 7):
            drawn = [own[int(hashlib.md5(f"{r}:{d}".encode()).hexdigest()[:8], 16) % len(own)] for d in range(1, len(own) + 1)]
            f = 0.0
            for x in LABELS:
                hit, either = sum(o[2] == o[3] == x for o in drawn), sum(o[2] == x for o in drawn) + sum(o[3] == x for o in drawn)
                f += 2 * hit / either if either else 0
            want[g, r] = f / len(LABELS)
    assert got == pytest.approx(want)


def test_counting_takes_few_texts_at_once():
    whole = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    parts = list(lexical.few([whole, whole.slice(0, 10)]))
    assert max(p.num_rows for p in parts) <= lexical.TEXTS and pa.Table.from_batches(parts).num_rows == 1010
