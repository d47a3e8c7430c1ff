"""What is older than a case, and undoing the last batch, against plain loops."""

import json
import os
import random

from overscribe.operators import library as lib
from overscribe.plans.common import cases
from overscribe.schemas import EVENT
from overscribe.sources import store
from overscribe.streaming import ingest


def test_kb_size_is_the_number_of_older_documents(spark):
    rng = random.Random(1)
    days = [f"2020-{m:02d}-{d:02d}" for m in range(1, 13) for d in (1, 9, 28)]
    docs = [(rng.choice(["2020-06-09", *days]),) for _ in range(500)] + [(None,)]
    asked = [(i, rng.choice([*days, "2019-01-01", "2021-01-01", None])) for i in range(80)]
    got = lib.with_kb_size(spark.createDataFrame(asked, "i int, at string"), spark.createDataFrame(docs, "date string"), "at")
    assert {r.i: r.kb_size for r in got.collect()} == {i: sum(d is not None and at is not None and d < at for (d,) in docs) for i, at in asked}
    assert [r.kb_size for r in lib.with_kb_size(spark.createDataFrame([("a",)], "at string"), spark.createDataFrame([], "date string"), "at").collect()] == [0]


def test_cases_are_spread_over_days(spark, data):
    found = [r.case_date for r in cases(spark, data).collect()]
    assert len(set(found)) > 10 and min(found) >= "2015-01-01" and max(found) < "2024-01-01"


def log(spark, events):
    """(action, batch, doc ids or (target, by)) in order, as events."""
    doc = lambda x: {"doc_id": x}
    rows = []
    for action, batch, what in events:
        for one in what if action == "add" else [what]:
            row = {"seq": len(rows), "action": action, "batch": batch}
            rows.append(row | ({"doc": doc(one)} if action == "add" else {"target": one[0], "by": one[1]} if action == "replace" else {"doc_ids": one}))
    return spark.createDataFrame(rows, EVENT)


def test_undo_last_takes_the_last_batch_that_stands(spark):
    events = [("add", "b1", ["x", "y"]), ("add", "b2", ["z"]), ("add", "b3", ["u", "v"]), ("undo", "b3", ["u", "v"])]
    got = lib.undo_last(log(spark, events), 99).collect()
    assert [(r.seq, r.action, r.batch, r.doc_ids) for r in got] == [(99, "undo", "b2", ["z"])]
    events.append(("undo", "b2", ["z"]))
    assert lib.undo_last(log(spark, events), 99).first().doc_ids == ["x", "y"]
    events.append(("undo", "b1", ["x", "y"]))
    assert lib.undo_last(log(spark, events), 99).collect() == []


def test_an_undone_batch_is_gone_and_its_targets_are_current(spark):
    library = spark.createDataFrame([("a", "2020-01-01", "2020-01-01|a")], "doc_id string, date string, pos string")
    events = [("add", "b1", ["x"]), ("replace", "b1", ("a", "x"))]
    before = lib.replay(library, log(spark, events))
    assert {(r.doc_id, r.replaced_by) for r in before.collect()} == {("a", "x"), ("x", None)}
    undo = lib.undo_last(log(spark, events), 9).first()
    after = lib.replay(library, log(spark, [*events, ("undo", undo.batch, undo.doc_ids)]))
    assert {(r.doc_id, r.replaced_by) for r in after.collect()} == {("a", None)}


def made_log(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        b = f"b{rng.randint(0, 25)}"
        kind = rng.choice(["add", "add", "replace", "replace", "undo"])
        what = [f"f{i}"] if kind == "add" else (f"d{rng.randint(0, 12)}", f"f{rng.randint(0, n)}") if kind == "replace" else [f"f{rng.randint(0, n)}" for _ in range(8)]
        out.append((kind, b, what))
    return out


def test_stream_is_replay_whatever_the_batches(spark, tmp_path):
    """The log in files of any size and in any order, one a batch, and one of them twice."""
    library = spark.createDataFrame([(f"d{i}", "2020-01-01", f"2020-01-01|d{i}") for i in range(13)], "doc_id string, date string, pos string")
    events = log(spark, made_log(3))
    want = sorted((r.doc_id, r.replaced_by or "", r.pos) for r in lib.replay(library, events).collect())
    assert 1 < sum(bool(w[1]) for w in want) < 13
    rows, folder = [r.asDict(recursive=True) for r in events.collect()], tmp_path / "log"
    folder.mkdir()
    for name, (a, b) in zip("cadbe", [(0, 40), (40, 41), (41, 90), (90, 120), (41, 90)], strict=True):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows[a:b]))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder))
    ingest.follow(stream, str(tmp_path / "facts"), str(tmp_path / "cp")).awaitTermination()
    got = ingest.library_of(library, str(tmp_path / "facts"))
    assert sorted((r.doc_id, r.replaced_by or "", r.pos) for r in got.collect()) == want


def test_a_batch_touches_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, by string, at long")
    store.merge_latest(spark, path, frame([(f"d{i}", "x", 1) for i in range(300)]), "doc_id")
    names = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    before = names()
    store.merge_latest(spark, path, frame([("d7", "late", 5), ("d7", "early", 0)]), "doc_id")
    assert sum(before[d] != x for d, x in names().items()) == 1
    got = {r.doc_id: (r.by, r.at) for r in spark.read.parquet(path).collect()}
    assert len(got) == 300 and got["d7"] == ("late", 5) and got["d8"] == ("x", 1)
