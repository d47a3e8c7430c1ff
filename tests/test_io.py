import io
import json
import zipfile

from overscribe.operators import router
from overscribe.schemas import RouterConfig
from overscribe.sources import readers, sinks
from overscribe.streaming import ingest


def test_bulletins(spark, tmp_path):
    rows = [{"doc_id": "b", "title": "t", "date": "2020-01-02", "text": ""}, {"doc_id": "a", "title": "", "date": "2020-01-02", "text": "x"}, {"doc_id": "c", "title": "t", "date": "0000-00-00"}, {"doc_id": "d", "title": "", "date": "2020-01-01", "text": ""}]
    (tmp_path / "n.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = readers.bulletins(spark, str(tmp_path / "n.jsonl")).orderBy("pos").collect()
    assert [r.doc_id for r in got] == ["a", "b"]


def test_labels_csv(spark, tmp_path):
    text = 'case_id,gold_label,gold_target,changed_field,notes,annotator,seconds\nc1,update,o1,,"a, ""b""",x,3\nc1, New ,,,,x,3\nc2,,,,,x,3\nc3,REDUNDANT,o1|o2,,n,x,3\n'
    (tmp_path / "l.csv").write_text("﻿" + text, encoding="utf-8")
    got = {r.case_id: (r.gold_label, r.targets) for r in readers.labels_csv(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {"c1": ("NEW", [""]), "c3": ("REDUNDANT", ["o1", "o2"])}


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("\n# Title\n\nbody  x\n")
    (tmp_path / "b.txt").write_bytes(b"first\xff\nsecond")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="urn:w"><w:p><w:t>one &amp; </w:t><w:t>only</w:t></w:p><w:p>two</w:p></w:d>')
    (tmp_path / "c.docx").write_bytes(buf.getvalue())
    got = {r.file: (r.title, r.text) for r in readers.files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("Title", "body x"), "b.txt": ("first", "second"), "c.docx": ("c", "one &amp; only\ntwo")}
    (tmp_path / "d.log").write_bytes(b"any\xff kind")
    assert {r.file: r.text for r in readers.uploads(spark, str(tmp_path), "*.log").collect()} == {"d.log": "any kind"}


def test_events_missing_then_streamed(spark, tmp_path):
    log = tmp_path / "log"
    assert readers.events(spark, str(log)).count() == 0
    log.mkdir()
    (log / "1.json").write_text(json.dumps({"seq": 1, "action": "add", "batch": "b", "doc": {"doc_id": "f", "title": "t", "date": "2020"}}) + "\n" + json.dumps({"seq": 2, "action": "replace", "batch": "b", "target": "d", "by": "f"}))
    base = spark.createDataFrame([("d", "t", "2019", "2019|d")], "doc_id string, title string, date string, pos string")
    out = str(tmp_path / "out")
    assert [(r.doc_id, r.replaced_by) for r in ingest.library_of(base, out).collect()] == [("d", None)]
    ingest.follow(ingest.event_stream(spark, str(log)), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.doc_id, r.replaced_by) for r in ingest.library_of(base, out).collect()) == [("d", "f"), ("f", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A/b", "x")], "title string, text string")
    sinks.markdown(df, str(tmp_path / "md"))
    assert "# A/b" in next((tmp_path / "md" / "name=A_b").glob("*.txt")).read_text()
    rows = spark.createDataFrame([("c", True), ("d", False)], "case_id string, correct boolean")
    sinks.errors(rows, str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e"), header=True).count() == 1


def test_router(spark):
    old = "Housing rules. " + "Students pay the fee by the first of June at the office. " * 8
    docs = spark.createDataFrame([("dorm.txt", old), ("visa.txt", "Visa papers are due in May. " * 10)], "doc_id string, text string")
    store = router.store_of(docs)
    new = spark.createDataFrame([("same", old), ("other", "Zq wv xk jj. " * 10), ("empty", "")], "item string, text string")
    out, _ = router.route(new, "item", store, RouterConfig.app())
    got = {r.file: (r.decision, r.target_file) for r in out.collect()}
    assert got == {"same": ("NO_CHANGE", "dorm.txt"), "other": ("NEW_BULLETIN", None)}


def test_sections_again_and_again(spark, data):
    """Every section of every document, the same each time in one session."""
    from overscribe.functions import text as tx
    from overscribe.operators.chunk import sections, split_text

    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted((r.doc_id, i, s) for r in docs.select("doc_id", tx.strip_furniture("text").alias("t")).collect() for i, s in enumerate(split_text(r.t or "")))
    for _ in range(3):
        assert sorted(map(tuple, sections(docs, "doc_id").collect())) == want
    assert sections(docs.where("false"), "doc_id").count() == 0
