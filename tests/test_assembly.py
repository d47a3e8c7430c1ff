import html
import json

import pytest
from pyspark.sql import functions as F

from overscribe.functions import text as tx
from overscribe.operators import cases, judge, methods, report, router, sampling
from overscribe.plans.assembly import made_up
from overscribe.sources import cache, readers, sinks, store


def test_unescape(spark):
    texts = [
        "&#8217;&#x2F;&#X41;&eacute;&nbsp;", "a &amp;lt; b", "&amp;amp;", "&copy 2020 &ampx; &notit; &notin;", "&unknown; & && &; &#; &#x;", "&#0;&#xD800;&#x110000;&#128512;",
        "&#150;&#x80;", "no entity", "", "&#65 &#66", "&hellip;&CounterClockwiseContourIntegral;", "tail &", "&#99999999999;",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.u for r in rows.select("i", tx.unescape("t").alias("u")).collect()}
    assert got == {i: html.unescape(t) for i, t in enumerate(texts)} | {99: None}


def test_vectors_are_kept(spark, tmp_path):
    path = str(tmp_path / "v")
    docs = spark.createDataFrame([("a", "t", "x"), ("b", "t", "y"), ("b", "t", "y"), ("c", None, None)], "doc_id string, title string, text string")
    first = {r.doc_id: r.vector for r in cache.vectors(docs, path).collect()}
    assert len(first) == 3 and spark.read.parquet(path).count() == 3
    more = docs.union(spark.createDataFrame([("a", "t", "new")], docs.schema))
    assert cache.vectors(more, path).count() == 5 and spark.read.parquet(path).count() == 4
    assert {r.doc_id: r.vector for r in cache.vectors(docs, path).collect()} == first


def test_store_and_latest_run(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.ensure(spark, path).count() == 0
    spark.createDataFrame([("i", "f", 0, "c", [1.0])], store.POINT).write.mode("append").parquet(path)
    assert store.ensure(spark, path).count() == 1
    assert store.ensure(spark, path, reset=True).count() == 0
    for run in ("r1", "r2"):
        store.publish(spark.createDataFrame([(run,)], "x string"), str(tmp_path / "runs"), run)
    assert [r.x for r in store.latest(spark, str(tmp_path / "runs")).collect()] == ["r2"]


def test_labeler(spark, tmp_path):
    rows = spark.createDataFrame([("c2", "</script>"), ("c1", 'a "b"')], "case_id string, text string")
    sinks.labeler(rows, "<script>\nlet d = /*DATA*/null;\n</script>", str(tmp_path / "l"))
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "l"), wholetext=True).collect()).strip()
    assert page.count("</script>") == 1
    data = page.split("let d = ")[1].split(";\n")[0]
    assert json.loads(data) == [{"case_id": "c1", "text": 'a "b"'}, {"case_id": "c2", "text": "</script>"}]


def test_response(spark):
    verdicts = spark.createDataFrame([("f", "UPDATE", "g", 0.5), ("e", "NEW", None, 0.0)], "file string, decision string, target_file string, top_score double")
    found = spark.createDataFrame([("f", 2, "h", 0.4, "y"), ("f", 1, "g", 0.5, "x")], "file string, rank int, source_file string, score double, excerpt string")
    got = {r.file: json.loads(r.json) for r in router.response(verdicts, found).collect()}
    assert [m["source_file"] for m in got["f"]["matches"]] == ["g", "h"]
    assert got["e"] == {"decision": "NEW", "target_file": None, "top_score": 0.0, "matches": []}


def test_answer_keys_must_agree(spark):
    rows = spark.createDataFrame([("r1", "m", "k1"), ("r2", "n", "k1")], "run string, model string, labels string")
    assert report.one_answer_key(rows).count() == 2
    other = rows.union(spark.createDataFrame([("r3", "o", "k2")], rows.schema))
    with pytest.raises(Exception, match="k1, k2"):
        report.one_answer_key(other).collect()


def test_model_comparison(spark):
    schema = "condition string, model string, case_id string, gold_label string, gold_target string, label string, target string, latency_s double, prompt_tokens int, output_tokens int, free_json boolean, json string, error_kind string"
    rows = [("M1", m, f"c{i}", "NEW", "", "NEW" if i < n else "UPDATE", None, 1.0, 5, 5, False, "valid", None) for m, n in (("a", 6), ("b", 0)) for i in range(6)]
    rows += [("M2", "a", "c0", "NEW", "", "NEW", None, None, None, None, True, None, "request_failed"), ("M2", "a", "c1", "NEW", "", "NEW", None, 1.0, 1, 1, True, "recovered", None)]
    df = spark.createDataFrame(rows, schema)
    pair = report.model_pairs(df.where("not free_json")).collect()
    assert [(r.a, r.b, r.a_only, r.b_only, round(r.p, 5), round(r.p_adj, 5)) for r in pair] == [("a", "b", 6, 0, 0.03125, 0.03125)]
    text = report.model_comparison(spark.createDataFrame([("r", "a", "k")], "run string, model string, labels string"), df)
    assert "Answer key: `k`" in text and "| a | M2 | 2 | 0 | 1 | 0 | 1 |" in text


def test_methods_chosen():
    names = ["B0 majority", "B3 BM25", "M1 judge alone", "M2 judge"]
    assert methods.chosen(names, no_llm=True) == names[:2]
    assert methods.chosen(names, only="B3,M2") == ["B3 BM25", "M2 judge"]
    assert methods.chosen(names, no_llm=True, only="M2") == []


def test_cases(spark):
    few = spark.createDataFrame([("c1", "d1"), ("c2", "d2"), ("c3", None)], "case_id string, doc_id string")
    manifest = spark.createDataFrame([("c1", "f1", "k"), ("c2", "f2", "k")], "case_id string, file string, kind string")
    files = spark.createDataFrame([("f1", "t", "x"), ("f2", "t", None)], "file string, title string, text string")
    assert [(r.case_id, r.text) for r in cases.assemble(few, manifest, files).collect()] == [("c1", "x")]
    texts = spark.createDataFrame([(None,), ("",), ("y" * 199,), ("y" * 200,)], "t string")
    got = [tuple(r.r) for r in texts.select(cases.readable_or(F.col("t"), F.lit("pdf"), F.lit("md")).alias("r")).collect()]
    note = "pdf has only {} characters of text (scan?)"
    assert got == [("md", "bulletin-md", ""), ("md", "bulletin-md", note.format(0)), ("md", "bulletin-md", note.format(199)), ("y" * 200, "attachment-pdf", "")]


def test_requests_differ_by_what_is_asked(spark):
    rows = spark.createDataFrame([("c", "t", "d", "x")], "case_id string, case_title string, case_date string, case_text string")
    none = spark.createDataFrame([], "case_id string, rank int, doc_id string, title string, date string, text string")
    alone, empty = judge.requests(rows).first(), judge.requests(rows, none).first()
    assert alone.key != empty.key and alone.candidates == empty.candidates == []
    assert [m.role for m in alone.messages] == ["system", "user"] and "EXISTING" not in alone.messages[1].content
    assert judge.decide(rows, made_up).count() == 1
    unanswered = spark.createDataFrame([], "key string, content string, cost struct<latency_s:double,prompt_tokens:int,output_tokens:int>")
    got = judge.decide(rows, judge.ReplayJudge(unanswered), none).first()
    assert (got.label, got.target, got.error_kind) == ("NEW", None, "request_failed")


def test_page_header_and_body(spark):
    page = '<h3 class="page-title">A &amp; <b>B</b></h3> <i title="日期"></i> 2020-01-02 <i title="修改人"></i> me <p> <div class="page-content">one<br>two<ul class="list-group"></ul>'
    rows = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "n int, html string")
    got = readers.pages(rows).collect()
    assert [(r.n, r.title, r.date, r.author, r.text) for r in got] == [(1, "A & B", "2020-01-02", "me", "one\ntwo")]


def test_rows_of_json_and_csv(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"case_id": "c1", "doc_id": "d", "candidates": ["x", "y"], "other": 1}\n')
    assert readers.cases(spark, str(tmp_path / "c.jsonl")).first().candidates == ["x", "y"]
    (tmp_path / "m.jsonl").write_text('{"case_id": "c1", "file": "f", "chars": 3}\n')
    assert readers.manifest(spark, str(tmp_path / "m.jsonl")).first().chars == 3
    (tmp_path / "calls.jsonl").write_text('{"key": "k", "content": "old"}\n{"key": "k", "content": "new"}\n{"key": "j", "content": null}\n')
    assert {r.key: r.content for r in readers.calls(spark, str(tmp_path / "calls.jsonl")).collect()} == {"k": "new", "j": None}
    run = tmp_path / "run1"
    run.mkdir()
    (run / "results.md").write_text("LLM: **m**\nLabels: `k.csv`\n| M1 | x |\n| M2 | y |\n")
    got = readers.run_infos(spark, f"{tmp_path}/*/results.md", ["M1", "M2", "M3"]).first()
    assert (got.run, got.model, got.labels, got.conditions) == ("run1", "m", "k.csv", 2)
    head = "case_id,split,condition,result,gold,gold_target,pred,pred_target,title,info\n"
    (run / "predictions.csv").write_text(head + 'c1,test,M2 x,CORRECT,NEW,,NEW,,t,"{""latency_s"": 1.5}"\nc2,dev,M2 x,CORRECT,NEW,,NEW,,t,{}\n')
    got = readers.predictions_csv(spark, f"{tmp_path}/*/predictions.csv").collect()
    assert [(r.case_id, r.run, r.code, r.info.latency_s) for r in got] == [("c1", "run1", "M2", 1.5)]


def test_kappa_subset(spark):
    rows = spark.range(200).withColumnRenamed("id", "n")
    got = {r.n for r in sampling.kappa_subset(rows, "n").collect()}
    assert len(got) == 40 and max(got) < 150
    assert {r.n for r in sampling.kappa_subset(rows.orderBy(F.desc("n")), "n").collect()} == got
