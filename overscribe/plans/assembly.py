"""Cases put together, requests and replies of a judge, runs compared, and results kept between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cases as assembled
from ..operators import judge, methods, report, sampling
from ..operators.stats import hash_int
from ..schemas import LABELS
from .common import ANSWER_SQL, CASE_SQL, GOLD_SQL, LIB_SQL, METHODS, answers, cases, f1_sql, gold, h, library, query, table


@query("select cast(l.doc_id as varchar) as case_id, 'f' || l.doc_id as file, length(d.text) as chars from labels l join documents d using (doc_id) where coalesce(d.text, '') <> ''")
def j06_case_files(spark: SparkSession, d: str) -> DataFrame:
    """Cases with their manifest's file."""
    manifest = gold(spark, d).select("case_id", F.concat(F.lit("f"), "case_id").alias("file"), "kind")
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.lit("").alias("title"), "text")
    out = assembled.assemble(gold(spark, d).select("case_id"), manifest, files)
    return out.select("case_id", "file", F.length("text").cast("long").alias("chars"))


@query(f"with {GOLD_SQL}, {LIB_SQL} select case_id, title, date from gold join lib on doc_id = case_id")
def j07_case_bulletins(spark: SparkSession, d: str) -> DataFrame:
    rows = gold(spark, d).select("case_id", F.col("case_id").alias("doc_id"))
    return assembled.with_bulletins(rows, library(spark, d)).select("case_id", "title", "date")


@query(
    """with a as (select doc_id, source, text as t from documents)
select doc_id, case when length(t) >= 200 then 'attachment-pdf' else 'bulletin-md' end as kind, case when length(t) >= 200 then md5(t) else md5(source) end as text_key,
case when t is null or length(t) >= 200 then '' else 'pdf has only ' || length(t) || ' characters of text (scan?)' end as note from a"""
)
def p08_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The documents as attachments; short ones give way to the name of their source."""
    rows = table(spark, d, "documents").select("doc_id", assembled.readable_or(F.col("text"), F.lit("pdf"), F.col("source")).alias("r"))
    return rows.select("doc_id", "r.kind", F.md5("r.text").alias("text_key"), "r.note")


@query(
    """select doc_id, case when doc_id % 4 = 0 then null else '20' || lpad(cast(doc_id % 30 as varchar), 2, '0') end as year, case doc_id % 3 when 0 then 'spring' when 1 then 'autumn' else 'unknown' end as term from documents"""
)
def t16_edition(spark: SparkSession, d: str) -> DataFrame:
    year = F.when(F.expr("doc_id % 4 = 0"), "").otherwise(F.concat(F.lit("20"), F.lpad(F.expr("doc_id % 30").cast("string"), 2, "0"), F.lit("年")))
    term = F.when(F.expr("doc_id % 3 = 0"), "春季").when(F.expr("doc_id % 3 = 1"), "秋季").otherwise("")
    name = F.concat(F.lit("in/"), year, term, F.lit(".pdf"))
    return table(spark, d, "documents").select("doc_id", tx.edition_of(name).alias("e")).select("doc_id", "e.*")


@query("""select doc_id, sha256('{"model":"m","doc_id":' || doc_id || ',"chars":' || n_chars || '}') as key from documents""")
def t18_request_key(spark: SparkSession, d: str) -> DataFrame:
    request = F.struct(F.lit("m").alias("model"), "doc_id", F.col("n_chars").alias("chars"))
    return table(spark, d, "documents").select("doc_id", tx.request_key(request).alias("key"))


def made_up(requests: DataFrame) -> DataFrame:
    """A judge that answers by the hash of the case: one in six fails, one in six breaks off, the others fit."""
    k = hash_int(F.concat(F.lit("j"), "case_id"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (k % 3 + 1).cast("int"))
    reply = F.format_string('{"rationale":"r","label":"%s","target":"C%d","confidence":0.5}', label, k % 5 + 1)
    content = F.when(k % 6 == 4, None).when(k % 6 == 5, '{"label":').otherwise(reply)
    return requests.groupBy("key").agg(F.min("case_id").alias("case_id")).select("key", content.alias("content"))


def three_candidates(rows: DataFrame) -> DataFrame:
    """(case_id, rank, doc_id, title, date, text): c1 to c3 of each case."""
    rows = rows.select("case_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"))
    doc_id = F.concat(F.lit("c"), F.col("rank").cast("string"), F.lit("-"), "case_id")
    return rows.select("case_id", "rank", doc_id.alias("doc_id"), F.lit("t").alias("title"), F.lit("2020-01-01").alias("date"), F.lit("x").alias("text"))


MADE_UP = f"""m0 as (select case_id, {h("'j' || case_id")} as k from cases),
m1 as (select case_id, k, case when k % 6 >= 4 then 'NEW' else {LABELS!r}[k % 3 + 1] end as label, case k % 6 when 4 then 'request_failed' when 5 then 'invalid_json' end as error_kind from m0)"""


@query(f"with {CASE_SQL}, {MADE_UP} select case_id, label, cast(null as varchar) as target, error_kind from m1")
def d05_judge_alone(spark: SparkSession, d: str) -> DataFrame:
    """M1: the judge sees the incoming document only."""
    return judge.decide(cases(spark, d), made_up).select("case_id", "label", "target", "error_kind")


@query(f"with {CASE_SQL}, {MADE_UP} select case_id, label, case when label <> 'NEW' and k % 5 < 3 then 'c' || (k % 5 + 1) || '-' || case_id end as target, error_kind from m1")
def d06_judge(spark: SparkSession, d: str) -> DataFrame:
    """M2: the judge names one of the candidates, or one that is not there."""
    rows = cases(spark, d)
    return judge.decide(rows, made_up, three_candidates(rows)).select("case_id", "label", "target", "error_kind")


def _dev(spark: SparkSession, d: str) -> DataFrame:
    rows = gold(spark, d).select("case_id", "pos", "gold_label", "notes", F.array(F.concat(F.lit("c2-"), "case_id")).alias("targets"))
    return rows.withColumns({"kb_size": F.lit(3), "case_title": F.col("case_id"), "case_date": F.lit("2021-01-01"), "case_text": F.repeat(F.lit("y"), 700)})


@query(
    f"""with {GOLD_SQL}, why as (select *, case when notes like 'template_trap%' then 'looks like the older one of that kind' when notes like 'unsure%' then 'the same text in another language' end as why from gold),
f as (select *, list_position({LABELS!r}, gold_label) as i from why where why is not null qualify row_number() over (partition by gold_label order by pos) = 1),
m as (select cast(2 * i - 1 as integer) as i, 'user' as role, md5('INCOMING ANNOUNCEMENT' || chr(10) || 'title: ' || case_id || chr(10) || 'date: 2021-01-01' || chr(10) || repeat('y', 600) || chr(10) || chr(10)
    || 'EXISTING DOCUMENTS (most similar first)' || chr(10) || array_to_string([('[C' || x || ']' || chr(10) || 'title: t' || chr(10) || 'date: 2020-01-01' || chr(10) || 'x') for x in [1, 2, 3]], chr(10) || chr(10))) as content_key from f
union all select cast(2 * i as integer), 'assistant', md5('{{"rationale":"' || why || '","label":"' || gold_label || '","target":"' || case when gold_label = 'NEW' then 'NONE' else 'C2' end || '","confidence":0.9}}') from f)
select cast(row_number() over (order by i) as integer) as i, role, content_key from m"""
)
def d07_few_shot(spark: SparkSession, d: str) -> DataFrame:
    """M3: the messages that show an exemplar of each label."""
    dev = _dev(spark, d)
    rows = judge.example_messages(dev, three_candidates(dev)).select(F.posexplode("messages").alias("i", "m"))
    return rows.select((F.col("i") + 1).alias("i"), "m.role", F.md5("m.content").alias("content_key"))


@query(
    f"""with {CASE_SQL}, {MADE_UP}, r as (select *, {h("'e' || case_id")} % 2 = 0 as escalated from m1)
select case_id, case when escalated then label else 'NEW' end as label, case when escalated and label <> 'NEW' and k % 5 < 3 then 'c' || (k % 5 + 1) || '-' || case_id end as target, escalated from r"""
)
def d08_cascade_judge(spark: SparkSession, d: str) -> DataFrame:
    """M4: rules decide half of the cases; the judge is asked for the others, with the exemplars."""
    rows, dev = cases(spark, d), _dev(spark, d)
    up = hash_int(F.concat(F.lit("e"), "case_id")) % 2 == 0
    rules = rows.select("case_id", F.when(~up, "NEW").alias("label"), F.lit(None).cast("string").alias("target"), up.alias("escalated"))
    return judge.cascade(rules, rows, made_up, three_candidates(rows), judge.example_messages(dev, three_candidates(dev)))


@query(f"with {GOLD_SQL}, f as (select case_id, pos from gold order by pos limit 150) select case_id from f order by md5('15:' || pos), pos limit 40")
def r02_kappa_subset(spark: SparkSession, d: str) -> DataFrame:
    """Forty of the first hundred and fifty cases, for a second annotator."""
    return sampling.kappa_subset(gold(spark, d), "pos").select("case_id")


@query(f"with {ANSWER_SQL} select method, count(*) as n from ans where method not like 'M%' and (method like 'B1 %' or method like 'B3 %' or method like 'M2 %') group by method")
def p11_method_filter(spark: SparkSession, d: str) -> DataFrame:
    names = methods.chosen(METHODS, no_llm=True, only="B1,B3,M2")
    return answers(spark, d).where(F.col("method").isin(names)).groupBy("method").agg(F.count("*").alias("n"))


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    """The made-up answers as those of as many models, with their costs."""
    rows = answers(spark, d).withColumnRenamed("method", "model").withColumn("condition", F.lit("M2"))
    k = hash_int(F.concat(F.lit("l"), "case_id", "model")) % 100
    costs = {"latency_s": F.when(k % 10 != 0, k / F.lit(4.0)), "prompt_tokens": k.cast("int"), "output_tokens": F.when(k % 3 != 0, 7)}
    return rows.withColumns(costs)


@query(
    f"""with {ANSWER_SQL}, c as (select *, {h("'l' || case_id || method")} % 100 as k from judged), l as (select *, case when k % 10 <> 0 then k / 4.0::double end as s, k + case when k % 3 <> 0 then 7 else 0 end as t from c)
select 'M2' as condition, method as model, count(*) as n, count(*) filter (correct) as right, count(*) filter (gold_label = label) as same_label,
round(({" + ".join(f1_sql(x) for x in LABELS)}) / 3, 6) as macro_f1, round(avg(s), 6) as mean_s, quantile_cont(s, 0.5) as median_s, round(quantile_cont(s, 0.9), 6) as p90_s, round(avg(t) filter (s is not null), 6) as tokens from l group by method"""
)
def a21_model_summary(spark: SparkSession, d: str) -> DataFrame:
    """Models by how right and how fast they are, provided that one answer key judged them all."""
    rows = _model_rows(spark, d)
    infos = report.one_answer_key(rows.select("model").distinct().withColumns({"run": F.col("model"), "labels": F.lit("key.csv")}))
    out = report.model_summary(rows).join(infos.select("model"), "model", "left_semi")
    return out.withColumns({c: F.round(c, 6) for c in ("macro_f1", "mean_s", "p90_s", "tokens")})


@query("select doc_id, md5(cast(doc_id as varchar) || chr(31) || coalesce(text, chr(30))) as key from documents")
def s07_content_key(spark: SparkSession, d: str) -> DataFrame:
    """The keys by which vectors are kept."""
    from ..sources.cache import content_key

    return table(spark, d, "documents").select("doc_id", content_key("doc_id", "text").alias("key"))
