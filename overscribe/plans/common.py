"""The registry of queries, and how the given tables stand in for bulletins, cases, answers and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import library as lib
from ..operators.stats import hash_int
from ..schemas import LABELS
from ..sources.scratch import spread

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Methods whose made-up answers the metrics are run on.
METHODS = ["B0 majority", "B1 metadata/title", "B2 cosine", "B3 BM25", "M2 LLM + candidates"]


#: Days over which a third of the incoming passages each is spread.
SPANS = [50, 300, 3000]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages", "embeddings") else rows


def library(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, title, text, date, pos of the documents."""
    return lib.from_documents(table(spark, d, "documents"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    """case_id, case_title, case_text, case_date: the benchmark passages, on days among those of small, middling and large libraries."""
    item = F.col("item_id").cast("string")
    span = F.element_at(F.array(*map(F.lit, SPANS)), (hash_int(F.concat(F.lit("s"), item)) % 3 + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2015-01-01"), (hash_int(F.concat(F.lit("d"), item)) % span).cast("int")), "yyyy-MM-dd")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("b-"), item).alias("case_id"), tx.title_and_text("text").alias("t"), day.alias("case_date"))
    return rows.select("case_id", F.col("t.title").alias("case_title"), F.col("t.text").alias("case_text"), "case_date")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """case_id, pos, gold_label, gold_target, notes, pool, kind: answers made from the labels, to run metrics on."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("case_id"), "quality", "toxic")
    label = F.when(F.col("toxic") == 1, "REDUNDANT").when(F.col("quality") == 1, "UPDATE").otherwise("NEW")
    target = F.when(label == "NEW", "").when(hash_int(F.concat(F.lit("t"), "case_id")) % 3 == 0, F.concat(F.lit("d"), "case_id", F.lit("|e"), "case_id")).otherwise(F.concat(F.lit("d"), "case_id"))
    note = hash_int(F.concat(F.lit("n"), "case_id")) % 4
    notes = F.when(note == 0, "template_trap | looks like the older one of that kind").when(note == 1, "reworded").when(note == 2, "unsure translation | the same text in another language").otherwise("short")
    pool = F.element_at(F.array(*map(F.lit, ("title", "semantic", "random"))), (hash_int(F.concat(F.lit("p"), "case_id")) % 3 + 1).cast("int"))
    kind = F.when(hash_int(F.concat(F.lit("k"), "case_id")) % 4 == 0, "attachment-pdf").otherwise("bulletin-md")
    return rows.select("case_id", "pos", label.alias("gold_label"), target.alias("gold_target"), notes.alias("notes"), pool.alias("pool"), kind.alias("kind"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """gold with method, label, target: six of ten answers have the right label."""
    rows = gold(spark, d).withColumn("method", F.explode(F.array(*map(F.lit, METHODS))))
    h = hash_int(F.concat_ws(":", "case_id", "method")) % 10
    label = F.when((h < 6), F.col("gold_label")).otherwise(F.element_at(F.array(*map(F.lit, LABELS)), (h % 3 + 1).cast("int")))
    label = F.when(F.col("method") == METHODS[0], "UPDATE").otherwise(label)
    target = F.when((label == "NEW") | (F.col("method") == METHODS[0]), None).when(h < 4, F.concat(F.lit("d"), "case_id")).otherwise("d0")
    return rows.withColumns({"label": label, "target": target})


def h(x: str) -> str:
    """hash_int() in SQL."""
    return f"(('0x' || substr(md5({x}), 1, 8))::bigint)"


TEXT_SQL = r"regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
LIB_SQL = rf"""
lib0 as (select doc_id, {TEXT_SQL} as t from documents),
lib1 as (select doc_id, t, split_part(t, chr(10), 1) as l from lib0),
lib2 as (select cast(doc_id as varchar) as doc_id, regexp_replace(l, '^#+\s*', '') as title, regexp_replace(substr(t, length(l) + 2), '^\s+', '') as text,
                strftime(date '2015-01-01' + cast(doc_id // 4 as integer), '%Y-%m-%d') as date from lib1),
lib as (select *, date || '|' || doc_id as pos from lib2 where title <> '' or text <> '')"""
CASE_SQL = rf"""
case0 as (select item_id, {TEXT_SQL} as t from benchmark),
case1 as (select item_id, t, split_part(t, chr(10), 1) as l from case0),
cases as (select 'b-' || item_id as case_id, regexp_replace(l, '^#+\s*', '') as case_title, regexp_replace(substr(t, length(l) + 2), '^\s+', '') as case_text, strftime(date '2015-01-01' + cast({h("'d' || item_id")} % ({SPANS!r}[{h("'s' || item_id")} % 3 + 1]) as integer), '%Y-%m-%d') as case_date from case1)"""
GOLD_SQL = f"""
gold0 as (select doc_id as pos, cast(doc_id as varchar) as case_id, case when toxic = 1 then 'REDUNDANT' when quality = 1 then 'UPDATE' else 'NEW' end as gold_label from labels),
gold as (select case_id, pos, gold_label,
    case when gold_label = 'NEW' then '' when {h("'t' || case_id")} % 3 = 0 then 'd' || case_id || '|e' || case_id else 'd' || case_id end as gold_target,
    case {h("'n' || case_id")} % 4 when 0 then 'template_trap | looks like the older one of that kind' when 1 then 'reworded' when 2 then 'unsure translation | the same text in another language' else 'short' end as notes,
    ['title', 'semantic', 'random'][{h("'p' || case_id")} % 3 + 1] as pool,
    case when {h("'k' || case_id")} % 4 = 0 then 'attachment-pdf' else 'bulletin-md' end as kind from gold0)"""
ANSWER_SQL = f"""{GOLD_SQL},
ans0 as (select *, {h("case_id || ':' || method")} % 10 as h from gold, (select unnest({METHODS!r}) as method)),
ans1 as (select *, case when method = '{METHODS[0]}' then 'UPDATE' when h < 6 then gold_label else {LABELS!r}[h % 3 + 1] end as label from ans0),
ans as (select *, case when label = 'NEW' or method = '{METHODS[0]}' then null when h < 4 then 'd' || case_id else 'd0' end as target from ans1),
scored as (select *, coalesce(list_contains(string_split(gold_target, '|'), target), false) as hit from ans),
judged as (select *, gold_label = label and (label <> 'UPDATE' or hit) as correct,
    case when gold_label = label and label <> 'UPDATE' then 'correct_' || lower(label) when gold_label = label and hit then 'correct_update' when gold_label = label then 'wrong_target'
         when label = 'UPDATE' and gold_label = 'NEW' then 'false_update' when gold_label = 'UPDATE' then 'missed_update' else 'other' end as outcome from scored)"""


def f1_sql(x: str, gold: str = "gold_label", pred: str = "label") -> str:
    hit = f"count(*) filter ({gold} = '{x}' and {pred} = '{x}')"
    return f"coalesce(2.0 * {hit} / nullif(count(*) filter ({gold} = '{x}') + count(*) filter ({pred} = '{x}'), 0), 0)"


def macro_sql(gold: str = "gold_label", pred: str = "label") -> str:
    return "(" + " + ".join(f1_sql(x, gold, pred) for x in LABELS) + ") / 3"
