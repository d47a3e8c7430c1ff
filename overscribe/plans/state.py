"""The library's log, made from events, and the upsert of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk
from ..operators import library as lib
from ..schemas import REDUNDANT, UPDATE
from .common import LIB_SQL, h, library, query, table


def events(spark: SparkSession, d: str) -> DataFrame:
    """Signups add a document of one of their user's five batches, purchases replace one, errors undo a batch; some batches stay."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    action = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "purchase", "replace").when(F.col("event_type") == "error", "undo")
    doc_id = F.concat(F.lit("file-"), F.col("user_id").cast("string"))
    rows = e.select(F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string")).alias("batch"), doc_id.alias("_d"), k.alias("_k")).where("action is not null")
    return rows.select(
        "seq", "action", "batch",
        F.when(F.col("action") == "add", F.struct(F.col("_d").alias("doc_id"), F.lit("your_file").alias("source"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("title"), F.lit("2020-01-01").alias("date"), F.lit("x").alias("text"))).alias("doc"),
        F.when(F.col("action") == "replace", F.coalesce(F.col("_k"), F.lit(0)).cast("string")).alias("target"),
        F.when(F.col("action") == "replace", F.col("_d")).alias("by"),
        F.when(F.col("action") == "undo", F.array("_d")).alias("doc_ids"),
    )


EVENT_SQL = """ev as (select event_id as seq, case event_type when 'signup' then 'add' when 'purchase' then 'replace' when 'error' then 'undo' end as action, 'b' || user_id || '-' || event_id % 5 as batch, 'file-' || user_id as d,
    cast(coalesce(cast(json_extract(props, '$.k') as bigint), 0) as varchar) as k from events where event_type in ('signup', 'purchase', 'error')),
adds as (select * from ev a where action = 'add' and not exists (select 1 from ev u where u.action = 'undo' and u.batch = a.batch and u.seq > a.seq)),
lastrep as (select k as target, arg_max(d, seq) as d_by, max(seq) as s from ev where action = 'replace' group by k),
rep as (select * from lastrep r where not exists (select 1 from ev u where u.action = 'undo' and u.d = r.d_by and u.seq > r.s))"""


@query(f"with {LIB_SQL}, {EVENT_SQL}, al as (select doc_id, title, date from lib union all select d, 't' || seq, '2020-01-01' from adds) select doc_id, title, date, d_by as replaced_by from al left join rep on target = doc_id")
def u06_replay(spark: SparkSession, d: str) -> DataFrame:
    return lib.replay(library(spark, d), events(spark, d)).select("doc_id", "title", "date", "replaced_by")


@query(f"with {LIB_SQL}, {EVENT_SQL} select doc_id from lib where doc_id not in (select target from rep)")
def j02_not_replaced(spark: SparkSession, d: str) -> DataFrame:
    _, replaced = lib.live(events(spark, d))
    return library(spark, d).join(replaced, "doc_id", "left_anti").select("doc_id")


@query(f"with {EVENT_SQL} select seq, batch, case action when 'add' then 'added ' || d || '  t' || seq when 'replace' then 'replaced ' || k || ' by ' || d else 'undid ' || batch end as line from ev")
def u05_history(spark: SparkSession, d: str) -> DataFrame:
    return lib.history(events(spark, d))


@query(f"with {EVENT_SQL}, l as (select batch, max(seq) as s, list_sort(list(d)) as ids from ev where action = 'add' and batch not in (select batch from ev where action = 'undo') group by batch) select batch, array_to_string(ids, ',') as doc_ids from l order by s desc limit 1")
def w09_last_batch(spark: SparkSession, d: str) -> DataFrame:
    return lib.undo_last(events(spark, d), 0).select("batch", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(
    f"""with {LIB_SQL}, dec as (select *, cast(doc_id as bigint) as seq, {h("'a' || doc_id")} % 3 as k, 'file-' || substr(md5(title || chr(10) || text), 1, 8) as fid from lib),
known as (select distinct fid from dec where {h("'z' || fid")} % 5 = 0), ok as (select * from dec where k <> 2 and fid not in (select fid from known))
select 2 * seq as seq, 'add' as action, fid as doc_id, null as target, null as by from ok union all select 2 * seq + 1, 'replace', null, 'd' || doc_id, fid from ok where k = 0"""
)
def u03_apply(spark: SparkSession, d: str) -> DataFrame:
    """Decisions made up for all documents, applied to a library that has a fifth of the texts already."""
    from ..functions import text as tx
    from ..operators.stats import hash_int

    k = hash_int(F.concat(F.lit("a"), "doc_id")) % 3
    label = F.when(k == 0, UPDATE).when(k == 1, "NEW").otherwise(REDUNDANT)
    rows = library(spark, d).select("title", "text", "date", F.concat(F.lit("d"), "doc_id").alias("target"), label.alias("label"), F.lit("b").alias("batch"), F.col("doc_id").cast("long").alias("seq"))
    ids = rows.select(tx.file_doc_id("title", "text").alias("doc_id")).distinct()
    known = ids.where(hash_int(F.concat(F.lit("z"), "doc_id")) % 5 == 0)
    return lib.change_events(rows, known).select("seq", "action", F.col("doc.doc_id").alias("doc_id"), "target", "by")


@query(
    """with c as (select doc_id, i, substr(text, i * 800 + 1, 800) as part from documents, unnest(range(0, cast(ceil(length(text) / 800.0) as bigint))) as t(i) where length(text) > 0),
n as (select doc_id, i, substr(substr(text, 1, length(text) // 2), i * 800 + 1, 800) as part from documents, unnest(range(0, cast(ceil((length(text) // 2) / 800.0) as bigint))) as t(i) where length(text) // 2 > 0),
u as (select * from n union all select * from c where (doc_id, i) not in (select (doc_id, i) from n)) select doc_id, cast(i as integer) as idx, md5(part) as part_key from u"""
)
def u02_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All documents, in parts of 800 characters, then a version of each that is half as long: its old tail stays."""

    def parts(text) -> DataFrame:
        rows = table(spark, d, "documents").select("doc_id", text.alias("t")).where(F.length("t") > 0)
        rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.ceil(F.length("t") / 800.0).cast("int") - 1)))
        return rows.select("doc_id", "idx", F.expr("substring(t, idx * 800 + 1, 800)").alias("part"))

    old, new = parts(F.col("text")), parts(F.expr("substring(text, 1, cast(length(text) div 2 as int))"))
    return chunk.upsert(old, new, ["doc_id", "idx"]).select("doc_id", "idx", F.md5("part").alias("part_key"))


@query(f"with {LIB_SQL}, {EVENT_SQL} select count(*) as documents, count(*) filter (target is not null) as replaced from (select doc_id from lib union all select d from adds) al left join rep on target = al.doc_id")
def a20_sizes(spark: SparkSession, d: str) -> DataFrame:
    return lib.replay(library(spark, d), events(spark, d)).agg(F.count("*").alias("documents"), F.count("replaced_by").alias("replaced"))


@query(f"with {LIB_SQL} select doc_id, date from lib order by date, doc_id")
def o01_sorted(spark: SparkSession, d: str) -> DataFrame:
    return library(spark, d).orderBy("date", "doc_id").select("doc_id", "date")


@query(f"with {LIB_SQL} select doc_id, title, date from lib where contains(lower(title), 'the') order by date desc, doc_id desc limit 15")
def t29_search(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifteen titles with a word in them."""
    return library(spark, d).where(F.lower("title").contains("the")).orderBy(F.desc("date"), F.desc("doc_id")).limit(15).select("doc_id", "title", "date")
