"""The library, its joins, and retrieval by words, vectors and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import blocks, chunk, dense, judge, lexical, methods, router, sampling, signals, vector_index
from ..operators.library import with_kb_size
from ..operators.ranks import place
from ..operators.stats import hash_int
from ..schemas import RouterConfig
from ..sources.scratch import written
from .common import CASE_SQL, GOLD_SQL, LIB_SQL, cases, gold, h, library, query, table

#: Every fiftieth vector is a query, against all.
QUERY_EVERY = 50
#: Vectors of each order that may be among the first ten when three are fused.
DEEP = 150
#: Cells of the vector index.
CELLS = 32
#: Thresholds that the untuned BM25 method takes.
T_UPD, T_RED = 0.35, 0.95

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
BM25_SQL = f"""{LIB_SQL}, {CASE_SQL},
tok0 as materialized (select doc_id, {_TOKENS.format("title || chr(10) || text")} as w from lib),
tok as (select doc_id, len(w) as dl, unnest(w) as term from tok0),
stat as materialized (select count(*) as n, avg(len(w)) as avg from tok0),
tf as materialized (select doc_id, term, any_value(dl) as dl, count(*) as tf from tok group by doc_id, term),
idf as materialized (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf, any_value(avg) as avg from tf, stat group by term, n),
post as (select doc_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)) as weight from tf join idf using (term)),
qtok0 as materialized (select case_id, {_TOKENS.format("case_title || chr(10) || case_text")} as w from cases),
qtok as (select case_id, len(w) as ql, unnest(w) as term from qtok0),
qtf as materialized (select case_id, term, any_value(ql) as ql, count(*) as tf from qtok group by case_id, term),
own as (select case_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ql / avg))) as own from qtf join idf using (term) group by case_id),
bm as (select case_id, doc_id, round(sum(weight) / any_value(case when own = 0 then 1 else own end), 6) as bm25 from qtf join post using (term) join own using (case_id) group by case_id, doc_id),
top as materialized (select case_id, lib.doc_id, bm25, row_number() over (partition by case_id order by bm25 desc, pos) as rank from bm join lib on lib.doc_id = bm.doc_id join cases using (case_id) where lib.date < case_date)"""


def bm25_top(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """case_id, doc_id, pos, bm25, rank."""
    return signals.bm25(cases(spark, d), library(spark, d), k)


@query(f"with {LIB_SQL} select doc_id, date, md5(title || chr(10) || text) as text_key from lib")
def s01_library(spark: SparkSession, d: str) -> DataFrame:
    return library(spark, d).select("doc_id", "date", F.md5(tx.doc_text("title", "text")).alias("text_key"))


@query(f"with {LIB_SQL} select doc_id from lib where doc_id in (select cast(doc_id as varchar) from labels) and date >= '2015-01-01'")
def p04_eligible(spark: SparkSession, d: str) -> DataFrame:
    return library(spark, d).where("date >= '2015-01-01'").join(gold(spark, d).select(F.col("case_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id")


@query(
    f"""with {LIB_SQL}, f as (select doc_id, {h("'q' || doc_id")} / 4294967296.0 as title_best, {h("'c' || doc_id")} / 4294967296.0 as cos_best from lib), q as (select round(quantile_cont(cos_best, 0.8), 9) as p from f)
select case when title_best >= 0.9 then 'title' when cos_best >= p then 'semantic' else 'random' end as pool, count(*) as n from f, q group by all"""
)
def p05_pools(spark: SparkSession, d: str) -> DataFrame:
    rows = library(spark, d).select("doc_id", *((hash_int(F.concat(F.lit(c), "doc_id")) / 4294967296.0).alias(n) for c, n in (("q", "title_best"), ("c", "cos_best"))))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.round(sim.quantile("cos_best", 0.8), 9).alias("cos_p80"))))
    return rows.groupBy(sampling.pool_of().alias("pool")).agg(F.count("*").alias("n"))


@query(f"""with {LIB_SQL}, {CASE_SQL}, a as (select length(case_title) as a, count(*) as n from cases group by all), b as (select length(title) as b, count(*) as m from lib group by all)
select cast(a as bigint) as a, cast(b as bigint) as b, n * m as pairs, round(case when a + b = 0 then 1 else 2.0 * least(a, b) / (a + b) end, 6) as bound from a, b""")
def m03_length_bound(spark: SparkSession, d: str) -> DataFrame:
    """The bound that lengths set to the likeness of an incoming and a library title; lengths meet, not titles."""
    a = cases(spark, d).groupBy(F.length("case_title").cast("long").alias("a")).agg(F.count("*").alias("n"))
    b = library(spark, d).groupBy(F.length("title").cast("long").alias("b")).agg(F.count("*").alias("m"))
    bound = F.when(F.col("a") + F.col("b") == 0, 1.0).otherwise(2.0 * F.least("a", "b") / (F.col("a") + F.col("b")))
    return a.join(b, F.lit(True)).select("a", "b", (F.col("n") * F.col("m")).alias("pairs"), F.round(bound, 6).alias("bound"))


@query(
    f"""with {LIB_SQL}, {CASE_SQL}, k as (select distinct {_TOKENS.format("case_title")} as w, case_title as a from cases), t as (select distinct title as b from lib),
p as (select a, b from k, t where 2.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 0.9),
ca as (select a, b, c, count(*) as n from (select a, b, unnest(string_split(a, '')) as c from p) group by all), cb as (select a, b, c, count(*) as n from (select a, b, unnest(string_split(b, '')) as c from p) group by all),
m as (select a, b, sum(least(ca.n, cb.n)) as m from ca join cb using (a, b, c) group by a, b)
select a, b, round(2.0 * coalesce(m, 0) / (length(a) + length(b)), 6) as quick from p left join m using (a, b)"""
)
def m02_quick_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an incoming title and a library title of nearly the same length: multiset overlap of characters."""
    a = cases(spark, d).select(F.col("case_title").alias("a")).distinct()
    b = library(spark, d).select(F.col("title").alias("b")).distinct()
    return signals.quick_ratios(a, b, 0.9).select("a", "b", F.round("quick", 6).alias("quick"))


_KNN_SQL = f"""q as (select vec_id as q_id, embedding as qe, label as ql from embeddings where vec_id % {QUERY_EVERY} = 0),
s as (select q_id, ql, e.vec_id, e.label, list_sum(list_transform(list_zip(qe, e.embedding), lambda x: x[1]::double * x[2]::double)) as c from q, embeddings e where e.vec_id <> q_id),
r as (select *, row_number() over (partition by q_id order by round(c, 6) desc, vec_id) as rank from s)"""


def neighbours(spark: SparkSession, d: str, k: int, older: bool = False, every: int = QUERY_EVERY) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id is not null")
    q = e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qe"))
    return dense.knn(q, "q_id", "qe", e, "vec_id", "embedding", k, "older" if older else "other", places=6)


@query(f"with {_KNN_SQL} select q_id, vec_id, round(c, 5) as cosine from r where rank <= 50")
def m05_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, 50).select("q_id", "vec_id", F.round("cosine", 5).alias("cosine"))


@query(f"with {_KNN_SQL.replace(f' where vec_id % {QUERY_EVERY} = 0', '')} select q_id, vec_id, cast(rank as integer) as rank from r where rank <= 5")
def j08_knn(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest ones of every vector."""
    return neighbours(spark, d, 5, every=1).select("q_id", "vec_id", "rank")


@query()
def s17_vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest ones by an inverted file that probes as many cells as a sample says."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = vector_index.build(e, "vec_id", "embedding", CELLS)
    q = e.where(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "q_id")
    probes = index.measured_probes(q, "q_id", "embedding", 5, own=False)
    return index.search(q, "q_id", "embedding", 5, probes, own=False).select("q_id", "vec_id", "rank", F.round("cosine", 5).alias("cosine"))


@query(f"with {BM25_SQL} select term, count(*) as df, round(sum(weight), 4) as weight from post group by term")
def m07_bm25_index(spark: SparkSession, d: str) -> DataFrame:
    terms = lexical.Counted.of(library(spark, d), tx.doc_text("title", "text"), "doc_id").terms()
    return terms.select("term", "df", F.round("weight", 4).alias("weight"))


@query(f"with {BM25_SQL} select case_id, doc_id, bm25 from top where rank <= 10")
def m08_bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return bm25_top(spark, d, 10).select("case_id", "doc_id", "bm25")


@query(
    f"""with {_KNN_SQL}, x as (select q_id, vec_id, row_number() over (partition by q_id order by round(c, 6) desc, vec_id) as a, row_number() over (partition by q_id order by abs(label - ql), vec_id) as b, row_number() over (partition by q_id order by abs(vec_id - q_id), vec_id) as t from s),
f as (select q_id, vec_id, round(1.0 / (60 + a) + 1.0 / (60 + b) + 1.0 / (60 + t), 9) as rrf from x)
select q_id, vec_id, rrf from f qualify row_number() over (partition by q_id order by rrf desc, vec_id) <= 10"""
)
def m10_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Cosine, label and place fused by their ranks, over all vectors for each query.

    Ten vectors have a rank of ten or better by cosine, so 1 / 70 and more;
    what is beyond DEEP in all three orders has less, 3 / (61 + DEEP), and is never among the first ten. Of the others, those
    that can still be have their places counted over all vectors.
    """
    e = written(table(spark, d, "embeddings").select("vec_id", "embedding", "label"), "vectors")
    q = e.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qe"), F.col("label").alias("ql"))
    far = {"l": F.abs(F.col("label") - F.col("ql")), "p": F.abs(F.col("vec_id") - F.col("q_id"))}
    near = dense.knn(q, "q_id", "qe", e, "vec_id", "embedding", DEEP, "other", places=6).select("q_id", "vec_id", F.col("rank").alias("a"))
    # Of each label the lowest ids, and of each row those that are beside it: one more than are wanted, for the query's own.
    lowest = written(dense.top_k(e.select("label", "vec_id"), "label", DEEP + 1, F.col("vec_id")).select("label", "vec_id"), "lowest")
    labels = dense.top_k(lowest.crossJoin(q.select("ql").distinct()), "ql", DEEP + 1, far["l"].asc_nulls_last(), F.col("vec_id"), name="n")
    labels = labels.withColumnRenamed("ql", "_ql").join(q.select("q_id", "ql"), F.col("_ql").eqNullSafe(F.col("ql"))).where("vec_id <> q_id")
    labels = dense.top_k(labels, "q_id", DEEP, F.col("n"), name="b").select("q_id", "vec_id", "b")
    placed = written(place(e.select("vec_id"), [], [F.col("vec_id")]), "places")
    beside = placed.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("q_id"), F.explode(F.sequence(F.col("place") - DEEP, F.col("place") + DEEP)).alias("place"))
    ids = dense.top_k(beside.join(placed, "place").where("vec_id <> q_id"), "q_id", DEEP, far["p"], F.col("vec_id"), name="t").select("q_id", "vec_id", "t")
    few = near.unionByName(labels, allowMissingColumns=True).unionByName(ids, allowMissingColumns=True).groupBy("q_id", "vec_id").agg(*(F.max(c).alias(c) for c in "abt"))
    sums = [sum(F.coalesce(1.0 / (60 + F.col(c)), F.lit(other)) for c in "abt") for other in (0.0, 1.0 / (61 + DEEP))]
    few = written(few.select("q_id", "vec_id", sums[0].alias("low"), sums[1].alias("high")), "few")
    bar = dense.top_k(few, "q_id", 10, F.desc("low")).where("rank = 10").select("q_id", F.col("low").alias("bar"))
    few = few.join(bar, "q_id", "left").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar") - 1e-8)).select("q_id", "vec_id")
    few = few.join(e, "vec_id").join(q, "q_id").select("q_id", F.struct("vec_id", F.round(sim.cosine(F.col("qe"), F.col("embedding")), 6).alias("c"), far["l"].alias("l"), far["p"].alias("p")).alias("x"))
    few = few.groupBy("q_id").agg(F.collect_list("x").alias("few"))  # 3 * DEEP at most
    asked = written(q.join(few, "q_id"), "asked")
    counts = blocks.places(blocks.met(asked, "q_id", "qe", e, "vec_id", "embedding", ("label",), ("ql", "few")), "q_id", "vec_id", 6)
    ranked = counts.groupBy("q_id", "vec_id").agg(*((F.sum(c) + 1).alias(c) for c in "abt"))
    f = dense.fused(ranked, "q_id", "vec_id", ["a", "b", "t"]).withColumn("rrf", F.round("rrf", 9))
    return dense.top_k(f, "q_id", 10, F.desc("rrf"), F.col("vec_id")).select("q_id", "vec_id", "rrf")


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.8), 6) as p80, round(quantile_cont(value, 0.9), 6) as p90 from events group by event_type")
def m11_quantile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(*(F.round(sim.quantile("value", p), 6).alias(n) for p, n in ((0.5, "p50"), (0.8, "p80"), (0.9, "p90"))))


@query(
    f"""with {BM25_SQL}, q as (select unnest(quantile_cont(bm25, [{', '.join(f'{i}/24.0' for i in range(25))}])) as t from top where rank = 1)
select distinct round(round_even(t, 4), 4) as t from q"""
)
def m12_grid(spark: SparkSession, d: str) -> DataFrame:
    return bm25_top(spark, d, 1).agg(sim.grid("bm25").alias("g")).select(F.explode("g").alias("t"))


@query(f"with {LIB_SQL} select d1.date, count(*) filter (d2.date < d1.date) as kb_size from (select distinct date from lib) d1, lib d2 group by d1.date")
def j01_before(spark: SparkSession, d: str) -> DataFrame:
    """For every day what is dated strictly before it, by running sums."""
    docs = library(spark, d)
    return with_kb_size(docs.select("date").distinct(), docs, "date").select("date", "kb_size")


@query(f"with {LIB_SQL}, {GOLD_SQL} select doc_id, title from lib where doc_id in (select case_id from gold where gold_label <> 'NEW')")
def j05_labelled(spark: SparkSession, d: str) -> DataFrame:
    known = gold(spark, d).where("gold_label <> 'NEW'").select(F.col("case_id").alias("doc_id"))
    return library(spark, d).join(known, "doc_id", "left_semi").select("doc_id", "title")


_BODY = r"regexp_replace(regexp_replace(regexp_replace({}, '(19|20)\d{{2}}', '<Y>', 'g'), '1[0-2]\d(\s*年)', '<Y>\1', 'g'), '\s+', '', 'g')"


@query(
    rf"""with {LIB_SQL}, b as (select *, {_BODY.format('text')} as body from lib where text <> ''), g as (select body, min(date) as first from b group by body)
select doc_id, first as first_date from b join g using (body) where first < date"""
)
def j11_identical_body(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose body is older than they are, with the day on which it first appeared. Groups are summed, never paired."""
    b = library(spark, d).select("doc_id", "date", tx.norm_body("text").alias("body")).where("body <> ''").select("doc_id", "date", F.md5("body").alias("k"))
    b = b.repartition("k")  # once for both uses: the shuffle is reused, and bodies are normalised once
    first = b.groupBy("k").agg(F.min("date").alias("first_date"))
    return b.join(first, "k").where("first_date < date").select("doc_id", "first_date")


@query(
    """with c as (select source, c, count(*) as n from (select source, unnest(string_split(lower(coalesce(text, '')), '')) as c from documents) where c <> '' group by all), t as (select source, sum(n) as t from c group by source),
m as (select a.source as a, b.source as b, sum(least(a.n, b.n)) as m from c a join c b on a.c = b.c group by all)
select m.a, m.b, round(2.0 * m / (x.t + y.t), 6) as quick from m join t x on x.source = m.a join t y on y.source = m.b"""
)
def j12_edition_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All sources against each other, by the multisets of their characters: characters are counted first."""
    chars = table(spark, d, "documents").select("source", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "")).alias("c")).where("c <> ''")
    c = chars.groupBy("source", "c").agg(F.count("*").alias("n"))
    t = c.groupBy("source").agg(F.sum("n").alias("t"))
    x, y = c.toDF("a", "c", "na"), c.toDF("b", "c", "nb")
    m = x.join(y, "c").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("m"))
    m = m.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b")
    return m.select("a", "b", F.round(2.0 * F.col("m") / (F.col("ta") + F.col("tb")), 6).alias("quick"))


@query("select md5(text) as key, count(*) as n from documents where text is not null and md5(text) not in (select md5(text) from benchmark) group by all")
def j15_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    """Texts that no recorded one has, by their key."""
    from ..operators.judge import misses

    texts = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("key"))
    return misses(texts, table(spark, d, "benchmark").select(F.md5("text").alias("key"))).groupBy("key").agg(F.count("*").alias("n"))


@query(f"with {BM25_SQL} select case_id, doc_id, cast(rank as integer) as rank from top where rank <= 5")
def w01_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25_top(spark, d, 5).select("case_id", "doc_id", "rank")


@query(
    f"""with {BM25_SQL}, n as (select case_id, doc_id, row_number() over (partition by case_id order by length(title), pos) as rank from cases, lib where length(title) >= length(case_title) and lib.date < case_date),
u as (select case_id, doc_id from top where rank <= 5 union select case_id, doc_id from n where rank <= 5)
select u.case_id, u.doc_id, cast(row_number() over (partition by case_id order by date desc, pos) as integer) as place from u join lib using (doc_id)"""
)
def w12_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best five by words and the five shortest titles that are not shorter, once each, newest first."""
    from pyspark.sql import Window

    docs, c = library(spark, d), cases(spark, d)
    a = bm25_top(spark, d, 5).select("case_id", "doc_id")
    asked = c.select(F.length("case_title").alias("n"), "case_date").distinct()
    # Lengths and days, not cases, meet the titles.
    found = docs.select("doc_id", "pos", "date", F.length("title").alias("len")).join(asked, (F.col("len") >= F.col("n")) & (F.col("date") < F.col("case_date")))
    by_length = dense.top_k(found, ["n", "case_date"], 5, F.col("len"), F.col("pos"))
    b = c.select("case_id", "case_date", F.length("case_title").alias("n")).join(by_length.select("n", "case_date", "doc_id"), ["n", "case_date"]).select("case_id", "doc_id")
    rows = a.union(b).distinct().join(docs.select("doc_id", "date", "pos"), "doc_id")
    return rows.select("case_id", "doc_id", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("date"), "pos")).alias("place"))


def gold_of_cases(c: DataFrame) -> DataFrame:
    """case_id, gold_label of incoming passages, made up, and the split."""
    rows = c.select("case_id", F.element_at(F.array(*map(F.lit, ("UPDATE", "NEW", "REDUNDANT", "NEW"))), (hash_int(F.concat(F.lit("g"), "case_id")) % 4 + 1).cast("int")).alias("gold_label"))
    return sampling.stratified_split(rows, "case_id")


CASE_GOLD_SQL = f"""cg0 as (select case_id, ['UPDATE', 'NEW', 'REDUNDANT', 'NEW'][{h("'g' || case_id")} % 4 + 1] as gold_label from cases),
cg as (select case_id, gold_label, case when row_number() over (partition by gold_label order by md5('13:' || case_id), case_id) <= round_even(0.4 * count(*) over (partition by gold_label), 0) then 'dev' else 'test' end as split from cg0),
best as (select case_id, doc_id, bm25 as score from top where rank = 1)"""


def _f1(gold_label: str, pred: str) -> str:
    return "(" + " + ".join(f"coalesce(2.0 * count(*) filter ({gold_label} = '{x}' and {pred} = '{x}') / nullif(count(*) filter ({gold_label} = '{x}') + count(*) filter ({pred} = '{x}'), 0), 0)" for x in ("UPDATE", "NEW", "REDUNDANT")) + ") / 3"


TUNE_SQL = f"""{CASE_GOLD_SQL},
dev as (select gold_label, score from cg left join best using (case_id) where split = 'dev'),
gr as (select distinct round_even(t, 4) as t from (select unnest(quantile_cont(score, [{', '.join(f'{i}/24.0' for i in range(25))}])) as t from dev)),
grid as (select a.t as t_upd, b.t as t_red from gr a, (select t from gr union all select 9e9) b where b.t >= a.t),
tried as (select t_upd, t_red, round({_f1('gold_label', 'label')}, 9) as macro_f1
          from (select t_upd, t_red, gold_label, case when score is null or score < t_upd then 'NEW' when score >= t_red then 'REDUNDANT' else 'UPDATE' end as label from dev, grid) group by t_upd, t_red),
par as (select t_upd, t_red from tried order by macro_f1 desc, t_upd, t_red limit 1)"""


def bm25_tops(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    best = bm25_top(spark, d, 1).select("case_id", "doc_id", F.col("bm25").alias("score"))
    return gold_of_cases(c).join(best, "case_id", "left")


@query(f"with {BM25_SQL}, {TUNE_SQL} select t_upd, t_red, macro_f1 from tried")
def j18_grid(spark: SparkSession, d: str) -> DataFrame:
    return methods.tune_thresholds(bm25_tops(spark, d).where("split = 'dev'")).select("t_upd", "t_red", "macro_f1")


@query(f"with {BM25_SQL}, {TUNE_SQL} select case_id, case when score is null or score < t_upd then 'NEW' when score >= t_red then 'REDUNDANT' else 'UPDATE' end as label, case when score >= t_upd then doc_id end as target from cg left join best using (case_id), par where split = 'test'")
def d03_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 method, tuned on development cases and applied to the others."""
    tops = bm25_tops(spark, d)
    par = methods.best_parameters(methods.tune_thresholds(tops.where("split = 'dev'")), "t_upd", "t_red")
    return methods.predict_threshold(tops.where("split = 'test'"), par).select("case_id", "label", "target")


@query(f"with {BM25_SQL} select case_id, case when bm25 is null or bm25 < {T_UPD} then 'NEW' when bm25 >= {T_RED} then 'REDUNDANT' else 'UPDATE' end as label, case when bm25 >= {T_UPD} then doc_id end as target, coalesce(bm25, 0) as score from cases left join (select * from top where rank = 1) using (case_id)")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """For each incoming passage: which earlier document it repeats or supersedes, if any."""
    best = bm25_top(spark, d, 1).select("case_id", "doc_id", F.col("bm25").alias("score"))
    rows = cases(spark, d).select("case_id").join(best, "case_id", "left")
    label = methods.threshold_label(F.col("score"), F.lit(T_UPD), F.lit(T_RED))
    return rows.select("case_id", label.alias("label"), F.when(label != "NEW", F.col("doc_id")).alias("target"), F.coalesce("score", F.lit(0.0)).alias("score"))


@query(
    f"""with {_KNN_SQL}, older as (select q_id, vec_id, round(c, 6) as c from s where vec_id < q_id), b as (select q_id, vec_id, c as score from older qualify row_number() over (partition by q_id order by c desc, vec_id) = 1),
k as (select q_id as case_id, score, vec_id, ['UPDATE', 'NEW', 'REDUNDANT', 'NEW'][{h("'g' || q_id")} % 4 + 1] as gold_label from q left join b using (q_id)),
gr as (select distinct round_even(t, 4) as t from (select unnest(quantile_cont(score, [{', '.join(f'{i}/24.0' for i in range(25))}])) as t from k)),
grid as (select a.t as t_upd, b.t as t_red from gr a, (select t from gr union all select 9e9) b where b.t >= a.t),
tried as (select t_upd, t_red, round({_f1('gold_label', 'label')}, 9) as macro_f1 from (select t_upd, t_red, gold_label, case when score is null or score < t_upd then 'NEW' when score >= t_red then 'REDUNDANT' else 'UPDATE' end as label from k, grid) group by t_upd, t_red),
par as (select t_upd, t_red from tried order by macro_f1 desc, t_upd, t_red limit 1)
select case_id, case when score is null or score < t_upd then 'NEW' when score >= t_red then 'REDUNDANT' else 'UPDATE' end as label, case when score >= t_upd then vec_id end as target from k, par"""
)
def d02_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The cosine method over vectors in the order of their ids: each query against what is older."""
    near = neighbours(spark, d, 1, older=True)
    best = near.select(F.col("q_id").alias("case_id"), F.col("vec_id").alias("doc_id"), F.round("cosine", 6).alias("score"), F.col("vec_id").alias("pos"))
    best = methods.best_document(best, "score")
    e = table(spark, d, "embeddings").where(F.col("vec_id") % QUERY_EVERY == 0)
    g = e.select(F.col("vec_id").alias("case_id"), F.element_at(F.array(*map(F.lit, ("UPDATE", "NEW", "REDUNDANT", "NEW"))), (hash_int(F.concat(F.lit("g"), F.col("vec_id").cast("string"))) % 4 + 1).cast("int")).alias("gold_label"))
    tops = g.join(best, "case_id", "left")
    par = methods.best_parameters(methods.tune_thresholds(tops), "t_upd", "t_red")
    return methods.predict_threshold(tops, par).select("case_id", "label", "target")


@query(f"with {BM25_SQL}, {CASE_GOLD_SQL}, c as (select score, avg((gold_label = 'NEW')::int) over (order by score, gold_label rows unbounded preceding) as share from cg join best using (case_id) where split = 'dev') select round(max(score) filter (share >= 0.9) + 1e-9, 9) as t_new from c")
def w04_cascade_cut(spark: SparkSession, d: str) -> DataFrame:
    return methods.new_cut(bm25_tops(spark, d).where("split = 'dev'")).select(F.round("t_new", 9).alias("t_new"))


@query(
    rf"""with {BM25_SQL}, {CASE_GOLD_SQL}, c as (select score, avg((gold_label = 'NEW')::int) over (order by score, gold_label rows unbounded preceding) as share from cg join best using (case_id) where split = 'dev'),
cut as (select max(score) filter (share >= 0.9) + 1e-9 as t_new from c), kb as (select case_id, count(*) filter (lib.date < case_date) as n from cases, lib group by case_id),
tw as (select case_id, arg_min(doc_id, (translate(date, '0123456789', '9876543210'), pos)) as twin from cases join lib on {_BODY.format('text')} = {_BODY.format('case_text')} and case_text <> '' and lib.date < case_date group by case_id),
r as (select case_id, twin, case when n = 0 then 'NEW' when twin is not null then 'REDUNDANT' when coalesce(score, 0) < t_new then 'NEW' end as label from cases left join tw using (case_id) left join best using (case_id) join kb using (case_id), cut)
select case_id, label, case when label = 'REDUNDANT' then twin end as target, label is null as escalated from r"""
)
def d08_cascade_rule(spark: SparkSession, d: str) -> DataFrame:
    c, docs = cases(spark, d), library(spark, d)
    tops = bm25_tops(spark, d)
    cut = methods.new_cut(tops.where("split = 'dev'"))
    return methods.cascade_rule(c, signals.kb_sizes(c, docs), signals.identical(c, docs), tops, cut)


@query(
    f"""with {BM25_SQL}, g as (select case_id, unnest([doc_id, 'x' || doc_id]) as doc_id from top where rank = {h("'r' || case_id")} % 12 + 1), b as (select g.case_id, min(rank) as best from g join top on top.case_id = g.case_id and top.doc_id = g.doc_id and rank <= 10 group by all),
k as (select distinct g.case_id, best from g left join b using (case_id))
select count(*) as n, round(avg(coalesce(best <= 1, false)::int), 6) as hit_1, round(avg(coalesce(best <= 5, false)::int), 6) as hit_5, round(avg(coalesce(best <= 10, false)::int), 6) as hit_10 from k"""
)
def a14_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Targets made from a document at some rank up to 12: how many the first 1, 5 and 10 hold."""
    from ..operators.metrics import hit_at_k

    ranked = bm25_top(spark, d, 12)
    g = ranked.where(F.col("rank") == hash_int(F.concat(F.lit("r"), "case_id")) % 12 + 1).select("case_id", F.array("doc_id", F.concat(F.lit("x"), "doc_id")).alias("targets"))
    out = hit_at_k(ranked.where("rank <= 10"), g)
    return out.select("n", *(F.round(f"hit_{k}", 6).alias(f"hit_{k}") for k in (1, 5, 10)))


@query()
def m01_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Incoming titles against library titles that could be half alike."""
    return signals.title_pairs(cases(spark, d), library(spark, d)).select("case_id", "doc_id", F.round("title_sim", 6).alias("title_sim"))


@query()
def j10_title_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The feature that pools are made by: documents whose title is that of an older one, or nearly."""
    return signals.best_older_title(library(spark, d), 0.9).select("doc_id", F.round("title_best", 6).alias("title_best"))


@query()
def m04_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each incoming passage its three best documents hold."""
    docs = library(spark, d)
    few = bm25_top(spark, d, 3).join(docs.select("doc_id", "text"), "doc_id")
    corpus = few.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("corpus"))
    rows = cases(spark, d).join(corpus, "case_id", "left")
    cover = sim.coverage(tx.norm_section(tx.doc_text("case_title", "case_text")), tx.norm_section(F.coalesce("corpus", F.lit(""))))
    return rows.select("case_id", F.round(cover, 6).alias("coverage"))


@query()
def d01_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The title method, tuned on development cases and applied to the others."""
    from ..operators.metrics import macro_f1

    c, docs = cases(spark, d), library(spark, d)
    same, titles = signals.identical(c, docs), signals.title_pairs(c, docs)
    # The latest match of each threshold is all whose body is ever looked at.
    grid = methods.title_grid(spark)
    latest = titles.crossJoin(F.broadcast(grid.select("t_title").distinct())).where("title_sim >= t_title")
    latest = latest.groupBy("case_id", "t_title").agg(F.min_by("doc_id", F.struct(methods._down("date"), -F.col("title_sim"), F.col("pos"))).alias("doc_id"))
    bodies = signals.body_similarity(latest, c, docs)
    decided = methods.decide_by_title(c, same, titles, bodies, grid).join(F.broadcast(grid), "i").join(gold_of_cases(c), "case_id")
    dev = decided.where("split = 'dev'").groupBy("i", "t_title", "t_body").agg(F.round(macro_f1(), 9).alias("macro_f1"))
    best = methods.best_parameters(dev, "i")
    return decided.where("split = 'test'").join(F.broadcast(best.select("i")), "i").select("case_id", "label", "target")


@query()
def d04_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The reranker method over the best ten, with a stand-in for the reranker."""
    docs, c = library(spark, d), cases(spark, d)
    few = bm25_top(spark, d, signals.SHORTLIST).select("case_id", "doc_id", F.col("rank").alias("pos"))
    few = few.join(c, "case_id").join(docs.select("doc_id", "title", "text"), "doc_id")
    scored = few.select("case_id", "doc_id", "pos", F.round(dense.rerank(tx.doc_text("case_title", "case_text"), tx.doc_text("title", "text")), 6).alias("score"))
    tops = gold_of_cases(c).join(methods.best_document(scored, "score"), "case_id", "left")
    par = methods.best_parameters(methods.tune_thresholds(tops.where("split = 'dev'")), "t_upd", "t_red")
    return methods.predict_threshold(tops.where("split = 'test'"), par).select("case_id", "label", "target")


@query()
def k14_related(spark: SparkSession, d: str) -> DataFrame:
    """The ten older documents that each incoming passage is listed with."""
    return signals.related(cases(spark, d), library(spark, d)).select("case_id", "place", "doc_id", "date", F.round("rrf", 9).alias("rrf"))


def _routed(spark: SparkSession, d: str, config: RouterConfig) -> tuple[DataFrame, DataFrame]:
    store = router.store_of(table(spark, d, "documents"))
    incoming = table(spark, d, "benchmark").select(F.concat(F.lit("b-"), F.col("item_id").cast("string")).alias("item"), "text")
    return router.route(incoming, "item", store, config)


@query()
def d09_router(spark: SparkSession, d: str) -> DataFrame:
    """Incoming passages routed against the sections of all documents."""
    return _routed(spark, d, RouterConfig.app())[0]


@query()
def d10_router_proto(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d, RouterConfig.prototype())[0]


@query()
def w10_matches(spark: SparkSession, d: str) -> DataFrame:
    """The best sections that the passages' own sections found."""
    config = RouterConfig.app()
    return router.matches(_routed(spark, d, config)[1], config)


@query()
def k13_response(spark: SparkSession, d: str) -> DataFrame:
    """Each passage's verdict with its best matches, as it is answered to whoever sent it."""
    config = RouterConfig.app()
    decided, report = _routed(spark, d, config)
    return router.response(decided, router.matches(report, config))


@query()
def d11_change_request(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked about the first revised sections of each passage."""
    return judge.change_request(_routed(spark, d, RouterConfig.prototype())[1])


@query()
def t14_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every document's sections, by their keys."""
    rows = chunk.with_point_id(chunk.sections(table(spark, d, "documents").withColumn("source_file", F.col("doc_id").cast("string")), "source_file"))
    return rows.select("source_file", "idx", "id", F.md5("content").alias("content_key"))
