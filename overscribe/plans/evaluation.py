"""Metrics, significance and sampling over answers made from the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judge, metrics, report, sampling, stats
from ..operators.stats import hash_int
from ..schemas import LABELS
from ..sources.readers import best_runs, gold_rows
from .common import ANSWER_SQL, GOLD_SQL, METHODS, answers, f1_sql, gold, h, macro_sql, query, table

#: Replicates by rows, which SQL can repeat, and by cells.
REPLICATES, MANY = 50, 10_000


@query(f"with {GOLD_SQL} select case_id, gold_label, gold_target, cast(len(string_split(gold_target, '|')) as bigint) as n_targets from gold")
def s02_gold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows read twice over, with labels that want trimming: the last one of each case stays."""
    rows = gold(spark, d).withColumn("annotator", F.lit("a"))
    messy = rows.withColumn("gold_label", F.concat(F.lit(" "), F.lower("gold_label"))).withColumn("at", F.lit(1))
    older = rows.withColumn("gold_target", F.lit("old")).withColumn("at", F.lit(0))
    empty = rows.withColumn("gold_label", F.lit("")).withColumn("at", F.lit(2))
    out = gold_rows(messy.unionByName(older).unionByName(empty), "at")
    return out.select("case_id", "gold_label", "gold_target", F.size("targets").cast("long").alias("n_targets"))


@query(f"with {GOLD_SQL} select pool, " + ", ".join(f"count(*) filter (gold_label = '{x}') as {x.lower()}" for x in LABELS) + " from gold group by pool")
def a01_class_dist(spark: SparkSession, d: str) -> DataFrame:
    rows = gold(spark, d).groupBy("pool").pivot("gold_label", LABELS).count()
    return rows.select("pool", *(F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x.lower()) for x in LABELS))


@query(f"with {ANSWER_SQL}, l as (select unnest({LABELS!r}) as x) select method, g.x as gold, p.x as predicted, count(*) filter (gold_label = g.x and label = p.x) as n from ans, l g, l p group by all")
def a05_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(answers(spark, d), "method")


@query(
    f"with {ANSWER_SQL} "
    + " union all ".join(
        f"select method, '{x}' as class, round(coalesce(count(*) filter (gold_label = '{x}' and label = '{x}') / nullif(count(*) filter (label = '{x}'), 0)::double, 0), 6) as precision, "
        f"round(coalesce(count(*) filter (gold_label = '{x}' and label = '{x}') / nullif(count(*) filter (gold_label = '{x}'), 0)::double, 0), 6) as recall, round({f1_sql(x)}, 6) as f1, count(*) filter (gold_label = '{x}') as support from ans group by method"
        for x in LABELS
    )
)
def a06_per_class(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_class(answers(spark, d), "method").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"with {ANSWER_SQL} select method, round({macro_sql()}, 6) as macro_f1 from ans group by method")
def a07_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).groupBy("method").agg(F.round(metrics.macro_f1(), 6).alias("macro_f1"))


@query(
    f"""with {ANSWER_SQL}, u as (select *, label = 'UPDATE' as said from scored where gold_label = 'UPDATE')
select method, count(*) as n, round(count(*) filter (said and hit) / nullif(count(*) filter (said), 0)::double, 6) as conditional, round(count(*) filter (said and hit) / count(*)::double, 6) as joint from u group by method"""
)
def a08_target_acc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.target_accuracy(answers(spark, d), "method").withColumns({c: F.round(c, 6) for c in ("conditional", "joint")})


@query(f"with {ANSWER_SQL} select method, count(*) as n, round(avg((gold_label = label)::int), 6) as right_label, round(avg(correct::int), 6) as correct, round({macro_sql()}, 6) as macro_f1 from judged group by method")
def a09_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(answers(spark, d), "method").withColumns({c: F.round(c, 6) for c in ("right_label", "correct", "macro_f1")})


_KINDS = ["false_update", "missed_update", "wrong_target", "other"]


@query(
    f"with {ANSWER_SQL}, c as (select method, "
    + ", ".join(f"count(*) filter (outcome = '{x}') as {x}" for x in ["correct_update", "correct_new", "correct_redundant", *_KINDS])
    + ", count(*) as n from judged group by method) select *, case when greatest("
    + ", ".join(_KINDS)
    + ") = 0 then null "
    + " ".join(f"when {k} = greatest({', '.join(_KINDS)}) then '{k}'" for k in _KINDS)
    + " end as top_mistake from c"
)
def a10_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outcomes(answers(spark, d), "method")


@query(f"with {ANSWER_SQL}, c as (select method, avg(correct::int) as c from judged group by method) select case when method[1] = 'B' then 'rules' else 'AI' end as family, round(avg(c), 6) as correct from c where method not like 'B0%' group by all")
def a11_family_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.accuracy(answers(spark, d), "method").where("method not like 'B0%'")
    return rows.groupBy(F.when(F.col("method").startswith("B"), "rules").otherwise("AI").alias("family")).agg(F.round(F.avg("correct"), 6).alias("correct"))


@query(f"with {ANSWER_SQL} select method, pool, kind, round({macro_sql()}, 6) as macro_f1, count(*) as n from ans group by method, pool, kind")
def a12_by_pool(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).groupBy("method", "pool", "kind").agg(F.round(metrics.macro_f1(), 6).alias("macro_f1"), F.count("*").alias("n"))


@query(
    f"""with {ANSWER_SQL} select method, outcome, count(*) as n, count(*) filter (outcome = 'false_update' and contains(notes, 'template_trap')) as trapped, count(*) filter (outcome = 'missed_update' and contains(notes, 'reworded')) as reworded
from judged where not correct group by method, outcome"""
)
def a13_errors(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import text as tx

    rows = answers(spark, d).where(~metrics.correct()).withColumn("outcome", tx.outcome(F.col("gold_label"), F.col("gold_target"), F.col("label"), F.col("target")))
    return rows.groupBy("method", "outcome").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("outcome") == "false_update") & F.col("notes").contains("template_trap")).alias("trapped"),
        F.count_if((F.col("outcome") == "missed_update") & F.col("notes").contains("reworded")).alias("reworded"),
    )


@query(f"with {GOLD_SQL} select gold_label from gold group by gold_label order by count(*) desc, min(pos) limit 1")
def a18_majority(spark: SparkSession, d: str) -> DataFrame:
    return metrics.majority(gold(spark, d))


_SPLIT_SQL = "split0 as (select case_id, gold_label, case when row_number() over (partition by gold_label order by md5('13:' || case_id), case_id) <= round_even(0.4 * count(*) over (partition by gold_label), 0) then 'dev' else 'test' end as split from gold)"


@query(f"with {GOLD_SQL}, {_SPLIT_SQL} select case_id, split from split0")
def w07_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(gold(spark, d), "case_id").select("case_id", "split")


@query(f"with {ANSWER_SQL}, {_SPLIT_SQL}, m as (select ans.gold_label from ans join split0 using (case_id) where split = 'dev' and method = '{METHODS[0]}' group by ans.gold_label order by count(*) desc, min(pos) limit 1) select case_id, m.gold_label as label from split0, m where split = 'test'")
def d00_majority(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent label of the development cases, for all others."""
    rows = sampling.stratified_split(gold(spark, d), "case_id")
    label = F.broadcast(metrics.majority(rows.where("split = 'dev'")).withColumnRenamed("gold_label", "label"))  # one row
    return rows.where("split = 'test'").select("case_id").crossJoin(label)


@query(f"with {ANSWER_SQL}, {_SPLIT_SQL} select method from (select method, round({macro_sql('ans.gold_label')}, 9) as f from ans join split0 using (case_id) where split = 'dev' and method like 'B%' and method not like 'B0%' group by method) order by f desc, method limit 1")
def a23_best_baseline(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.methods import best_baseline

    split = sampling.stratified_split(gold(spark, d), "case_id").where("split = 'dev'").select("case_id")
    return best_baseline(answers(spark, d).join(split, "case_id"), [m for m in METHODS if m.startswith("B") and not m.startswith("B0")])


def annotators(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = answers(spark, d).where(~F.col("notes").contains("unsure"))
    return rows.where(F.col("method") == METHODS[1]).select("case_id", "label"), rows.where(F.col("method") == METHODS[4]).select("case_id", "label")


_PAIR_SQL = f"pair as (select a.case_id, a.label as a, b.label as b from ans a join ans b using (case_id) where a.method = '{METHODS[1]}' and b.method = '{METHODS[4]}' and not contains(a.notes, 'unsure'))"


@query(f"with {ANSWER_SQL}, {_PAIR_SQL} select case_id, a, b, a = b as same from pair")
def j13_agreement_rows(spark: SparkSession, d: str) -> DataFrame:
    a, b = annotators(spark, d)
    rows = a.withColumnRenamed("label", "a").join(b.withColumnRenamed("label", "b"), "case_id")
    return rows.withColumn("same", F.col("a") == F.col("b"))


@query(
    f"""with {ANSWER_SQL}, {_PAIR_SQL}, e as (select count(*) as n, avg((a = b)::int) as raw, {' + '.join(f"avg((a = '{x}')::int) * avg((b = '{x}')::int)" for x in LABELS)} as chance from pair)
select n, round(raw, 6) as raw, round(case when chance = 1 then 1 else (raw - chance) / (1 - chance) end, 6) as kappa from e"""
)
def a19_kappa(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kappa(*annotators(spark, d)).select("n", *(F.round(c, 6).alias(c) for c in ("raw", "kappa")))


@query(
    f"""with {ANSWER_SQL} select a.method as method_a, b.method as method_b, count(*) as n, count(*) filter (a.correct and not b.correct) as a_only, count(*) filter (not a.correct and b.correct) as b_only
from judged a join judged b on a.case_id = b.case_id and a.method < b.method group by all"""
)
def j14_model_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).select("case_id", "method", metrics.correct().alias("ok"))
    pairs = rows.toDF("case_id", "method_a", "a").join(rows.toDF("case_id", "method_b", "b"), "case_id").where("method_a < method_b")
    return pairs.groupBy("method_a", "method_b").agg(F.count("*").alias("n"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"))


def tests(spark: SparkSession, d: str) -> DataFrame:
    """method, a_only, b_only, p: every method against the first rule."""
    rows = answers(spark, d).select("case_id", "method", metrics.correct().alias("ok"))
    base = rows.where(F.col("method") == METHODS[1]).select("case_id", F.col("ok").alias("base"))
    return stats.mcnemar(rows.where(F.col("method") != METHODS[1]).join(base, "case_id"), "method", "base", "ok")


_TEST_SQL = f"""disc as (select m.method, count(*) filter (b.correct and not m.correct) as a_only, count(*) filter (not b.correct and m.correct) as b_only
        from judged m join judged b on m.case_id = b.case_id and b.method = '{METHODS[1]}' where m.method <> '{METHODS[1]}' group by m.method),
tests as (select method, a_only, b_only, case when a_only + b_only = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
        lambda k: exp(lgamma(a_only + b_only + 1) - lgamma(k + 1) - lgamma(a_only + b_only - k + 1) - (a_only + b_only) * ln(2))))) end as p from disc)"""


@query(f"with {ANSWER_SQL}, {_TEST_SQL} select method, a_only, b_only, round(p, 6) as p from tests")
def r05_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return tests(spark, d).withColumn("p", F.round("p", 6))


@query(
    f"""with {ANSWER_SQL}, {_TEST_SQL}, s as (select method, round(p, 9) as p, (count(*) over () - row_number() over (order by round(p, 9), method) + 1) * round(p, 9) as s from tests)
select method, round(least(1, max(s) over (order by p, method rows unbounded preceding)), 6) as p_adj from s"""
)
def w05_holm(spark: SparkSession, d: str) -> DataFrame:
    rows = tests(spark, d).withColumns({"p": F.round("p", 9), "family": F.lit("all")})
    return stats.holm(rows, "p", "family", "method").select("method", F.round("p_adj", 6).alias("p_adj"))


@query(f"with {ANSWER_SQL} select method, case_id, correct from judged")
def r07_correct(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("method", "case_id", metrics.correct().alias("correct"))


_BOOT_SQL = f"""num as (select method, case_id, gold_label, label, row_number() over (partition by method order by case_id) - 1 as i, count(*) over (partition by method) as n from ans),
dr as (select r, i, count(*) as times from (select r, {h("r || ':' || k")} % n as i from range(1, {REPLICATES + 1}) as t(r), (select max(n) as n from num), unnest(range(1, n + 1)) as u(k)) group by all)"""


def _wf1(pred: str) -> str:
    return "(" + " + ".join(f"coalesce(2.0 * sum(times) filter (gold_label = '{x}' and {pred} = '{x}') / nullif(coalesce(sum(times) filter (gold_label = '{x}'), 0) + coalesce(sum(times) filter ({pred} = '{x}'), 0), 0), 0)" for x in LABELS) + ") / 3"


@query(
    f"""with {ANSWER_SQL}, {_BOOT_SQL}, b as (select method, r, {_wf1('label')} as f from num join dr using (i) group by method, r)
select method, round(quantile_cont(f, 0.025), 6) as low, round(quantile_cont(f, 0.975), 6) as high from b group by method"""
)
def r03_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    b = stats.bootstrap(answers(spark, d), "method", REPLICATES, ["label"])
    return stats.interval(b, "method", F.col("f1_label")).select("method", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    f"""with {ANSWER_SQL}, {_BOOT_SQL}, pr as (select num.*, o.label as other from num join ans o on o.case_id = num.case_id and o.method = '{METHODS[1]}' where num.method <> '{METHODS[1]}'),
b as (select method, r, round({_wf1('label')} - {_wf1('other')}, 9) as f from pr join dr using (i) group by method, r)
select method, round(quantile_cont(f, 0.025), 6) as low, round(quantile_cont(f, 0.975), 6) as high, round(avg((f <= 0)::int), 6) as p_le_0 from b group by method"""
)
def r04_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d)
    base = rows.where(F.col("method") == METHODS[1]).select("case_id", F.col("label").alias("other"))
    pairs = rows.where(F.col("method") != METHODS[1]).join(base, "case_id")
    b = stats.bootstrap(pairs, "method", REPLICATES, ["label", "other"])
    return stats.interval(b, "method", F.round(F.col("f1_label") - F.col("f1_other"), 9)).select("method", *(F.round(c, 6).alias(c) for c in ("low", "high", "p_le_0")))


@query()
def r03_bootstrap_cells(spark: SparkSession, d: str) -> DataFrame:
    """Intervals by ten thousand replicates, drawn by cells."""
    b = stats.bootstrap_cells(answers(spark, d), "method", MANY, ["label"])
    return stats.interval(b, "method", F.col("f1_label")).select("method", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def r04_paired_cells(spark: SparkSession, d: str) -> DataFrame:
    """Differences from the title method, both scored on the same ten thousand replicates."""
    rows = answers(spark, d)
    base = rows.where(F.col("method") == METHODS[1]).select("case_id", F.col("label").alias("other"))
    b = stats.bootstrap_cells(rows.where(F.col("method") != METHODS[1]).join(base, "case_id"), "method", MANY, ["label", "other"])
    return stats.interval(b, "method", F.round(F.col("f1_label") - F.col("f1_other"), 9)).select("method", *(F.round(c, 6).alias(c) for c in ("low", "high", "p_le_0")))


@query(f"with {ANSWER_SQL}, c as (select method, {h('case_id')} % 1000 / 100.0 as s, {h('case_id')} % 3 = 0 as called from ans) select method, count(*) filter (called) as calls, round(sum(case when called then s end) / count(*), 6) as s_per_case from c group by method")
def a25_cost(spark: SparkSession, d: str) -> DataFrame:
    """Seconds by decision over all cases: those that no model was asked about count as well."""
    x = hash_int(F.col("case_id"))
    rows = answers(spark, d).withColumns({"called": x % 3 == 0, "s": x % 1000 / 100.0})
    return rows.groupBy("method").agg(F.count_if("called").alias("calls"), F.round(F.sum(F.when(F.col("called"), F.col("s"))) / F.count("*"), 6).alias("s_per_case"))


@query(
    f"""with {ANSWER_SQL}, c as (select method, round(avg(correct::int), 9) as c, round({macro_sql()}, 9) as f from judged group by method)
select (select method from c order by c desc, method limit 1) as most_correct, (select method from c order by f desc, method limit 1) as best_f1, (select method from c where method not like 'B0%' order by c, method limit 1) as least_correct"""
)
def a24_conclusions(spark: SparkSession, d: str) -> DataFrame:
    return report.conclusions(answers(spark, d))


@query(
    f"""with {GOLD_SQL}, e as (select *, case when notes like 'template_trap%' then 'looks like the older one of that kind' when notes like 'unsure%' then 'the same text in another language' else '' end as why from gold),
r as (select gold_label, case_id, why, {h("'e' || case_id")} % 6 + 1 as k, pos from e where why <> '')
select gold_label, case_id, why, case when gold_label = 'NEW' then 'NONE' else 'C' || k end as target from r where gold_label = 'NEW' or k <= 5 qualify row_number() over (partition by gold_label order by pos) = 1"""
)
def w06_exemplar(spark: SparkSession, d: str) -> DataFrame:
    rows = gold(spark, d).withColumns({"targets": F.array(F.concat(F.lit("d"), "case_id")), "kb_size": F.lit(1)})
    candidates = rows.where("gold_label <> 'NEW'").select("case_id", F.col("targets")[0].alias("doc_id"), (hash_int(F.concat(F.lit("e"), "case_id")) % 6 + 1).alias("rank"))
    return judge.exemplars(rows, candidates)


@query(
    """with r as (select distinct cast(user_id as varchar) as run, 'm' || user_id % 7 as model, user_id % 2 = 0 as free_json, cast(user_id % 5 + 1 as integer) as conditions from events)
select model, free_json, run, conditions from r qualify row_number() over (partition by model, free_json order by conditions desc, run desc) = 1"""
)
def w08_best_run(spark: SparkSession, d: str) -> DataFrame:
    """Runs made from users: for each model and kind of answer the most complete one."""
    u = F.col("user_id")
    runs = table(spark, d, "events").select(u.cast("string").alias("run"), F.concat(F.lit("m"), (u % 7).cast("string")).alias("model"), (u % 2 == 0).alias("free_json"), (u % 5 + 1).cast("int").alias("conditions")).distinct()
    return best_runs(runs).select("model", "free_json", "run", "conditions")


@query(f"with {ANSWER_SQL} select case_id from ans where method = '{METHODS[1]}' and label = 'UPDATE' intersect select case_id from ans where method = '{METHODS[4]}' and label = 'UPDATE'")
def o05_shared(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).where("label = 'UPDATE'")
    return rows.where(F.col("method") == METHODS[1]).select("case_id").intersect(rows.where(F.col("method") == METHODS[4]).select("case_id"))


@query(
    f"""with {GOLD_SQL}, o as (select *, md5('13:' || case_id) as o from gold), t as (select *, row_number() over (partition by pool order by o, case_id) as rn from o),
named as (select case_id, pool from t where (pool = 'title' and rn <= 90) or (pool = 'semantic' and rn <= 60)), rest as (select case_id, row_number() over (order by o, case_id) as rn from o where case_id not in (select case_id from named))
select * from named union all select case_id, 'random' as pool from rest where rn <= 200 - (select count(*) from named)"""
)
def r01_pools(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_pools(gold(spark, d).select("case_id", "pool"), "case_id")


@query(
    f"""with {GOLD_SQL}, o as (select *, md5('13:' || case_id) as o from gold), t as (select *, row_number() over (partition by pool order by o, case_id) as rn from o)
select case_id from t where pool = 'random' or (pool = 'title' and rn > 90) or (pool = 'semantic' and rn > 60)"""
)
def o06_rest(spark: SparkSession, d: str) -> DataFrame:
    """What the named pools leave over."""
    rows = gold(spark, d).select("case_id", "pool")
    taken = sampling.sample_pools(rows, "case_id", sizes={"title": 90, "semantic": 60, "random": 0}).where("pool <> 'random'")
    return rows.join(taken.select("case_id"), "case_id", "left_anti").select("case_id")


@query("select source, min(doc_id) as first_id from documents group by source")
def o08_first_seen(spark: SparkSession, d: str) -> DataFrame:
    w = metrics.first_seen(table(spark, d, "documents").select("source", "doc_id"), "source", F.col("doc_id"))
    return w.select("source", F.col("doc_id").alias("first_id"))


