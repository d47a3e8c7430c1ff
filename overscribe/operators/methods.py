"""Decision methods: each tunes parameters on development cases and then labels cases.

``tops`` has a row a case: case_id, doc_id, score (null without candidates) and
gold_label where it is known. Tuning crosses the cases with a small grid of
parameters, in one aggregation, and keeps the first best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from .metrics import macro_f1
from .ranks import running

NEVER = 9e9
#: The codes of the methods that ask a model.
ASKING = ["M1", "M2", "M3", "M4"]
#: Thresholds that the title method tries.
TITLE_GRID, BODY_GRID = [0.7, 0.8, 0.9, 0.95, 1.0], [0.8, 0.9, 0.95, 0.98, 1.01]
PRECISE = 0.9


def chosen(names: list[str], no_llm: bool = False, only: str | None = None) -> list[str]:
    """The methods to run, by the code that their names begin with: without those that ask a model, or only the listed ones."""
    code = {x: x.split()[0] for x in names}
    wanted = only.split(",") if only else None
    return [x for x in names if not (no_llm and code[x] in ASKING) and (wanted is None or code[x] in wanted)]


def best_document(scored: DataFrame, score: str) -> DataFrame:
    """case_id, doc_id, score of each case's best document, the first one on ties."""
    best = F.min_by(F.struct("doc_id", F.col(score).alias("score")), F.struct(-F.col(score), F.col("pos")))
    return scored.groupBy("case_id").agg(best.alias("b")).select("case_id", "b.doc_id", "b.score")


def threshold_label(score: Column, upd: Column, red: Column) -> Column:
    return F.when(score.isNull() | (score < upd), "NEW").when(score >= red, "REDUNDANT").otherwise("UPDATE")


def threshold_grid(tops: DataFrame) -> DataFrame:
    """i, t_upd, t_red in the order in which they are tried."""
    g = tops.agg(sim.grid("score").alias("g"))
    upd = g.select("g", F.posexplode("g").alias("i", "t_upd"))
    red = upd.select("i", "t_upd", F.posexplode(F.concat(F.expr("slice(g, i + 1, size(g))"), F.array(F.lit(NEVER)))).alias("j", "t_red"))
    return red.select((F.col("i") * 1000 + F.col("j")).alias("i"), "t_upd", "t_red")


def tune_thresholds(tops: DataFrame) -> DataFrame:
    """Rows of the grid with macro_f1 on the cases of ``tops``; the best first one is min_by(struct(-macro_f1, i))."""
    grid = F.broadcast(threshold_grid(tops))  # 25 * 26 / 2 + 25 rows at most
    tried = tops.select("gold_label", "score").crossJoin(grid).withColumn("label", threshold_label(F.col("score"), F.col("t_upd"), F.col("t_red")))
    return tried.groupBy("i", "t_upd", "t_red").agg(F.round(macro_f1(), 9).alias("macro_f1"))


def best_parameters(tried: DataFrame, *names: str) -> DataFrame:
    """One row: the parameters with the best macro_f1, the first tried on ties."""
    best = F.min_by(F.struct(*names, "macro_f1"), F.struct(-F.col("macro_f1"), F.col("i")))
    return tried.agg(best.alias("b")).select("b.*")


def predict_threshold(tops: DataFrame, parameters: DataFrame) -> DataFrame:
    """case_id, label, target, score, t_upd, t_red."""
    rows = tops.crossJoin(F.broadcast(parameters.select("t_upd", "t_red")))  # one row
    label = threshold_label(F.col("score"), F.col("t_upd"), F.col("t_red"))
    return rows.select("case_id", label.alias("label"), F.when(label != "NEW", F.col("doc_id")).alias("target"), "score", "t_upd", "t_red")


def decide_by_title(cases: DataFrame, same: DataFrame, titles: DataFrame, bodies: DataFrame, grid: DataFrame) -> DataFrame:
    """i, case_id, label, target for each row (i, t_title, t_body) of the grid.

    An older document with the same body makes it REDUNDANT, the latest one
    being the target. Else the latest document with a title that similar is it,
    and its body decides between REDUNDANT and UPDATE.
    """
    latest = same.groupBy("case_id").agg(F.min_by("doc_id", F.struct(_down("date"), F.col("pos"))).alias("twin"))
    rows = titles.crossJoin(F.broadcast(grid)).where(F.col("title_sim") >= F.col("t_title"))
    best = rows.groupBy("i", "t_body", "case_id").agg(F.min_by("doc_id", F.struct(_down("date"), -F.col("title_sim"), F.col("pos"))).alias("match"))
    best = best.join(bodies.withColumnRenamed("doc_id", "match"), ["case_id", "match"], "left")
    all_cases = cases.select("case_id").crossJoin(F.broadcast(grid.select("i")))
    out = all_cases.join(best, ["i", "case_id"], "left").join(latest, "case_id", "left")
    label = F.when(F.col("twin").isNotNull(), "REDUNDANT").when(F.col("match").isNull(), "NEW").when(F.coalesce("body_sim", F.lit(0.0)) >= F.col("t_body"), "REDUNDANT").otherwise("UPDATE")
    return out.select("i", "case_id", label.alias("label"), F.coalesce("twin", "match").alias("target"))


def _down(date: str) -> Column:
    """Sorts dates as text from the latest to the oldest."""
    return F.translate(F.col(date), "0123456789", "9876543210")


def title_grid(spark) -> DataFrame:
    return spark.createDataFrame([(5 * i + j, t, b) for i, t in enumerate(TITLE_GRID) for j, b in enumerate(BODY_GRID)], "i int, t_title double, t_body double")


def new_cut(tops: DataFrame) -> DataFrame:
    """One row, t_new: just above the largest score up to which NEW is right in nine of ten cases; null if it never is.

    It is the last such prefix in the order of (score, label) that counts.
    """
    known = tops.where("score is not null")
    counts = known.groupBy("score", "gold_label").agg(F.count("*").alias("n"))
    new = F.when(F.col("gold_label") == "NEW", F.col("n")).otherwise(0)
    # Cases of one score and label are one row. A prefix can end within it: of NEW ones the last is best, of others the first.
    sums = running(counts, [], [F.col("score"), F.col("gold_label")], seen=F.col("n"), right=new)
    one = F.when(F.col("gold_label") == "NEW", 0).otherwise(F.col("n") - 1)
    good = F.col("right") >= PRECISE * (F.col("seen") - one) - 1e-9
    return sums.agg((F.max(F.when(good, F.col("score"))) + 1e-9).alias("t_new"))


def cascade_rule(cases: DataFrame, kb: DataFrame, same: DataFrame, tops: DataFrame, cut: DataFrame) -> DataFrame:
    """case_id, label, target, escalated: what the rules decide; the rest, with null, is for the judge."""
    latest = same.groupBy("case_id").agg(F.min_by("doc_id", F.struct(_down("date"), F.col("pos"))).alias("twin"))
    rows = cases.select("case_id").join(kb, "case_id").join(latest, "case_id", "left").join(tops.select("case_id", "score"), "case_id", "left").crossJoin(F.broadcast(cut))
    label = F.when(F.col("kb_size") == 0, "NEW").when(F.col("twin").isNotNull(), "REDUNDANT").when(F.coalesce("score", F.lit(0.0)) < F.col("t_new"), "NEW")
    return rows.select("case_id", label.alias("label"), F.when(label == "REDUNDANT", F.col("twin")).alias("target"), label.isNull().alias("escalated"))


def best_baseline(dev: DataFrame, order: list[str]) -> DataFrame:
    """One row, method: the rule with the best macro-F1 on development cases, the first of ``order`` on ties."""
    f = dev.where(F.col("method").isin(order)).groupBy("method").agg(F.round(macro_f1(), 9).alias("f1"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    return f.agg(F.min_by("method", F.struct(-F.col("f1"), place)).alias("method"))
