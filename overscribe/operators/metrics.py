"""Metrics of answers: rows of (case_id, method, gold_label, gold_target, label, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import LABELS, OUTCOMES


def _by(by: str | list[str] | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def f1(label: str, gold: str = "gold_label", pred: str = "label") -> Column:
    """2tp / (2tp + fp + fn), 0 where that is undefined; an aggregate."""
    hit = F.count_if((F.col(gold) == label) & (F.col(pred) == label))
    either = F.count_if(F.col(gold) == label) + F.count_if(F.col(pred) == label)
    return F.coalesce(F.try_divide(2.0 * hit, either), F.lit(0.0))


def macro_f1(gold: str = "gold_label", pred: str = "label") -> Column:
    """The mean over all three classes, whether they occur or not; an aggregate."""
    return sum(f1(x, gold, pred) for x in LABELS) / len(LABELS)


def per_class(rows: DataFrame, by: str | list[str]) -> DataFrame:
    """by, class, precision, recall, f1, support."""
    cells = [
        F.struct(
            F.lit(x).alias("class"),
            F.coalesce(F.try_divide(F.count_if((F.col("gold_label") == x) & (F.col("label") == x)).cast("double"), F.count_if(F.col("label") == x)), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide(F.count_if((F.col("gold_label") == x) & (F.col("label") == x)).cast("double"), F.count_if(F.col("gold_label") == x)), F.lit(0.0)).alias("recall"),
            f1(x).alias("f1"),
            F.count_if(F.col("gold_label") == x).alias("support"),
        )
        for x in LABELS
    ]
    return rows.groupBy(*_by(by)).agg(F.array(*cells).alias("c")).select(*_by(by), F.explode("c").alias("c")).select(*_by(by), "c.*")


def confusion(rows: DataFrame, by: str | list[str]) -> DataFrame:
    """by, gold, predicted, n: all nine cells, zeros too."""
    cells = [F.struct(F.lit(g).alias("gold"), F.lit(p).alias("predicted"), F.count_if((F.col("gold_label") == g) & (F.col("label") == p)).alias("n")) for g in LABELS for p in LABELS]
    return rows.groupBy(*_by(by)).agg(F.array(*cells).alias("c")).select(*_by(by), F.explode("c").alias("c")).select(*_by(by), "c.*")


def hit() -> Column:
    return tx.target_hit("target", "gold_target")


def correct() -> Column:
    """The right label, and for UPDATE the right target."""
    return (F.col("gold_label") == F.col("label")) & ((F.col("label") != "UPDATE") | hit())


def target_accuracy(rows: DataFrame, by: str | list[str]) -> DataFrame:
    """by, n (gold UPDATEs), conditional (of those called UPDATE), joint (of all of them); null without rows."""
    gold = F.col("gold_label") == "UPDATE"
    said = gold & (F.col("label") == "UPDATE")
    return rows.groupBy(*_by(by)).agg(
        F.count_if(gold).alias("n"),
        F.try_divide(F.count_if(said & hit()).cast("double"), F.count_if(said)).alias("conditional"),
        F.try_divide(F.count_if(said & hit()).cast("double"), F.count_if(gold)).alias("joint"),
    )


def outcomes(rows: DataFrame, by: str | list[str]) -> DataFrame:
    """by, a count of each outcome, n, and the most common mistake (the first on ties; null without mistakes)."""
    o = rows.withColumn("_o", tx.outcome(F.col("gold_label"), F.col("gold_target"), F.col("label"), F.col("target")))
    out = o.groupBy(*_by(by)).agg(*(F.count_if(F.col("_o") == x).alias(x) for x in OUTCOMES), F.count("*").alias("n"))
    kinds = OUTCOMES[3:]
    most = F.array_max(F.array(*(F.struct(F.col(x).alias("n"), F.lit(-i).alias("o"), F.lit(x).alias("kind")) for i, x in enumerate(kinds))))
    return out.withColumn("top_mistake", F.when(most["n"] > 0, most["kind"]))


def accuracy(rows: DataFrame, by: str | list[str]) -> DataFrame:
    return rows.groupBy(*_by(by)).agg(
        F.count("*").alias("n"),
        F.avg((F.col("gold_label") == F.col("label")).cast("double")).alias("right_label"),
        F.avg(correct().cast("double")).alias("correct"),
        macro_f1().alias("macro_f1"),
    )


def hit_at_k(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: n, hit_<k>: the share of gold rows (case_id, targets array) with a target among the first k (case_id, doc_id, rank)."""
    targets = gold.select("case_id", F.explode("targets").alias("doc_id")).distinct()
    best = targets.join(ranked, ["case_id", "doc_id"]).groupBy("case_id").agg(F.min("rank").alias("best"))
    rows = gold.select("case_id").distinct().join(best, "case_id", "left")
    return rows.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("double")).alias(f"hit_{k}") for k in ks))


def majority(gold: DataFrame, label: str = "gold_label", order: str = "pos") -> DataFrame:
    """One row, label: the most frequent one, the first seen on ties."""
    return gold.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(1).select(label)


def kappa(a: DataFrame, b: DataFrame, key: str = "case_id", label: str = "label") -> DataFrame:
    """One row: n, raw, kappa of two annotators on the cases that both have."""
    both = a.select(key, F.col(label).alias("a")).join(b.select(key, F.col(label).alias("b")), key)
    row = both.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("raw"), *(F.avg((F.col(s) == x).cast("double")).alias(f"{s}_{x}") for s in "ab" for x in LABELS))
    chance = sum(F.col(f"a_{x}") * F.col(f"b_{x}") for x in LABELS)
    return row.select("n", "raw", F.when(chance == 1, 1.0).otherwise((F.col("raw") - chance) / (1 - chance)).alias("kappa"))


def first_seen(rows: DataFrame, by: str | list[str], *order: Column) -> DataFrame:
    """One row of each group: the first."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rn = 1").drop("_rn")
