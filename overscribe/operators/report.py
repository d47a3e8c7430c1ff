"""Reports as Markdown, from small tables of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import accuracy, correct, macro_f1, outcomes, per_class, target_accuracy
from .stats import holm, mcnemar


def fmt(x, places: int = 3) -> str:
    """A dash for what is not there."""
    return "–" if x is None or x != x else f"{x:.{places}f}" if isinstance(x, float) else str(x)


def markdown_table(df: DataFrame) -> str:
    """Of a table that is small by its kind, such as one row a method."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(fmt(x) for x in row) + " |" for row in df.collect()])


def verdict(p_adj, more) -> "F.Column":
    """What a corrected test says of a method against the best rule."""
    return F.when(p_adj >= 0.05, "not significantly different").when(more, "significantly more often correct").otherwise("significantly less often correct")


def conclusions(rows: DataFrame) -> DataFrame:
    """One row: the method most often correct, that with the best macro-F1, and the least often correct one but for B0."""
    table = accuracy(rows, "method")
    return table.agg(
        F.min_by("method", F.struct(-F.col("correct"), F.col("method"))).alias("most_correct"),
        F.min_by("method", F.struct(-F.round("macro_f1", 9), F.col("method"))).alias("best_f1"),
        F.min_by("method", F.when(~F.col("method").startswith("B0"), F.struct("correct", "method"))).alias("least_correct"),
    )


def results(rows: DataFrame, title: str) -> str:
    """The report of answers (method, case_id, gold_label, gold_target, label, target)."""
    parts = [
        ("Accuracy", accuracy(rows, "method").orderBy("method")),
        ("Outcomes", outcomes(rows, "method").orderBy("method")),
        ("Classes", per_class(rows, "method").orderBy("method", "class")),
        ("Targets of UPDATE", target_accuracy(rows, "method").orderBy("method")),
        ("Conclusion", conclusions(rows)),
    ]
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in parts) + "\n"


def one_answer_key(infos: DataFrame) -> DataFrame:
    """Runs (run, model, labels): an error if they were judged by different answer keys."""
    keys = infos.agg(F.count_distinct("labels").alias("_n"), F.array_join(F.sort_array(F.collect_set("labels")), ", ").alias("_k"))
    same = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("runs used different answer keys: "), F.col("_k"))).cast("boolean")).otherwise(True)
    return infos.crossJoin(F.broadcast(keys)).where(same).drop("_n", "_k")  # one row


def model_summary(rows: DataFrame) -> DataFrame:
    """condition, model, n, right, same_label, macro_f1 and, over the rows that have a latency, mean_s, median_s, p90_s, tokens.

    rows: condition, model, gold_label, gold_target, label, target, latency_s, prompt_tokens, output_tokens.
    """
    seen = F.col("latency_s").isNotNull()
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return rows.groupBy("condition", "model").agg(
        F.count("*").alias("n"),
        F.count_if(correct()).alias("right"),
        F.count_if(F.col("gold_label") == F.col("label")).alias("same_label"),
        macro_f1().alias("macro_f1"),
        F.avg("latency_s").alias("mean_s"),
        F.percentile("latency_s", 0.5).alias("median_s"),
        F.percentile("latency_s", 0.9).alias("p90_s"),
        F.avg(F.when(seen, tokens)).alias("tokens"),
    )


def model_pairs(rows: DataFrame) -> DataFrame:
    """condition, a, b, a_only, b_only, p, p_adj: exact McNemar tests between models on the cases of both, corrected in each condition."""
    right = rows.select("condition", "model", "case_id", F.coalesce(correct(), F.lit(False)).alias("r"))
    x, y = right.toDF("condition", "a", "case_id", "ra"), right.toDF("condition", "b", "case_id", "rb")
    both = x.join(y, ["condition", "case_id"]).where("a < b")
    return holm(mcnemar(both, ["condition", "a", "b"], "ra", "rb"), "p", "condition", "a", "b")


def stability(rows: DataFrame) -> DataFrame:
    """model, condition, calls and how the replies without a fixed form came: valid, recovered, invalid, request_failed."""
    kind = F.coalesce("json", "error_kind")
    counts = [F.count_if(kind == k).alias(k.removesuffix("_json")) for k in ("valid", "recovered", "invalid_json", "request_failed")]
    return rows.groupBy("model", "condition").agg(F.count("*").alias("calls"), *counts)


def model_comparison(infos: DataFrame, rows: DataFrame) -> str:
    """The report on models as Markdown; rows: as for :func:`model_summary`, with case_id, free_json, json and error_kind."""
    keys = sorted({r.labels for r in one_answer_key(infos).select("labels").distinct().collect()})
    fixed, free = rows.where("not free_json"), rows.where("free_json")
    parts = [
        ("Models", model_summary(fixed).orderBy("condition", "model")),
        ("Pairs of models", model_pairs(fixed).orderBy("condition", "a", "b")),
        ("JSON stability", stability(free).orderBy("model", "condition")),
    ]
    return f"# Model comparison\n\nAnswer key: `{', '.join(keys)}`\n\n" + "\n\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in parts) + "\n"
