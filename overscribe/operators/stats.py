"""Significance: bootstrap, McNemar and Holm, with draws that any engine can repeat."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LABELS
from ..sources.scratch import written
from .ranks import place


#: Replicates that one row of work stands for.
TOGETHER = 500
#: Draws that one row of work stands for, draws of a task, and groups up to which their sizes are broadcast.
DRAWS, TASK, GROUPS = 50_000, 500_000, 100_000


def hash_int(x: Column) -> Column:
    """A number below 2^32 from the MD5 of a text."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def cell_draws(group: str, counts: list[int], replicates: range, seed: int) -> np.ndarray:
    """How often each replicate draws each cell, when n rows are drawn with replacement: conditional binomials, no row draws.

    The generator is keyed by the group and the replicate, so that draws are the
    same on any cluster and in any order.
    """
    share = np.array(counts, dtype=np.float64) / sum(counts)
    key = zlib.crc32(f"{seed}:{group}".encode())
    return np.stack([np.random.Generator(np.random.Philox(key=[key, r])).multinomial(sum(counts), share) for r in replicates])


def drawn_f1(times: np.ndarray, gold: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Macro-F1 of each replicate from how often it drew each cell."""
    total = np.zeros(len(times))
    for x in LABELS:
        hit, either = times[:, (gold == x) & (pred == x)].sum(1), times[:, gold == x].sum(1) + times[:, pred == x].sum(1)
        total += np.divide(2.0 * hit, either, out=np.zeros(len(times)), where=either > 0)
    return total / len(LABELS)


def bootstrap_cells(rows: DataFrame, by: str, replicates: int, preds: list[str], seed: int = 7) -> DataFrame:
    """by, replicate, one macro-F1 for each column of ``preds``: like :func:`bootstrap`, at a cost that does not grow with the rows.

    Rows are counted by (gold, predictions), which are a few cells a group;
    replicates of a group are dealt over tasks.
    """
    cells = rows.groupBy(by, "gold_label", *preds).agg(F.count("*").alias("n"))
    cells = cells.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("gold_label", *preds, "n"))).alias("cells"))
    todo = cells.select(F.col(by), "cells", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(TOGETHER))).alias("first"))
    todo = todo.repartition(F.col(by), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, which = row["cells"], range(row["first"], min(row["first"] + TOGETHER, replicates + 1))
                times = cell_draws(str(row[by]), [c["n"] for c in own], which, seed)
                column = {c: np.array([x[c] for x in own], dtype=object) for c in ("gold_label", *preds)}
                scores = [pa.array(drawn_f1(times, column["gold_label"], column[p])) for p in preds]
                yield pa.RecordBatch.from_arrays([pa.array([row[by]] * len(which), batch.schema.field(by).type), pa.array(list(which), pa.int32()), *scores], names=[by, "replicate", *(f"f1_{p}" for p in preds)])

    return todo.mapInArrow(run, f"`{by}` {rows.schema[by].dataType.simpleString()}, replicate int, " + ", ".join(f"`f1_{p}` double" for p in preds))


def bootstrap(rows: DataFrame, by: str, replicates: int, preds: list[str], case: str = "case_id") -> DataFrame:
    """by, replicate, one macro-F1 for each column of ``preds``.

    Rows of a group are numbered by case; draw d of replicate r takes the row
    md5('r:d') modulo n, so groups of one size share their draws. Numbers come
    from ranges and draws from parts of DRAWS: no task has a whole group or a
    whole replicate. What is drawn is counted by (gold, predictions), which are few.
    """
    sizes = written(rows.groupBy(by).agg(F.count("*").alias("n")), "sizes")
    few = F.broadcast(sizes) if sizes.limit(GROUPS + 1).count() <= GROUPS else sizes
    numbered = place(rows.select(by, case, "gold_label", *preds), [by], [F.col(case)], "i")
    # As many parts as the draws ask for: they are few bytes, by which Spark would put all of them into one task.
    total = sizes.select("n").distinct().agg(F.sum("n")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), replicates * total // TASK)
    numbered = numbered.join(few, by).select(by, "n", (F.col("i") - 1).alias("i"), "gold_label", *preds).repartition(parts, "n", "i")
    drawn = sizes.select("n").distinct().select("n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.select("n", "replicate", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(DRAWS).cast("long"))).alias("first"))
    drawn = drawn.repartition(parts, "n", "replicate", "first")
    drawn = drawn.select("n", "replicate", F.explode(F.sequence("first", F.least(F.col("first") + (DRAWS - 1), F.col("n")))).alias("d"))
    drawn = drawn.select("n", "replicate", (hash_int(F.concat_ws(":", "replicate", "d")) % F.col("n")).alias("i")).repartition(parts, "n", "i")
    cells = drawn.join(numbered, ["n", "i"]).groupBy(by, "replicate", "gold_label", *preds).agg(F.count("*").alias("times"))
    return cells.groupBy(by, "replicate").agg(*(_weighted_f1(p).alias(f"f1_{p}") for p in preds))


def _weighted_f1(pred: str) -> Column:
    total = None
    for x in LABELS:
        g, p = F.col("gold_label") == x, F.col(pred) == x
        hit, either = F.sum(F.when(g & p, F.col("times")).otherwise(0)), F.sum(F.when(g, F.col("times")).otherwise(0) + F.when(p, F.col("times")).otherwise(0))
        one = F.coalesce(F.try_divide(2.0 * hit, either), F.lit(0.0))
        total = one if total is None else total + one
    return total / len(LABELS)


def interval(replicates: DataFrame, by: str, value: Column) -> DataFrame:
    """by, low, high (95 %), p_le_0 (share of replicates at or below zero)."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(by).agg(q.alias("q"), F.avg((value <= 0).cast("double")).alias("p_le_0")).select(by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_le_0")


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact and two-sided from the discordant counts; 1 without any. Sums in logarithms, so that large counts hold."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.lit(0.0).alias("log_c"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log_c = a["log_c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log_c.alias("log_c"), (a["sum"] + F.exp(log_c - n * F.log(F.lit(2.0)))).alias("sum"))

    tail = F.aggregate(F.filter(F.sequence(F.lit(0), k), lambda i: i > 0), start, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(pairs: DataFrame, by: str | list[str], a: str, b: str) -> DataFrame:
    """by, a_only, b_only, p of two boolean columns."""
    counts = pairs.groupBy(by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("a_only"), F.count_if(~F.col(a) & F.col(b)).alias("b_only"))
    return counts.withColumn("p", mcnemar_p(F.col("a_only"), F.col("b_only")))


def holm(tests: DataFrame, p: str, family: str, *order: str) -> DataFrame:
    """The rows with p_adj: (m - rank + 1) * p, not below that of a smaller p, at most 1."""
    w = Window.partitionBy(family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(family))
    step = tests.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    return step.withColumn("p_adj", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")
