"""Places and running sums in an order of all rows, without a window that has all rows of a group in one task.

Rows are range-partitioned and sorted; each partition numbers or sums its own
rows, and adds what the partitions before it hold in all: a table with a row for
each partition and group in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def running(rows: DataFrame, by: list[str], order: list[Column], **values: Column) -> DataFrame:
    """The rows with, for each value, its sum over the rows of the group up to and with this one.

    ``by`` may be empty; groups of any size are spread over partitions. The
    order has to tell all rows of a group apart for the result to be fixed.
    """
    keyed = rows.withColumns({f"_o{i}": x for i, x in enumerate(order)} | {f"_v{i}": x for i, x in enumerate(values.values())})
    sort = [*map(F.col, by), *(F.col(f"_o{i}") for i in range(len(order)))]
    # Written, as ranges are sampled and could differ the next time.
    cut = written(keyed.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*by, "_part").orderBy(*sort[len(by) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cut.groupBy(*by, "_part").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(values))))
    ahead = Window.partitionBy(*by or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_part", *(F.coalesce(F.sum(f"_s{i}").over(ahead), F.lit(0)).alias(f"_b{i}") for i in range(len(values))))
    out = cut.withColumns({f"_r{i}": F.sum(f"_v{i}").over(own) for i in range(len(values))})
    same = F.col("c._part") == F.col("b._part")
    for c in by:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = out.alias("c").join(base.alias("b"), same)
    return out.select(*(f"c.{c}" for c in rows.columns), *((F.col(f"c._r{i}") + F.col(f"b._b{i}")).alias(n) for i, n in enumerate(values)))


def place(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in the order of their group."""
    return running(rows, by, order, **{name: F.lit(1).cast("long")})
