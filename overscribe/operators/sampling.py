"""Sampling by hash order: the same rows on any cluster, whatever the order they are read in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import place

DEV = 0.4
#: Cases of each pool.
POOLS = {"title": 90, "semantic": 60, "random": 50}


def _hash(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))


def stratified_split(rows: DataFrame, key: str, label: str = "gold_label", share: float = DEV, seed: str = "13") -> DataFrame:
    """The rows with split (dev or test): of each label the first round-half-even(share * n) in hash order are dev."""
    ranked = place(rows, [label], [_hash(key, seed), F.col(key)], "_place")
    n = rows.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))  # a row a label
    out = ranked.join(n, F.col(label).eqNullSafe(F.col("_l")))
    return out.withColumn("split", F.when(F.col("_place") <= F.bround(F.lit(share) * F.col("_n")), "dev").otherwise("test")).drop("_place", "_l", "_n")


def pool_of(title: str = "title_best", cos: str = "cos_best", cut: str = "cos_p80"):
    """title if an older title is that alike, semantic if only the vector is, random otherwise; null without a library."""
    return F.when(F.col(cos).isNull(), None).when(F.col(title) >= 0.9, "title").when(F.col(cos) >= F.col(cut), "semantic").otherwise("random")


def sample_pools(rows: DataFrame, key: str, pool: str = "pool", sizes: dict[str, int] | None = None, seed: str = "13") -> DataFrame:
    """Of the named pools as many as their sizes say; the random pool, of all that is left, makes up what they lack."""
    sizes = sizes or POOLS
    named, most = [k for k in sizes if k != "random"], sum(sizes.values())
    rows = rows.where(F.col(pool).isNotNull()).withColumn("_o", _hash(key, seed))
    limit = F.element_at(F.create_map(*(F.lit(x) for k in named for x in (k, sizes[k]))), F.col(pool))
    first = Window.partitionBy(pool).orderBy("_o", key)
    # Each task cuts a pool to the largest size before the shuffle.
    taken = rows.where(F.col(pool).isin(named)).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(sizes[k] for k in named)).where(F.col("_n") <= limit).drop("_n")
    rest = rows.join(taken.select(key), key, "left_anti").orderBy("_o", key).limit(most)
    # ``most`` rows at most: in order, and cut to what is lacking.
    rest = rest.agg(F.array_sort(F.collect_list(F.struct("_o", key, *(c for c in rows.columns if c not in ("_o", key))))).alias("_r"))
    lacking = taken.agg((F.lit(most) - F.count("*")).cast("int").alias("_n"))
    rest = rest.crossJoin(F.broadcast(lacking)).select(F.inline(F.slice("_r", F.lit(1), F.greatest(F.col("_n"), F.lit(0))))).withColumn(pool, F.lit("random"))
    return taken.unionByName(rest.select(*taken.columns)).drop("_o")


def kappa_subset(rows: DataFrame, key: str, first: int = 150, n: int = 40, seed: str = "15") -> DataFrame:
    """n of the first ``first`` cases, in hash order."""
    few = rows.orderBy(key).limit(first)
    return few.orderBy(_hash(key, seed), key).limit(n)
