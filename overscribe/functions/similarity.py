"""Similarities of texts and vectors, and exact quantiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .matching import Corpus, matched


def length_bound(a: Column, b: Column) -> Column:
    """An upper bound of ratio() by the lengths alone; 1 for two empty texts."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / n)


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matched / (length of both), by longest matching blocks. The order of the arguments matters."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else 2.0 * matched(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def _matched(a: pd.Series, b: pd.Series) -> pd.Series:
    last, out = None, []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
        elif not x or x in y:
            out.append(1.0)
        else:
            if last is None or y != last.text:  # sections of a file come one after the other
                last = Corpus(y)
            out.append(last.matched(x) / len(x))
    return pd.Series(out, dtype="float64")


def coverage(section: Column, corpus: Column) -> Column:
    """The share of the section's text that the corpus has; both normalised. An empty section is covered."""
    return _matched(section, corpus)


def quantile(x: Column | str, p) -> Column:
    """Exact, by linear interpolation."""
    return F.percentile(x, F.lit(p))


def grid(x: Column | str, n: int = 25) -> Column:
    """Thresholds: n quantiles, rounded to 4 places, each once, ascending; [0.5] without values."""
    at = F.array(*(F.lit(i / (n - 1)) for i in range(n)))
    q = F.transform(F.percentile(x, at), lambda v: F.bround(v, 4))
    return F.coalesce(F.array_sort(F.array_distinct(q)), F.array(F.lit(0.5)))
