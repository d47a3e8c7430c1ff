"""Rows of a query and of its SQL, in a form that can be compared."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and x.is_integer() else x  # a column of whole numbers with nulls is read as floats


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in pdf.itertuples(index=False, name=None))


def by_sql(data, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c.sql(sql).df()
