"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.chunk import upsert


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """The library's log and the record of replies grow only."""
    df.write.mode("append").json(path)


def predictions(df: DataFrame, path: str) -> None:
    df.withColumn("info", F.to_json("info")).write.mode("overwrite").csv(path, header=True, escape='"')


def errors(df: DataFrame, path: str) -> None:
    """The wrong rows; a header alone if there is none."""
    df.where("not coalesce(correct, false)").write.mode("overwrite").csv(path, header=True, escape='"')


def labels(df: DataFrame, path: str) -> None:
    """Notes are the flags and the text, joined as annotators write them."""
    notes = F.concat_ws(" | ", F.nullif(F.array_join("flags", " "), F.lit("")), F.nullif("note", F.lit("")))
    df.withColumn("notes", notes).drop("flags", "note").write.mode("overwrite").csv(path, header=True, escape='"')


def upsert_points(store: DataFrame, new: DataFrame, path: str, prune: bool = False) -> DataFrame:
    """The store after an upsert, as a new table: a table that is being read is not written over."""
    upsert(store, new, "id", "source_file" if prune else None).write.mode("errorifexists").parquet(path)
    return store.sparkSession.read.parquet(path)


def markdown(df: DataFrame, path: str) -> None:
    """One text column a document, in files named by their title."""
    rows = df.select(tx.safe_name("title").alias("name"), tx.markdown(F.col("title"), F.col("text")).alias("value"))
    rows.write.mode("overwrite").partitionBy("name").text(path)


def labeler(cases: DataFrame, template: str, path: str, mark: str = "/*DATA*/null") -> None:
    """A page for annotators with the cases to label, a list of bounded size, as JSON in the place of ``mark``; </ can't end its script."""
    data = F.replace(F.to_json(F.array_sort(F.collect_list(F.struct(*cases.columns)))), F.lit("</"), F.lit("<\\/"))
    cases.agg(F.replace(F.lit(template), F.lit(mark), data).alias("value")).coalesce(1).write.mode("overwrite").text(path)
