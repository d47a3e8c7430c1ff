"""BM25: counted documents, scores of all pairs, and the exact first k by impact bounds.

Statistics are those of the whole library, not of what is older than a query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import written

K1, B = 1.5, 0.75
#: Postings that the first round takes, for each document wanted: rare terms, which set the bar for the second.
FIRST_ROUND = 256
#: Terms up to which the queries' vocabulary is sent to the tasks that count documents, some 10 MB.
VOCABULARY = 500_000
#: Texts that a task counts at once: their words are Python objects, many times the size of the texts.
TEXTS = 256
#: Scores are compared rounded to so many places, so that the last digit decides nothing.
PLACES = 6
#: What is left out adds up to this share of the bar at most; more of it, and most documents would have to be looked up.
LEFT_OUT = 0.4
WORDS, RUNS = re.compile("[a-z0-9]+"), re.compile("[㐀-鿿]+")


def terms_of(text: str | None) -> list[str]:
    """The same terms as :func:`..functions.text.tokens` gives, within a task."""
    if text is None:
        return []
    runs = RUNS.findall(text)
    return WORDS.findall(text.lower()) + [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut to TEXTS rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            yield whole.slice(at, TEXTS)


def counted(docs: DataFrame, text: Column, *carry: str, among: list[str] | None = None) -> DataFrame:
    """(row, carry..., n_terms, terms: array of (term, tf)), a row a document, without a shuffle.

    A document is split and counted where it is read, so that only counts leave
    the task. Only terms ``among`` the given ones are kept; n_terms counts all.
    ``row`` is a number to group by, which holds once the result is written.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *carry, text.alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("n_terms int, terms array<struct<term:string,tf:int>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = frozenset(among) if among is not None else None
        for batch in few(batches):
            sizes, ends, terms, tfs = [], [0], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                found = terms_of(t)
                sizes.append(len(found))
                counts = Counter(found if kept is None else filter(kept.__contains__, found))
                terms.extend(counts)
                tfs.extend(counts.values())
                ends.append(len(terms))
            entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Counted:
    """A counted library that is written, with the two numbers that weights need."""

    table: DataFrame
    n: int
    avg: float

    @classmethod
    def of(cls, docs: DataFrame, text: Column, *carry: str, among: DataFrame | None = None) -> Counted:
        """Documents without terms count. Of terms, those that ``among`` (term) has are enough, if these are few enough to be sent around; else all are kept."""
        vocabulary = None
        if among is not None:
            few = among.select("term").distinct().limit(VOCABULARY + 1).toPandas().term.tolist()
            vocabulary = few if len(few) <= VOCABULARY else None
        table = written(counted(docs, text, *carry, among=vocabulary), "counted")
        n, total = table.agg(F.count("*"), F.sum("n_terms")).first()
        return cls(table, n, (total or 0) / n if n else 0.0)

    def entries(self, *columns: str) -> DataFrame:
        """(columns..., n_terms, term, tf), a row for each different term of each document."""
        return self.table.select(*columns, "n_terms", F.inline("terms"))

    def saturated(self) -> Column:
        return _saturated(F.col("tf"), F.col("n_terms"), F.lit(self.avg))

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5))

    def terms(self, among: DataFrame | None = None) -> DataFrame:
        """(term, df, idf, most, weight): how many documents have it, its largest weight in any, and the sum of its weights.

        Each task sums up its documents by term first. ``among`` holds the terms wanted.
        """
        rows = self.entries()
        rows = rows.join(among.select("term"), "term", "left_semi") if among is not None else rows
        t = rows.groupBy("term").agg(F.count("*").alias("df"), F.max(self.saturated()).alias("most"), F.sum(self.saturated()).alias("weight")).withColumn("idf", self.idf(F.col("df")))
        return t.select("term", "df", "idf", (F.col("idf") * F.col("most")).alias("most"), (F.col("idf") * F.col("weight")).alias("weight"))


def _saturated(tf: Column, n_terms: Column, avg: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms / avg))


def index(docs: DataFrame, key: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(postings: key, term, weight; terms: term, df, idf, most, weight)."""
    library = Counted.of(docs, text, key)
    terms = library.terms()
    postings = library.entries(key).join(terms.select("term", "idf"), "term").select(key, "term", (F.col("idf") * library.saturated()).alias("weight"))
    return postings, terms


def asked(queries: DataFrame, query_key: str, query_text: Column, *carry: str) -> DataFrame:
    """(q, query_key, carry..., n_terms, term, tf) of the queries' terms; written. ``q`` is a number to group by."""
    rows = written(counted(queries, query_text, query_key, *carry), "asked")
    return rows.select(F.col("_row").alias("_q"), query_key, *carry, "n_terms", F.inline("terms"))


def known(library: Counted, rows: DataFrame, query_key: str, *carry: str) -> DataFrame:
    """(q, query_key, carry..., own, terms: array of (df, most, term, idf)) of queries that share a term with the library; written.

    A query term counts once. ``own`` is the query's score against itself, in
    which its counts and its length with unknown terms do count.
    """
    own = F.sum(F.col("idf") * library.saturated())
    rows = rows.join(library.terms(rows.select("term").distinct()), "term")
    out = rows.groupBy("_q", query_key, *carry).agg(own.alias("own"), F.collect_list(F.struct("df", "most", "term", "idf")).alias("terms"))  # a query's own terms
    return written(out.withColumn("own", F.when(F.col("own") == 0, 1.0).otherwise(F.col("own"))), "known")


def scores(queries: DataFrame, query_key: str, query_text: Column, docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(query_key, key, bm25) of all pairs that share a term; all others score 0."""
    rows = asked(queries, query_key, query_text)
    library = Counted.of(docs, text, key, among=rows)
    q = known(library, rows, query_key)
    out = _sums(library, q.select("_q", F.inline("terms")), None).join(q.select("_q", query_key, "own"), "_q").join(library.table.select("_row", key), "_row")
    return out.select(query_key, key, (F.col("sum") / F.col("own")).alias("bm25"))


def _sums(library: Counted, wanted: DataFrame, where: Column | None, *carry: str) -> DataFrame:
    """(q, row, sum) over the wanted terms (q, term, idf, ...) of each query: their postings meet, by term."""
    entries = library.entries("_row", *carry).join(wanted.select("term").distinct(), "term", "left_semi")
    pairs = entries.join(wanted.drop("most", "before", "df"), "term")
    pairs = pairs.where(where) if where is not None else pairs
    return pairs.groupBy("_q", "_row").agg(F.sum(F.col("idf") * library.saturated()).alias("sum"))


def _looked_up(library: Counted, wanted: DataFrame) -> DataFrame:
    """(q, row, sum) over wanted terms (q, row, term, idf) of certain documents: their own rows are looked up, not the terms' postings."""
    rows = library.table.join(wanted.select("_row").distinct(), "_row", "left_semi").select("_row", "n_terms", F.inline("terms"))
    return wanted.join(rows, ["_row", "term"]).groupBy("_q", "_row").agg(F.sum(F.col("idf") * library.saturated()).alias("sum"))


def _first(sums: DataFrame, k: int) -> DataFrame:
    """The k largest sums of each query; each task keeps k a query before the shuffle."""
    return sums.withColumn("_n", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("sum")))).where(F.col("_n") <= k).drop("_n")


def _before(terms: Column, field: str) -> Column:
    """(term, idf, most, before) in the order of ``terms``: ``before`` is the sum of a field over those that come first."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<term:string,idf:double,most:double,before:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        one = F.struct(x["term"].alias("term"), x["idf"].alias("idf"), x["most"].alias("most"), a["sum"].alias("before"))
        return F.struct((a["sum"] + x[field].cast("double")).alias("sum"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(terms, start, step)["out"]


def top_k(library: Counted, q: DataFrame, query_key: str, key: str, order: str, k: int, where: Column | None = None, of_query: tuple[str, ...] = (), of_document: tuple[str, ...] = ()) -> DataFrame:
    """(query_key, key, order, bm25, rank): the exact first k of each query by rounded score, ties by ``order``; written.

    ``q`` comes from :func:`known`; ``where`` says which documents count for a
    query, by the columns named ``of_query`` and ``of_document``.

    A first round sums up the rarest terms, as far as they have about
    FIRST_ROUND * k postings, and works out the whole scores of the best few:
    the kth is a score that k documents reach, the bar. A second round leaves out
    the terms, from the least largest weight up, that all together add up to
    LEFT_OUT of the bar at most: what has none of the others is not among the
    first k. Stop words are looked up only for documents whose sum, with all
    that is left out, reaches the bar. Queries for which no bar is known take
    all their terms, so the result is whole whatever the bounds are worth.
    """
    rare = F.filter(_before(F.array_sort("terms"), "df"), lambda x: x["before"] < FIRST_ROUND * k)
    ahead = written(_first(_sums(library, q.select("_q", *of_query, F.inline(rare)), where, *of_document), 4 * k).select("_q", "_row"), "ahead")
    whole = _first(_looked_up(library, ahead.join(q.select("_q", F.inline("terms")), "_q").select("_q", "_row", "term", "idf")), k)
    bar = whole.groupBy("_q").agg(F.min("sum").alias("bar"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")
    # Least largest weight first: ``before`` with a term's own weight is what it and all left out before it can add.
    slack = F.col("own") * 10.0**-PLACES
    by_most = F.array_sort(F.transform("terms", lambda x: F.struct(x["most"].alias("most"), x["term"].alias("term"), x["idf"].alias("idf"))))
    parts = q.join(bar, "_q", "left").select("_q", *of_query, (F.coalesce("bar", F.lit(0.0)) * (1 - 1e-9) - slack).alias("bar"), _before(by_most, "most").alias("terms"))
    left_out = F.filter("terms", lambda x: (x["before"] + x["most"]) * (1 + 1e-9) < LEFT_OUT * F.col("bar"))
    parts = parts.select("*", left_out.alias("small")).withColumn("rest", F.aggregate("small", F.lit(0.0), lambda s, x: s + x["most"]))
    parts = written(parts.withColumn("large", F.slice("terms", F.size("small") + 1, F.greatest(F.size("terms") - F.size("small"), F.lit(0)))).drop("terms"), "parts")
    found = _sums(library, parts.select("_q", *of_query, F.inline("large")), where, *of_document)
    reach = found.join(parts.select("_q", "rest", "bar", "small"), "_q").where((F.col("sum") + F.col("rest")) * (1 + 1e-9) >= F.col("bar"))
    reach = written(reach.select("_q", "_row", "sum", "small"), "reach")
    # What was left out, for the documents that can reach the bar.
    more = _looked_up(library, reach.select("_q", "_row", F.inline("small")).select("_q", "_row", "term", "idf")).withColumnRenamed("sum", "more")
    full = reach.select("_q", "_row", "sum").join(more, ["_q", "_row"], "left").join(q.select("_q", query_key, "own"), "_q").join(library.table.select("_row", key, order), "_row")
    full = full.withColumn("bm25", F.round((F.col("sum") + F.coalesce("more", F.lit(0.0))) / F.col("own"), PLACES))
    w = Window.partitionBy("_q").orderBy(F.desc("bm25"), order)
    return written(full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_key, key, order, "bm25", "rank"), "top")
