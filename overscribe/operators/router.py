"""Section router: what of a document is in the store, what is revised, and what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..schemas import RouterConfig
from ..sources.scratch import written
from . import dense
from .chunk import sections, with_point_id
from .metrics import first_seen


def store_of(docs: DataFrame, name: str = "doc_id", make: Callable = dense.HashedEmbedder) -> DataFrame:
    """(id, source_file, idx, content, vector): the sections of documents as they are ingested."""
    rows = sections(docs.withColumn("source_file", F.col(name).cast("string")), "source_file")
    return with_point_id(rows).withColumn("vector", dense.embed(F.col("content"), make, "passage"))


def hits(parts: DataFrame, store: DataFrame, k: int, make: Callable = dense.HashedEmbedder, rerank: Callable = dense.LexicalReranker) -> DataFrame:
    """(file, idx, id, source_file, content, rank, cosine, score) of each section's nearest ones."""
    q = parts.select(F.struct("file", "idx").alias("q"), dense.embed(F.col("section"), make, "query").alias("qv"))
    found = dense.knn(q, "q", "qv", store, "id", "vector", k)
    found = found.join(store.select("id", "source_file", "content"), "id").select("q.file", "q.idx", "id", "source_file", "content", "rank", "cosine")
    found = found.join(parts.select("file", "idx", "section"), ["file", "idx"])
    # Written, as verdicts and matches read it several times over, and each time would embed the store anew.
    return written(found.withColumn("score", dense.rerank(F.col("section"), F.col("content"), rerank)).drop("section"), "hits")


def classify(parts: DataFrame, found: DataFrame, config: RouterConfig) -> DataFrame:
    """(file, idx, section, status, coverage, score, source_file, matched).

    Coverage is looked at before the score: what stands in the store word for
    word is there, however little a reranker thinks of it. It is measured
    against all that any section of the file found, each once, in order.
    """
    best = first_seen(found, ["file", "idx"], F.desc("score"), F.col("rank")).select("file", "idx", "score", "source_file", F.col("content").alias("matched"))
    once = found.groupBy("file", "id").agg(F.min(F.struct("idx", "rank")).alias("at"), F.first("content").alias("content"))
    corpus = once.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n").alias("_corpus"))
    rows = parts.join(corpus, "file", "left").join(best, ["file", "idx"], "left")
    cover = sim.coverage(tx.norm_section("section"), tx.norm_section(F.coalesce("_corpus", F.lit(""))))
    rows = rows.withColumn("coverage", cover).drop("_corpus")
    status = F.when(F.col("coverage") >= config.identical, "UNCHANGED").when(F.col("score") >= config.threshold, "REVISED").otherwise("NEW")
    return rows.withColumn("status", status)


def verdicts(report: DataFrame, found: DataFrame, config: RouterConfig) -> DataFrame:
    """(file, decision, target_file, top_score, total, unchanged, revised, new) of every file.

    A file that found nothing at all is new. Else any revised section makes an
    UPDATE of the file of the best one; a file without new sections is
    NO_CHANGE; else it is NEW_BULLETIN. With ``any_change``, revised or new
    sections make an UPDATE, and all else is NO_CHANGE.
    """
    n = report.groupBy("file").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "UNCHANGED").alias("unchanged"), F.count_if(F.col("status") == "REVISED").alias("revised"), F.count_if(F.col("status") == "NEW").alias("new"),
        F.max_by("source_file", F.when(F.col("status") == "REVISED", F.struct("score", "idx"))).alias("_revised"),
        F.min_by(F.struct("source_file", "score"), F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col("idx")))).alias("_top"),
    )
    any_hit = found.select(F.col("file").alias("_f")).distinct()
    n = n.join(any_hit, n.file == any_hit._f, "left")
    none = F.col("_f").isNull()
    if config.any_change:
        decision = F.when(none | (F.col("revised") + F.col("new") > 0), "UPDATE").otherwise("NO_CHANGE")
    else:
        decision = F.when(none, "NEW_BULLETIN").when(F.col("revised") > 0, "UPDATE").when((F.col("unchanged") > 0) & (F.col("new") == 0), "NO_CHANGE").otherwise("NEW_BULLETIN")
    target = F.when(decision == "UPDATE", F.col("_revised")).when(decision == "NO_CHANGE", F.col("_top.source_file"))
    return n.select("file", decision.alias("decision"), target.alias("target_file"), F.coalesce(F.round("_top.score", 4), F.lit(0.0)).alias("top_score"), "total", "unchanged", "revised", "new")


def matches(report: DataFrame, config: RouterConfig) -> DataFrame:
    """(file, rank, source_file, score, excerpt): the best reranked sections of each file."""
    rows = dense.top_k(report.where("score is not null"), "file", config.matches, F.desc("score"), F.col("idx"))
    return rows.select("file", "rank", "source_file", F.round("score", 4).alias("score"), F.substring("matched", 1, 300).alias("excerpt"))


def response(verdicts: DataFrame, matched: DataFrame) -> DataFrame:
    """(file, json): a verdict with its best matches, as it is answered to whoever sent the file."""
    found = matched.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("rank", "source_file", "score", "excerpt"))).alias("matches"))
    rows = verdicts.join(found, "file", "left")
    fields = [c for c in verdicts.columns if c != "file"]
    return rows.select("file", F.to_json(F.struct(*fields, F.coalesce("matches", F.array().cast(found.schema["matches"].dataType)).alias("matches")), {"ignoreNullFields": "false"}).alias("json"))


def route(docs: DataFrame, key: str, store: DataFrame, config: RouterConfig | None = None, make: Callable = dense.HashedEmbedder, rerank: Callable = dense.LexicalReranker) -> tuple[DataFrame, DataFrame]:
    """(verdicts, report) of documents (key, text) against a store."""
    config = config or RouterConfig.app()
    parts = sections(docs.withColumn("file", F.col(key).cast("string")), "file").withColumnRenamed("content", "section")
    found = hits(parts, store, config.top_k, make, rerank)
    report = written(classify(parts, found, config), "report")
    return verdicts(report, found, config), report
