"""Scans. Every schema is given, so that no pass over the data is spent on guessing it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..operators.library import position, usable


def bulletins(spark: SparkSession, path: str) -> DataFrame:
    """The dated bulletins with a title or a text, with their position."""
    return usable(spark.read.schema(schemas.BULLETIN).json(path)).withColumn("pos", position())


def cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CASE).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).json(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The library's log; empty if there is none yet. Its order is its column seq, not that of lines."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schemas.EVENT)
    return spark.read.schema(schemas.EVENT).json(path)


def calls(spark: SparkSession, path: str) -> DataFrame:
    """Recorded replies, one a request: the last in the file."""
    rows = spark.read.schema(schemas.CALL).json(path).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy("key").agg(F.max_by(F.struct("content", "cost"), "_at").alias("c")).select("key", "c.*")


def gold_rows(rows: DataFrame, order: str) -> DataFrame:
    """Rows with a label, the last of each case; labels are trimmed, in capitals, and known ones; targets are an array."""
    last = rows.where("coalesce(gold_label, '') <> ''").groupBy("case_id").agg(F.max_by(F.struct("gold_label", "gold_target", "notes", "annotator"), order).alias("r"))
    label = F.upper(F.trim("r.gold_label"))
    known = F.when(label.isin(schemas.LABELS), label).otherwise(F.raise_error(F.concat(F.col("case_id"), F.lit(": unknown label "), label)).cast("string"))
    target = F.trim(F.coalesce("r.gold_target", F.lit("")))
    return last.select("case_id", known.alias("gold_label"), target.alias("gold_target"), F.split(target, r"\|").alias("targets"), F.coalesce("r.notes", F.lit("")).alias("notes"), "r.annotator")


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """An answer key: CSV with a header, with or without a byte order mark."""
    schema = "case_id string, gold_label string, gold_target string, changed_field string, notes string, annotator string, seconds int"
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', enforceSchema=False)
    return gold_rows(rows.withColumn("_at", F.monotonically_increasing_id()), "_at")


def predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Test rows of runs' predictions.csv, with run (folder), code (first word of the condition) and the parsed info."""
    schema = "case_id string, split string, condition string, result string, gold string, gold_target string, pred string, pred_target string, title string, info string"
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    info = F.from_json(F.coalesce("info", F.lit("{}")), "latency_s double, prompt_tokens int, output_tokens int, json string, error_kind string, escalated boolean, confidence double")
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.where("split = 'test'").withColumns({"run": run, "code": F.split_part("condition", F.lit(" "), F.lit(1)), "info": info})


def run_infos(spark: SparkSession, path: str, codes: list[str]) -> DataFrame:
    """run, model, labels, free_json, conditions of results.md files; runs without a condition that asks a model go."""
    rows = spark.read.text(path, wholetext=True).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    model, labels = (F.nullif(F.regexp_extract("value", p, 1), F.lit("")) for p in (r"LLM: \*\*(.+?)\*\*", r"Labels: `(.+?)`"))
    n = sum(F.col("value").contains(f"| {c} ").cast("int") for c in codes)
    rows = rows.select("run", F.coalesce(model, F.lit("qwen3:4b")).alias("model"), F.coalesce(labels, F.lit("?")).alias("labels"), F.col("value").contains("JSON: free").alias("free_json"), n.alias("conditions"))
    return rows.where("conditions > 0 and run not in ('latest', 'old')")


def best_runs(infos: DataFrame) -> DataFrame:
    """For each model and kind of answer the run with the most conditions, the newest by name on ties."""
    from ..operators.metrics import first_seen

    return first_seen(infos, ["model", "free_json"], F.desc("conditions"), F.desc("run"))


#: The part of an office file that holds its text, and the elements that end a line.
OFFICE = {"docx": ("word/document.xml", {"p"}), "odt": ("content.xml", {"p", "h"})}


def _office_lines(node: ElementTree.Element, ends: set[str]) -> Iterator[str]:
    """The text below a node, with a line break where one of these elements ends. What XML has to escape stays escaped."""
    yield escape(node.text or "")
    for child in node:
        yield from _office_lines(child, ends)
        yield escape(child.tail or "")
    if node.tag.rpartition("}")[2] in ends:
        yield "\n"


def _parsed(name: str, data: bytes, page_break: str, any_kind: bool) -> str:
    """The text of a file by its kind; a kind that can't be read is an error, or plain text with any_kind."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in OFFICE and not (any_kind and kind == "odt"):
        member, ends = OFFICE[kind]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return "".join(_office_lines(ElementTree.fromstring(z.read(member)), ends))
    if kind == "pdf":
        try:
            import pypdf
        except ImportError as e:
            raise ValueError(f"no PDF reader is installed for {name}") from e
        return page_break.join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
    if any_kind or kind in ("txt", "md"):
        return data.decode("utf-8", "ignore")
    raise ValueError(f"can't read {name}: PDF, docx, odt, txt and md can be read")


def _read(spark: SparkSession, path: str, glob: str | None, page_break: str, any_kind: bool) -> DataFrame:
    """path, file, raw. Parsed in a plan node of its own: as a column, the parser could be drawn into the expressions below."""

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            yield pd.DataFrame({"path": x["path"], "file": x["file"], "raw": [_parsed(n, bytes(d), page_break, any_kind) for n, d in zip(x["file"], x["content"], strict=True)]})

    reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return rows.select("path", "file", "content").mapInPandas(parsed, "path string, file string, raw string")


def uploads(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, file, text as the router takes it: pages apart by a blank line, and any kind that is not known as UTF-8 without what is none."""
    return _read(spark, path, glob, "\n\n", True).withColumnRenamed("raw", "text")


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, file, title, text of document files. Plain ones are named by their first line, others by their name."""
    rows = _read(spark, path, glob, "\n", False)
    named = tx.title_and_text("raw")
    plain = F.lower(F.col("file")).rlike(r"\.(txt|md)$")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return rows.select("path", "file", F.when(plain, named["title"]).otherwise(stem).alias("title"), F.when(plain, named["text"]).otherwise(tx.squeeze("raw")).alias("text"))


def pages(rows: DataFrame, html: str = "html") -> DataFrame:
    """Bulletins from page sources: rows without a header go."""
    head = tx.page_header(html)
    body = tx.page_body(html)
    return rows.withColumns({"_h": head, "_b": body}).where("_h is not null").select(*[c for c in rows.columns if c != html], "_h.title", "_h.date", "_h.author", tx.html_to_text("_b").alias("text"), tx.links("_b").alias("links"))
