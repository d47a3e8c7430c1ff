"""The library: its order, what is older than a query, and its log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranks import running


def position(date: str = "date", doc_id: str = "doc_id") -> Column:
    """Sorts as (date, doc_id as text): one text, so that no global numbering of all rows is needed."""
    return F.concat_ws("|", F.col(date), F.col(doc_id).cast("string"))


def usable(docs: DataFrame) -> DataFrame:
    """Documents with a title or a text, and with a date."""
    return docs.where(((F.coalesce("title", F.lit("")) != "") | (F.coalesce("text", F.lit("")) != "")) & ~F.col("date").startswith("0000"))


def from_documents(docs: DataFrame) -> DataFrame:
    """doc_id, title, text, date, pos of plain documents: four share a day, as their ids go."""
    day = F.date_format(F.date_add(F.lit("2015-01-01"), F.expr("cast(doc_id div 4 as int)")), "yyyy-MM-dd")
    # Bound by a generator: a filter below would split every text once more.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), day.alias("date"), F.explode(F.array(tx.title_and_text("text"))).alias("_t"))
    return usable(rows.select("doc_id", "_t.title", "_t.text", "date", position().alias("pos")))


def before(cases: DataFrame, library: DataFrame, case_date: str = "case_date") -> DataFrame:
    """Pairs of a case and what is dated strictly before it: the theta join. Cases are the small side."""
    return library.join(cases, library.date < cases[case_date])


def with_kb_size(asked: DataFrame, library: DataFrame, at: str = "case_date") -> DataFrame:
    """The rows with kb_size, the number of documents dated strictly before ``at``; 0 where that is null.

    Days of the library and days asked for are put in one order, in which those
    asked for come first; a running sum tells how many documents are older. No
    day meets another one.
    """
    days = library.where("date is not null").groupBy(F.col("date").alias("_d")).agg(F.lit(1).alias("_k"), F.count("*").alias("_n"))
    wanted = asked.where(F.col(at).isNotNull()).select(F.col(at).alias("_d"), F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_n")).distinct()
    sums = running(wanted.union(days), [], [F.col("_d"), F.col("_k")], kb_size=F.col("_n")).where("_k = 0").select("_d", "kb_size")
    out = asked.join(sums, F.col(at) == F.col("_d"), "left").drop("_d")
    return out.withColumn("kb_size", F.coalesce("kb_size", F.lit(0)).cast("long"))


def facts(events: DataFrame) -> dict[str, tuple[str, DataFrame]]:
    """What counts of a log, name -> (key, rows): of each key the row with the largest ``at``.

    Facts of two parts of a log make those of the whole by the same rule, in
    whatever order the parts come, and if one comes twice.
    """
    undo = events.where("action = 'undo'")
    last = events.where("action = 'replace'").groupBy(F.col("target").alias("doc_id")).agg(F.max_by("by", "seq").alias("by"), F.max("seq").alias("at"))
    return {
        "adds": ("seq", events.where("action = 'add'").withColumn("at", F.col("seq"))),
        "undone": ("batch", undo.groupBy("batch").agg(F.max("seq").alias("at"))),
        "last": ("doc_id", last),
        "taken": ("doc_id", undo.select(F.explode("doc_ids").alias("doc_id"), "seq").groupBy("doc_id").agg(F.max("seq").alias("at"))),
    }


def settled(known: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(added: the add events that no later undo of their batch takes back; replaced: doc_id, replaced_by), by the facts of a log."""
    undone = known["undone"].select(F.col("batch").alias("_b"), F.col("at").alias("_s"))
    adds = known["adds"].drop("at")
    added = adds.join(undone, (F.col("batch") == F.col("_b")) & (F.col("_s") > F.col("seq")), "left_anti")
    taken = known["taken"].select(F.col("doc_id").alias("_d"), F.col("at").alias("_s"))
    replaced = known["last"].join(taken, (F.col("by") == F.col("_d")) & (F.col("_s") > F.col("at")), "left_anti")
    return added, replaced.select("doc_id", F.col("by").alias("replaced_by"))


def live(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, replaced) of a log, as :func:`settled` gives them.

    The last replacement of a target counts. If a later undo lists the one that
    replaced it, the target is current again; an earlier one is not restored.
    """
    return settled({name: rows for name, (_, rows) in facts(events).items()})


def replay(library: DataFrame, events: DataFrame) -> DataFrame:
    """The library after its log: added documents are appended, replaced ones are marked."""
    return with_changes(library, *live(events))


def with_changes(library: DataFrame, added: DataFrame, replaced: DataFrame) -> DataFrame:
    new = added.select("doc.*", F.concat(F.lit("~"), F.lpad(F.col("seq").cast("string"), 20, "0")).alias("pos"))
    docs = library.unionByName(new.select(*[c for c in new.columns if c in library.columns]), allowMissingColumns=True)
    return docs.join(replaced, "doc_id", "left")


def current(library: DataFrame) -> DataFrame:
    return library.where(F.col("replaced_by").isNull())


def change_events(decided: DataFrame, known: DataFrame) -> DataFrame:
    """The events of decisions (label, target, title, text, date, batch, seq): an add, and a replace for an UPDATE.

    REDUNDANT adds nothing; neither does a text that the library already has,
    which its id, a hash of its content, tells.
    """
    rows = decided.where("label <> 'REDUNDANT'").withColumn("doc_id", tx.file_doc_id("title", "text"))
    rows = rows.join(known.select("doc_id"), "doc_id", "left_anti")
    doc = F.struct("doc_id", F.lit("your_file").alias("source"), "title", "date", "text")
    add = rows.select((2 * F.col("seq")).alias("seq"), F.lit("add").alias("action"), "batch", doc.alias("doc"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("by"))
    swap = rows.where("label = 'UPDATE' and target is not null").select((2 * F.col("seq") + 1).alias("seq"), F.lit("replace").alias("action"), "batch", F.lit(None).cast(add.schema["doc"].dataType).alias("doc"), "target", F.col("doc_id").alias("by"))
    return add.union(swap)


def undo_last(events: DataFrame, seq: int) -> DataFrame:
    """The undo event of the last batch that is not undone; no row if there is none."""
    done = events.where("action = 'undo'").select("batch")
    adds = events.where("action = 'add'").join(done, "batch", "left_anti")
    last = adds.groupBy("batch").agg(F.max("seq").alias("at"), F.collect_list("doc.doc_id").alias("doc_ids")).orderBy(F.desc("at")).limit(1)
    return last.select(F.lit(seq).cast("long").alias("seq"), F.lit("undo").alias("action"), "batch", F.sort_array("doc_ids").alias("doc_ids"))


def history(events: DataFrame) -> DataFrame:
    """seq, batch, line: what each event did."""
    line = (
        F.when(F.col("action") == "add", F.concat(F.lit("added "), F.col("doc.doc_id"), F.lit("  "), F.coalesce("doc.title", F.lit(""))))
        .when(F.col("action") == "replace", F.concat(F.lit("replaced "), F.col("target"), F.lit(" by "), F.col("by")))
        .otherwise(F.concat(F.lit("undid "), F.col("batch")))
    )
    return events.select("seq", "batch", line.alias("line"))
