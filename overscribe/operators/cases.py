"""Cases with what belongs to them: their files' texts and the documents that they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters from which an attachment's text is taken for readable.
MIN_CHARS = 200


def readable_or(text: Column, ext: Column, fallback: Column) -> Column:
    """struct(text, kind, note): the attachment's text if it is long enough, else the fallback with a note that says why.

    A null text is an attachment that is missing: it needs no note.
    """
    n = F.length(text)
    return F.when(n >= MIN_CHARS, F.struct(text.alias("text"), F.concat(F.lit("attachment-"), ext).alias("kind"), F.lit("").alias("note"))).otherwise(
        F.struct(
            fallback.alias("text"),
            F.lit("bulletin-md").alias("kind"),
            F.coalesce(F.concat(ext, F.lit(" has only "), n.cast("string"), F.lit(" characters of text (scan?)")), F.lit("")).alias("note"),
        )
    )


def with_bulletins(cases: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Cases (case_id, doc_id) with the title, date and text of the document that each is about; a case without one goes."""
    return cases.join(bulletins.select("doc_id", "title", "date", "text"), "doc_id")


def assemble(cases: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Cases with the file that the manifest (case_id, file, kind) names and its title and text; cases without a readable file go."""
    named = manifest.select("case_id", "file", "kind")
    return cases.join(named, "case_id").join(files.select("file", "title", "text").where("coalesce(text, '') <> ''"), "file")
