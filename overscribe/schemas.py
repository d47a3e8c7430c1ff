"""Data model: row types, labels and the parameters of the decision methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The answers, in the order in which ties and tables take them.
LABELS = ["UPDATE", "NEW", "REDUNDANT"]
UPDATE, NEW, REDUNDANT = LABELS
#: Flag words of annotators' notes.
FLAGS = ["unsure", "template_trap", "reworded", "translation", "old_predecessor"]
#: Outcomes of an answer; the last four are the mistakes, in the order in which ties take them.
OUTCOMES = ["correct_update", "correct_new", "correct_redundant", "false_update", "missed_update", "wrong_target", "other"]

_LINK = T.StructType().add("href", "string").add("label", "string")
_FILE = T.StructType().add("url", "string").add("label", "string").add("ext", "string")
BULLETIN = (
    T.StructType().add("doc_id", "string").add("source", "string").add("sn", "integer").add("url", "string").add("title", "string").add("date", "string").add("author", "string").add("text", "string")
    .add("links", T.ArrayType(_LINK)).add("attachments", T.ArrayType(_FILE))
)
CASE = T.StructType().add("case_id", "string").add("corpus", "string").add("doc_id", "string").add("date", "string").add("pool", "string").add("candidates", T.ArrayType(T.StringType()))
MANIFEST = T.StructType().add("case_id", "string").add("doc_id", "string").add("date", "string").add("file", "string").add("kind", "string").add("chars", "integer").add("note", "string")
EVENT = (
    T.StructType().add("seq", "long").add("action", "string").add("batch", "string").add("doc", BULLETIN).add("vector", T.ArrayType(T.DoubleType()))
    .add("target", "string").add("by", "string").add("doc_ids", T.ArrayType(T.StringType()))
)
CALL = T.StructType().add("key", "string").add("content", "string").add("cost", T.StructType().add("latency_s", "double").add("prompt_tokens", "integer").add("output_tokens", "integer"))
VERDICT = T.StructType().add("rationale", "string").add("label", "string").add("target", "string").add("confidence", "double")
CHANGE = T.StructType().add("change_type", "string").add("summary", "string").add("old_value", "string").add("new_value", "string")


@dataclass(frozen=True)
class RouterConfig:
    """Section router. any_change: a document with any revised or new section is an update."""

    threshold: float = 0.50
    identical: float = 0.95
    top_k: int = 5
    matches: int = 3
    any_change: bool = False

    @classmethod
    def app(cls) -> RouterConfig:
        return cls()

    @classmethod
    def prototype(cls) -> RouterConfig:
        return cls(threshold=0.30, any_change=True)
