"""The language-model judge as an interface: prompts, replies, and a cache of replies by request."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import LABELS
from .dense import top_k

CANDIDATES = 5
#: Characters of an incoming document and of a candidate that an example shows.
EXAMPLE_CHARS, EXAMPLE_CANDIDATE_CHARS = 600, 250
#: The task as it is put to a model, with and without a library.
SYSTEM = (
    "An announcement comes in. Say UPDATE if it replaces one of the existing documents, REDUNDANT if one of them says the same already, and NEW otherwise. "
    'Answer with a JSON object: rationale, label, target (C1 to C5, or NONE), confidence (0 to 1).'
)
SYSTEM_ALONE = (
    "An announcement comes in. Say UPDATE if it reads like a new version of an earlier one, REDUNDANT if it reads like a repetition, and NEW otherwise. "
    "Answer with a JSON object: rationale, label, confidence (0 to 1)."
)
MESSAGES = "array<struct<role:string,content:string>>"


class Judge(Protocol):
    def __call__(self, requests: DataFrame) -> DataFrame:
        """(case_id, key, messages) -> (key, content, latency_s, prompt_tokens, output_tokens), a row a key."""


class ReplayJudge:
    """Answers from recorded replies only; a request that is not recorded is an error row."""

    def __init__(self, calls: DataFrame) -> None:
        self.calls = calls.select("key", "content", "cost.*")

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.select("key").distinct().join(self.calls, "key", "left")


def latest_calls(calls: DataFrame, order: str) -> DataFrame:
    """One row a key: later recordings win."""
    return calls.groupBy("key").agg(F.max_by(F.struct("content", "cost"), order).alias("c")).select("key", "c.*")


def misses(requests: DataFrame, calls: DataFrame) -> DataFrame:
    return requests.join(calls.select("key"), "key", "left_anti")


def prompts(cases: DataFrame, candidates: DataFrame, in_chars: int | None = None, cand_chars: int | None = None) -> DataFrame:
    """case_id, prompt, candidates (doc_ids, best first) from (case_id, case_title, case_date, case_text) and (case_id, rank, doc_id, title, date, text)."""
    block = tx.render_doc(F.col("title"), F.col("date"), F.col("text"), cand_chars)
    few = candidates.where(F.col("rank") <= CANDIDATES).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", block.alias("block")))).alias("c"))
    rows = cases.join(few, "case_id", "left")
    blocks = F.coalesce(F.col("c.block"), F.array().cast("array<string>"))
    incoming = tx.render_doc(F.col("case_title"), F.col("case_date"), F.col("case_text"), in_chars)
    return rows.select("case_id", tx.render_prompt(incoming, blocks).alias("prompt"), F.coalesce(F.col("c.doc_id"), F.array().cast("array<string>")).alias("candidates"))


def predictions(requests: DataFrame, replies: DataFrame, with_target: bool = True) -> DataFrame:
    """case_id, label, target, json, error_kind, confidence: a reply that fails or does not fit counts as NEW."""
    rows = requests.join(replies, "key", "left").withColumn("r", tx.parse_reply("content", with_target))
    ok = F.col("content").isNotNull() & (F.col("r.quality") != "invalid")
    k = F.regexp_extract("r.target", r"^C(\d)$", 1)
    target = F.when(ok & (F.col("r.label") != "NEW") & (k != ""), F.try_element_at("candidates", k.try_cast("int")))
    kind = F.when(F.col("content").isNull(), "request_failed").when(~ok, "invalid_json")
    return rows.select("case_id", F.when(ok, F.col("r.label")).otherwise("NEW").alias("label"), target.alias("target"), F.when(ok, F.col("r.quality")).alias("json"), kind.alias("error_kind"), "r.confidence")


def exemplars(dev: DataFrame, candidates: DataFrame) -> DataFrame:
    """gold_label, case_id, why, target (Ck or NONE): the first usable development case of each label.

    dev: case_id, pos, gold_label, targets (array), notes, kb_size. Usable: a
    written reason, a library, and unless it is NEW a target among the candidates.
    """
    ranks = dev.select("case_id", F.explode("targets").alias("doc_id")).join(candidates.where(F.col("rank") <= CANDIDATES).select("case_id", "doc_id", "rank"), ["case_id", "doc_id"])
    ranks = ranks.groupBy("case_id").agg(F.min("rank").alias("k"))
    rows = dev.withColumn("why", tx.reason("notes")).where("why <> '' and kb_size > 0").join(ranks, "case_id", "left")
    rows = rows.where((F.col("gold_label") == "NEW") | F.col("k").isNotNull())
    target = F.when(F.col("gold_label") == "NEW", "NONE").otherwise(F.concat(F.lit("C"), F.col("k").cast("string")))
    return top_k(rows.withColumn("target", target), "gold_label", 1, F.col("pos")).select("gold_label", "case_id", "why", "target")


def example_messages(dev: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row, messages: for each label, in the order of LABELS, its exemplar as a question and the right answer.

    dev: as for :func:`exemplars` and :func:`prompts`. Labels without a usable case have none, so the array may be empty.
    """
    chosen = exemplars(dev, candidates)
    shown = prompts(dev.join(chosen.select("case_id"), "case_id", "left_semi"), candidates, EXAMPLE_CHARS, EXAMPLE_CANDIDATE_CHARS)
    answer = F.to_json(F.struct(F.col("why").alias("rationale"), F.col("gold_label").alias("label"), "target", F.lit(0.9).alias("confidence")))
    pair = F.array(_message("user", F.col("prompt")), _message("assistant", answer))
    place = F.array_position(F.array(*map(F.lit, LABELS)), F.col("gold_label"))
    rows = chosen.join(shown.select("case_id", "prompt"), "case_id").select(F.struct(place.alias("i"), pair.alias("m")).alias("p"))
    return rows.agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["m"])).cast(MESSAGES).alias("messages"))  # one row a label at most


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def requests(cases: DataFrame, candidates: DataFrame | None = None, examples: DataFrame | None = None, model: str = "") -> DataFrame:
    """(case_id, key, messages, candidates): one request a case. Without ``candidates`` the judge sees the incoming document alone."""
    if candidates is None:
        incoming = tx.render_doc(F.col("case_title"), F.col("case_date"), F.col("case_text"), None)
        rows = cases.select("case_id", incoming.alias("prompt"), F.array().cast("array<string>").alias("candidates"))
    else:
        rows = prompts(cases, candidates)
    system = F.array(_message("system", F.lit(SYSTEM_ALONE if candidates is None else SYSTEM)))
    shown = F.array().cast(MESSAGES)
    if examples is not None:
        rows = rows.crossJoin(F.broadcast(examples.select(F.col("messages").alias("_shown"))))  # one row
        shown = F.col("_shown")
    messages = F.concat(system, shown, F.array(_message("user", F.col("prompt"))))
    rows = rows.select("case_id", messages.alias("messages"), "candidates")
    return rows.select("case_id", tx.request_key(F.struct(F.lit(model).alias("model"), "messages")).alias("key"), "messages", "candidates")


def decide(cases: DataFrame, judge: Judge, candidates: DataFrame | None = None, examples: DataFrame | None = None, model: str = "") -> DataFrame:
    """The judge as a method: :func:`predictions` of its replies. No candidates: a label without a target."""
    asked = requests(cases, candidates, examples, model)
    return predictions(asked, judge(asked), candidates is not None)


def cascade(rules: DataFrame, cases: DataFrame, judge: Judge, candidates: DataFrame, examples: DataFrame | None = None, model: str = "") -> DataFrame:
    """(case_id, label, target, escalated): what the rules (of methods.cascade_rule) leave open is put to the judge; nothing else is."""
    asked = decide(cases.join(rules.where("escalated").select("case_id"), "case_id", "left_semi"), judge, candidates, examples, model)
    ruled = rules.where("not escalated").select("case_id", "label", "target", "escalated")
    return ruled.union(asked.select("case_id", "label", "target", F.lit(True)))


def quality_counts(rows: DataFrame, by: str, quality: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("asked"), *(F.count_if(quality == q).alias(q) for q in ("valid", "recovered", "invalid")))


def change_request(sections: DataFrame, per_file: int = 3) -> DataFrame:
    """The first revised sections of each file (file, idx, section, matched), with the prompt that asks what changed."""
    rows = top_k(sections.where("status = 'REVISED'"), "file", per_file, F.col("idx"))
    prompt = F.concat(F.lit("OLD TEXT\n"), F.coalesce("matched", F.lit("")), F.lit("\n\nNEW TEXT\n"), F.col("section"), F.lit("\n\nSay whether the change is SUBSTANTIVE or COSMETIC, and give the old and the new value."))
    return rows.select("file", "idx", prompt.alias("prompt"))
