"""Toxicity by a lexicon trie crossed with Levenshtein automata, and a score of the context.

The lexicon is mined from labelled texts: whole words, and stems that take many
endings, whose texts are toxic far more often than others. Its trie and the
Levenshtein automata of its terms run as one product automaton: a state is the
set of trie nodes reached, each with its least number of edits, and states are
made deterministic as texts need them. So a word is checked against all terms
at once, in one step per letter, and most words die after a few letters.

Each hit is then seen in its window of words: between quotation marks, or near a
word of reporting, it counts as quoted, else as abuse. A logistic regression on
these counts gives the score. Labels, language, source and doc_id are no input.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import DOC_COLUMNS, in_batches, materialize

#: Labelled documents, at most, from which lexicon and weights are learned: those with the least hash of their doc_id.
SAMPLE = 20_000
#: Terms of the lexicon at most, and candidates for it that the driver sees at most.
TERMS, CANDIDATES = 512, 8_000
#: Lengths of stems.
STEMS = range(4, 10)
#: Words to each side of a hit that make its context.
WINDOW = 8
#: Words of which each task keeps the verdict, and deterministic states it keeps.
MEMO, STATES = 150_000, 5_000

QUOTES = "\"“”„«»‚‘’‹›"
EDGES = string.punctuation + QUOTES + "…–—¡¿"
#: Fixed value: words of reporting, in the languages of the corpus.
REPORTING = frozenset("said says wrote called quoted quote quoting sagte schrieb zitat dit écrit cite dijo escribió cita".split())

FEATURES = ("log_abuse", "any_abuse", "log_quoted", "density", "strength", "cluster")


def edits(term: str, stem: bool) -> int:
    """Edits that a term forgives. A stem, which any ending may follow, has to be longer for that."""
    n = len(term) - stem
    return 0 if n < 5 else 1 if n < 9 else 2


def weight(e: int) -> float:
    """What a hit with so many edits counts."""
    return 1 / (1 + e)


@dataclass
class Lexicon:
    """terms: (text, is_stem, strength). A stem matches any word that it begins. harmless: words that are no misspelling."""

    terms: list[tuple[str, bool, float]]
    harmless: frozenset[str] = frozenset()
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])

    def __post_init__(self) -> None:
        for i, (term, _, _) in enumerate(self.terms):
            at = 0
            for c in term:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.ends.append([])
                at = self.nodes[at][c]
            self.ends[at].append(i)
        # The most edits that any term below a node forgives: what can't be forgiven any more is dropped at once.
        self.room = [-1] * len(self.nodes)
        for at in reversed(range(len(self.nodes))):  # children come after their parents
            below = [edits(*self.terms[i][:2]) for i in self.ends[at]] + [self.room[x] for x in self.nodes[at].values()]
            self.room[at] = max(below, default=-1)
        self.forget()

    def forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.found: list[tuple] = []
        self.start = self._id({0: 0})

    def _id(self, state: dict[int, int]) -> int:
        todo = list(state.items())
        while todo:  # letters of a term that the word leaves out
            at, e = todo.pop()
            for x in self.nodes[at].values():
                if e < self.room[x] and e + 1 < state.get(x, 99):
                    state[x] = e + 1
                    todo.append((x, e + 1))
        key = frozenset(state.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            hits = [(e, i) for at, e in key for i in self.ends[at] if e <= edits(*self.terms[i][:2])]
            self.found.append((min((h for h in hits if self.terms[h[1]][1]), default=None), min(hits, default=None)))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(at: int, e: int) -> None:
            if e <= self.room[at] and e < out.get(at, 99):
                out[at] = e

        for at, e in self.sets[state]:
            put(at, e + 1)  # a letter that the term does not have
            for x, to in self.nodes[at].items():
                put(to, e + (x != c))
        out = self._id(out)
        self.steps[state, c] = out
        return out

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best term within its edits of the word, or of one of its beginnings for a stem."""
        best = self._find(word)
        return None if best is not None and best[0] and word in self.harmless else best

    def _find(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > STATES:
            self.forget()
        state, best, steps = self.start, None, self.steps
        for c in word:
            to = steps.get((state, c))
            state = self._step(state, c) if to is None else to
            if not self.sets[state]:
                return best
            if (stem := self.found[state][0]) is not None and (best is None or stem < best):
                best = stem
        whole = self.found[state][1]
        return whole if whole is not None and (best is None or whole < best) else best


def words_of(text: str) -> tuple[list[str], list[str]]:
    """(pieces between white space, the same without marks at their edges), in lower case."""
    raw = text.lower().split()
    return raw, [w.strip(EDGES) for w in raw]


class Reader:
    """Features of a text."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.memo = lexicon, {}

    def __call__(self, text: str) -> list[float]:
        raw, words = words_of(text)
        memo, find = self.memo, self.lexicon.find
        if len(memo) > MEMO:
            memo.clear()
        distinct = set(words)
        for w in distinct.difference(memo):
            memo[w] = find(w)
        if not any(map(memo.__getitem__, distinct)):
            return [0.0] * len(FEATURES)
        hits = [(i, *h) for i, w in enumerate(words) if (h := memo[w]) is not None]
        mass = most = strength = 0.0
        quoted, places = 0, []
        for i, e, term in hits:
            if self.quoted(raw, words, i):
                quoted += 1
                continue
            mass, most = mass + weight(e), max(most, weight(e))
            strength = max(strength, self.lexicon.terms[term][2] * weight(e))
            places.append(i)
        cluster, j = 0, 0
        for i, at in enumerate(places):
            while at - places[j] > 2 * WINDOW:
                j += 1
            cluster = max(cluster, i - j + 1)
        return [math.log1p(mass), most, math.log1p(quoted), mass / (len(words) + 20), strength, math.log1p(max(0, cluster - 1))]

    @staticmethod
    def quoted(raw: list[str], words: list[str], i: int) -> bool:
        before, after = raw[max(0, i - WINDOW) : i], raw[i + 1 : i + 1 + WINDOW]
        word = raw[i]
        opens = word[:1] in QUOTES or any(w[:1] in QUOTES and w[-1:] not in QUOTES for w in before)
        closes = word[-1:] in QUOTES or word.rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES and w[:1] not in QUOTES for w in after)
        return opens and closes or (opens or closes) and any(w in REPORTING for w in words[max(0, i - WINDOW) : i])


def _pick(counts: dict[tuple[str, bool], tuple[int, int]], texts: list[list[tuple[str, bool]]], pos: int, neg: int) -> list[tuple[str, bool, float]]:
    """Terms of the candidates (term, stem): (positive texts, negative texts).

    Those that many toxic texts have are kept; others, which may only go along
    with them, as long as they are the ones that explain a further text best.
    """
    having: dict[tuple[str, bool], set[int]] = {}
    for i, found in enumerate(texts):
        for k in found:
            having.setdefault(k, set()).add(i)

    def longest(key: tuple[str, bool]) -> tuple[str, bool]:
        """The longest continuation that has the same texts."""
        same = [k for k, v in having.items() if k[0].startswith(key[0]) and len(v) >= 0.97 * len(having[key])] if key[1] else [key]
        return max(same, key=lambda k: (len(k[0]), not k[1], k[0]))

    left, terms = set(range(len(texts))), set()
    often = max(6, 0.025 * pos)

    def add(key: tuple[str, bool]) -> None:
        left.difference_update(having[key])
        if not any(key[0].startswith(t) if s else key[0] == t for t, s in terms):
            terms.add(longest(key))

    for key in sorted((k for k, v in having.items() if len(v) >= often), key=lambda k: (len(k[0]), not k[1], k[0])):
        add(key)
    while having and len(terms) < TERMS:
        key = max(having, key=lambda k: (len(having[k] & left), -len(having[k]), k))
        if len(having[key] & left) < 3:
            break
        add(key)
    strength = {k: math.log((counts[k][0] + 0.5) / (pos + 1)) - math.log((counts[k][1] + 0.5) / (neg + 1)) for k in terms}
    return sorted((t, s, strength[t, s]) for t, s in terms)[:TERMS]


def _keys(text: str) -> set[tuple[str, bool]]:
    found = {w for w in words_of(text or "")[1] if len(w) > 2 and w.isalpha()}
    return {(w, False) for w in found} | {(w[:n], True) for w in found for n in STEMS if n < len(w)}


def mine(sample: DataFrame) -> Lexicon:
    """The lexicon of (text, toxic) rows. Texts are counted on the executors; what the driver gets is bounded by SAMPLE and CANDIDATES."""

    def run(batches):
        counts: dict[bool, Counter] = {False: Counter(), True: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[bool(toxic)].update(_keys(text))
        keys = list(counts[True].keys() | counts[False].keys())
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            cols = [pa.array([k[0] for k in part]), pa.array([k[1] for k in part]), *(pa.array([counts[b][k] for k in part], pa.int64()) for b in (True, False))]
            yield pa.RecordBatch.from_arrays(cols, ["term", "stem", "pos", "neg"])

    pos, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    neg = n - pos
    if not pos or not neg:
        return Lexicon([])
    rows = in_batches(sample.select("text", "toxic"), run, "term string, stem boolean, pos long, neg long")
    rows = rows.groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3")
    # Toxic most of the time, and by a likelihood ratio that chance hardly gives.
    share, base = (F.col("pos") + 0.5) / (F.col("pos") + F.col("neg") + 1), pos / n
    ratio = F.col("pos") * F.log(share / base) + F.col("neg") * F.log((1 - share) / (1 - base))
    rows = rows.where((share >= max(0.8, base + 0.7 * (1 - base))) & (ratio >= 4)).orderBy(ratio.desc(), "term", "stem").limit(CANDIDATES)
    counts = {(r.term, r.stem): (r.pos, r.neg) for r in rows.collect()}

    def having(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[{"term": t, "stem": s} for t, s in sorted(_keys(x) & counts.keys())] for x in batch.column(0).to_pylist()], pa.list_(pa.struct([("term", pa.string()), ("stem", pa.bool_())])))], ["found"])

    texts = in_batches(sample.where("toxic = 1").select("text"), having, "found array<struct<term:string,stem:boolean>>").collect()
    terms = _pick(counts, [[(x.term, x.stem) for x in r.found] for r in texts], pos, neg)

    def alike(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            words = {w for x in batch.column(0).to_pylist() for w in words_of(x or "")[1]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(w for w in words if (h := lexicon.find(w)) and h[0]), pa.string())], ["word"])

    clean = in_batches(sample.where("toxic = 0").select("text"), alike, "word string").groupBy("word").count().orderBy(F.desc("count"), "word").limit(CANDIDATES)
    return Lexicon(terms, frozenset(r.word for r in clean.collect()))


def fit_rising(x: np.ndarray, y: np.ndarray, rising: list[int]) -> np.ndarray:
    """As fit(), with no weight below zero in these columns: a column that would get one is left out."""
    used = list(range(x.shape[1]))
    while True:
        w = fit(x[:, used], y)
        down = [(w[1 + i], c) for i, c in enumerate(used) if c in rising and w[1 + i] < 0]
        if not down:
            break
        used.remove(min(down)[1])
    out = np.zeros(x.shape[1] + 1)
    out[[0] + [1 + c for c in used]] = w
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression, the constant first, by Newton's method. times: how often each row counts."""
    x = np.hstack([np.ones((len(x), 1)), x])
    times = np.ones(len(x)) if times is None else times
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (times * p * (1 - p))[:, None]) + penalty, x.T @ (times * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id="doc_id"):
    """Rows of which no label is ever learned; a row without a doc_id has none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -30, 30)))


def _features(batch: pa.RecordBatch, column: int, read: Reader) -> np.ndarray:
    return np.array([read(t or "") for t in batch.column(column).to_pylist()], dtype=float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out, SAMPLE of them at most. Without both labels every score is low."""
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("_id"), "toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    # SAMPLE rows at most, over all cores that there are.
    sample = materialize(sample.dropDuplicates(), "toxic").repartition(max(16, docs.sparkSession.sparkContext.defaultParallelism))
    lexicon = mine(sample)

    def run(batches):
        read = Reader(lexicon)
        for batch in batches:
            x = _features(batch, 0, read)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(x.shape[1])), batch.column(1).cast(pa.int32())], [*FEATURES, "toxic"])

    rows = in_batches(sample, run, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").collect()  # SAMPLE rows of a few numbers
    data = np.array(sorted(tuple(r) for r in rows), dtype=float).reshape(-1, len(FEATURES) + 1)
    if not len(data) or data[:, -1].min() == data[:, -1].max():
        return Model(lexicon, np.array([-4.0] + [0.0] * len(FEATURES)))
    return Model(lexicon, fit_rising(data[:, :-1], data[:, -1], [i for i, f in enumerate(FEATURES) if f != "log_quoted"]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with one more column, score. A null or empty text has the score of a text without hits."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.terms, model.lexicon.harmless, model.weights))  # TERMS terms and CANDIDATES words at most
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches):
        terms, harmless, weights = shared.value
        own = Model(Lexicon(terms, harmless), weights)
        read = Reader(own.lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.score(_features(batch, at, read)))], [*batch.schema.names, "score"])

    return in_batches(docs, run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null or empty text scores as one without hits, rows that repeat the same
    each; without labels of both kinds nothing is toxic. Empty in, empty out.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score under 0.5, repeated ones too; a null or empty text scores as one without hits."""
    return scored(docs.select(*DOC_COLUMNS), train(docs, labels)).where("score < 0.5").select(*DOC_COLUMNS)
