"""BM25 against plain sums over every pair, whatever the bounds leave out."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from overscribe.functions import text as tx
from overscribe.operators import lexical, signals

ODD = ["Ab1 c-d É x", "海洋學院 abc 海 x海x", "", None, "İstanbul K", "a" * 5000 + " " + "b " * 3000]


def test_terms_are_those_of_the_text_function(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    want = {r.i: r.w or [] for r in df.select("i", tx.tokens("t").alias("w")).collect()}
    assert want == {i: lexical.terms_of(t) for i, t in enumerate(ODD)}
    got = {r.i: (r.n_terms, {x.term: x.tf for x in r.terms}) for r in lexical.counted(df, F.col("t"), "i").collect()}
    assert got == {i: (len(w), dict(Counter(w))) for i, w in want.items()}
    few = {r.i: (r.n_terms, {x.term: x.tf for x in r.terms}) for r in lexical.counted(df, F.col("t"), "i", among=["b", "海洋"]).collect()}
    assert few == {i: (len(w), {t: n for t, n in Counter(w).items() if t in ("b", "海洋")}) for i, w in want.items()}


def plain(docs, queries):
    """{(query, doc): score} of all pairs that share a term."""
    counts = {i: Counter(lexical.terms_of(t)) for i, t, _, _ in docs}
    n, size = len(docs), {i: sum(c.values()) for i, c in counts.items()}
    avg = sum(size.values()) / n
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    weight = lambda t, tf, length: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))
    out = {}
    for q, text, _ in queries:
        c = Counter(lexical.terms_of(text))
        own = sum(weight(t, f, sum(c.values())) for t, f in c.items() if t in idf) or 1.0
        for i, d in counts.items():
            if any(t in d for t in c):
                out[q, i] = sum(weight(t, d[t], size[i]) for t in c if t in d) / own
    return out


def corpus(seed=1, n=400):
    """Words by Zipf's law, so that the first are in most documents; copies, short and very long ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    draw = lambda m: " ".join(rng.choices(words, [1 / (i + 1) for i in range(600)], k=m))
    docs = [(f"d{i}", draw(rng.choice([3, 20, 60, 400])), f"2020-01-{i % 28 + 1:02d}", f"{i:05d}") for i in range(n)]
    docs += [(f"d{n + j}", docs[7][1], "2020-01-05", f"{n + j:05d}") for j in range(12)] + [(f"d{n + 12}", "", "2020-01-01", "x")]
    queries = [(f"q{j}", draw(rng.choice([1, 5, 30])), rng.choice(["2020-01-02", "2020-01-15", "9999-12-31"])) for j in range(25)]
    return docs, [*queries, ("q-copy", docs[7][1], "9999-12-31"), ("q-stop", "w0 w1", "9999-12-31"), ("q-none", "zzz", "9999-12-31"), ("q-empty", "", "9999-12-31"), ("q-first", "w0 w5", "2019-12-31")]


@pytest.mark.parametrize(("k", "share", "first"), [(1, 0.4, 256), (5, 0.4, 4), (12, 0.95, 256), (5, 0.0, 1), (1000, 0.4, 256)])
def test_top_k_is_exact(spark, monkeypatch, k, share, first):
    monkeypatch.setattr(lexical, "LEFT_OUT", share)
    monkeypatch.setattr(lexical, "FIRST_ROUND", first)
    docs, queries = corpus()
    d, q = spark.createDataFrame(docs, "id string, text string, date string, pos string"), spark.createDataFrame(queries, "q string, text string, until string")
    rows = lexical.asked(q, "q", F.col("text"), "until")
    library = lexical.Counted.of(d, F.col("text"), "id", "pos", "date", among=rows)
    got = lexical.top_k(library, lexical.known(library, rows, "q", "until"), "q", "id", "pos", k, F.col("date") < F.col("until"), ("until",), ("date",)).collect()
    scores, at = plain(docs, queries), {i: (date, pos) for i, _, date, pos in docs}
    want = set()
    for name, _, until in queries:
        able = sorted((-round(s, 6), at[i][1], i) for (x, i), s in scores.items() if x == name and at[i][0] < until)
        want |= {(name, i, r + 1, -s) for r, (s, _, i) in enumerate(able[:k])}
    assert {(r.q, r.id, r["rank"], r.bm25) for r in got} == want


def test_scores_and_index(spark):
    docs, queries = corpus(2, 60)
    d, q = spark.createDataFrame(docs, "id string, text string, date string, pos string"), spark.createDataFrame(queries, "q string, text string, until string")
    got = {(r.q, r.id): r.bm25 for r in lexical.scores(q, "q", F.col("text"), d, "id", F.col("text")).collect()}
    want = plain(docs, queries)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)
    postings, terms = lexical.index(d, "id", F.col("text"))
    sums = {r.term: r.w for r in postings.groupBy("term").agg(F.sum("weight").alias("w")).collect()}
    assert sums == pytest.approx({r.term: r.weight for r in terms.collect()})


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "case_id string, case_title string, case_text string, case_date string")
    empty = spark.createDataFrame([], "doc_id string, title string, text string, date string, pos string")
    one = spark.createDataFrame([("a", "x", "y", "2020-01-01", "p")], "doc_id string, title string, text string, date string, pos string")
    case = spark.createDataFrame([("c", "x", "y", "2021-01-01")], none.schema)
    assert signals.bm25(none, one).collect() == [] == signals.bm25(case, empty).collect()
    assert [(r.doc_id, r["rank"]) for r in signals.bm25(case, one).collect()] == [("a", 1)]
