"""Title pairs against difflib over all pairs."""

import difflib
import random

import pytest

from overscribe.operators import signals
from overscribe.plans import REGISTRY
from overscribe.plans.common import cases, library


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def titles(seed, n):
    """Words in any order, titles a few edits apart, very short ones, ones of one character, and a long one."""
    rng = random.Random(seed)
    words = ["ocean", "grant", "call", "fellow", "exchange", "海洋", "學院", "abc", "xyz", "award", "aaaa"]
    out = {"a", "b", "ab", "ba", "abc", "abd", "aaaa", "aaab", "aaaaaaaa", "海", "海洋", "x" * 300, "x" * 290 + "y" * 10}
    while len(out) < n:
        t = "".join(rng.choices(words, k=rng.randint(1, 6)))
        out.add(t)
        for _ in range(2):
            s = list(t)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randint(0, 1)] = rng.choice("abcxyz海") * rng.randint(0, 1)
            out.add("".join(s) or "q")
    return sorted(out)


@pytest.mark.parametrize("least", [0.5, 0.7, 0.75, 0.9, 1.0])
def test_similar_titles_are_those_of_all_pairs(spark, least):
    a, b = titles(1, 120), titles(2, 160)
    frames = [spark.createDataFrame([(t,) for t in [*x, x[0], ""]], "title string") for x in (a, b)]
    got = signals.similar_titles(*frames, least).collect()
    want = {(x, y): ratio(x, y) for x in a for y in b if ratio(x, y) >= least}
    assert {(r.a, r.b): r.title_sim for r in got} == pytest.approx(want) and len(got) == len(want) > 3


def test_no_titles(spark):
    none, one = spark.createDataFrame([], "title string"), spark.createDataFrame([("abc",)], "title string")
    assert signals.similar_titles(none, one, 0.9).collect() == [] == signals.similar_titles(one, none, 0.5).collect()


def _normalised(spark, rows, title):
    from overscribe.functions import text as tx

    return rows.withColumn("t", tx.norm_title(title)).where("t <> ''").collect()


def test_m01_and_j10_whole(spark, data):
    docs = _normalised(spark, library(spark, data), "title")
    asked = _normalised(spark, cases(spark, data), "case_title")
    want = {(c.case_id, d.doc_id): round(ratio(c.t, d.t), 6) for c in asked for d in docs if d.date < c.case_date and ratio(c.t, d.t) >= 0.5}
    assert {(r.case_id, r.doc_id): r.title_sim for r in REGISTRY["m01_ratio"](spark, data).collect()} == pytest.approx(want)
    best = {}
    for d in docs:
        older = [ratio(o.t, d.t) for o in docs if o.date < d.date and 2 * min(len(o.t), len(d.t)) >= 0.9 * (len(o.t) + len(d.t))]
        if older and max(older) >= 0.9:
            best[d.doc_id] = round(max(older), 6)
    got = {r.doc_id: r.title_best for r in REGISTRY["j10_title_pairs"](spark, data).collect()}
    assert got == pytest.approx(best) and len(got) > 3


def test_matched_is_what_the_matcher_finds():
    from overscribe.functions.matching import matched

    rng = random.Random(3)
    for _ in range(500):
        letters = "abcdefghijklmnopqrst海"[: rng.choice([1, 2, 3, 5, 20])]
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in "ab")
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        least = rng.randint(0, 60)
        assert matched(a, b) == want and (a == b or matched(a, b, least) == (want if want >= least else -1))


def test_few_titles_of_one_language_are_read_to_their_end(monkeypatch):
    """Grams near their place tell titles of the same words apart, and lose none that is alike, however its places are moved."""
    import numpy as np

    left, in_order = [], signals._in_order
    monkeypatch.setattr(signals, "_in_order", lambda x, y, rows, cols, least: left.append(len(rows)) or in_order(x, y, rows, cols, least))
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 4))) for _ in range(120)]
    for tables in (1 << 25, 1 << 18):
        monkeypatch.setattr(signals, "TABLE", tables)
        x = ["".join(rng.choices(words, k=rng.randint(150, 160))) for _ in range(24)]
        y = [t[: rng.randint(0, 60)] + t[60:300] + "".join(rng.choices(words, k=rng.randint(0, 12))) + t[rng.randint(290, 320) :] for t in x]
        want = {(i, i) for i in range(24) if ratio(x[i], y[i]) >= 0.9}
        known = {}
        for _ in range(2):
            rows, cols = signals._may_be_alike(x, y, 0.9, np.ones((24, 24), bool), known)
            assert want <= set(zip(rows.tolist(), cols.tolist())) and len(want) > 10 and left[-1] < 50
        left.clear()


def test_long_texts_are_split_by_hashes(monkeypatch):
    from overscribe.functions import matching

    monkeypatch.setattr(matching, "CELLS", 300)
    monkeypatch.setattr(matching, "Corpus", None)  # the automaton took 34 s for two titles of 40,000 characters
    rng = random.Random(6)
    for letters in ("ab", "abcdefgh", "abcdefghijklmnopqrst海"):
        for _ in range(40):
            a = "".join(rng.choices(letters, k=rng.randint(30, 160)))
            b = "".join(c if rng.random() > 0.1 else rng.choice(letters) * rng.randint(0, 2) for c in a)
            assert matching.matched(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


@pytest.mark.parametrize("words", [32, 0])
def test_long_titles_of_the_same_grams(monkeypatch, words):
    """Titles of one language share nearly all grams: only few pairs may be left whose blocks are worked out, and all that count."""
    import numpy as np

    monkeypatch.setattr(signals, "WORDS", words)
    rng = random.Random(4)
    x = ["".join(rng.choices(["the", "re", "an", "tion", "ou"], k=130)) for _ in range(40)]
    y = [t[:150] + "q" * rng.randint(0, 30) + t[150 + rng.randint(0, 40) :] for t in x]
    rows, cols = signals._may_be_alike(x, y, 0.9, np.ones((40, 40), bool))
    want = {(i, j) for i in range(40) for j in range(40) if ratio(x[i], y[j]) >= 0.9}
    assert want <= set(zip(rows.tolist(), cols.tolist())) and len(rows) < 60 and len(want) > 20


@pytest.mark.parametrize("older", ["a", "b"])
def test_only_older_titles_count(spark, older):
    a = spark.createDataFrame([("abcdefgh", "2015-01-02"), ("abcdefgx", "2015-01-05"), ("abcdefgy", None)], "title string, day string")
    b = spark.createDataFrame([("abcdefgz", "2015-01-02"), ("abcdefgw", "2015-01-04")], "title string, day string")
    want = {("abcdefgh", "abcdefgw")} if older == "a" else {("abcdefgx", "abcdefgz"), ("abcdefgx", "abcdefgw")}
    assert {(r.a, r.b) for r in signals.similar_titles(a, b, 0.8, older).collect()} == want
