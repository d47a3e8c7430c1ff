"""Matching blocks by automaton against the standard library's matcher."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from overscribe.functions import similarity as sim
from overscribe.functions.matching import Automaton, Corpus, Searched


def blocks(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def pairs(seed=1):
    rng = random.Random(seed)
    for letters in ("ab", "abc", "abcdefgh", "海洋學院獎"):
        for _ in range(120):
            b = "".join(rng.choices(letters, k=rng.randint(0, 60)))
            cut = sorted(rng.randint(0, len(b)) for _ in range(4))
            a = b[cut[2] : cut[3]] + "".join(rng.choices(letters, k=rng.randint(0, 20))) + b[cut[0] : cut[1]]
            yield a, b


@pytest.mark.parametrize("large", [10**9, 0])
def test_matched_is_the_sum_of_blocks(large):
    for a, b in pairs():
        assert Corpus(b, large).matched(a) == blocks(a, b), (a, b)


def test_longest_within_ranges():
    rng = random.Random(2)
    for a, b in pairs(3):
        m, tools = difflib.SequenceMatcher(None, a, b, autojunk=False), (Automaton(b), Searched(b))
        alo, ahi = sorted((rng.randint(0, len(a)), rng.randint(0, len(a))))
        blo, bhi = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
        want = tuple(m.find_longest_match(alo, ahi, blo, bhi))
        for x in tools:
            got = x.longest(a, alo, ahi, blo, bhi)
            assert got == want or got[2] == want[2] == 0, (a, b, alo, ahi, blo, bhi)


def test_time_is_about_linear():
    """Eight times the text takes well below the 64 times of all pairs of characters."""
    rng = random.Random(4)

    def took(n):
        b = "".join(rng.choices("abcdefghij", k=n))
        a = "".join(rng.choices("abcdefghij", k=n // 4)) + b[n // 2 : n // 2 + n // 8]
        start = time.process_time()
        Corpus(b).matched(a)
        return time.process_time() - start

    took(2_000)
    assert took(32_000) < 30 * max(took(4_000), 0.005)


def test_coverage_column(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs(5)) if i % 7 == 0] + [(-1, None, "a"), (-2, "a", None), (-3, "", "")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r.i: r.c for r in df.select("i", sim.coverage(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {i: None if a is None or b is None else 1.0 if not a else blocks(a, b) / len(a) for i, a, b in rows}
