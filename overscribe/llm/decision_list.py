"""Quality rules: text statistics and a learned decision list, all in Spark's own functions.

The list is learned by sequential covering from labelled statistics. A rule is
a conjunction of up to three thresholds; it grows by the literal with the best
information gain on two thirds of the labelled rows, counted by Spark in a
histogram over quantile bins, and is pruned on the other third. Rows that it
covers go, and the next rule grows on the rest, until none is precise enough.
The result is an ordered list of conditions, emitted as one CASE expression.

No Python runs on the executors. The driver sees histograms of a fixed size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows from which the list is learned, at most: those with the least hash of their doc_id.
SAMPLE = 10_000
#: Fewest words of a kept text; most repeated words in percent.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Windows up to this position are sorted by a packed number; longer texts take the plain way.
PACK = 20

FEATURES = {
    "symbol_rate": "n_symbols / word_chars",
    "bang_rate": "n_bangs / word_chars",
    "upper_rate": "n_upper / word_chars",
    "repeat_rate": "n_repeat_words / n_words",
    "dup_line_rate": "n_dup_lines / n_lines",
    "distinct_rate": "n_distinct / n_words",
    "word_length": "word_chars / n_words",
}


def _stage(df: DataFrame, **exprs: str) -> DataFrame:
    return df.select("*", *(F.expr(e).alias(n) for n, e in exprs.items()))


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the features need.

    Repeated windows of three words: each window is hashed, and hash and
    position, packed in one number, are sorted, so that equal windows are
    neighbours. Neighbours are compared by their words; should two different
    windows ever share a hash, or a text be too long to pack its positions, the
    windows themselves are sorted.
    """
    low = (1 << PACK) - 1
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    df = _stage(df, _w="array_remove(split(_t, '[ \\\\t-\\\\r]+'), '')", _l="filter(split(_t, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')")
    df = _stage(df, _n="size(_w)", word_chars="cast(length(array_join(_w, '')) as long)")
    of = [f"slice(_w, {i}, greatest(_n - 2, 0))" for i in (1, 2, 3)]
    df = _stage(df, _h=f"transform(arrays_zip({', '.join(of)}), x -> xxhash64(x))")
    df = _stage(df, _rep="size(array_distinct(_h)) < size(_h)")
    df = _stage(df, _p=f"case when _rep and _n <= {low} then sort_array(transform(_h, (x, i) -> (x & {~low}L) | i)) else cast(array() as array<bigint>) end")
    near = f"case when shiftrightunsigned(a ^ b, {PACK}) = 0 then named_struct('a', cast(a & {low}L as int), 'b', cast(b & {low}L as int)) end"
    df = _stage(df, _d=f"case when size(_p) > 1 then filter(zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> {near}), x -> x is not null) end")
    df = _stage(df, _plain="_rep and (_d is null or exists(_d, x -> slice(_w, x.a + 1, 3) <> slice(_w, x.b + 1, 3)))")
    # The plain way, for the rare rows: windows with their positions, sorted as they are.
    df = _stage(df, _s=f"case when _plain then sort_array(transform(arrays_zip({', '.join(of)}), (x, i) -> named_struct('x', x, 'i', i))) end")
    df = _stage(df, _e="case when _plain then filter(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (p, q) -> case when p.x = q.x then named_struct('a', p.i, 'b', q.i) end), x -> x is not null) else _d end")
    words = "transform(_e, x -> array(x.a, x.a + 1, x.a + 2, x.b, x.b + 1, x.b + 2))"
    return df.select(
        "doc_id",
        F.expr("cast(_n as long)").alias("n_words"),
        "word_chars",
        F.expr("cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as long)").alias("n_dup_lines"),
        F.expr(f"cast(case when _rep then size(array_distinct(flatten({words}))) else 0 end as long)").alias("n_repeat_words"),
        F.expr("size(_l)").alias("n_lines"),
        F.expr("size(array_distinct(_w))").alias("n_distinct"),
        F.expr("length(_t) - length(translate(_t, '!', ''))").alias("n_bangs"),
        F.expr("length(_t) - length(translate(_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))").alias("n_upper"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    """The rates that rules are about; zero for texts without words."""
    return stats.select("*", *(F.expr(f"coalesce(try_divide({e.split(' / ')[0]}, {e.split(' / ')[1]}), 0D)").alias(n) for n, e in FEATURES.items()))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule, from 1, that covers a row; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(covers(rule), F.lit(i)).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Features and label ``bad`` of at most ``limit`` labelled documents, and ``grow`` for two thirds of them."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = chosen.select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    feats = with_features(text_stats(some))
    feats = feats.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return feats.select(*FEATURES, "bad", (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(3)) > 0).alias("grow"))


def learn(sample: DataFrame, max_rules: int = 8, max_literals: int = 3, precision: float = 0.9, support: int = 8, bins: int = 24) -> list[Rule]:
    """Sequential covering. ``sample`` is small and read again and again: hand in a materialized table."""
    at = [i / bins for i in range(1, bins)]
    q = sample.agg(*(F.percentile(f, F.lit(at)).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(q[f] or [])) for f in FEATURES}

    def counts(rows: DataFrame) -> tuple[dict[str, list[list[int]]], list[int]]:
        """Per feature and bin, good and bad rows; and both in all."""
        binned = [F.struct(F.lit(f).alias("f"), sum((F.col(f) > c).cast("int") for c in cuts[f]).alias("b")) for f in FEATURES if cuts[f]]
        out = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items()}
        for r in rows.select("bad", F.explode(F.array(*binned)).alias("x")).groupBy("x.f", "x.b", "bad").count().collect():
            out[r.f][r.b][r.bad] += r["count"]
        return out, [sum(x[i] for x in next(iter(out.values()))) for i in (0, 1)]

    def gain(n: int, p: int, n0: int, p0: int) -> float:
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0

    def score(rows: DataFrame, rule: Rule) -> list[tuple[int, int]]:
        """(good, bad) rows that each prefix of the rule covers."""
        sums = [F.sum((covers(rule[: i + 1]) & (F.col("bad") == b)).cast("int")) for i in range(len(rule)) for b in (0, 1)]
        got = [x or 0 for x in rows.agg(*sums).first()]
        return list(zip(got[::2], got[1::2], strict=True))

    rules: list[Rule] = []
    rest = sample
    while len(rules) < max_rules and any(cuts.values()):
        rule: Rule = ()
        n0 = p0 = None
        while len(rule) < max_literals:
            hist, (n, p) = counts(rest.where("grow").where(covers(rule)))
            if not p or not n:
                break
            n0, p0 = n, p
            best, best_gain, best_counts = None, 1e-9, (0, 0)
            for f, cells in hist.items():
                below = [0, 0]
                for c, cell in zip(cuts[f], cells, strict=False):
                    below = [below[0] + cell[0], below[1] + cell[1]]
                    for above, (x, y) in ((False, below), (True, (n0 - below[0], p0 - below[1]))):
                        if y >= support and (g := gain(x, y, n0, p0)) > best_gain:
                            best, best_gain, best_counts = Literal(f, above, c), g, (x, y)
            if best is None:
                break
            rule += (best,)
            if not best_counts[0]:
                break
        if not rule:
            break
        held, grown = score(rest.where("not grow"), rule), score(rest.where("grow"), rule)
        worth = [(p - n) / (p + n) if p + n else -1 for n, p in held]
        keep = max(range(len(rule)), key=lambda i: (worth[i], -i))
        n, p = (a + b for a, b in zip(held[keep], grown[keep], strict=True))
        if p < support or p / (p + n) < precision:
            break
        rules.append(rule[: keep + 1])
        rest = rest.where(~covers(rules[-1]))
    return rules


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (number of the first that rejects, null for none), kept."""
    df = with_features(text_stats(docs))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict(rules).alias("rule"))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn the list from the labels (at most SAMPLE of them) and judge every document.

    A null or blank text has zeros and fails the base rules. Without usable
    labels the list is empty and the base rules decide alone.
    """
    return judge(docs, learn(materialize(labelled_sample(docs, labels), "quality")))
