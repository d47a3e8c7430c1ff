"""Each operator against a plain version, on the small tables and on rows made to be awkward."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from overscribe.llm import decision_list, golay, licenses, lines, queries, sharding, site_bayes, toxicity, winnow, wordpiece
from overscribe.llm import sentencepiece as sp
from overscribe.llm.components import components

from ..oracle import by_sql, rows

WS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, words string, row string, rule string"


def awkward(spark):
    """Nulls, blanks, ties, repeated rows, a long text, and columns with clashing names."""
    texts = [None, "", " \n\t ", "a", "A a", "a b c", "word " * 300, "x" * 5000, "é 日本 ☃ \u0000 b", "same text here\nsame text here\n", "same text here\nsame text here\n", "\n".join(f"line {i % 7} of many words that repeat" for i in range(400))]
    data = [(i, t, "en", "s", len(t or ""), "f", "s", "w", "r", "u") for i, t in enumerate(texts)]
    data += [data[9], (None, "no id at all", None, None, None, "f", "s", "w", "r", "u"), (9, "same id, other text", "en", None, 1, "f", "s", "w", "r", "u")]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="module")
def items(spark, data):
    return spark.read.parquet(f"{data}/benchmark.parquet")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, data, name):
    got, want = queries.queries()[name](spark, data).toPandas(), by_sql(data, queries.SQL[name])
    assert rows(got) == rows(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (50, 52), (52, 51)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30} | {50: 50, 51: 50, 52: 50}
    assert components(df.where("false"), "a", "b").count() == 0


# 1, 7


def test_sentencepiece_like_the_library(docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = sp.load()
    p = pb.ModelProto()
    with open(sp.MODEL, "rb") as f:
        p.ParseFromString(f.read())
    p.trainer_spec.model_type = 1
    for i, x in enumerate(p.pieces):
        if x.type == 1:
            x.score = float(m.scores[i])
    lib = sentencepiece.SentencePieceProcessor(model_proto=p.SerializeToString())
    texts = [line for r in docs.limit(60).collect() for line in r.text.split("\n")[:6]] + ["", " ", "  a ", "日本語 ☃", "\n\n", "x" * 300, "a▁b"]
    encoder = sp.Encoder(m)
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder(texts)]
    assert got == [lib.encode(t) for t in texts]
    units = [u.encode() for t in texts for u in m.units.findall("▁" + t.replace(" ", "▁"))]
    assert sp.viterbi(units, m) == [sp.viterbi_one(u, m) for u in units]
    assert [sp.decode_ids(np.array(x, dtype=np.int32), m) for x in got] == [lib.decode(x) if x else "" for x in got]
    assert sp.decode_ids(np.array([m.byte_ids[0xE6], m.byte_ids[0x97]], dtype=np.int32), m) == "��"


def test_round_trip(spark, docs):
    out = sp.round_trip(awkward(spark).union(docs.select("*", *(F.lit("") for _ in range(5))))).collect()
    assert len(out) == 15 + docs.count() and all(r.exact and r.n_pieces == len(r.ids) for r in out)
    assert sp.round_trip(docs.where("false")).count() == 0
    m = sp.load()
    both = sp.decode(sp.encode(awkward(spark), m), m).collect()
    assert [r.decoded for r in both] == [r.text or "" for r in both]
    assert [r.ids for r in both] == [r.ids for r in out[:15]]


def test_token_counts_like_the_library(spark, docs):
    from tokenizers import models

    initial, further = wordpiece.vocabulary()
    vocabulary: dict[str, int] = {}
    for p in ["[UNK]", *initial, *("##" + x for x in further)]:
        vocabulary.setdefault(p, len(vocabulary))
    lib = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6, continuing_subword_prefix="##")
    df = awkward(spark).select("doc_id", "text").union(docs.select("doc_id", "text"))
    for (_, text), r in zip(df.collect(), wordpiece.token_counts(df).collect(), strict=True):
        pieces = [[t.value for t in lib.tokenize(w)] for w in wordpiece.WORDS.findall(text or "")]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(pieces), sum(map(len, pieces)), sum(p == ["[UNK]"] for p in pieces))
    small = wordpiece.Automaton(["ab", "abc", "a"], ["c", "cd", "bcz", "d"])
    assert [small.count(w) for w in ("ab", "abcd", "abcz", "acd", "z", "abcc")] == [1, 2, 0, 2, 0, 2]


# 2


def test_sharding_fits(spark, docs, tmp_path):
    df = docs.select("doc_id", "text").union(spark.sql("select 7777777L, repeat('z', 500) from range(60)")).union(awkward(spark).select("doc_id", "text"))
    out = sharding.shards(df, 4000).collect()
    by = collections.defaultdict(list)
    for r in out:
        assert len(r.shard) == r.depth
        by[r.shard].append(r.n_bytes)
    known = lambda d: -1 if d is None else d
    assert sorted((known(r.doc_id), r.n_bytes) for r in out) == sorted((known(r.doc_id), len((r.text or "").encode())) for r in df.collect())
    assert all(sum(v) <= 4000 or len(v) == 1 for v in by.values())
    keys = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(keys, keys[1:], strict=False))
    # Only oversized buckets were split: the two halves of any split are over the limit together.
    for k in keys:
        if k:
            inside = [n for x, v in by.items() if x.startswith(k[:-1]) for n in v]
            assert sum(inside) > 4000
    assert sharding.shards(df.where("false")).count() == 0
    d = sharding.write_shards(docs, str(tmp_path / "s"), 50_000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count() == d.agg(F.sum("n_docs")).first()[0]


# 3, 4


def test_site_quality(spark, docs, labels):
    out = site_bayes.site_quality(docs, labels, "source", "lang")
    pairs = out.join(labels.withColumnRenamed("quality", "y"), "doc_id").where(toxicity.held_out()).select("y", "kept").collect()
    assert out.count() == docs.count() and np.mean([bool(r.y) == r.kept for r in pairs]) >= 0.9
    assert site_bayes.site_quality(awkward(spark), labels, "source", "lang").count() == 15
    assert site_bayes.site_quality(docs.where("false"), labels, "source", "lang").count() == 0
    host, path = site_bayes.site_of("u")
    df = spark.createDataFrame([("http://www.A.org/x/y?q",), ("nonsense",), (None,)], "u string")
    assert [tuple(r) for r in df.select(host, path).collect()] == [("a.org", "x"), ("", ""), ("", "")]


def test_site_quality_in_plain_python(spark, docs, labels):
    """Every column of every row against dictionaries and sums."""
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.quality)
    data = docs.collect()

    def measures(text):
        w, n = WS.findall(text), max(1, len(WS.findall(text)))
        rate = lambda marks: sum(c in marks for c in text) / max(1, len(text))
        return rate("#*$%&|<>"), rate("!"), rate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(set(w)) / n, len(text) / n, float(len(w))

    x = {r.doc_id: measures(r.text or "") for r in data}
    seen = [i for i in x if i in known]
    cuts = []
    for f in range(6):
        v = sorted(x[i][f] for i in seen)
        cuts.append(sorted({v[math.ceil(k / site_bayes.BINS * len(v)) - 1] for k in range(1, site_bayes.BINS)}))
    cell = lambda i, f: sum(x[i][f] > c for c in cuts[f])
    count = collections.Counter((f, cell(i, f), known[i]) for i in seen for f in range(6))
    n = collections.Counter(known[i] for i in seen)

    def ratio(i):
        of = lambda f, y: math.log((count[f, cell(i, f), y] + 0.5) / (n[y] + 0.5 * (len(cuts[f]) + 1)))
        return max(-20.0, min(20.0, sum(of(f, 1) - of(f, 0) for f in range(6))))

    steps = np.array([[math.copysign(math.floor(abs(ratio(i)) * 2 + 0.5), ratio(i)) / 2] for i in seen])
    w = toxicity.fit(steps, np.array([float(known[i]) for i in seen]))
    share = n[1] / len(seen)
    evidence = {i: w[0] - logit(share) + w[1] * ratio(i) for i in x}
    p = {i: float(known[i]) if i in known else sigmoid(logit(share) + evidence[i]) for i in x}
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for r in data:
        hosts[r.source].append(p[r.doc_id])
        paths[r.source, r.lang].append(p[r.doc_id])

    def strength(sites, mean):
        of = [(len(v), sum(v) / len(v), mean(k)) for k, v in sites.items() if len(v) > 1]
        within, chance = sum(k * m * (1 - m) for k, _, m in of), sum(m * (1 - m) for *_, m in of)
        if len(of) < 2 or within <= 0:
            return site_bayes.STRONGEST
        rho = (sum(k * (s - m) ** 2 for k, s, m in of) - chance) / max(within - chance, 1e-12)
        return site_bayes.STRONGEST if rho <= 0 else min(site_bayes.STRONGEST, max(site_bayes.WEAKEST, 1 / rho - 1))

    mean = sum(p.values()) / len(p)
    a = strength(hosts, lambda _: mean)
    quality = {h: (a * mean + sum(v)) / (a + len(v)) for h, v in hosts.items()}
    b = strength(paths, lambda k: quality[k[0]])
    out = {r.doc_id: r for r in site_bayes.site_quality(docs, labels, "source", "lang").collect()}
    assert len(out) == len(data)
    for r in data:
        i, h, v = r.doc_id, hosts[r.source], paths[r.source, r.lang]
        above = (a * mean + sum(h) - p[i]) / (a + len(h) - 1)
        others = (b * above + sum(v) - p[i]) / (b + len(v) - 1)
        want = evidence[i], quality[r.source], others, sigmoid(logit(others) + evidence[i])
        assert (out[i].evidence, out[i].host_quality, out[i].path_quality, out[i].quality) == pytest.approx(want, rel=1e-5, abs=1e-7)
        assert out[i].kept == (out[i].quality >= 0.5)


def test_sparse_sites_shrink(spark):
    data = [(i, "g" if i % 2 else "b") for i in range(200)]
    docs = spark.createDataFrame([(i, ("fine words here " * 9) if k == "g" else "### $$$ " * 20, k + "ig", "p") for i, k in data] + [(900, "fine words here " * 9, "tiny", "p")], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(k == "g")) for i, k in data], "doc_id long, quality int")
    out = {r.doc_id: r for r in site_bayes.site_quality(docs, labels, "host", "path").collect()}
    assert out[1].host_quality > 0.9 > 0.6 > out[900].path_quality > 0.4 > 0.1 > out[0].host_quality


def stats_of(text):
    w = WS.findall(text or "")
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {i + j for i in range(len(w) - 2) for j in range(3) if c[tuple(w[i : i + 3])] > 1}
    ls = [x for x in (text or "").split("\n") if WS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(rep)


def test_text_stats(spark, docs):
    df = awkward(spark).select("doc_id", "text").union(docs.select("doc_id", "text"))
    for low in (decision_list.PACK, 3):  # with 3, most texts take the plain way
        before, decision_list.PACK = decision_list.PACK, low
        got = decision_list.text_stats(df).collect()
        decision_list.PACK = before
        for (_, text), r in zip(df.collect(), got, strict=True):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats_of(text)


def test_quality_rules(spark, docs, labels):
    out = decision_list.quality_rules(docs, labels)
    pairs = out.join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    assert np.mean([bool(r.quality) == r.kept for r in pairs if not r.base_failed]) >= 0.9
    got = decision_list.quality_rules(awkward(spark), labels.where("false")).collect()
    assert len(got) == 15 and all(r.kept == (not r.base_failed) for r in got)
    assert decision_list.quality_rules(docs.where("false"), labels).count() == 0


def test_rules_by_hand(spark):
    """Rows that two thresholds tell apart: the learned list rejects just the bad ones, in any order of rows."""
    rng, zero = np.random.default_rng(4), dict.fromkeys(decision_list.FEATURES, 0.0)
    data = [zero | {"symbol_rate": float(a), "word_length": float(b), "bad": int(a > 0.6 or b < 0.2), "grow": bool(i % 3)} for i, (a, b) in enumerate(rng.random((900, 2)))]
    rules = decision_list.learn(spark.createDataFrame(data).cache())
    assert rules and all(x.feature in ("symbol_rate", "word_length") for r in rules for x in r)
    rejects = lambda row: any(all((row[x.feature] > x.threshold) == x.above for x in r) for r in rules)
    assert np.mean([rejects(row) == bool(row["bad"]) for row in data]) > 0.93
    df = spark.createDataFrame(data).withColumn("rule", decision_list.verdict(rules))
    assert [r.rule is not None for r in df.select("rule").collect()] == [rejects(row) for row in data]


def test_ids_of_other_types_and_large_texts(spark):
    """String ids, and texts of a megabyte in one line and in many."""
    texts = ["word " * 200_000, "\n".join(f"line {i} of a long text" for i in range(40_000)), "short"]
    df = spark.createDataFrame([(f"d{i}", t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id string, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([("x", "nothing of this kind")], "item_id string, text string")
    results = [wordpiece.token_counts(df), sp.round_trip(df), golay.near_duplicates(df), winnow.decontaminate(df, items), licenses.scan(df, licenses.train(["plain words"])), lines.dedup(df)]
    for out in results:
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == ["d0", "d1", "d2"]


# 5


def test_edit_automaton():
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = [("idiot", False, 1.0), ("worthless", False, 1.0), ("scum", False, 1.0), ("lostra", True, 1.0), ("vequ", True, 1.0)]
    lexicon = toxicity.Lexicon(terms)
    words = "idiot idi0t idot idiott idioot iidot scum scam scums worthles wurthles worthelss wrthlss lostrabc lostrxbc lstrabc lozzra vequille vequ veq wequille idiom trash x".split()
    for w in words:
        want = []
        for i, (t, stem, _) in enumerate(terms):
            e = min(lev(w[:n], t) for n in range(len(w) + 1)) if stem else lev(w, t)
            if e <= toxicity.edits(t, stem):
                want.append((e, i))
        assert lexicon.find(w) == min(want, default=None), w


def test_toxicity(spark, docs, labels):
    out = toxicity.toxicity(docs, labels)
    pairs = out.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    assert len(pairs) > 10 and np.mean([r.toxic == r.predicted for r in pairs]) >= 0.9
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    assert {r.doc_id for r in out.where("held_out").collect()} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    model = toxicity.Model(toxicity.Lexicon([("idiot", False, 8.0), ("scum", False, 8.0)]), np.array([-6, 2, 2, -1, 1, 0.5, 1.0]))
    df = awkward(spark).union(spark.sql("select 100L, 'you are an idiot and scum', '', '', 0L, '', '', '', '', '' union all select 101L, 'they said \"what an idiot\" to him', '', '', 0L, '', '', '', '', ''"))
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert got[100] > 0.5 > got[101] and 0 <= got[0] == got[1] < 0.5
    none = toxicity.toxicity(awkward(spark), labels.where("false")).collect()
    assert len(none) == 15 and all(r.predicted == 0 for r in none)


# 6


def test_words_as_hashes():
    texts = ["", "A a\n\nb-c d", "x" * 200_000 + " y", "é日本 Z9\n", "a b c\nA, B; C!", "word " * 30_000]
    found = {}
    for text, line, first, count, words in lines.Scanner()([t.encode() for t in texts]):
        for t, i, f, n in zip(text.tolist(), line.tolist(), first.tolist(), count.tolist(), strict=True):
            found[t, i] = words[f : f + n].tolist()
    want = {(t, i): w for t, x in enumerate(texts) for i, y in enumerate(x.split("\n")) if (w := winnow.split_words(y.encode()))}
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    names = {}
    for k, v in found.items():
        for h, w in zip(v, want[k], strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names) == 9


def test_edits():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 70)).tolist() for _ in range(2))
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() > 0.1]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        most = lines.most_edits(max(len(a), len(b)))
        assert lines.edits(a, b, 1000) == row[-1] and lines.similar(a, b) == (row[-1] <= most)


def test_line_dedup_of_awkward_rows(spark, docs):
    out = {(r.doc_id, r.text) for r in lines.dedup(awkward(spark)).collect()}
    assert (0, None) in out and (1, "") in out and (2, " \n\t ") in out and lines.dedup(awkward(spark)).count() == 15
    assert (9, "same text here\n") in out and (10, "\n") in out or (10, "") in out
    assert lines.dedup(docs.where("false")).count() == 0


def test_line_dedup_by_edit_similarity_alone(spark, docs):
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(300))]
    made = []
    for i, n in enumerate([*range(1, 30), 42, 61, 80, 120, 170] * 3):
        line = [vocabulary[j] for j in np.minimum(rng.geometric(0.02, n) - 1, 302)]
        made.append(" ".join(line))
        for d in {1, n // 10, n // 5}:  # d edits of words, of which n // 5 at most make a link
            copy = list(line)
            for at in rng.choice(n, min(d, n), replace=False):
                copy[at] = ["", f"new{i}", f"{copy[at]} more{i}"][rng.integers(3)]
            made.append(" ".join(copy))
    made += ["ok", "ok", "two words", "Two, words!", "a b c d e f", "a b c d e x"]
    texts = [r.text for r in docs.limit(60).collect()] + ["\n".join(made[i::20]) for i in range(20)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    split = {(d, i): tuple(winnow.split_words(x.encode())) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))}
    distinct = sorted({w for w in split.values() if w}, key=len)
    parent = {w: w for w in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    linked = 0
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 5 * (len(b) - len(a)) > len(b):
                break
            if 5 * len(set(b).difference(a)) <= len(b) and 5 * edits(a, b) <= len(b):
                parent[find(a)] = find(b)
                linked += 1
    assert linked > 150
    seen, kept = set(), collections.defaultdict(list)
    for (d, i), w in split.items():
        if not w or find(w) not in seen:
            kept[d].append(texts[d].split("\n")[i])
        seen.add(w and find(w))
    got = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    lost = extra = gone = 0
    for d, t in enumerate(texts):
        have, want, all_lines = (collections.Counter(x) for x in (got[d].split("\n"), "\n".join(kept[d]).split("\n"), t.split("\n")))
        short = {x for x in all_lines if len(winnow.split_words(x.encode())) <= 15}
        assert {x: n for x, n in have.items() if x in short} == {x: n for x, n in want.items() if x in short}, d
        lost, extra, gone = lost + (have - want).total(), extra + (want - have).total(), gone + (all_lines - want).total()
    assert not extra and lost <= 0.03 * gone and gone > 250


def test_recall_of_line_keys(data):
    """Of all pairs of similar lines of sf0.01, by brute force, those that share a key."""
    import zlib

    import pyarrow.parquet as pq

    texts = [(x or "").encode() for x in pq.read_table(data.replace("sf0.001", "sf0.01") + "/documents.parquet", columns=["text"]).column(0).to_pylist()]
    distinct = sorted({w for t in texts for x in t.split(b"\n") if len(w := tuple(winnow.split_words(x))) >= lines.FUZZY_WORDS}, key=len)
    classes = np.zeros((len(distinct), 256), dtype=bool)  # the parity of words in classes: two changes an edit
    for i, w in enumerate(distinct):
        for x in w:
            classes[i, zlib.crc32(x) % 256] ^= True
    bits, n = np.packbits(classes, axis=1).view(np.uint64), np.array([len(w) for w in distinct])
    scan, counts = lines.Scanner(), np.zeros(1 << lines.SLOT_BITS)
    for *_, words in scan(texts):
        counts += np.bincount(lines.slots(words), minlength=len(counts))
    keys = []
    for w in distinct:
        (_, _, first, count, words), = scan([b" ".join(w)])
        keys.append(set(lines.least_pairs(words, first, count, (counts / counts.sum() ** 0.5).astype(np.float32))[1].tolist()))
    links = found = 0
    for i, w in enumerate(distinct):
        j = np.arange(i + 1, np.searchsorted(n, n[i] * 5 // 4, "right"))
        for k in j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= 2 * (n[j] // 5)]:
            if lines.similar(list(w), list(distinct[k])):
                links, found = links + 1, found + bool(keys[i] & keys[k])
    assert links > 300 and found >= 0.98 * links


def test_line_links_of_hot_keys(spark):
    """With every key hot, a group of near copies is one group all the same."""
    rng = np.random.default_rng(8)
    line = [f"w{i}" for i in range(30)]
    copies = [" ".join(w if rng.random() > 0.06 else f"new{rng.integers(1000)}" for w in line) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate([*copies, "quite another line of words"])], "doc_id long, text string, lang string, source string, n_chars long")
    texts = [r.text.split() for r in df.orderBy("doc_id").collect()]
    group = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if lines.similar(a, texts[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    want = {group.index(g) for g in set(group)}
    assert len(want) < 20
    before = lines.HOT
    for lines.HOT in (before, 10**9):
        got = {r.doc_id for r in lines.dedup(df).where("text <> ''").collect()}
        assert want <= got and len(got) <= len(want) + 3  # those with few lines alike may not have met one
    lines.HOT = before



def test_alike_lines():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint32) for _ in range(2))
        if rng.random() < 0.7:
            b = a[rng.random(len(a)) > 0.15]
        assert lines.alike(a, b) == lines.similar(a.tolist(), b.tolist())


def test_lines_are_compared_many_at_once(monkeypatch):
    """Lines of one key that are near but not similar, and those that are, cost no comparison each; lines of any length are told apart as one by one."""
    rng = np.random.default_rng(5)
    plain, texts = lines.similar, []
    for n in [4, 5, 9, 10, 39, 40, 79, 80, 159, 160, 319, 320, 400] * 3:
        for vocabulary in (3, 50, 2**32):
            texts.append(base := rng.integers(0, vocabulary, n, dtype=np.uint32))
            for share in (0.5, 0.9, 1.1):
                x = base.tolist()
                for _ in range(max(1, int(n / 5 * share))):
                    at = int(rng.integers(len(x)))
                    x[at : at + int(rng.integers(2))] = rng.integers(0, vocabulary, int(rng.integers(2)), dtype=np.uint32).tolist()
                texts.append(np.array(x, dtype=np.uint32))
    count = np.array([len(x) for x in texts])
    i = rng.integers(0, len(texts), 4_000)
    j = np.where(rng.random(4_000) < 0.8, i // 4 * 4 + rng.integers(0, 4, 4_000), rng.integers(0, len(texts), 4_000))
    got = lines.all_alike(np.concatenate(texts), np.cumsum(count) - count, count, i, j)
    assert got.tolist() == [plain(texts[a].tolist(), texts[b].tolist()) for a, b in zip(i, j, strict=True)] and 0 < got.sum() < len(got)
    assert len(lines.all_alike(np.concatenate(texts), np.cumsum(count) - count, count, i[:0], j[:0])) == 0

    def one_by_one(a, b):
        raise AssertionError("a pair was compared by itself")

    monkeypatch.setattr(lines, "similar", one_by_one), monkeypatch.setattr(lines, "alike", one_by_one)
    base, near = rng.integers(0, 2**32, 40, dtype=np.uint32), []
    for k in range(300):  # 12 words of 40 are each line's own, and 2 lines each are alike
        x = base.copy()
        x[rng.permutation(40)[:12]] = rng.integers(0, 2**32, 12, dtype=np.uint32)
        near += [x.tobytes(), np.append(x[1:], np.uint32(k)).tobytes()]
    num = np.arange(600)
    assert {tuple(sorted(x)) for x in lines._linked(num, num, pa.array(near, pa.binary()))} == {(2 * k, 2 * k + 1) for k in range(300)}


def test_numbers_of_lines(spark):
    texts = ["", "\n", "a", "a\n", "\n\na b\n", None, "é\r\né"]
    df = spark.createDataFrame([(k, t, "en", "x", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.n_lines for r in lines.dedup(df).collect()} == {k: len(t.split("\n")) if t is not None else 0 for k, t in enumerate(texts)}


def test_word_frequencies_come_from_all_lines(spark):
    """No count is from a part of the documents: each word counts as often as lines have it."""
    texts = ["all lines have these words", *(f"also w{i} w{i + 1} w{i + 2}" for i in range(9_000))]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = lines.common_words(lines.occurrences(df).where("codes is not null").select("num", "codes"))
    total = sum(len(t.split()) for t in texts)
    assert got.max() == pytest.approx(9_000 / total**0.5) and got.sum() == pytest.approx(total**0.5, rel=1e-3)


def test_lines_of_very_hot_keys_all_meet(spark, monkeypatch):
    """One key has more lines than meet in one place: near copies of its first line, and others, of which two are similar."""
    monkeypatch.setattr(lines, "TILE", 8)
    monkeypatch.setattr(lines, "keyed", lambda known: known.select(F.lit(7).cast("long").alias("block"), "num", *(F.lit(0).cast("long").alias(c) for c in "pq"), (F.length("codes") / 4).cast("int").alias("words")))
    near = [f"a b c d e f g h i j k l m n x{i}" for i in range(100)]
    rest = [" ".join(f"{c}{i}" for c in "qrstuvwxyz"[: 5 + i % 6]) for i in range(60)]
    rest += [f"{rest[k]} more" for k in (3, 11, 27)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(near + rest)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in lines.dedup(df).where("text <> ''").collect()}
    assert got == {0, *range(100, 160)}


# 8


def test_golay_code():
    code = golay.Golay()
    assert len(set(code.error.tolist())) == 2048
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    y = x.copy()
    for i in range(400):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.int64(1 << int(b)) if b < 63 else np.int64(-(2**63))
    keys = []
    for v in (x, y):
        row, key = golay.golay_keys(v, code)
        keys.append([set(key[row == i].tolist()) for i in range(400)])
    assert all(a & b for a, b in zip(*keys, strict=True)) and max(map(len, keys[0])) <= 18


def simhash(text):
    w = WS.findall(ascii_lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bucket", [golay.BUCKET, 1])
def test_near_duplicates(spark, docs, bucket):
    extra = spark.createDataFrame([(5000 + i, " ".join(f"w{j}" for j in range(400)) + f" tail{i}") for i in range(12)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(awkward(spark).select("doc_id", "text")).union(extra)
    before, golay.BUCKET = golay.BUCKET, bucket
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in golay.near_duplicates(df).collect()]
    golay.BUCKET = before
    want = [(r.doc_id, simhash(r.text)) for r in df.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((a, b) for a, b, _ in got), key=key) == sorted(want, key=key)
    fps = sorted({f for _, f in want})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for d, f in want:
        if d is not None:
            least[find(f)].append(d)
    assert all(c == min(least[find(f)], default=None) for _, f, c in got)


def test_keep_one(spark):
    df = awkward(spark)
    kept = golay.keep_one(df).collect()
    texts = [(r.doc_id, r.text) for r in kept]
    assert texts.count((9, "same text here\nsame text here\n")) == 1 and (10, "same text here\nsame text here\n") not in texts
    assert sum(not (t or "").strip() for _, t in texts) == 1 and golay.keep_one(df.where("false")).count() == 0


def test_keep_one_of_a_component_and_not_of_an_id(spark):
    unlike = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, t, "", "", 0) for t in unlike[:3]] + [(7, t, "", "", 0) for t in unlike[3:]] + [(8, unlike[3], "", "", 0)]
    kept = golay.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted(r.text for r in kept) == unlike and all(r.doc_id in (None, 7) for r in kept)


def test_near_texts_by_shingles(spark, docs):
    rng, made = np.random.default_rng(3), []
    for i, n in enumerate([30, 60, 120, 300, 800] * 8):
        words = [f"w{j}" for j in rng.integers(0, 5000, n)]
        for edits in range(0, max(2, n // 40) + 2):
            copy = list(words)
            for at in rng.choice(n, edits, replace=False):
                copy[at] = f"new{i}"
            made.append(" ".join(copy))
    texts = [r.text for r in docs.collect()] + made
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = WS.findall(ascii_lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                linked += a != sets[j]
                parent[find(i)] = find(j)
    assert linked > 50
    want = collections.defaultdict(set)
    for i in range(len(texts)):
        want[find(i)].add(i)
    before = golay.BUCKET
    for bucket in (before, 1):
        golay.BUCKET = bucket
        try:
            got = collections.defaultdict(set)
            for r in golay.near_texts(df).collect():
                got[bytes(r.root)].add(r.doc_id)
        finally:
            golay.BUCKET = before
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# 9


def test_decontaminate(spark, docs, items):
    more = spark.sql("select 777L as item_id, 'Zebra' as text union all select 778L, '' union all select 779L, 'for the and' union all select 780L, null union all select 777L, 'Zebra'")
    both = items.select("item_id", "text").union(more)
    df = docs.select("doc_id", "text").union(awkward(spark).select("doc_id", "text")).union(spark.sql("select 10000001L, 'zebra, for-the and ZEBRA'"))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = collections.defaultdict(set)
    for r in both.collect():
        w = words(r.text)
        k = min(13, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[p : p + k])].add(str(r.item_id))
    lengths = {len(x) for x in windows}
    want = []
    for r in df.collect():
        w, hit, ids = words(r.text), set(), set()
        for k in lengths:
            for p in range(len(w) - k + 1):
                if found := windows.get(tuple(w[p : p + k])):
                    hit.update(range(p, p + k))
                    ids |= found
        want.append((r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in winnow.decontaminate(df, both).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert winnow.decontaminate(df.where("false"), both).count() == 0
    assert winnow.decontaminate(df, both.where("false")).where("contaminated").count() == 0


# 10


def test_licenses(spark, docs):
    out = {r.doc_id: r.licenses for r in licenses.licenses(docs).collect()}
    cues = {"Apache License": "Apache-2.0", "MIT License": "MIT", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC": "CC-BY-NC", "All rights reserved": "proprietary"}
    for r in docs.collect():
        assert out[r.doc_id] == ",".join(sorted({v for k, v in cues.items() if k in r.text}))
    model = licenses.train(["plain words of no kind", "weather and harvest in the north"])
    held = [("This file is licensed under the Apache License, Version 2.0, see NOTICE", "Apache-2.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"), ("Licensed under the Nobody Knows License of 1987, chapter nine.", "unknown"), ("The harvest came late this year in the valley.", "none")]
    got = model.judge([licenses.words_of(t) for t, _ in held])
    assert [g[0] for g in got] == [w for _, w in held]
    wrapped = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.",
        "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
        "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
        "unknown": "This project is released under the ISC License.",
    }
    def families(text):
        return sorted({f for _, f, _ in model.found([licenses.words_of(x) for x in text.split("\n")])})

    for family, text in wrapped.items():
        assert families("The harvest came late.\n\n" + text + "\n\nThe valley slept.") == [family], family
    assert families("Licensed under the EUPL, Version 1.2 or later.") == ["unknown"]
    assert families("All rights reserved.\nReleased under the MIT License.") == ["MIT", "proprietary"]
    assert families("The city may license the new drivers of the night buses before the winter.") == []
    assert licenses.scan(docs.where("false"), model).count() == 0
    assert [len(r.hits) for r in licenses.scan(awkward(spark), model).collect()] == [0] * 15


def templated(n, values, seed=3):
    """(lines, which of them go): lines of one template, two of which are similar just if they share two of four slots; the first of each group stays."""
    rng = np.random.default_rng(seed)
    slots = sorted({tuple(x) for x in rng.integers(0, values, (n, 4)).tolist()}, key=lambda x: hash(x))
    root = list(range(len(slots)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = {}
    for i, x in enumerate(slots):
        for p, q in itertools.combinations(range(4), 2):
            j = first.setdefault((p, q, x[p], x[q]), i)
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [f"user a{a} posted b{b} from c{c} near d{d} today ok" for a, b, c, d in slots], [find(i) != i for i in range(len(slots))]


@pytest.mark.parametrize("n, values", [(12_000, 150), (48_000, 300)])
def test_hot_keys_of_templated_lines_are_split(spark, n, values):
    """All keys are hot, and similar lines two or three among a hundred a key: they are found by keys put together."""
    texts, goes = templated(n, values)
    rows = [(i, "\n".join(texts[i :: 1000])) for i in range(1000)]
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lines.dedup(df).agg({"n_dropped": "sum"}).first()[0]
    assert 0.98 * sum(goes) <= got <= sum(goes)


#: Notices as they are found in files, and what they are; empty for ordinary text.
GNU = "This program is free software{s} you can redistribute it and/or modify\nit under the terms of the GNU{k} General Public License as published by\nthe Free Software Foundation{c} either version {v} of the License, or\n(at your option) any later version."
NOTICES = [
    (GNU.format(s=";",k="",c=";",v=2),"GPL-2.0"),
    (GNU.format(s=":",k="",c=",",v=3),"GPL-3.0"),
    (GNU.format(s=":",k=" Affero",c=",",v=3),"AGPL-3.0"),
    (GNU.format(s=";",k=" Lesser",c=";",v="2.1"),"LGPL"),
    ("Licensed under CC BY-NC-ND 4.0.","CC-BY-NC-ND"),
    ("Licensed under CC BY-NC-SA 4.0.","CC-BY-NC-SA"),
    ("Licensed under CC BY-ND 4.0.","CC-BY-ND"),
    ("Licensed under CC BY-NC 4.0.","CC-BY-NC"),
    ("Licensed under CC BY-SA 4.0.","CC-BY-SA"),
    ("Licensed under CC BY 4.0.","CC-BY"),
    ("SPDX-License-Identifier: MIT","MIT"),
    ("SPDX-License-Identifier: Apache-2.0","Apache-2.0"),
    ("License: MIT","MIT"),
    ("SPDX-License-Identifier: GPL-2.0-or-later","GPL-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-only","GPL-3.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later","LGPL"),
    ("SPDX-License-Identifier: AGPL-3.0-only","AGPL-3.0"),
    ("SPDX-License-Identifier: MPL-2.0","MPL-2.0"),
    ("SPDX-License-Identifier: BSD-3-Clause","BSD"),
    ("This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.","unknown"),
    ("This is free and unencumbered software released into the public domain.","Unlicense"),
    ("We believe that all human rights are reserved for citizens.",""),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.","CC-BY"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.","CC-BY-NC-ND"),
    ("CC BY 3.0 Unported","CC-BY"),
    ("All rights reserved.","proprietary"),
    ("Copyright 2020 Example Ltd. All rights reserved.","proprietary"),
    ("Released under the MIT License.","MIT"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software","MIT"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at","Apache-2.0"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:","BSD"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.","MPL-2.0"),
    ("Licensed under the Example Corp Source License, version 4.","unknown"),
    ("Use is subject to the license of the vendor.","unknown"),
    ("She lost her driving license in the forest.",""),
    ("The general met the public in the library.",""),
    ("He took the option and the foundation was happy.",""),
    ("Released into the public domain under CC0 1.0 Universal.","CC0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.","LGPL"),
    ("Licensed under the GNU General Public License v2.0 only.","GPL-2.0"),
]


def test_notices_of_near_families(docs):
    """Each notice, wrapped and on one line, is named as what it is: version and terms count, not the words that families share."""
    ordinary = [x for r in docs.collect() for x in (r.text or "").split("\n")[:4] if len(x) < 2000 and not re.search("(?i)licen|copyright|reserved|permission", x)]
    model = licenses.train(ordinary)
    for text, family in NOTICES:
        for form in (text, " ".join(text.split("\n"))):
            got = {f for _, f, _ in model.found([licenses.words_of(x) for x in form.split("\n")])}
            assert ",".join(sorted(got)) == family, form
