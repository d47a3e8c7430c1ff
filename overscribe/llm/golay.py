"""Near duplicates by SimHash, with Golay-code fuzzy hashing as the candidate search.

A fingerprint of 64 bits falls into segments of 22, 21 and 21 bits. Two
fingerprints that differ in at most two bits agree on one whole segment, and
differ in at most two bits of the next one. A segment, padded to 23 bits, is
decoded by the perfect binary Golay code, once as it is and once with each bit
flipped: if x and y differ in bits i and j, then x with i flipped is y with j
flipped, so both have that word's codeword among theirs. As the code is
perfect with radius three, a segment has one such codeword or six. Each
fingerprint so gets at most 18 keys of (segment number, whole segment, codeword
index of the next one), about 33 bits, and every linked pair shares one.

Pairs within a key are verified by their differing bits. A key with over
``BUCKET`` fingerprints (thousands of near copies of one text) is not paired
out: its fingerprints are linked through the words that differ from them in at
most one bit. Two fingerprints are within two bits just if they share such a
word, and no word has more than 65 of them, so this way is exact as well and
its work per fingerprint has a fixed bound.

That is op8's query. The pipeline's stage, keep_one, links texts by the Jaccard
similarity of their five-word shingles instead (near_texts), as near copies
differ in more bits than the Golay keys reach. Candidates are linked by the
Golay keys or share a band of least hashes, and shingles decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, id_type, in_batches, materialize, same_row, small, text_hash
from .components import components

#: Differing bits up to which fingerprints are linked. The keys below are made for two.
MAX_BITS = 2
#: Fingerprints with one key up to which they are compared in pairs.
BUCKET = 64
#: Texts of a band with over BUCKET ones with which the others are compared while they are in different groups.
HUBS = 16
#: Shingles hashed at once; bounds the memory that a very long text takes.
BLOCK = 8192

#: Band keys of a text, and least hashes that each is made of.
BANDS, ROWS = 16, 4
#: What tells the hash functions of the bands apart.
MIXERS = np.random.default_rng(20).integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64)

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: (lowest bit, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fixed value: a generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the text's word shingles, as a signed 64-bit number.

    A text of fewer words than ``size`` is one shingle; a text without words has fingerprint zero.
    """
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)) if len(part) >= size else [b" ".join(part)]
        bits = np.unpackbits(np.frombuffer(b"".join([digest(s, 42) for s in shingles]), dtype=np.uint8))
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _remainder(word: np.ndarray) -> np.ndarray:
    """Of 23-bit words, modulo the generator: 11 bits, zero for codewords."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
    return word


class Golay:
    """Decoding by a table of the 2048 error patterns of weight three and less."""

    def __init__(self) -> None:
        flips = [0] + [1 << i for i in range(23)]
        patterns = np.array(sorted({a | b | c for a in flips for b in flips for c in flips}), dtype=np.int64)
        self.error = np.zeros(2048, dtype=np.int64)
        self.error[_remainder(patterns)] = patterns

    def index(self, word: np.ndarray) -> np.ndarray:
        """The 12-bit number of the codeword within distance three of each word."""
        return (word ^ self.error[_remainder(word)]) >> 11

    def near(self, word: np.ndarray, bits: int) -> np.ndarray:
        """A row for each word: the numbers of its codeword and of those of its neighbours, -1 for repeats."""
        out = np.stack([self.index(word)] + [self.index(word ^ (1 << i)) for i in range(bits)], axis=1)
        out.sort(axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        return out


def golay_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints."""
    u = fps.astype(np.int64).view(np.uint64)
    parts = [(u >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    rows, keys = [], []
    for i, whole in enumerate(parts):
        j = (i + 1) % len(parts)
        near = code.near(parts[j], SEGMENTS[j][1])
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((i << 36) | (whole[row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, fp) of every row. A null or blank text has fp zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "row_hash", "fp"])

    return in_batches(docs.select("doc_id", text_hash().alias("row_hash"), "text"), run, f"doc_id {id_type(docs)}, row_hash long, fp long")


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(fp, key): all Golay keys of each fingerprint."""

    def run(batches):
        code = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                fp = batch.column(0).slice(at, BLOCK).to_numpy(zero_copy_only=False)
                row, key = golay_keys(fp, code)
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(key)], ["fp", "key"])

    return in_batches(fps.select("fp"), run, "fp long, key long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of fingerprints within two bits.

    ``fps`` has one row for each fingerprint.
    """
    keys = materialize(fuzzy_keys(fps), "keys")
    sizes = keys.groupBy("key").count().where("count > 1")
    shared = materialize(keys.join(sizes, "key"), "shared")
    few = shared.where(F.col("count") <= BUCKET)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = shared.where(F.col("count") > BUCKET).select("fp").distinct()
    flipped = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    stars = many.select("fp", F.explode(flipped).alias("word")).groupBy("word").agg(F.collect_list("fp").alias("fps"))
    stars = stars.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def _near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, fp, root, component_id) of every row.

    root is the least fingerprint of the component and names it. component_id is the least doc_id among the documents that links reach,
    the document itself included; null only where all of these are null.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    comp = materialize(components(links(fps), "a", "b"), "components")
    grouped = fps.join(comp, fps.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.where("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(grouped.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "of")
    return rows.join(of, rows.fp == F.col("_fp")).select("doc_id", "row_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, fp, component_id) of every row; see :func:`_near_rows`."""
    return _near_rows(docs).select("doc_id", "row_hash", "fp", "component_id")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The different hashes of the text's word shingles, in order; a text of fewer words is one shingle."""
    words = text.translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    return np.unique(np.fromiter((digest(x, 42) for x in shingles), dtype=np.uint64, count=len(shingles)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles: each of ROWS least values under different hash functions."""
    out = np.zeros(BANDS, dtype=np.uint64)
    for band in range(BANDS):
        for row in range(ROWS):
            h = (hashes ^ MIXERS[band, row]) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[band : band + 1] ^= (h ^ (h >> np.uint64(29))).min()
            out[band : band + 1] *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row_hash, set, n, bands) of every row: set names the set of n shingles; bands is null without words."""

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t.as_py() or b"", size) for t in batch.column(2).cast(pa.binary())]
            sets = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
            bands = pa.array([band_keys(h) if len(h) else None for h in found], pa.list_(pa.int64()))
            n = pa.array([len(h) for h in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets, n, bands], ["doc_id", "row_hash", "set", "n", "bands"])

    return in_batches(docs.select("doc_id", text_hash().alias("row_hash"), "text"), run, f"doc_id {id_type(docs)}, row_hash long, set binary, n int, bands array<long>")


def alike(docs: DataFrame, pairs: DataFrame, sets: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets whose shingles in common are that share of all of both."""

    def run(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            ok = []
            for i, (s, t) in enumerate(zip(x.cast(pa.binary()), y.cast(pa.binary()), strict=True)):
                s, t = shingle_hashes(s.as_py() or b"", size), shingle_hashes(t.as_py() or b"", size)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both >= similarity * (len(s) + len(t) - both) - 1e-9:
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(ok, pa.int64())), b.take(pa.array(ok, pa.int64()))], ["a", "b"])

    wanted = pairs.select(F.col("a").alias("_k")).union(pairs.select("b")).distinct()
    wanted = materialize(sets.join(wanted, F.col("set") == F.col("_k")).select("at.doc_id", "at.row_hash", "set"), "wanted")
    texts = same_row(docs.select("doc_id", "text", text_hash().alias("row_hash")), small(wanted), "inner").select("set", "text").dropDuplicates(["set"])
    texts = materialize(texts, "texts")
    return in_batches(pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y"), run, "a binary, b binary")


def golay_pairs(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): sets of shingles (doc_id, row_hash, set) whose texts' fingerprints the Golay keys link.

    The least set of a fingerprint stands for it: its other sets are paired with
    that one, and of linked fingerprints those that stand for them.
    """
    fps = materialize(fingerprints(docs).distinct(), "fingerprints")
    sets = rows.where("bands is not null").select("doc_id", "row_hash", "set").distinct()
    of = materialize(same_row(fps, sets, "inner").select("fp", "set").distinct(), "fingerprints-of")
    first = materialize(of.groupBy("fp").agg(F.min("set").alias("hub")), "distinct")
    same = of.join(first, "fp").where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b"))
    linked = links(first).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").where("x <> y")
    return same.union(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_texts(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row_hash, root) of every row: root is the same for texts that links reach.

    Texts are linked if the Jaccard similarity of their sets of ``size``-word
    shingles is ``similarity`` or more. Two of 0.8 share one of their band keys
    with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, 0.9998, and more alike
    ones with a higher one. Texts whose SimHash fingerprints the Golay keys link
    (:func:`golay_pairs`) meet as well. What meets is compared shingle by shingle. Of a band
    with over BUCKET texts each is compared with one, and, while they are in
    different groups, with HUBS others, different ones for each band: its work is
    in proportion to its size, and only a text that is alike with few of the
    others of all its bands may miss them.
    """
    rows = materialize(shingle_sets(docs, size), "shingles")
    at = F.min(F.struct("doc_id", "row_hash")).alias("at")
    sets = materialize(rows.groupBy("set").agg(at, F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    keys = sets.select("set", "n", F.explode("bands").alias("band"))
    sizes = keys.groupBy("band").agg(F.count("*").alias("count"), F.min("set").alias("hub")).where("count > 1")
    shared = materialize(keys.join(sizes, "band"), "shared")
    few, many = shared.where(F.col("count") <= BUCKET), shared.where(F.col("count") > BUCKET)
    long_enough = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.set") < F.col("y.set")) & long_enough)
    pairs = pairs.select(F.col("x.set").alias("a"), F.col("y.set").alias("b"))
    to_hub = many.where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b"))
    pairs = materialize(pairs.union(to_hub).union(golay_pairs(docs, rows)).distinct(), "pairs")
    edges = materialize(alike(docs, pairs, sets, size, similarity), "links")
    comp = materialize(components(edges, "a", "b"), "components")
    if many.limit(1).count():
        rest = many.join(comp, F.col("set") == F.col("node"), "left").select("band", "set", "n", F.coalesce("root", "set").alias("root"))
        rest = materialize(rest, "rest")
        # Other ones for each band: a grouped minimum for each of HUBS parts of its texts.
        least = F.min(F.struct(F.xxhash64("band", "set").alias("o"), "set", "n", "root")).alias("h")
        hubs = rest.groupBy("band", F.pmod(F.xxhash64("set"), F.lit(HUBS)).alias("part")).agg(least).select(F.col("band").alias("_b"), "h.*").alias("y")
        across = rest.alias("x").join(hubs, (F.col("x.band") == F.col("y._b")) & (F.col("x.root") != F.col("y.root")) & long_enough)
        across = materialize(across.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct(), "across")
        if across.limit(1).count():
            comp = materialize(components(edges.union(alike(docs, across, sets, size, similarity)), "a", "b"), "components")
    return rows.join(comp, rows.set == comp.node, "left").select("doc_id", "row_hash", F.coalesce("root", "set").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of one document for each group of :func:`near_texts`: that with the least doc_id, then the least text hash.

    Rows that repeat as a whole count once. Rows without a doc_id come last.
    """
    found = materialize(near_texts(docs), "near")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    one = found.groupBy("root").agg(F.min(order).alias("w")).select(F.col("root").alias("_c"), F.col("w.doc_id").alias("_d"), F.col("w.row_hash").alias("_h"))
    lost = found.join(one, found.root == F.col("_c")).where(~(found.doc_id.eqNullSafe(F.col("_d")) & (found.row_hash == F.col("_h"))))
    lost = materialize(lost.select("doc_id", "row_hash").distinct(), "lost")
    again = materialize(found.groupBy("doc_id", "row_hash").count().where("count > 1").select("doc_id", "row_hash"), "again")
    docs = docs.select(*DOC_COLUMNS, text_hash().alias("row_hash"))
    kept = same_row(docs, small(lost), "left_anti")
    if again.limit(1).count():
        kept = same_row(kept, small(again), "left_anti").union(same_row(kept, small(again), "left_semi").dropDuplicates(["doc_id", "row_hash"]))
    return kept.select(*DOC_COLUMNS)
