"""Benchmark decontamination by winnowing.

Words are runs of characters other than ASCII ones that are no letters or
digits, with A-Z in lower case. The hash of every K-word gram is taken, and of
every W grams in a row the least one is kept, by the same rule in documents and
items. A span of SPAN = K + W - 1 words that an item shares with a document is
W grams in both, whose least one is kept in both, so every such span is found.
Kept grams are joined on their hash; each match is then extended, word by word,
to both sides, as far as a window of SPAN words that holds it can reach, which
proves the match exactly and yields the words hit.

Items of fewer than SPAN words are one window each; the grams of each such
length are all kept.

Before the join, documents drop the grams that no item has, by a Bloom filter
of fixed size (2 MB) over the items' grams, whatever their number: a larger
benchmark lets more rows through to the join and loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, id_type, in_batches, materialize, same_row, small, text_hash

#: Words of a window; words of a gram; grams from which the least one is kept.
SPAN, K = 13, 9
W = SPAN - K + 1
#: Bits of the filter, as a power of two, and of one of the blocks that it is put together from.
FILTER_BITS, BLOCK_BITS = 24, 15
#: Known words of which each task keeps the hash.
MEMO = 150_000
#: Share of hit words, as 1 in so many, from which a document is contaminated.
SHARE = 20

#: ASCII letters in lower case, digits, and bytes of other characters as they are; any other byte as a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

_GRAM = "struct<h:long,k:int,pos:int,lead:int,ctx:string>"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Grams:
    """The grams that a text keeps, as (hash, kind, position); kind 0 is winnowed, others are of that many words."""

    def __init__(self, short: list[int]) -> None:
        self.short, self.memo = short, {}

    def codes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        digest = xxhash.xxh64_intdigest
        for w in set(words).difference(memo):
            memo[w] = digest(w)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))

    @staticmethod
    def hashes(codes: np.ndarray, k: int, kind: int) -> np.ndarray:
        n = len(codes) - k + 1
        if n < 1:
            return np.zeros(0, dtype=np.uint64)
        h = np.full(n, kind + 1, dtype=np.uint64)
        for j in range(k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += codes[j : j + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def __call__(self, words: list[bytes], filtered: np.ndarray | None = None, whole: int = 0):
        """filtered: only what this Bloom filter has. whole: only grams of that many words, not the winnowed ones."""
        codes = self.codes(words)
        if not whole and len(words) >= SPAN:
            h = self.hashes(codes, K, 0)
            windows = np.lib.stride_tricks.sliding_window_view(h, W)
            at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
            yield from self.known(h[at], at, 0, filtered)
        for k in [whole] if whole else self.short:
            h = self.hashes(codes, k, k)
            yield from self.known(h, np.arange(len(h)), k, filtered)

    @staticmethod
    def known(h, at, kind, filtered):
        if filtered is not None:
            a, b = bits_of(h)
            has = (filtered[a >> 3] >> (a & 7)) & (filtered[b >> 3] >> (b & 7)) & 1
            h, at = h[has == 1], at[has == 1]
        yield from ((x, kind, p) for x, p in zip(h.astype(np.int64).tolist(), at.tolist(), strict=True))


def bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, mask = np.uint64(FILTER_BITS), np.uint64((1 << FILTER_BITS) - 1)
    return (h & mask).astype(np.int64), (h >> n & mask).astype(np.int64)


def context(words: list[bytes], kind: int, pos: int) -> dict:
    """The gram with the words around it that a window which holds it can reach."""
    start, end = (max(0, pos - W + 1), pos + K + W - 1) if kind == 0 else (pos, pos + kind)
    return {"pos": pos, "lead": pos - start, "ctx": b" ".join(words[start:end]).decode("utf-8", "replace")}


def _text_grams(make, whole):
    """For mapInArrow: the first columns as they are, then n_words and grams from the last one, the text."""

    def run(batches):
        grams, filtered = make()
        for batch in batches:
            ns, found = [], []
            for t in batch.column(batch.num_columns - 1).cast(pa.binary()):
                words = split_words(t.as_py() or b"")
                ns.append(len(words))
                k = len(words) if whole and 0 < len(words) < SPAN else 0
                found.append([{"h": h, "k": kind} | context(words, kind, pos) for h, kind, pos in grams(words, filtered, k)])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            kind = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int32()), ("pos", pa.int32()), ("lead", pa.int32()), ("ctx", pa.string())]))
            names = [*batch.schema.names[:-1], "n_words", "grams"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ns, pa.int64()), pa.array(found, kind)], names)

    return run


def item_grams(items: DataFrame) -> DataFrame:
    """(item_id string, h, k, pos, lead, ctx) of the items."""
    run = _text_grams(lambda: (Grams([]), None), True)
    out = in_batches(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), run, f"item_id string, n_words long, grams array<{_GRAM}>")
    return out.select("item_id", F.explode("grams").alias("g")).select("item_id", "g.*")


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """Bytes of the filter over column h: of the same size for any number of rows; partial filters are joined in blocks."""
    width = 1 << (BLOCK_BITS - 3)

    def partial(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        for batch in batches:
            for x in bits_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                np.bitwise_or.at(bits, x >> 3, (1 << (x & 7)).astype(np.uint8))
        blocks = bits.reshape(-1, width)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "bits"])

    def merged(pdf):
        out = np.bitwise_or.reduce(np.stack([np.frombuffer(x, dtype=np.uint8) for x in pdf.bits]))
        return pdf.head(1).assign(bits=out.tobytes())

    schema = "block long, bits binary"
    rows = in_batches(hashes.select("h"), partial, schema).groupBy("block").applyInPandas(merged, schema).collect()
    out = np.zeros((1 << (FILTER_BITS - 3)) // width * width, dtype=np.uint8).reshape(-1, width)
    for r in rows:
        out[r.block] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1)


def extend(a: str, la: int, b: str, lb: int, kind: int) -> tuple[int, int] | None:
    """Words by which two matching grams go on, equal, to the left and to the right; None if no window fits."""
    if kind:
        return (0, 0) if a == b else None
    x, y = a.split(" "), b.split(" ")
    if x[la : la + K] != y[lb : lb + K]:
        return None
    left = 0
    while left < min(la, lb) and x[la - left - 1] == y[lb - left - 1]:
        left += 1
    right, most = 0, min(len(x) - la, len(y) - lb) - K
    while right < most and x[la + K + right] == y[lb + K + right]:
        right += 1
    return (left, right) if left + K + right >= SPAN else None


def _verified(batches):
    for batch in batches:
        c = batch.to_pydict()
        rows = []
        for row, k, pos, lead, ctx, gid, ilead, ictx in zip(*(c[n] for n in ("row", "k", "pos", "lead", "ctx", "gid", "ilead", "ictx")), strict=True):
            if (found := extend(ctx, lead, ictx, ilead, k)) is not None:
                rows.append((row, pos - found[0], pos + (k or K) + found[1], gid))
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["row", "start", "end", "gid"])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, row_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the document's words inside any occurrence of an item's
    window, n_items the item_ids with such windows; items without an id hit
    words but are not counted. A text without words has n_words 0 and is clean.
    """
    spark = docs.sparkSession
    known = materialize(item_grams(items), "items")
    short = [r.k for r in known.where("k > 0").select("k").distinct().collect()]  # 12 lengths at most
    filtered = spark.sparkContext.broadcast(bloom_filter(known))
    run = _text_grams(lambda: (Grams(short), filtered.value), False)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_hash().alias("row_hash"), "text")
    rows = materialize(in_batches(rows, run, f"row long, doc_id {id_type(docs)}, row_hash long, n_words long, grams array<{_GRAM}>"), "grams")
    cand = rows.select("row", F.explode("grams").alias("g")).select("row", "g.*")
    known = known.select("h", "k", "item_id", F.col("lead").alias("ilead"), F.col("ctx").alias("ictx"))
    # A passage of many items is one context, and documents with the same contexts have the same items: ids are put to each such set once.
    at = ["h", "k", "ilead", "ictx"]
    contexts = materialize(known.select(*at).distinct().withColumn("gid", F.monotonically_increasing_id()), "contexts")
    members = materialize(known.where("item_id is not null").join(contexts, at).select("gid", "item_id").distinct(), "members")
    spans = in_batches(cand.join(small(contexts, 100_000), ["h", "k"]), _verified, "row long, start int, end int, gid long")
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("gid")).alias("gids"))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n")),
    )["n"]
    spans = materialize(spans.select(F.col("row").alias("_row"), union.alias("hit"), "gids"), "hits")
    sets = spans.select("gids").distinct().select("gids", F.explode("gids").alias("gid")).join(members, "gid")
    sets = sets.groupBy("gids").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    sets = sets.select(F.col("gids").alias("_gids"), F.size("ids").cast("long").alias("items"), F.sha2(F.array_join("ids", ","), 256).alias("sha"))
    spans = materialize(spans.join(sets, F.col("gids") == F.col("_gids"), "left").select("_row", "hit", "items", "sha"), "items_hit")
    out = rows.drop("grams").join(small(spans), F.col("row") == F.col("_row"), "left")
    out = out.select("doc_id", "row_hash", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of documents that are not contaminated, repeated ones and those with a null or empty text too."""
    bad = materialize(decontaminate(docs, items).where("contaminated").select("doc_id", "row_hash").distinct(), "bad")
    return same_row(docs.select(*DOC_COLUMNS, text_hash().alias("row_hash")), small(bad), "left_anti").select(*DOC_COLUMNS)
