"""Signals of a case against the library: one long table, a row for each pair that any method may name."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.matching import matched
from ..sources.scratch import written
from . import lexical
from .dense import Embedder, HashedEmbedder, embed, top_k
from .library import before, with_kb_size
from .ranks import place

TITLE_KEPT, SHORTLIST = 0.5, 10
#: Documents of a listing, the constant of rank fusion, characters that are embedded.
RELATED, RRF, EMBEDDED = 10, 60, 1500

#: Titles of a pack, their characters, pairs that are worked out at once, and characters up to which all packs are sent to the tasks.
PACKED, CHARS, PAIRS, SENT = 512, 1_000_000, 10_000, 16 << 20
#: Classes that single characters, and grams of three, are counted in.
CLASSES = {1: 101, 3: 509}
#: Characters of a gram that is held against those near its place; cells of the table that tells which titles have it there.
GRAM, TABLE = 4, 1 << 25
#: Characters from which parts are cut finer, as more grams come up by chance.
LENGTHY = 600
#: Numbers of 64 bits up to which titles are compared all at once, and characters between two looks at which pairs are left.
WORDS, STEPS = 32, 16


def identical(cases: DataFrame, library: DataFrame) -> DataFrame:
    """(case_id, doc_id, date, pos) of older documents with the same normalised body, which is not empty: a hash join."""
    q = cases.select("case_id", "case_date", tx.norm_body("case_text").alias("_b")).where("_b <> ''").withColumn("_h", F.md5("_b"))
    d = library.select("doc_id", "date", "pos", tx.norm_body("text").alias("_body")).withColumn("_h", F.md5("_body"))
    return d.join(q, "_h").where((F.col("_b") == F.col("_body")) & (F.col("date") < F.col("case_date"))).select("case_id", "doc_id", "date", "pos")


def _packed(titles: DataFrame, name: str) -> DataFrame:
    """``name``: arrays of up to PACKED titles that come one after the other, and of up to CHARS characters in all but the longest one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for t in batch.column(0).to_pylist():
                if held and (len(held) == PACKED or n + len(t) > CHARS):
                    yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.string()))], names=[name])
                    held, n = [], 0
                held.append(t)
                n += len(t)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.string()))], names=[name])

    return titles.mapInArrow(run, f"`{name}` array<string>")


def quick_ratios(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, quick) of titles (a) and (b), each once, whose lengths let them be as alike as ``least``: twice the characters that both have over those of both.

    Packs of titles meet; characters are counted once a pack, and pairs leave the
    task as results: nothing is shuffled by pair or by character.
    """
    packs = written(_packed(written(a.select("a"), "titles").coalesce(1), "_a"), "title-packs")
    size = packs.agg(F.sum(F.aggregate("_a", F.lit(0).cast("long"), lambda s, x: s + F.length(x)))).first()[0] or 0
    blocks = _packed(b.select("b"), "_b")
    pairs = blocks.crossJoin(F.broadcast(packs)) if size <= SENT else written(blocks, "title-blocks").crossJoin(packs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column("_a")[i].as_py(), batch.column("_b")[i].as_py()
                la, lb = np.array([len(t) for t in x]), np.array([len(t) for t in y])
                with np.errstate(invalid="ignore"):
                    bound = 2.0 * np.minimum(la[:, None], lb[None, :]) / (la[:, None] + lb[None, :])
                rows, cols = np.nonzero(~(bound < least))
                letters = {c: n for n, c in enumerate(sorted(set().union(*(x[r] for r in np.unique(rows)))))}
                one, two = _counts(x, letters, rows), _counts(y, letters, cols)
                for at in range(0, len(rows), PAIRS):
                    r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
                    m = np.zeros(len(r), np.int64)
                    for n in range(len(letters)):
                        m += np.minimum(one[n][r], two[n][c])
                    m += la[r] + lb[c] == 0  # an empty text has one part, an empty one, in SQL
                    with np.errstate(divide="ignore"):
                        quick = 2.0 * m / (la[r] + lb[c])
                    yield pa.RecordBatch.from_arrays([pa.array(x).take(pa.array(r)), pa.array(y).take(pa.array(c)), pa.array(quick)], names=["a", "b", "quick"])

    return pairs.mapInArrow(run, "a string, b string, quick double")


def _counts(titles: list[str], letters: dict[str, int], used: np.ndarray) -> np.ndarray:
    """How often each letter (row) comes up in each title (column) that is used."""
    out = np.zeros((len(letters), len(titles)), np.int32)
    for i in np.unique(used):
        for c, n in Counter(titles[i]).items():
            if c in letters:
                out[letters[c], i] = n
    return out


def _histogram(titles: list[str], size: int) -> np.ndarray:
    """How often grams of each class (row) come up in each title (column)."""
    codes = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in titles])
    of, ends = np.repeat(np.arange(len(titles)), lengths), np.repeat(np.cumsum(lengths), lengths)
    n = max(0, len(codes) - size + 1)
    gram = sum(codes[k : k + n] * 31**k for k in range(size)) % CLASSES[size]
    inside = np.arange(n) + size <= ends[:n]
    out = np.bincount((gram * len(titles) + of[:n])[inside], minlength=CLASSES[size] * len(titles)).reshape(CLASSES[size], len(titles))
    return out.astype(np.uint8 if lengths.max() < 1 << 8 else np.uint16 if lengths.max() < 1 << 16 else np.int64)


def _placed_grams(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, title, place) of all grams of GRAM characters, one title after the other."""
    codes = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in titles])
    of = np.repeat(np.arange(len(titles)), lengths)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    n = max(0, len(codes) - GRAM + 1)
    gram = sum(codes[k : k + n] << np.uint64(63 * k // GRAM) for k in range(GRAM)) if n else codes[:0]
    inside = at[:n] + GRAM <= lengths[of[:n]]
    return gram[inside], of[:n][inside], at[:n][inside]


def _slots(gram: np.ndarray, part: np.ndarray, bits: int) -> np.ndarray:
    return ((gram ^ (part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


def _share_places(x: list[str], y: list[str], least: float, counts: np.ndarray, known: dict) -> np.ndarray:
    """``counts``, without pairs of which too few grams of ``x`` come up in ``y`` near their place.

    Blocks of M >= least * (|a| + |b|) / 2 characters hold M - (GRAM - 1) * (|a| +
    |b| - 2 M + 1) grams at least (see :func:`_may_be_alike`), and no place is
    moved by more than the |a| - M or |b| - M characters without a partner. Places
    of ``x`` count by parts; a table has a row for each gram and part, with the
    titles of ``y`` that have it in reach. Grams that meet in a row are no fewer.

    ``known`` keeps the tables of the ``y`` that was asked for last.
    """
    la, lb = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    both = la[:, None] + lb[None, :]
    need = ((GRAM - 0.5) * least - (GRAM - 1)) * both - (GRAM - 1) - 1e-9
    if not (counts & (need > 0)).any():
        return counts
    # Rounded up, so that packs of about the same length find the same tables.
    step = max(4, int(lb.max()) // 32)
    right, left = (-(-max(0, int(longest - least * (longest + other) / 2 + 1e-9)) // step) * step for longest, other in ((la.max(), lb.min()), (lb.max(), la.min())))
    width = (left + right) // (6 if lb.max() > LENGTHY else 2) + 1
    bits = min(20, max(12, int(128 * lb.max()).bit_length()))
    some = min(len(y), max(8, TABLE >> bits))
    if known.get("key") != (left, right) or known.get("y") is not y and known.get("y") != y:
        known.clear()
        tables, (gram, of, at) = [], _placed_grams(y)
        first, last = (at - left) // width, (at + right) // width
        for low in range(0, len(y), some):
            table = np.zeros((1 << bits, min(some, len(y) - low)), np.uint8)
            mine = slice(*np.searchsorted(of, (low, low + some)))
            for n in range(int((last - first).max(initial=0)) + 1):
                part = first[mine] + n
                ok = (part >= 0) & (part <= last[mine])
                table[_slots(gram[mine][ok], part[ok], bits), of[mine][ok] - low] = 1
            tables.append((low, low + table.shape[1], np.packbits(table, axis=1)))
        known.update(key=(left, right), y=y, tables=tables)
    gram, of, at = _placed_grams(x)
    slots, ends = _slots(gram, at // width, bits), np.searchsorted(of, np.arange(len(x) + 1))
    kept = counts.copy()
    for low, high, table in known["tables"]:
        cols = slice(low, high)
        for i in np.flatnonzero((counts[:, cols] & (need[:, cols] > 0)).any(axis=1)):
            shared = np.zeros(high - low, np.int64)
            for at in range(ends[i], ends[i + 1], 255):
                have = np.unpackbits(table.take(slots[at : min(at + 255, ends[i + 1])], axis=0), axis=1, count=high - low)
                shared += np.add.reduce(have, axis=0, dtype=np.uint8)
            kept[i, cols] &= shared >= need[i, cols]
    return kept


def _may_be_alike(x: list[str], y: list[str], least: float, counts: np.ndarray, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the pairs of titles that ``counts`` whose lengths and grams let them reach ``least``.

    A pair has M >= least * (|a| + |b|) / 2 matched characters. It shares as many
    single ones; of grams of three all but two in each of its blocks, of which
    there are |a| + |b| - 2 M + 1 at most. Classes of grams are no fewer.
    """
    la, lb = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    both = la[:, None] + lb[None, :]
    counts = counts & (2.0 * np.minimum(la[:, None], lb[None, :]) >= least * both - 1e-9)
    if counts.any() and (GRAM - 0.5) * least > GRAM - 1:
        counts = _share_places(x, y, least, counts, {} if known is None else known)
    rows, cols = np.nonzero(counts)
    if not len(rows):
        return rows, cols
    if len(rows) < counts.size / 8:
        used, at_x = np.unique(rows, return_inverse=True)
        other, at_y = np.unique(cols, return_inverse=True)
        some, few, kept = [x[i] for i in used], [y[i] for i in other], np.arange(len(rows))
        for size, need in ((1, least * both[rows, cols] / 2 - 1e-9), (3, (2.5 * least - 2) * both[rows, cols] - 2 - 1e-9)):
            if size == 1 or 2.5 * least > 2 and len(kept):
                one, two = (np.ascontiguousarray(_histogram(t, size).T) for t in (some, few))
                parts = [kept[at : at + PAIRS] for at in range(0, len(kept), PAIRS)]
                kept = np.concatenate([k[np.minimum(one[at_x[k]], two[at_y[k]]).sum(axis=1, dtype=np.int64) >= need[k]] for k in parts])
        rows, cols = rows[kept], cols[kept]
    else:
        one, two = _histogram(x, 1), _histogram(y, 1)
        shared = np.zeros(both.shape, np.promote_types(one.dtype, two.dtype))
        for n in np.flatnonzero(one.any(axis=1) & two.any(axis=1)):
            shared += np.minimum(one[n][:, None], two[n][None, :])
        rows, cols = np.nonzero(counts & (2.0 * shared >= least * both - 1e-9))
        if 2.5 * least > 2 and len(rows):
            one, two = (np.ascontiguousarray(_histogram(t, 3).T) for t in (x, y))
            need, kept = (2.5 * least - 2) * both[rows, cols] - 2 - 1e-9, np.zeros(len(rows), bool)
            for at in range(0, len(rows), PAIRS):
                part = slice(at, at + PAIRS)
                kept[part] = np.minimum(one[rows[part]], two[cols[part]]).sum(axis=1, dtype=np.int64) >= need[part]
            rows, cols = rows[kept], cols[kept]
    if 2.5 * least <= 2 or not len(rows):
        return rows, cols
    kept = [_in_order(x, y, rows[at : at + PAIRS], cols[at : at + PAIRS], least) for at in range(0, len(rows), PAIRS)]
    kept = np.concatenate(kept)
    return rows[kept], cols[kept]


def _in_order(x: list[str], y: list[str], rows: np.ndarray, cols: np.ndarray, least: float) -> np.ndarray:
    """Whether as many characters as the ratio asks for come in the same order in both: blocks have no more than the longest common subsequence.

    It is worked out for all pairs at once, bits for the characters of ``x`` and a
    step for each one of ``y``; a pair is dropped once ``y`` has too many without a partner.
    """
    used, at_x = np.unique(rows, return_inverse=True)
    other, at_y = np.unique(cols, return_inverse=True)
    x, y = [x[i] for i in used], [y[i] for i in other]
    la, lb = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    spare = lb[at_y] - np.ceil(least * (la[at_x] + lb[at_y]) / 2 - 1e-9).astype(np.int64)
    words, longest = -(-int(la.max()) // 64), int(lb.max())
    if words > WORDS:
        return np.array([_lacking(x[a], y[b], s) <= s for a, b, s in zip(at_x.tolist(), at_y.tolist(), spare.tolist(), strict=True)])
    letters = {c: n for n, c in enumerate(sorted(set().union(*x)))}
    bits = np.zeros((len(letters) + 1, len(x), 64 * words), bool)
    for i, t in enumerate(x):
        bits[[letters[c] for c in t], i, np.arange(len(t))] = True
    bits = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
    codes = np.full((len(y), longest), len(letters))
    for i, t in enumerate(y):
        codes[i, : len(t)] = [letters.get(c, len(letters)) for c in t]
    ends, out = lb[at_y], np.zeros(len(rows), bool)
    free, pairs = np.full((words, len(rows)), ~np.uint64(0)), np.arange(len(rows))
    for j in range(longest):
        match = bits[codes[at_y, j], at_x]
        carry = np.zeros(len(pairs), np.uint64)
        for w in range(words):
            u = free[w] & match[:, w]
            s = free[w] + u
            t = s + carry
            free[w], carry = t | (free[w] ^ u), ((s < u) | (t < s)).astype(np.uint64)
        if j % STEPS == STEPS - 1 or j == longest - 1:
            alive = np.minimum(j + 1, ends) - np.bitwise_count(~free).sum(axis=0, dtype=np.int64) <= spare
            free, pairs, at_x, at_y, ends, spare = free[:, alive], pairs[alive], at_x[alive], at_y[alive], ends[alive], spare[alive]
            if not len(pairs):
                break
    out[pairs] = True
    return out


def _lacking(a: str, b: str, spare: int) -> int:
    """Characters of b that are not in the longest common subsequence; of a part of b, if these are over ``spare``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    lacking = 0
    for j in range(0, len(b), STEPS):
        for c in b[j : j + STEPS]:
            u = free & at.get(c, 0)
            free = ((free + u) | (free - u)) & full
        lacking = min(j + STEPS, len(b)) - (len(a) - free.bit_count())
        if lacking > spare:
            break
    return lacking


def _dated_packs(titles: DataFrame, side: str) -> DataFrame:
    """(t, d, low, high): arrays of up to PACKED titles of about the same length with their days, of up to CHARS characters in all but the longest one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(held: list[tuple[str, str]]) -> pa.RecordBatch:
            t, d = zip(*held, strict=True)
            values = [pa.array([t], pa.list_(pa.string())), pa.array([d], pa.list_(pa.string())), pa.array([len(t[0])], pa.int32()), pa.array([len(t[-1])], pa.int32())]
            return pa.RecordBatch.from_arrays(values, names=names)

        held, n = [], 0
        for batch in batches:
            for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (len(held) == PACKED or n + len(t) > CHARS):
                    yield pack(held)
                    held, n = [], 0
                held.append((t, d))
                n += len(t)
        if held:
            yield pack(held)

    names = [f"{side}t", f"{side}d", f"{side}low", f"{side}high"]
    return titles.select("title", "day").sortWithinPartitions(F.length("title")).mapInArrow(run, f"{side}t array<string>, {side}d array<string>, {side}low int, {side}high int")


def similar_titles(a: DataFrame, b: DataFrame, least: float, older: str | None = None) -> DataFrame:
    """(a, b, title_sim) of different normalised titles (title) whose ratio is at least ``least``; equal ones are in it as well.

    With ``older``, "a" or "b", titles have a day, and only pairs count in which
    the day of that side is before the other one's.

    Packs of titles meet, as far as their lengths allow; counts of characters
    tell pairs apart, and where ``least`` is high enough for any to be shared
    those of grams of three and the longest common subsequence. The others'
    blocks are worked out in the same task: nothing but results leaves it, and
    no pair or gram is shuffled.
    """
    day = F.lit("") if older is None else F.col("day")
    a, b = (written(x.where("title <> ''").select("title", day.alias("day")).where("day is not null").distinct(), "titles") for x in (a, b))
    size = a.agg(F.sum(F.length("title"))).first()[0] or 0
    parts = 4 * b.sparkSession.sparkContext.defaultParallelism
    by_length = (F.length("title"), F.col("title"))
    packs = _dated_packs(a.coalesce(1) if size <= SENT else a.repartitionByRange(-(-size // SENT), *by_length), "a")
    if (GRAM - 0.5) * least > GRAM - 1:
        # Packs of nearly one length meet few others; they are dealt out one by one, so that all cores have a share of the long ones.
        blocks = written(_dated_packs(b.repartitionByRange(parts, *by_length), "b"), "title-blocks").repartition(parts)
    else:
        # Few titles on one side: the other one is cut finely, so that all cores have a share of the long ones.
        blocks = _dated_packs(b.repartition(parts, "title"), "b")
    fit = (F.col("alow") * least <= F.col("bhigh") * (2 - least) + 1e-6) & (F.col("blow") * least <= F.col("ahigh") * (2 - least) + 1e-6)
    if size <= SENT:
        pairs = blocks.join(F.broadcast(written(packs, "title-packs")), fit)
    else:
        pairs = written(blocks, "title-blocks").join(written(packs, "title-packs"), fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, dx, dy = (batch.column(c)[i].as_py() for c in ("at", "bt", "ad", "bd"))
                _, days = np.unique(np.array(dx + dy), return_inverse=True)
                dx, dy = days[: len(x), None], days[None, len(x) :]
                counts = np.ones((len(x), len(y)), bool) if older is None else dx < dy if older == "a" else dy < dx
                out = []
                for r, c in zip(*_may_be_alike(x, y, least, counts, known), strict=True):
                    both = len(x[r]) + len(y[c])
                    m = matched(x[r], y[c], math.ceil(least * both / 2 - 1e-9))
                    if 2.0 * m / both >= least:
                        out.append((x[r], y[c], 2.0 * m / both))
                yield pa.RecordBatch.from_arrays([pa.array([v[n] for v in out], t) for n, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a", "b", "title_sim"])

    return pairs.select("at", "ad", "bt", "bd").mapInArrow(run, "a string, b string, title_sim double")


def title_pairs(cases: DataFrame, library: DataFrame, least: float = TITLE_KEPT) -> DataFrame:
    """(case_id, doc_id, date, pos, title_sim) of older documents with titles that similar.

    Distinct titles are compared once, however many documents or cases share
    them, and only if one's first day is before the other one's last.
    """
    q = written(cases.select("case_id", "case_date", tx.norm_title("case_title").alias("a")).where("a <> ''"), "asked-titles")
    last = q.agg(F.max("case_date").alias("_last"))
    d = library.select("doc_id", "date", "pos", "title").join(F.broadcast(last), F.col("date") < F.col("_last"))
    d = written(d.select("doc_id", "date", "pos", tx.norm_title("title").alias("b")).where("b <> ''"), "dated-titles")
    asked = q.groupBy(F.col("a").alias("title")).agg(F.max("case_date").alias("day"))
    known = d.groupBy(F.col("b").alias("title")).agg(F.min("date").alias("day"))
    pairs = written(similar_titles(asked, known, least, "b"), "title-pairs")
    return pairs.join(q, "a").join(d, "b").where(F.col("date") < F.col("case_date")).select("case_id", "doc_id", "date", "pos", "title_sim")


def best_older_title(library: DataFrame, least: float) -> DataFrame:
    """(doc_id, title_best): how alike the title of each document is to one of an older document, where that is at least ``least``.

    Titles are compared once, older against newer, by the day on which each first
    came up; a title that thousands share is one row of it.
    """
    d = written(library.select("doc_id", "date", tx.norm_title("title").alias("b")).where("b <> ''"), "dated-titles")
    first = d.groupBy("b").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    older, newer = (first.select(F.col("b").alias("title"), F.col(c).alias("day")) for c in ("first", "last"))
    pairs = written(similar_titles(older, newer, least, "a"), "title-pairs").join(first.select(F.col("b").alias("a"), "first"), "a")
    return d.join(pairs, "b").where(F.col("first") < F.col("date")).groupBy("doc_id").agg(F.max("title_sim").alias("title_best"))


def bm25(cases: DataFrame, library: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """(case_id, doc_id, pos, bm25, rank) of the k best older documents, ties to the older one; statistics are the whole library's."""
    q = lexical.asked(cases, "case_id", tx.doc_text("case_title", "case_text"), "case_date")
    counted = lexical.Counted.of(library, tx.doc_text("title", "text"), "doc_id", "pos", "date", among=q)
    return lexical.top_k(counted, lexical.known(counted, q, "case_id", "case_date"), "case_id", "doc_id", "pos", k, F.col("date") < F.col("case_date"), ("case_date",), ("date",))


def body_similarity(pairs: DataFrame, cases: DataFrame, library: DataFrame) -> DataFrame:
    """pairs (case_id, doc_id) with body_sim, by longest matching blocks: for shortlists only."""
    out = pairs.select("case_id", "doc_id").distinct()
    out = out.join(cases.select("case_id", tx.norm_body("case_text").alias("_a")), "case_id").join(library.select("doc_id", tx.norm_body("text").alias("_b")), "doc_id")
    return out.select("case_id", "doc_id", sim.ratio("_a", "_b").alias("body_sim"))


def kb_sizes(cases: DataFrame, library: DataFrame) -> DataFrame:
    """case_id, kb_size: how many documents are older."""
    return with_kb_size(cases.select("case_id", "case_date"), library).select("case_id", "kb_size")


def related(cases: DataFrame, library: DataFrame, k: int = RELATED, make: Callable[[], Embedder] = HashedEmbedder) -> DataFrame:
    """(case_id, place, doc_id, date, title, rrf): the older documents that rank best by meaning, words and title together.

    Every older document has a rank in all three; what a signal does not name
    scores 0 there, and ties go to the older one. The ranks of a case are
    worked out over ranges, so that a case may have a library of any size.
    """
    vectors = library.select("doc_id", "pos", "date", embed(tx.doc_text("title", "text", EMBEDDED), make, "passage").alias("_v"))
    asked = cases.select("case_id", "case_date", embed(tx.doc_text("case_title", "case_text", EMBEDDED), make, "query").alias("_q"))
    pairs = before(written(asked, "asked-vectors"), written(vectors, "vectors")).select("case_id", "doc_id", "pos", F.round(sim.cosine(F.col("_q"), F.col("_v")), 6).alias("cos"))
    words = lexical.scores(cases, "case_id", tx.doc_text("case_title", "case_text"), library, "doc_id", tx.doc_text("title", "text"))
    titles = title_pairs(cases, library).select("case_id", "doc_id", "title_sim")
    rows = pairs.join(words, ["case_id", "doc_id"], "left").join(titles, ["case_id", "doc_id"], "left")
    rows = rows.select("case_id", "doc_id", "pos", "cos", F.round(F.coalesce("bm25", F.lit(0.0)), lexical.PLACES).alias("bm25"), F.coalesce("title_sim", F.lit(0.0)).alias("title_sim"))
    for name in ("cos", "bm25", "title_sim"):
        rows = place(rows, ["case_id"], [-F.col(name), F.col("pos")], f"by_{name}")
    best = rows.withColumn("rrf", sum(1.0 / (RRF + F.col(f"by_{name}")) for name in ("cos", "bm25", "title_sim")))
    best = top_k(best, "case_id", k, F.desc("rrf"), F.col("pos"), name="place")
    return best.select("case_id", "place", "doc_id", "rrf").join(library.select("doc_id", "date", "title"), "doc_id").select("case_id", "place", "doc_id", "date", "title", "rrf")


def top_documents(scored: DataFrame, score: str, k: int = SHORTLIST) -> DataFrame:
    """The k best documents of each case, with rank; ties go to the older one."""
    return top_k(scored, "case_id", k, F.desc(score), F.col("pos"))
