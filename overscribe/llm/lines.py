"""Line dedup: least-hash sketches of word pairs as candidate keys, edit similarity, connected groups.

A line is normalised to its words in lower case, without punctuation; lines
without words stay out of it. Equal normalised lines are one, whatever their
length. Lines are also linked if their words differ in at most a fifth, by edit
distance over the longer one; that lets lines of FUZZY_WORDS words and more
differ at all. Of each connected group the occurrence that comes first, by
doc_id, text hash and line number, is kept and the others are removed.

Candidates. A SimHash of lines this similar differs in about 13 of 64 bits, too
many for blocks of bits to be both shared and selective, so the keys are blocks
of another kind: in one pseudo-random order of all pairs of neighbouring words,
in which pairs of words that are rare in the whole table tend to come first, a
line's KEYS first pairs. An edit changes two pairs at most, so lines of up to 15
words that are similar enough always share two of them; of longer ones that
differ in just a fifth a few in a hundred share none, of more alike ones far
fewer. The parity of words in classes changes by two bits an edit at most; lines
further apart in it are not compared word by word.

Lines that share a key are all compared, however many share it. Up to BUCKET
lines of a key give pairs, whose words are joined to them. The lines of a hot
key, over BUCKET, meet with their words in one place, TILE at once, and give a
link only where it joins two groups, so that a group of near copies gives as
many links as it has lines. Of a key with over TILE lines each part meets with
the key's first line; if the key then still has lines of several groups, those
outside the first line's group meet each other and the lines of that group, part
by part, in bands of length. A task that has over HOT lines of a key lets just
over BUCKET of them meet in the key's place, by which the key is known to be hot,
and hands the others on, so that no task gets all lines of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, DOC_COLUMNS, id_type, in_batches, materialize, release, same_row, small, text_hash
from .components import components
from .winnow import FOLD

SIMILARITY = 0.8
#: Words from which a line can be similar enough to another one: to one of five words, by one edit.
FUZZY_WORDS = 4
#: Word pairs of a line that are its keys, at most.
KEYS = 8
#: Words of which frequencies are kept.
COMMON = 50_000
#: Lines with one key up to which all pairs are dealt out, and lines that meet at once in one place beyond.
BUCKET, TILE = 128, 4_096
#: Lines of a key among LINES, which a task looks at together, from which they are handed on, and to how many places.
HOT, LINES, PLACES = 400, 20_000, 4_096
#: Bytes of text scanned at once, texts put together for that, and lines that each task remembers.
CHUNK, TEXTS, MEMO = 1 << 16, 200, 150_000
#: Pairs of lines and bytes of words that are put together to be compared, and cells of edit matrices at once.
PAIRS, BYTES, CELLS = 20_000, 1 << 23, 1 << 23
#: Bits of a key and of a slot of the word frequencies.
KEY_BITS, SLOT_BITS = 50, 20
#: Numbers of words at which a band begins: similar lines are of one band or of neighbouring ones.
BANDS = [1]
while BANDS[-1] < 1 << 30:
    BANDS.append(-(-5 * BANDS[-1] // 4))

_U = np.uint64
#: Odd numbers that hashes are made of.
STEP, LINE, PAIR, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, _U(0xA24BAED4963EE407), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)
#: Which bytes are parts of words, and a number for each folded byte.
IN_WORD = np.array([c != 32 for c in FOLD])
BYTE = np.where(IN_WORD, (np.random.default_rng(7).integers(0, 2**64, 256, dtype=_U) | _U(1))[np.frombuffer(FOLD, np.uint8)], _U(0))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * MIX1
    h = (h ^ (h >> _U(29))) * MIX2
    return h ^ (h >> _U(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out, k = np.ones(n, dtype=_U), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * _U(pow(base, k, 2**64))
        k *= 2
    return out


def most_edits(n: int, least: float = SIMILARITY) -> int:
    """Edits that two lists, the longer one of n elements, may have at that similarity."""
    return int((1 - least) * n + 1e-9)


class Scanner:
    """Words of texts as hashes: sums of a number a byte times the powers of one base, so that all words of a chunk come from one running sum."""

    def __init__(self) -> None:
        self.up, self.down = powers(STEP, CHUNK + 1), powers(pow(STEP, -1, 2**64), CHUNK + 1)
        self.sums, self.parts = np.zeros(CHUNK + 1, dtype=_U), np.zeros(CHUNK, dtype=_U)

    def words(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the words of these bytes."""
        n, up, down, sums, parts = len(a), self.up, self.down, self.sums, self.parts
        if n > CHUNK:  # one long line
            up, down, sums, parts = powers(STEP, n + 1), powers(pow(STEP, -1, 2**64), n + 1), np.zeros(n + 1, dtype=_U), np.zeros(n, dtype=_U)
        inside = np.zeros(n + 2, dtype=bool)
        IN_WORD.take(a, out=inside[1:-1], mode="clip")
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        BYTE.take(a, out=parts[:n], mode="clip")
        np.multiply(parts[:n], up[:n], out=parts[:n])
        np.cumsum(parts[:n], out=sums[1 : n + 1])
        return start, mixed((sums[end] - sums[start]) * down[start])

    def __call__(self, texts: list[bytes]):
        """In chunks (text, line number, first word, number of words, hashes of words): arrays with an entry a line that has words, and the words."""
        a = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        breaks = np.flatnonzero(a == 10)
        starts, ends = np.append(0, breaks + 1), np.append(breaks, len(a))
        of_text = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        first_line = np.searchsorted(starts, of_text)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
            place, words = self.words(a[starts[at] : ends[to - 1]])
            first = np.searchsorted(place, starts[at:to] - starts[at])
            count = np.diff(first, append=len(words))
            line = np.flatnonzero(count)
            if len(line):
                text = np.searchsorted(first_line, line + at, "right") - 1
                yield text, line + at - first_line[text], first[line], count[line], words
            at = to


def slots(words: np.ndarray) -> np.ndarray:
    return (words >> _U(64 - SLOT_BITS)).astype(np.int64)


def least_pairs(words: np.ndarray, first: np.ndarray, count: np.ndarray, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(number of keys, keys) of each line of FUZZY_WORDS words and more, in ascending order.

    common: by slot, how often words are there, over the root of all words. A pair that would be
    expected f times comes later, as if it were drawn with a weight of (1 + 50 f) ** -0.5.
    """
    n = count - 1
    end = np.cumsum(n)
    at = np.arange(end[-1]) + np.repeat(first - (end - n), n)
    h = mixed(words[at] * PAIR + words[at + 1])
    order = -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
    if common is not None:
        of = common[slots(words)]
        order *= np.sqrt(1 + 50 * of[at] * of[at + 1])
    line = np.repeat(np.arange(len(first)), n)
    keys = order.view(_U) >> _U(64 - KEY_BITS)  # positive numbers sort as their bits do
    if len(first) < 1 << (64 - KEY_BITS):
        both = (line.astype(_U) << _U(KEY_BITS)) | keys
        both.sort()
        line, keys = (both >> _U(KEY_BITS)).astype(np.int64), both & _U((1 << KEY_BITS) - 1)
    else:
        by = np.lexsort((keys, line))
        line, keys = line[by], keys[by]
    new = np.append(True, (keys[1:] != keys[:-1]) | (line[1:] != line[:-1]))
    line, keys = line[new], keys[new]
    rank = np.arange(len(line)) - np.searchsorted(line, np.arange(len(first)))[line]
    kept = rank < np.minimum(KEYS, 2 * (count // 4) + 2)[line]
    return np.bincount(line[kept], minlength=len(first)), keys[kept].astype(np.int64)


def parities(words: np.ndarray, first: np.ndarray, n: int = 4) -> list[np.ndarray]:
    """n numbers a line, 4 or 2: the parity of its words in 64 n classes."""
    bit, part = _U(1) << ((words >> _U(56)) & _U(63)), (words >> _U(62)) & _U(n - 1)
    return [np.bitwise_xor.reduceat(np.where(part == _U(i), bit, _U(0)), first).view(np.int64) for i in range(n)]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _slices(batch: pa.RecordBatch, column: int):
    """(slice, its texts): few texts at once."""
    for at in range(0, batch.num_rows, TEXTS):
        part = batch.slice(at, TEXTS)
        yield part, _texts(part.column(column))


def line_names(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each line's words and their order; lines have all the words, one after the other."""
    place = np.arange(len(words)) - np.repeat(first, count)
    return mixed(np.add.reduceat(words * powers(LINE, int(count.max()))[place], first) + count.astype(_U) * PAIR)


def _coded(words: np.ndarray, count: np.ndarray, new: np.ndarray) -> pa.Array:
    """The words of each new line in 32 bits each, null for other lines; lines have all the words, one after the other."""
    data = (words >> _U(32)).astype(np.uint32)[np.repeat(new, count)]
    ends = np.append(0, np.cumsum(np.where(new, 4 * count, 0))).astype(np.int32)
    bits = np.packbits(new, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(count), [pa.py_buffer(x) for x in (bits, ends, data)])


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, line, num, words, codes) of every line that counts.

    num, a hash of 64 bits, names the normalised line. codes, the hashes of its words in 32 bits each, are null for short lines and
    most repeats.
    """

    def run(batches):
        scan, seen = Scanner(), np.zeros(MEMO, dtype=_U)
        for batch in batches:
            for part, texts in _slices(batch, 2):
                for text, line, first, count, words in scan(texts):
                    names = line_names(words, first, count)
                    place = (names % _U(MEMO)).astype(np.int64)
                    new = np.zeros(len(names), dtype=bool)
                    new[np.unique(names, return_index=True)[1]] = True
                    new &= (count >= FUZZY_WORDS) & (seen[place] != names)
                    seen[place[new]] = names[new]
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), part.column(1).take(at), pa.array(line.astype(np.int32)), pa.array(names.view(np.int64)), pa.array(count.astype(np.int32)), _coded(words, count, new)],
                        ["doc_id", "row_hash", "line", "num", "words", "codes"],
                    )

    docs_ = docs.select("doc_id", text_hash().alias("row_hash"), "text")
    return in_batches(docs_, run, f"doc_id {id_type(docs)}, row_hash long, line int, num long, words int, codes binary")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, count) of lines that are given by their codes: those of all, and where each line has its own."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    codes = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32)
    return codes, (ends[:-1] - ends[0]) // 4, np.diff(ends) // 4


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_codes` with numbers of 64 bits for the words."""
    codes, first, count = _codes(column)
    return mixed(codes * _U(STEP)), first, count


def common_words(known: DataFrame) -> np.ndarray:
    """By slot, how often the most frequent words are in all lines (codes), over the root of the number of these."""

    def run(batches):
        counts, held = np.zeros(1 << SLOT_BITS, dtype=np.int64), []
        for batch in batches:
            held.append(slots(_words(batch.column(0))[0]))
            if sum(map(len, held)) > 1 << SLOT_BITS:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held = []
        for x in held:
            counts += np.bincount(x, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["slot", "n"])

    few = known.select("codes").coalesce(known.sparkSession.sparkContext.defaultParallelism)  # a task gives up to a million rows, however many lines it has
    rows = in_batches(few, run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = rows.orderBy(F.desc("n"), "slot").limit(COMMON).collect()
    out = np.zeros(1 << SLOT_BITS, dtype=np.float32)
    out[[r.slot for r in rows]] = [r.n for r in rows]
    return out / max(1.0, float(out.sum()) ** 0.5)


def keyed(known: DataFrame) -> DataFrame:
    """(block, num, p, q, words): a row for each key of the lines (num, codes); p and q, the parity of words in 128 classes.

    Rows beyond the first BUCKET + 1 of a key with over HOT lines among LINES have one of PLACES numbers above the key's bits.
    """
    shared = known.sparkSession.sparkContext.broadcast(common_words(known))  # 4 MB
    most = HOT

    def told(held):
        num, count, p, q, n, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        of = np.repeat(np.arange(len(num)), n)
        by = np.lexsort((num[of], keys))
        of, keys = of[by], keys[by]
        new = np.append(True, (keys[1:] != keys[:-1]) | (num[of[1:]] != num[of[:-1]]))
        of, keys = of[new], keys[new]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(start, append=len(keys))
        on = (np.repeat(size, size) > most) & (np.arange(len(keys)) - np.repeat(start, size) > BUCKET)
        keys = np.where(on, keys | ((num[of] & (PLACES - 1)) + 1) << KEY_BITS, keys)
        for at in range(0, len(keys), 10_000):
            o = of[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[at : at + 10_000], num[o], p[o], q[o], count[o].astype(np.int32))], ["block", "num", "p", "q", "words"])

    def run(batches):
        held, lines = [], 0
        for batch in batches:
            words, first, count = _words(batch.column(1))
            n, keys = least_pairs(words, first, count, shared.value)
            held.append((batch.column(0).to_numpy(), count, *parities(words, first, 2), n, keys))
            lines += batch.num_rows
            if lines >= LINES:
                yield from told(held)
                held, lines = [], 0
        if held:
            yield from told(held)

    return in_batches(known.select("num", "codes"), run, "block long, num long, p long, q long, words int")


def edits(a: list, b: list, most: int) -> int:
    """Edits between two lists; more than ``most`` if there are more. Equal ends are cut off; the rest goes in bits, one element of b at a time."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = sorted((a[i : len(a) - j], b[i : len(b) - j]), key=len)
    if not a or len(b) - len(a) > most:
        return len(b)
    # Column differences of the edit matrix, plus and minus, as bits of two numbers.
    m, where = len(a), {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, left = full, 0, m, len(b)
    for x in b:
        equal = where.get(x, 0)
        vertical, across = equal | minus, (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus), plus & across
        left -= 1
        score += 1 if up & top else -1 if down & top else 0
        if score - left > most:
            return most + 1
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
    return score


def similar(a: list, b: list) -> bool:
    """Whether the edits of two lists are at most a fifth of the longer one."""
    if len(a) < len(b):
        a, b = b, a
    most = most_edits(len(a))
    if len(a) - len(b) > most:
        return False
    x = set(a)
    if len(x) - len(x.intersection(b)) > most:
        return False
    return edits(a, b, most) <= most


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """:func:`similar` for two lines' codes. Most that are differ in no more places, counted from their starts or ends, than edits are allowed."""
    if len(a) < len(b):
        a, b = b, a
    most, more = most_edits(len(a)), len(a) - len(b)
    if more > most:
        return False
    if np.count_nonzero(a[: len(b)] != b) + more <= most or more and np.count_nonzero(a[more:] != b) + more <= most:
        return True
    return similar(a.tolist(), b.tolist())


def bags(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each line, how many of its words are in each of 256 classes."""
    out, classes = np.zeros((len(first), 256), dtype=np.uint8), (words >> words.dtype.type(8 * words.itemsize - 8)).astype(np.int64)
    for at in range(0, len(first), 200):
        n = count[at : at + 200]
        end = np.cumsum(n)
        place = np.arange(end[-1]) + np.repeat(first[at : at + 200] - (end - n), n)
        got = np.bincount(classes[place] + np.repeat(np.arange(0, 256 * len(n), 256), n), minlength=256 * len(n))
        out[at : at + 200] = np.minimum(got, 255).reshape(-1, 256)
    return out


def _places_apart(words: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """In how many places the n words from a on differ from those from b on."""
    end = np.cumsum(n)
    each = np.arange(end[-1]) if len(n) else end
    differ = words[each + np.repeat(a - (end - n), n)] != words[each + np.repeat(b - (end - n), n)]
    return np.diff(np.append(0, np.cumsum(differ))[end], prepend=0)


def _edits_in_band(words: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, up: np.ndarray, kind) -> np.ndarray:
    """The fewest edits from the na words at a to the nb words at b, nb <= na, on paths that keep to as many diagonals of the edit matrix as kind has bits.

    Of these ``up`` are above the main one. As in :func:`edits`, a word of b at a time, for all pairs at once; bits move on by one with each word,
    so that a diagonal keeps its bit, and the edits are those that the diagonal of the end takes.
    """
    width, most = 8 * np.dtype(kind).itemsize, int(nb.max())
    rows = np.lib.stride_tricks.sliding_window_view(words.take(a[:, None] - up[:, None] + np.arange(most + width - 1), mode="clip"), width, axis=1)
    equal = np.packbits(rows == words.take(b[:, None] + np.arange(most), mode="clip")[:, :, None], axis=2, bitorder="little")
    equal = np.ascontiguousarray(equal.view(kind)[:, :, 0].T)
    one, full = kind(1), kind(2**width - 1)
    for c in range(min(most, int(up.max()))):  # there are no words before the first
        equal[c] &= full << np.maximum(up - c, 0).astype(kind)
    plus, minus, end = full << up.astype(kind), np.zeros(len(a), dtype=kind), one << (na - nb + up).astype(kind)
    out = na - nb
    left = np.searchsorted(-nb, -np.arange(most), "left")  # nb falls: so many pairs have a word there
    for c in range(most):
        n = left[c]
        x, p, m = equal[c, :n], plus[:n], minus[:n]
        level = (((x & p) + p) ^ p) | x | m
        out[:n] += (level & end[:n]) == 0
        rise, fall = m | ~(level | p), level & p
        level >>= one
        plus, minus = fall | ~(level | rise), level & rise
    return out


def all_alike(words: np.ndarray, first: np.ndarray, count: np.ndarray, i: np.ndarray, j: np.ndarray, bag: np.ndarray | None = None) -> np.ndarray:
    """:func:`similar` for the pairs (i, j) of lines, each with count words from first on; bag: :func:`bags` of the lines.

    Places that differ tell that lines are similar, bags that they are not; edits, which decide on the others, need just one diagonal more than
    there may be edits, up to 64. Lines of 320 words and more, which may have more, are compared one by one where 64 are not enough.
    """
    swap = count[i] < count[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    most, more = (count[i] * (1 - SIMILARITY) + 1e-9).astype(np.int64), count[i] - count[j]
    out, left = np.zeros(len(i), dtype=bool), np.flatnonzero(more <= most)
    for ends in (False, True):
        a, b = first[i[left]], first[j[left]]
        ok = _places_apart(words, a + more[left] if ends else a, b, count[j[left]]) + more[left] <= most[left]
        out[left[ok]] = True
        left = left[~ok]
    x, y = i[left], j[left]
    if bag is None:
        used, at = np.unique(np.append(x, y), return_inverse=True)
        bag, x, y = bags(words, first[used], count[used]), at[: len(x)], at[len(x) :]
    for at in range(0, len(left), 4_000):
        o, own, other = left[at : at + 4_000], bag[x[at : at + 4_000]], bag[y[at : at + 4_000]]
        left[at : at + 4_000] = np.where((np.maximum(own, other) - other).sum(axis=1, dtype=np.int64) <= most[o], o, -1)
    left = left[left >= 0]
    for low, kind in ((0, np.uint8), (8, np.uint16), (16, np.uint32), (32, np.uint64)):
        width = 8 * np.dtype(kind).itemsize
        of = left[(most[left] >= low) & ((most[left] < width) | (low == 32)) & (more[left] < 64)]
        of, at = of[np.argsort(-count[j[of]], kind="stable")], 0
        while at < len(of):
            o = of[at : at + max(1, CELLS // (width * int(count[j[of[at]]])))]
            up = (np.minimum(most[o], width - 1) - more[o]) // 2
            out[o] = _edits_in_band(words, first[i[o]], count[i[o]], first[j[o]], count[j[o]], up, kind) <= most[o]
            at += len(o)
    for o in left[(most[left] > 63) & ~out[left]].tolist():
        out[o] = alike(*(words[first[x] : first[x] + count[x]] for x in (i[o], j[o])))
    return out


def meetings(rows: DataFrame) -> DataFrame:
    """(hot, a, b, words) of rows of :func:`keyed`, which may repeat.

    Where hot is false, a and b are two lines that may be similar; else line b, of so many words, has key a, which over BUCKET lines have.
    Rows come in order of their key, so that a task holds BUCKET rows and PAIRS at most, and a batch.
    """

    def run(batches):
        held, going = np.zeros((5, 0), dtype=np.int64), -1  # rows of the last key, which may go on, and the last key if it is hot
        for some in _piled(batches):
            now = (np.concatenate([b.column(c).to_numpy() for b in some]).astype(np.int64) for c in range(5))
            held, going, out = _met(np.concatenate([held, np.stack(list(now))], axis=1), going, False)
            yield out
        yield _met(held, going, True)[2]

    rows = rows.repartition("block").sortWithinPartitions("block", "num")
    return in_batches(rows, run, "hot boolean, a long, b long, words int", 10_000)


def _met(x: np.ndarray, going: int, last: bool) -> tuple[np.ndarray, int, pa.RecordBatch]:
    """For :func:`meetings`: (rows of the last key, which may go on; that key if it is hot; what the others give)."""
    if x.shape[1]:
        x = x[:, np.append(True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1]))]
    block, num, p, q, words = x
    n = len(block)
    start = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(start, append=n)
    many = (size > BUCKET) | (block[start] == going) | (block[start] >> KEY_BITS > 0)
    done = n if last or not n or many[-1] else start[-1]
    each = np.repeat(many, size)[:done]
    pairs = [np.zeros((2, 0), dtype=np.int64)]
    i = np.flatnonzero(~each)
    for k in range(1, BUCKET):
        i = i[i + k < done]
        i = i[block[i + k] == block[i]]
        if not len(i):
            break
        most = (np.maximum(words[i], words[i + k]) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
        bits = np.bitwise_count((p[i] ^ p[i + k]).view(_U)).astype(np.int64) + np.bitwise_count((q[i] ^ q[i + k]).view(_U))
        ok = i[(np.abs(words[i] - words[i + k]) <= most) & (bits <= 2 * most)]
        pairs.append(np.stack([num[ok], num[ok + k]]))
    pairs, hot = np.concatenate(pairs, axis=1), np.flatnonzero(each)
    out = [np.append(pairs[0], block[hot] & ((1 << KEY_BITS) - 1)), np.append(pairs[1], num[hot]), np.append(np.zeros(pairs.shape[1], np.int64), words[hot]).astype(np.int32)]
    of = pa.array(np.repeat([False, True], [pairs.shape[1], len(hot)]))
    return x[:, done:], int(block[-1]) if n and many[-1] else -1, pa.RecordBatch.from_arrays([of, *map(pa.array, out)], ["hot", "a", "b", "words"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of lines (num, codes) that are similar enough, without most that a task's other pairs link already."""

    def told(held):
        table = pa.Table.from_batches(held).combine_chunks()
        words, first, count = _codes(pa.concat_arrays([table["x"].chunk(0), table["y"].chunk(0)]))
        n = table.num_rows
        return table.filter(pa.array(all_alike(words, first, count, np.arange(n), np.arange(n, 2 * n)))).select(["a", "b"])

    def run(batches):
        group: dict[int, int] = {}

        def root(x):
            while (y := group.get(x, x)) != x:
                group[x] = group.get(y, y)
                x = y
            return x

        for held in _piled(batches):
            found = told(held)
            ok = []
            for i, (a, b) in enumerate(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)):
                p, q = root(a), root(b)
                if p != q:
                    group[p] = q
                    ok.append(i)
            if len(group) > MEMO:
                group.clear()
            yield from found.take(pa.array(ok, pa.int64())).to_batches()

    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return in_batches(both, run, "a long, b long")


def _piled(batches):
    """Lists of batches with PAIRS rows or BYTES, or just more."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PAIRS or size >= BYTES:
            yield held
            held, rows, size = [], 0, 0
    if rows:
        yield held


def _linked(num: np.ndarray, root: np.ndarray, codes: pa.Array) -> list[tuple[int, int]]:
    """Pairs of similar lines, as many as it takes to put all of these together that are not yet; root: their groups so far.

    Lines are compared with all longer ones, first one line, then more at once: near copies are one group before most of their pairs are due.
    """
    short, first, count = _codes(codes)
    bits, by = np.stack(parities(mixed(short * _U(STEP)), first), axis=1).view(_U), np.argsort(count, kind="stable")
    num, root, first, n, bits = num[by], root[by], first[by], count[by], np.ascontiguousarray(bits[by].T)
    group = np.unique(root, return_inverse=True)[1]
    left = group.max()
    most, end = (n * (1 - SIMILARITY) + 1e-9).astype(np.int64), np.searchsorted(n, n * 5 // 4, "right")
    bag, out, i, step = bags(short, first, n), [], 0, 1
    while left and i < len(n):
        to = min(i + step, len(n))
        until = int(end[to - 1])
        apart = np.zeros((to - i, until - i), dtype=np.uint16)
        for x in bits:
            apart += np.bitwise_count(x[i:to, None] ^ x[None, i:until])
        ok = (apart <= 2 * most[i:until]) & (group[i:to, None] != group[i:until]) & (np.arange(i, until) < end[i:to, None])
        a, b = (x + i for x in np.nonzero(np.triu(ok, 1)))
        i, step = to, max(1, min(4 * step, CELLS // 64 // len(n)))
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(n[b]) // (BYTES // 8))) + 1):
            part = part[group[a[part]] != group[b[part]]]
            ok = part[all_alike(short, first, n, a[part], b[part], bag)] if len(part) else part
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                if group[x] != group[y]:
                    out.append((int(num[x]), int(num[y])))
                    group[group == group[y]] = group[x]
                    left -= 1
    return out


def linked(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that put the similar lines together that are in one part of a key; rows: (block, part, num, root), texts: (num, codes)."""

    def told(held):
        num, root, codes = (pa.concat_arrays([b.column(c) for b in held]) for c in (2, 3, 4))
        num, at = np.unique(num.to_numpy(), return_index=True)
        pairs = _linked(num, root.to_numpy()[at], codes.take(pa.array(at))) if len(num) > 1 else []
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            block, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            start = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]))) if len(block) else []
            for s, e in zip(start, [*start[1:], len(block)], strict=True):
                if held and last != (block[s], part[s]):
                    yield told(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = block[s], part[s]
        if held:
            yield told(held)

    rows = rows.join(texts.withColumnRenamed("num", "_n"), F.col("num") == F.col("_n")).select("block", "part", "num", "root", "codes")
    return in_batches(rows.repartition("block", "part").sortWithinPartitions("block", "part"), run, "a long, b long")


def groups(known: DataFrame) -> DataFrame:
    """(node, root): the group of each line (num, codes) that is linked to another one."""
    met = materialize(meetings(keyed(known)), "met")
    pairs = materialize(met.where("not hot").select("a", "b").distinct(), "pairs")
    hot = met.where("hot").select(F.col("a").alias("block"), F.col("b").alias("num"), "words")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_n")).union(hot.select("num")).distinct()
    wanted = materialize(wanted, "wanted")
    texts = known.join(small(wanted, 2 * BROADCAST_ROWS), F.col("num") == F.col("_n"), "left_semi")  # a number a row
    texts = materialize(texts.dropDuplicates(["num"]), "codes")
    sizes = hot.groupBy("block").agg(F.count("*").alias("n"), F.min("num").alias("first")).where(F.col("n") > TILE)
    sizes = materialize(sizes.withColumnRenamed("block", "_b"), "sizes")
    rows = hot.join(F.broadcast(sizes) if (large := sizes.limit(BROADCAST_ROWS).count()) < BROADCAST_ROWS else sizes, F.col("block") == F.col("_b"), "left")
    n = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1))
    part = F.when(F.col("num") == F.col("first"), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.pmod(F.xxhash64("num"), n)))
    rows = rows.select("block", F.explode(part).alias("part"), "num", F.col("num").alias("root"))
    edges = materialize(verified(pairs, texts).union(linked(rows, texts)), "links")
    comp = materialize(components(edges, "a", "b"), "groups")
    if large:
        root = F.coalesce("root", "num").alias("root")
        rows = hot.join(sizes, F.col("block") == F.col("_b")).join(comp, F.col("num") == F.col("node"), "left").select("block", "num", "words", root)
        rows = materialize(rows.distinct(), "large")
        more = materialize(linked(tiles(rows), texts), "links")
        comp = _together(comp, more)
        release(rows)
    for x in (met, pairs, wanted, texts, sizes, edges):
        release(x)
    return comp


def tiles(rows: DataFrame) -> DataFrame:
    """(block, part, num, root): lines (block, num, words, root) put to parts so that each two of a key that may be similar and are not of one group meet.

    Lines of the group of the key's first line meet just the others, in parts of TILE at most of each; the others meet each other as well. Lines
    of a band meet those of it and of the next one. Only here rows come several times: their number is that of lines times TILEs of others.
    """
    first = rows.groupBy("block").agg(F.min_by("root", "num").alias("_main")).withColumnRenamed("block", "_b")
    band = F.size(F.filter(F.array(*map(F.lit, BANDS)), lambda x: x <= F.col("words")))
    rows = rows.join(first, F.col("block") == F.col("_b")).withColumn("other", F.col("root") != F.col("_main"))
    rows = rows.select("block", "num", "root", "other", F.explode(F.array(band, band + 1)).alias("band"))
    sizes = rows.groupBy("block", "band").agg(F.count_if("other").alias("m"), F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    sizes = sizes.where("lo < hi").select(F.col("block").alias("_b"), F.col("band").alias("_band"), F.ceil(F.col("m") / TILE).alias("g"), F.ceil((F.col("n") - F.col("m")) / TILE).alias("h"))
    rows = rows.join(sizes, (F.col("block") == F.col("_b")) & (F.col("band") == F.col("_band")))
    mine = F.pmod(F.xxhash64("num"), F.when(F.col("other"), F.col("g")).otherwise(F.col("h")))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)  # noqa: E731  none if n is 0
    others = F.transform(upto(F.col("g")), lambda i: F.xxhash64("band", F.lit(0), F.least(i, mine), F.greatest(i, mine)))
    meets_main = F.transform(upto(F.col("h")), lambda i: F.xxhash64("band", F.lit(1), i, mine))
    main = F.transform(upto(F.col("g")), lambda i: F.xxhash64("band", F.lit(1), mine, i))
    return rows.select("block", F.explode(F.when(F.col("other"), F.concat(others, meets_main)).otherwise(main)).alias("part"), "num", "root")


def _together(comp: DataFrame, new: DataFrame) -> DataFrame:
    """The groups (node, root) after more links (a, b); only groups that these touch are put together anew."""
    of = comp.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    new = new.join(of, F.col("a") == F.col("_n"), "left").select(F.coalesce("_r", "a").alias("a"), "b")
    new = new.join(of, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_r", "b").alias("b")).where("a <> b")
    joined = materialize(components(new, "a", "b"), "joined").select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    moved = comp.join(joined, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    alone = joined.join(comp, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_r").alias("root"))
    return materialize(moved.union(alone), "groups")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, lines): the numbers of the lines to remove, for rows that have any."""
    occ = materialize(occurrences(docs), "lines")
    comp = groups(occ.where("codes is not null").select("num", "codes"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash", "line")
    again = occ.groupBy("num").agg(F.min(place).alias("at"), F.count("*").alias("n")).join(comp, F.col("num") == F.col("node"), "left")
    again = again.where("root is not null or n > 1").select("num", "at", F.coalesce("root", "num").alias("root"))
    again = materialize(again, "again")
    first = again.groupBy("root").agg(F.min("at").alias("at")).withColumnRenamed("root", "_root")
    first = again.select(F.col("num").alias("_num"), "root").join(first, F.col("root") == F.col("_root")).select("_num", "at")
    drop = occ.select("doc_id", "row_hash", "line", "num").join(first, F.col("num") == F.col("_num")).where(~place.eqNullSafe(F.col("at")))
    out = drop.select("doc_id", "row_hash", "line").distinct().groupBy("doc_id", "row_hash").agg(F.collect_list("line").alias("lines"))
    out = materialize(out, "removals")
    release(occ), release(again), release(comp)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with the columns n_lines and n_dropped, and without the lines that others repeat.

    Rows that repeat as a whole (doc_id and text) are one document, and keep
    the same lines. A document all of whose lines go stays, with an empty text;
    a document without such lines keeps its text, a null one too, as it is.
    n_chars becomes the length of the new text where lines went. An empty table
    gives an empty result; of equal lines the one of the least doc_id stays, a
    null doc_id being the last.
    """
    docs = docs.select(*DOC_COLUMNS)
    gone = removals(docs).withColumnRenamed("lines", "_gone")
    out = same_row(docs.withColumn("row_hash", text_hash()), gone, "left")
    # Bound by a lambda, so that a text is split once; array_except takes the numbers to remove as a set.
    kept = F.expr("transform(array(split(text, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), _gone), i -> l[i]), '\\n'))[0]")
    out = out.withColumns({"_text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept), "_n": F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")})
    chars = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("_text").cast("long"))
    return out.select("doc_id", F.col("_text").alias("text"), "lang", "source", chars.alias("n_chars"), F.col("_n").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
