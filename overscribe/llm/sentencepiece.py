"""SentencePiece encoding by Unigram Viterbi over a double-array trie, and decoding.

The pieces come from a model file, which the driver reads and broadcasts as a
few arrays (their size is that of the vocabulary). A Unigram model brings log
scores; one of another type (BPE keeps merge ranks in their place) gets the log
probabilities that Zipf's law gives its ranks. Characters that no piece covers
fall back to their bytes.

No piece holds a white-space marker after another character, which is checked,
so the best segmentation of a text is that of its units put together: runs of
markers with the characters up to the next marker. Units that recur are looked
up; the others are solved together, one position of all of them at a time.
"""

from __future__ import annotations

import math
import os
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import id_type, in_batches

#: The model file, unless the environment names another one.
MODEL = os.environ.get("OVERSCRIBE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Fixed values of the model format: types of pieces, and the Unigram model's type.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE, UNIGRAM = 1, 2, 3, 4, 5, 6, 1
#: Fixed value: what a character outside the vocabulary scores below the least piece.
UNK_PENALTY = 10.0
#: Units solved together, units of which each task keeps the ids, and characters up to which it keeps one.
BATCH, MEMO, LONGEST = 4096, 150_000, 64
#: Units under which a group is not worth solving together.
FEW = 64


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints, and bytes for what has a length or is a float."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return n, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Trie:
    """A double-array trie over bytes: node s has a child by c at base[s] + c + 1 if check[] of that is s."""

    def __init__(self, keys: list[bytes]) -> None:
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for i, key in enumerate(keys):
            at = 0
            for c in key:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                    value.append(-1)
                at = tree[at][c]
            value[at] = i
        size = 2 * len(tree) + 1024
        used, base, check, out = bytearray(size), [0] * size, [-1] * size, [-1] * size
        # Nodes with one child fill the holes that those with several leave behind.
        used[0], hole, wide, todo = 1, 1, 1, [(0, 0)]
        for node, slot in todo:
            out[slot] = value[node]
            children = sorted(tree[node])
            if not children:
                continue
            if len(children) == 1:
                while used[hole] or hole <= children[0]:
                    hole += 1
                b = hole - children[0] - 1
            else:
                b = wide
                while any(used[b + c + 1] for c in children):
                    b += 1
                wide = max(wide, b - 256)
            base[slot] = b
            for c in children:
                used[b + c + 1], check[b + c + 1] = 1, slot
                todo.append((tree[node][c], b + c + 1))
            if b + 600 > len(used):
                more = len(used)
                used, base, check, out = used + bytearray(more), base + [0] * more, check + [-1] * more, out + [-1] * more
        self.base, self.check, self.value = (np.array(x, dtype=np.int32) for x in (base, check, out))


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    types: list[int]
    dummy_prefix: bool

    def __post_init__(self) -> None:
        if any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER_DEFINED)):
            raise ValueError("a piece holds a white-space marker after another character")
        own = [i for i, t in enumerate(self.types) if t in (NORMAL, USER_DEFINED)]
        self.trie = Trie([self.pieces[i].encode() for i in own])
        self.ids = np.array(own, dtype=np.int32)
        self.own_scores = self.scores[self.ids]
        self.longest = max(len(self.pieces[i].encode()) for i in own)
        self.unk_score = float(self.own_scores.min()) - UNK_PENALTY
        found = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.byte_ids = [found.get(b, -1) for b in range(256)]
        self.lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.own_scores, self.ids)]
        self.unk = self.types.index(UNKNOWN)
        self.fallback = len(found) == 256
        # A line break that no piece has is a unit of its own.
        alone = "" if any("\n" in self.pieces[i] for i in own) else "\n"
        self.units = re.compile(f"{alone}{'|' * bool(alone)}{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")
        plain = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}
        self.texts = [bytes([int(p[3:5], 16)]) if t == BYTE else plain.get(t, p.replace(MARK, " ").encode()) for p, t in zip(self.pieces, self.types, strict=True)]


def load(path: str = MODEL) -> Model:
    """Read a model file. Only models that leave the text as it is, but for white space, are taken."""
    pieces, scores, types, kind, prefix = [], [], [], UNIGRAM, True
    if not os.path.exists(path):
        raise FileNotFoundError(f"no model file {path}: give its path, or name it in OVERSCRIBE_PIECE_MODEL")
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append(x[1].decode())
            scores.append(struct.unpack("<f", x.get(2, bytes(4)))[0])
            types.append(x.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            x = dict(_fields(value))
            prefix = bool(x.get(3, 1))
            if x.get(2) or x.get(4, 1):
                raise ValueError("the model changes more of a text than its white space")
    s = np.array(scores, dtype=np.float64)
    if kind != UNIGRAM:
        own = np.array([t in (NORMAL, USER_DEFINED) for t in types])
        rank = np.zeros(len(s))
        rank[own] = np.argsort(np.argsort(-s[own], kind="stable"), kind="stable")
        p = np.where(own, 1 / (rank + 2.7), 0)
        # In steps of 2^-10, so that sums are exact and equally good ways are equal, in whatever order they are summed.
        s = np.where(own, np.round(np.log(np.where(own, p / p.sum(), 1)) * 1024) / 1024, 0)
    return Model(pieces, s, types, prefix)


def viterbi(units: list[bytes], m: Model) -> list[bytes]:
    """The ids of each unit's best segmentation, as 32-bit numbers put together.

    Of equally good ways to a position that with the longest last piece wins.
    """
    base, check, value = m.trie.base, m.trie.check, m.trie.value
    n = np.array([len(u) for u in units])
    width, rows = int(n.max()), len(units)
    text = np.zeros((rows, width), dtype=np.int64)
    flat = np.frombuffer(b"".join(units), dtype=np.uint8)
    text[np.arange(width) < n[:, None]] = flat
    best = np.full((rows, width + 1), -np.inf)
    best[:, 0] = 0
    start = np.full((rows, width + 1), -1, dtype=np.int32)
    last = np.full((rows, width + 1), -1, dtype=np.int32)
    char = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
    for at in range(width):
        row = np.flatnonzero((n > at) & (best[:, at] > -np.inf))
        if not len(row):
            continue
        alone = np.ones(rows, dtype=bool)
        here, node, k = row, np.zeros(len(row), dtype=np.int64), at
        while len(here) and k < min(width, at + m.longest):
            to = base[node] + text[here, k] + 1
            ok = (check[to] == node) & (n[here] > k)
            here, node, k = here[ok], to[ok], k + 1
            piece = value[node]
            ends = piece >= 0
            r, p = here[ends], piece[ends]
            got = m.own_scores[p] + best[r, at]
            alone[r[k - at == char[r, at]]] = False
            up = got > best[r, k]
            r, p = r[up], p[up]
            best[r, k], start[r, k], last[r, k] = got[up], at, m.ids[p]
        row = row[alone[row]]
        end = at + char[row, at]
        got = m.unk_score + best[row, at]
        up = got > best[row, end]
        row, end = row[up], end[up]
        best[row, end], start[row, end], last[row, end] = got[up], at, -1
    starts, lasts = start.tolist(), last.tolist()
    return [_trace(unit, starts[i], lasts[i], m) for i, unit in enumerate(units)]


def viterbi_one(unit: bytes, m: Model) -> bytes:
    """The same for one unit, one position and piece at a time."""
    base, check, value, scores, piece_ids = m.lists
    n = len(unit)
    best, start, last = [-math.inf] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for at in range(n):
        here = best[at]
        if here == -math.inf:
            continue
        b = unit[at]
        one = at + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
        node, alone = 0, True
        for k in range(at, n):
            to = base[node] + unit[k] + 1
            if check[to] != node:
                break
            node, piece = to, value[to]
            if piece >= 0:
                if k + 1 == one:
                    alone = False
                got = here + scores[piece]
                if got > best[k + 1]:
                    best[k + 1], start[k + 1], last[k + 1] = got, at, piece_ids[piece]
        if alone and here + m.unk_score > best[one]:
            best[one], start[one], last[one] = here + m.unk_score, at, -1
    return _trace(unit, start, last, m)


def _trace(unit: bytes, start: list[int], last: list[int], m: Model) -> bytes:
    ids, at = [], len(unit)
    while at:
        if last[at] >= 0:
            ids.append(last[at])
        elif m.fallback:
            ids += [m.byte_ids[b] for b in reversed(unit[start[at] : at])]
        elif not ids or ids[-1] != m.unk:
            ids.append(m.unk)
        at = start[at]
    return struct.pack(f"<{len(ids)}i", *reversed(ids))


class Encoder:
    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, {}

    def _solve(self, units: set[str]) -> None:
        """In groups of about the same length, so that little is padded; those of small groups one by one."""
        todo = sorted((u.encode() for u in units), key=lambda u: (len(u), u))
        at = 0
        while at < len(todo):
            most = len(todo[at]) * 5 // 4 + 2
            end = at + 1
            while end < len(todo) and end - at < BATCH and len(todo[end]) <= most:
                end += 1
            part = todo[at:end]
            ids = viterbi(part, self.model) if len(part) >= FEW else [viterbi_one(u, self.model) for u in part]
            self.memo.update(zip((u.decode() for u in part), ids, strict=True))
            at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers put together."""
        m, memo = self.model, self.memo
        if len(memo) > MEMO:
            memo.clear()
        prefix = MARK if m.dummy_prefix else ""
        units = [m.units.findall(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*units).difference(memo)
        self._solve(new)
        out = [b"".join(map(memo.__getitem__, u)) for u in units]
        for u in new:
            if len(u) > LONGEST:
                del memo[u]
        return out


def decode_ids(ids: bytes | np.ndarray, m: Model) -> str:
    """The text of ids. Bytes that are no UTF-8 become U+FFFD, one each."""
    numbers = np.frombuffer(ids, dtype="<i4") if isinstance(ids, bytes) else ids
    raw = b"".join(map(m.texts.__getitem__, numbers.tolist()))
    if m.dummy_prefix and raw.startswith(b" ") and len(numbers) and m.types[numbers[0]] != BYTE:
        raw = raw[1:]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[at : at + e.start].decode() + "�")
                at += e.start + 1
        return "".join(out)


def _shared(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size


def _slices(batch: pa.RecordBatch, chars: int = 4_000_000):
    """Parts of a batch of about so many bytes of text, one row at least."""
    start = size = 0
    for i, n in enumerate(batch.column(0).cast(pa.binary())):
        size += len(n.as_py() or b"")
        if size > chars:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _id_columns(ids: list[bytes], low: int, high: int) -> tuple[pa.Array, pa.Array]:
    """(ids, number of ids between low and high) of each text."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    buffer = b"".join(ids)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(buffer)])
    numbers = np.frombuffer(buffer, dtype="<i4")
    bytes_to = np.concatenate([[0], np.cumsum((numbers >= low) & (numbers <= high) & (low >= 0))])
    return pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(np.diff(bytes_to[offsets]), pa.int64())


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """text, doc_id, ids (array<int>) and n_bytes (ids that are single bytes) of every row; a null or empty text has none."""
    shared = _shared(docs, model)
    low, high = min(model.byte_ids), max(model.byte_ids)

    def run(batches):
        encoder = Encoder(shared.value)
        for whole in batches:
            for batch in _slices(whole):
                ids = encoder([t or "" for t in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_id_columns(ids, low, high)], ["text", "doc_id", "ids", "n_bytes"])

    return in_batches(docs.select("text", "doc_id"), run, f"text string, doc_id {id_type(docs)}, ids array<int>, n_bytes long")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """The rows with one more column, decoded, from ids. Null ids decode to null."""
    shared = _shared(encoded, model)
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")

    def run(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(at)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            valid = column.is_valid().to_pylist()
            texts = [decode_ids(values[a:b], m) if ok else None for a, b, ok in zip(offsets, offsets[1:], valid, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return in_batches(encoded, run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes (pieces that are single bytes), exact (ids decode to the text) of every row.

    Encodes and decodes in one pass: no text goes back to Spark, and each task needs one Python worker.
    """
    model = load(path)
    shared = _shared(docs, model)
    low, high = min(model.byte_ids), max(model.byte_ids)

    def run(batches):
        m = shared.value
        encoder = Encoder(m)
        for whole in batches:
            for batch in _slices(whole):
                texts = [t or "" for t in batch.column(0).to_pylist()]
                ids = encoder(texts)
                exact = pa.array([decode_ids(x, m) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(1), *_id_columns(ids, low, high), exact], ["doc_id", "ids", "n_bytes", "exact"])

    out = in_batches(docs.select("text", "doc_id"), run, f"doc_id {id_type(docs)}, ids array<int>, n_bytes long, exact boolean")
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "n_bytes", "exact")
