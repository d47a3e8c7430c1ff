"""Vectors in blocks of bounded size: each pack of queries meets each block of the base in one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import written

#: Base rows of a block, and queries of a pack.
BLOCK, PACK = 1024, 512
#: Bytes up to which all packs are sent to the tasks; beyond that both sides are written and meet in parts.
SENT = 64 << 20
#: What a matrix product differs by, at most, from the sum in the order of the components.
NOISE = 1e-9


def packed(rows: DataFrame, key: str, vector: str, size: int, *carry: str) -> DataFrame:
    """(keys, carry...: arrays; data, ok, n): up to ``size`` neighbouring rows in one, vectors as bytes. ``ok`` is 0 for vectors that are null or hold a null."""
    rows = rows.select(F.col(vector).alias("_v"), F.col(key).alias("keys"), *carry)
    types = [pa.list_(to_arrow_type(f.dataType)) for f in rows.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                part = whole.slice(at, size)
                data, ok = _matrix(part.column(0))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c).cast(t) for c, t in zip(part.columns[1:], types, strict=True)]
                values = [pa.array([data.tobytes()]), pa.array([ok.tobytes()]), pa.array([part.num_rows], pa.int32())]
                yield pa.RecordBatch.from_arrays([*lists, *values], names=[*part.schema.names[1:], "data", "ok", "n"])

    ddl = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{ddl}, data binary, ok binary, n int")


def _matrix(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, zeros in place of those that are no vectors of the usual length, and which are."""
    lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    flat = v.flatten()
    numbers = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(lengths.max(initial=0))
    ok = (lengths == dim) & (dim > 0)
    if ok.all() and not flat.null_count:
        return numbers.reshape(len(v), dim), ok
    holes, ends, data = flat.is_null().to_numpy(zero_copy_only=False), np.cumsum(lengths), np.zeros((len(v), dim))
    for i in np.flatnonzero(ok):
        part = slice(ends[i] - dim, ends[i])
        ok[i] = not holes[part].any()
        if ok[i]:
            data[i] = numbers[part]
    return data, ok


def met(queries: DataFrame, query_key: str, query_vector: str, base: DataFrame, key: str, vector: str, carry: tuple[str, ...] = (), query_carry: tuple[str, ...] = ()) -> DataFrame:
    """(q, qkeys, qdata, ..., keys, data, ...): each pack of queries beside each block of the base; ``q`` is the pack's number."""
    asked = written(queries.select(query_key, query_vector, *query_carry), "asked-vectors")
    packs = packed(asked.repartition(max(1, -(-asked.count() // PACK))), query_key, query_vector, PACK, *query_carry)
    packs = written(packs.select(F.monotonically_increasing_id().alias("q"), *(F.col(c).alias(f"q{c}") for c in packs.columns)), "packs")
    size = packs.agg(F.sum(F.length("qdata"))).first()[0] or 0
    blocks = packed(base, key, vector, BLOCK, *carry)
    # Written where parts meet, as each part of one side is read once for each part of the other.
    return blocks.crossJoin(F.broadcast(packs)) if size <= SENT else written(blocks, "blocks").crossJoin(packs)


def products(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, vectors, products) of a row of :func:`met`: -inf where either is no vector, and what is not a number above all, as an order has them."""
    sides = []
    for side in ("q", ""):
        n = batch.column(f"{side}n")[i].as_py()
        sides.append((np.frombuffer(batch.column(f"{side}data")[i].as_buffer(), np.float64).reshape(n, -1), np.frombuffer(batch.column(f"{side}ok")[i].as_buffer(), bool)))
    (q, some), (v, other) = sides
    if q.shape[1] != v.shape[1]:
        return q, v, np.full((len(q), len(v)), -np.inf)
    s = q @ v.T
    s[np.isnan(s)] = np.inf
    s[~some] = -np.inf
    s[:, ~other] = -np.inf
    return q, v, s


def rounded(x: np.ndarray, places: int | None) -> np.ndarray:
    return x if places is None else np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places, x) + 0.0


def summed(q: np.ndarray, v: np.ndarray, s: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of single pairs, summed in the order of the components: the same for the same vectors, wherever they stand."""
    out = s[rows, cols]
    number = np.isfinite(out)
    rows, cols, sums = rows[number], cols[number], np.zeros(int(number.sum()))
    for c in range(q.shape[1]):
        sums += q[rows, c] * v[cols, c]
    out[number] = sums
    return out


def nearest(rows: DataFrame, query_key: str, key: str, k: int, pairs: str = "all", places: int | None = None) -> DataFrame:
    """(query_key, key, cosine): of each task's part of :func:`met` the k first ones of each query, by rounded product and key.

    ``pairs`` tells which count: all, those of another key, or those of a lower
    ("older") key than the query's. A task holds k rows for each query it has met.
    """
    ktype = {c: rows.schema[c].dataType.elementType for c in ("qkeys", "keys")}
    margin = NOISE + (0 if places is None else 10.0**-places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                pack, own, keys = batch.column("q")[i].as_py(), batch.column("qkeys")[i].values, batch.column("keys")[i].values
                q, v, s = products(batch, i)
                skip = None
                if pairs != "all":
                    a, b = own.to_numpy(zero_copy_only=False)[:, None], keys.to_numpy(zero_copy_only=False)[None, :]
                    skip = a == b if pairs == "other" else b >= a
                    s[skip] = -np.inf
                _, at, names, score, bar = held.get(pack) or (own, np.zeros(0, np.int64), keys.slice(0, 0), np.zeros(0), np.full(len(own), -np.inf))
                if len(keys) > k:
                    bar = np.maximum(bar, np.partition(s, len(keys) - k, axis=1)[:, len(keys) - k] - NOISE)
                near = s >= (bar - margin)[:, None]
                r, c = np.nonzero(near if skip is None else near & ~skip)
                at, names, score = np.concatenate([at, r]), pa.concat_arrays([names, keys.take(pa.array(c))]), np.concatenate([score, summed(q, v, s, r, c)])
                place = pc.rank(names, sort_keys="ascending", tiebreaker="dense").to_numpy()
                order = np.lexsort((place, -rounded(score, places), at))
                first = np.searchsorted(at[order], np.arange(len(own)))
                order = order[np.arange(len(order)) - first[at[order]] < k]
                at, names, score = at[order], names.take(pa.array(order)), score[order]
                full = np.bincount(at, minlength=len(own)) == k
                last = np.searchsorted(at, np.arange(len(own)), side="right") - 1
                bar[full] = score[last[full]]
                held[pack] = own, at, names, score, bar
        for own, at, names, score, _ in held.values():
            score = pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf)
            yield pa.RecordBatch.from_arrays([own.take(pa.array(at)), names, score], names=[query_key, key, "cosine"])

    return rows.mapInArrow(run, f"`{query_key}` {ktype['qkeys'].simpleString()}, `{key}` {ktype['keys'].simpleString()}, cosine double")


def places(rows: DataFrame, query_key: str, key: str, digits: int) -> DataFrame:
    """(query_key, key, a, b, t): of each task's part of :func:`met` how many vectors come before each candidate, by rounded product, by label and by key.

    Queries carry a label ``ql`` and candidates ``few``: (key, product rounded to
    ``digits``, distances of label and key; what is null comes last), vectors a
    ``label``; ties go to the lower key. A query's own key does not count.
    """
    ktype = {c: rows.schema[c].dataType.elementType for c in ("qkeys", "keys")}
    far = 1 << 50

    def whole(x: np.ndarray) -> np.ndarray:
        return np.clip(np.nan_to_num(np.rint(x), nan=far, posinf=far, neginf=-far), -far, far).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                pack, ids = batch.column("q")[i].as_py(), batch.column("keys")[i].values.to_numpy(zero_copy_only=False)
                if pack not in held:
                    few = batch.column("qfew")[i].values
                    names, *values = few.flatten().flatten()
                    values = [v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in values]
                    own, ql = batch.column("qkeys")[i].values, batch.column("qql")[i].values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                    ends = np.cumsum(pc.fill_null(pc.list_value_length(few), 0).to_numpy(zero_copy_only=False))
                    held[pack] = own, ql, names, [whole(-values[0] * 10.0**digits), whole(values[1]), whole(values[2])], np.append(0, ends), np.zeros((3, len(names)), np.int64)
                own, ql, names, wanted, ends, found = held[pack]
                mine, label = own.to_numpy(zero_copy_only=False), batch.column("label")[i].values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                q, v, s = products(batch, i)
                with np.errstate(invalid="ignore"):
                    part = np.abs(np.abs(s) * 10.0**digits % 1 - 0.5) < NOISE * 10.0**digits
                    r, c = np.nonzero(part)
                    s[r, c] = summed(q, v, s, r, c)
                    orders = [whole(-rounded(s, digits) * 10.0**digits), whole(np.abs(label[None, :] - ql[:, None])), np.abs(ids[None, :] - mine[:, None]).clip(max=far)]
                by = np.sort(ids)
                at, of = np.searchsorted(by, ids), np.searchsorted(by, names.to_numpy(zero_copy_only=False))
                for n, order in enumerate(orders):
                    order = order * (2 * BLOCK) + at
                    order[ids[None, :] == mine[:, None]] = np.iinfo(np.int64).max
                    order.sort(axis=1)
                    asked = wanted[n] * (2 * BLOCK) + of
                    for k in range(len(mine)):
                        some = slice(ends[k], ends[k + 1])
                        found[n, some] += np.searchsorted(order[k], asked[some])
        for own, _, names, _, ends, found in held.values():
            of = own.take(pa.array(np.repeat(np.arange(len(own)), np.diff(ends))))
            yield pa.RecordBatch.from_arrays([of, names, *map(pa.array, found)], names=[query_key, key, "a", "b", "t"])

    return rows.mapInArrow(run, f"`{query_key}` {ktype['qkeys'].simpleString()}, `{key}` {ktype['keys'].simpleString()}, a long, b long, t long")
