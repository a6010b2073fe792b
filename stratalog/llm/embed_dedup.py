"""Near-duplicate vectors by collision-counting projections.

Every unit vector is projected on many random lines. On each line the vectors
are sorted, and a pair collides if one value lies in a window centred on the
other. Pairs at the linking cosine differ by a normal variable of known spread
on every line, so their count of collisions is binomial: the count asked for is
the largest that such pairs miss with at most the stated probability. Pairs
that reach it are verified by their cosine in double precision.

A window of a sorted line is the difference of two prefixes of that order, as
sets of bits; the sets of the first lines are added bit by bit, 64 pairs an
operation, and pairs that reach those lines' own count are counted on all
lines. So counting costs no more than the pairs' inner products.

On one line a linked pair is only a few times closer than a random one, so
counting over all rows would compare all pairs. Vectors are first met in the
cells of several tables, a cell being the signs of K further projections; the
number of tables follows from K and the recall asked for, and K from the number
of vectors, so that a cell holds about CELL vectors and the recall is the same
at any size. A pair counts in the first table that it shares. Crowded cells
are cut in blocks and pairs of blocks become tasks of their own. What is sent
to the cells is a vector's number, its cells and its places on the lines, a
byte each; vectors themselves are fetched only where some new pair reaches the
count. Pairs never leave a task, only counts by vector and spanning links do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import components, discard, materialize, spanning

CELL = 400
BLOCK = 1024
#: Lines whose windows are sorted, and all lines.
FIRST, LINES = 32, 64
SEED = 20
#: Steps of a place within half a window; places are rounded, windows widened by one step.
STEPS = 10


def plan(n: int, cosine: float, miss: float) -> dict:
    """Bits, tables, window and count for n vectors: a pair at the cosine is
    missed by the tables, and by the count, with probability miss/2 each."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(0, min(30, round(math.log2(max(n, 1) / CELL))))
    tables = 1 if not bits else math.ceil(math.log(miss / 2) / math.log(1 - agree**bits))
    window = math.sqrt(2 - 2 * cosine)  # one standard deviation of a linked pair's difference
    return {"bits": bits, "tables": tables, "window": window, "first": _least(FIRST, miss / 4), "count": _least(LINES, miss / 4)}


def _least(lines: int, miss: float) -> int:
    """The largest count of collisions that a linked pair misses with at most that probability."""
    p = math.erf(1 / math.sqrt(2))
    tail, count = 0.0, 0
    while (tail := tail + math.comb(lines, count) * p**count * (1 - p) ** (lines - count)) <= miss:
        count += 1
    return count


def _lines(dim: int, n: int, salt: int) -> np.ndarray:
    return np.random.default_rng([SEED, salt, dim]).standard_normal((dim, n))


def _unit(raw: list[bytes], kind) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (x @ _lines(x.shape[1], max(1, bits * tables), 1) > 0)[:, : bits * tables].reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def places(x: np.ndarray, window: float) -> np.ndarray:
    """Places of unit vectors on the lines, in steps of window/STEPS. Beyond
    four standard deviations or so all are one place, which only adds collisions."""
    at = np.rint(x @ _lines(x.shape[1], LINES, 2) * (STEPS / window))
    return np.clip(at, -127, 127).astype(np.int8)


def _add(a, b, c):
    """Sum of three planes of bits: (carry, low)."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def _windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On one line: for each of a the set of bits of those b in its window."""
    order = np.argsort(b, kind="stable")
    line = b[order].astype(np.int16)
    prefix = np.zeros((len(b) + 1, -(-len(b) // 64)), np.uint64)
    prefix[np.arange(1, len(b) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    np.bitwise_or.accumulate(prefix, axis=0, out=prefix)
    mid = a.astype(np.int16)
    return prefix[np.searchsorted(line, mid + (STEPS + 1), "right")] ^ prefix[np.searchsorted(line, mid - (STEPS + 1), "left")]


def collide(a: np.ndarray, b: np.ndarray, first: int, count: int):
    """Indexes (i, j) of the pairs of a and b (places, a row a vector) that
    collide on at least ``first`` of the FIRST lines and ``count`` of all."""
    i, j = _collide(a, b, first)
    keep = [(np.abs(a[i[s : s + 20_000]].astype(np.int16) - b[j[s : s + 20_000]]) <= STEPS + 1).sum(axis=1) >= count for s in range(0, len(i), 20_000)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _collide(a: np.ndarray, b: np.ndarray, count: int):
    shape = (len(a), -(-len(b) // 64))
    ones, twos, fours, high = (np.zeros(shape, np.uint64) for _ in range(4))
    planes = [np.zeros(shape, np.uint64) for _ in range(FIRST.bit_length() - 3)]  # eights and more
    for s in range(0, FIRST, 8):
        w = [_windows(a[:, n], b[:, n]) for n in range(s, s + 8)]
        t1, ones = _add(ones, w[0], w[1])
        t2, ones = _add(ones, w[2], w[3])
        f1, twos = _add(twos, t1, t2)
        t1, ones = _add(ones, w[4], w[5])
        t2, ones = _add(ones, w[6], w[7])
        f2, twos = _add(twos, t1, t2)
        high, fours = _add(fours, f1, f2)
        for k in range(len(planes)):
            planes[k], high = planes[k] ^ high, planes[k] & high
    more, same = np.zeros(shape, np.uint64), np.full(shape, ~np.uint64(0))
    for k, plane in reversed(list(enumerate([ones, twos, fours, *planes]))):  # number of collisions > count - 1
        if (count - 1) >> k & 1:
            same &= plane
        else:
            more |= same & plane
            same &= ~plane
    found = np.unpackbits(more.view(np.uint8), axis=1, bitorder="little")[:, : len(b)]
    return np.nonzero(found)


def _packed(kind):
    """(id, dim, v): v is null for rows that link with nothing."""

    def run(batches):
        for b in batches:
            raw, dims = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = None
                if i is not None and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    x = x if np.isfinite(x).all() and x.any() else None
                raw.append(None if x is None else (x + 0.0).tobytes()), dims.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["id", "dim", "v"])

    return run


def _short(codes: np.ndarray, bits: int) -> np.ndarray:
    return codes.astype(np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32)


def _new(codes: np.ndarray, t: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs share none of the tables before t."""
    out = np.ones(len(i), bool)
    for c in codes[:, :t].T:
        out &= c[i] != c[j]
    return out


def _coded(kind, bits, tables, window):
    """Of vectors (node, dim, v): their cell in each table, all of these, and their places."""

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                dims = b.column(1).to_numpy()
                for d in np.unique(dims):
                    part = b.filter(pa.array(dims == d))
                    x = _unit(part.column(2).to_pylist(), kind)
                    at = np.repeat(np.arange(len(x)), tables)
                    codes = _codes(x, bits, tables)
                    where, all_ = (pa.array([r.tobytes() for r in m], pa.binary()) for m in (places(x, window), _short(codes, bits)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), pa.array(codes.ravel()), *(c.take(pa.array(at)) for c in (part.column(1), part.column(0), where, all_))],
                        names=["t", "code", "dim", "node", "places", "codes"],
                    )

    return run


def _sides(pdf: pd.DataFrame, one: bool):
    side = pdf.side.to_numpy()
    first = np.flatnonzero(side == 0)
    return first, first if one else np.flatnonzero(side == 1)


def _candidates(bits, tables, window, first, count):
    """The vectors of two blocks that reach the count with some other, for the first time."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        one, other = _sides(pdf, key[3] == key[4])
        hit = np.zeros(len(pdf), bool)
        if len(one) and len(other):
            at = np.frombuffer(b"".join(pdf.places), np.int8).reshape(len(pdf), -1)
            codes = np.frombuffer(b"".join(pdf.codes), _short(np.zeros(0), bits).dtype).reshape(len(pdf), -1)
            i, j = collide(at[one], at[other], first, count)
            i, j = one[i], other[j]
            new = (i != j) & _new(codes, key[0], i, j)
            hit[i[new]] = hit[j[new]] = True
        return pdf.loc[hit, ["t", "code", "dim", "p", "q", "side", "node"]]

    return run


def _compare(kind, cosine, bits, tables, window, first, count):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t, same = key[0], key[3] == key[4]
        one, other = _sides(pdf, same)
        nodes, n = pdf.node.to_numpy(), pdf.n.to_numpy()
        empty = pd.DataFrame({"a": nodes[:0], "b": nodes[:0], "n": n[:0]})
        if not len(one) or not len(other):
            return empty
        x = _unit(list(pdf.v), kind)
        at = places(x, window)
        i, j = collide(at[one], at[other], first, count)
        i, j = one[i], other[j]
        if same:
            i, j = i[i < j], j[i < j]
        near = np.empty(len(i), bool)
        for s in range(0, len(i), 50_000):
            near[s : s + 50_000] = np.einsum("ij,ij->i", x[i[s : s + 50_000]], x[j[s : s + 50_000]]) >= cosine
        i, j = i[near], j[near]
        if t and len(i):
            new = _new(_codes(x, bits, tables), t, i, j)
            i, j = i[new], j[new]
        if not len(i):
            return empty
        links = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        order = np.argsort(nodes)  # spanning names the smallest index
        rank = np.argsort(order)
        low = order[spanning(len(x), rank[i], rank[j])[rank]]
        a = np.flatnonzero(links > 0)
        return pd.DataFrame({"a": nodes[a], "b": nodes[low[a]], "n": links[a].astype(np.int64)})

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, miss: float = 0.002) -> DataFrame:
    """(id, n_links, component) for each row of vectors.

    n_links counts the other rows whose cosine with this row was found to be
    at least ``cosine``; component is the smallest id reachable over links.
    A pair at exactly that cosine is missed with probability ``miss``, nearer
    pairs less often; equal vectors are never missed; no pair below it links.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and vectors of another length, link with nothing; a row with a null id
    links with nothing and has a null component. Rows are what links, so rows
    that repeat an id, with the same vector or another, are rows of their own.
    Other columns are ignored; no rows give no rows.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = np.float32 if element in ("float", "tinyint", "smallint") else np.float64
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    packed = materialize(rows.mapInArrow(_packed(kind), "id long, dim int, v binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    able = packed.filter("v is not null")
    distinct = materialize(able.groupBy("dim", "v").agg(F.min("row").alias("node"), F.min("id").alias("id"), F.count("*").alias("n")).select("node", "dim", "v", "id", "n"), "distinct")
    how = plan(distinct.count(), cosine, miss)
    coded = distinct.select("node", "dim", "v").mapInArrow(_coded(kind, how["bits"], how["tables"], how["window"]), "t int, code long, dim int, node long, places binary, codes binary")
    crowd = coded.groupBy("t", "code", "dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("s"))
    cut = coded.join(crowd, ["t", "code", "dim"]).withColumn("i", F.pmod(F.xxhash64("node"), "s").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    sides = cut.select("t", "code", "dim", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("side"), "node", "places", "codes")
    cell = ["t", "code", "dim", "p", "q"]
    some = materialize(sides.groupBy(*cell).applyInPandas(_candidates(**how), "t int, code long, dim int, p int, q int, side int, node long"), "candidates")
    fetched = some.join(distinct.select("node", "v", "n"), "node")
    found = materialize(fetched.groupBy(*cell).applyInPandas(_compare(kind, cosine, **how), "a long, b long, n long"), "found")
    counts = found.groupBy("a").agg(F.sum("n").alias("linked"))
    group = components(found.select("a", "b"))
    named = distinct.join(group, "node", "left").withColumn("g", F.coalesce("component", "node"))
    smallest = named.groupBy("g").agg(F.min("id").alias("least"))
    reps = named.join(smallest, "g").join(counts, named.node == counts.a, "left").select(F.col("dim").alias("_d"), F.col("v").alias("_v"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least")
    out = packed.join(reps, (F.col("dim") == F.col("_d")) & (F.col("v") == F.col("_v")), "left")
    discard(some)
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component"))
