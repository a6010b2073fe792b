"""Exact top-k search by distributed histogram selection.

Vectors become integers and are packed in blocks, candidates by thousands,
queries by dozens. The query blocks, an eighth or less of the bytes, are sent
to every candidate block, which scores them by an integer matrix product.
Each round sends histograms of the scores inside every query's current
interval; summed over all blocks they show which bin holds the k-th score, and
that bin is the next interval, until it is one score wide. A last pass keeps
what lies above the k-th score and, of its ties, the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import discard, materialize

QUERIES = 64
CANDIDATES = 8192
BINS = 256  # 8 bits of the score a round
#: Scores beyond this in size count as this.
LIMIT = 2**62 - 1


def _integers(scale: float):
    """(id, dim, v, wanted): v as float64 integers; rows that can't be scored go."""

    def run(batches):
        for b in batches:
            ids, raw, dims, wanted = [], [], [], []
            for i, v, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64))
                if np.isfinite(x).all():
                    ids.append(i), raw.append(_narrow(x)), dims.append(len(x)), wanted.append(bool(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(wanted, pa.bool_())], names=["id", "dim", "v", "wanted"])

    return run


def _narrow(x: np.ndarray) -> bytes:
    """Integers in the smallest of four kinds that holds them, as the kind's letter and their bytes."""
    top = np.abs(x).max() if x.size else 0
    kind = "b" if top < 2**7 else "h" if top < 2**15 else "i" if top < 2**31 else "d"
    return kind.encode() + x.astype(f"<{np.dtype(kind).str[1:]}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<{np.dtype(raw[:1].decode()).str[1:]}", offset=1).astype(np.float64)


def _pack(size_name):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"])
        x = np.concatenate([_wide(v) for v in pdf.v]) if key[0] else np.empty(0)
        longest = float(np.sqrt((x.reshape(len(pdf), -1) ** 2).sum(axis=1)).max()) if key[0] else 0.0
        return pd.DataFrame({"dim": [key[0]], size_name: [key[1]], "ids": [pdf.id.to_numpy().tobytes()], "rows": [pdf.row.to_numpy().tobytes()], "x": [_narrow(x)], "n": [len(pdf)], "longest": [longest]})

    return run


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integers, within LIMIT: a float product where no
    rounding can occur, 64-bit ones, else integers of any size."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    top = q.shape[1] * float(np.abs(q).max()) * float(np.abs(c).max())
    if top < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    if top < LIMIT:
        return q.astype(np.int64) @ c.astype(np.int64).T
    a, b = (np.array([[int(v) for v in r] for r in x.tolist()], object) for x in (q, c))
    return np.clip(a @ b.T, -LIMIT, LIMIT).astype(np.int64)


def _each(work):
    """Over rows sorted by candidate block, the block before the queries sent
    to it: work(query row, query ids, candidate ids, scores, own)."""

    def run(batches):
        at = None
        for b in batches:
            for n in range(b.num_rows):
                r = {k: b.column(i)[n].as_py() for i, k in enumerate(b.schema.names)}
                ids, rows, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64), _wide(r["x"]).reshape(-1, r["dim"]) if r["dim"] else np.zeros((r["n"], 0))
                if r["side"] == 0:
                    at, block = (r["dim"], r["cb"]), (ids, rows, x)
                elif at == (r["dim"], r["cb"]):  # a length without candidates has no block
                    yield work(r, ids, block[0], _scores(x, block[2]), rows[:, None] == block[1][None, :])

    return run


def _histogram(r, qi, ci, s, own):
    """Counts of scores by bin inside each query's interval [low, low + 2**span), in bins of 2**step.

    A block sends its bins from the highest down to the one that holds its own
    need-th score: the need-th over all blocks is never lower."""
    low, shift, span, need = (np.frombuffer(r[k], np.int64) for k in ("low", "step", "span", "need"))
    at = (s - low[:, None]) >> shift[:, None]
    fits = (s >= low[:, None]) & (at < (1 << (span - shift))[:, None]) & ~own
    q, _ = np.nonzero(fits)
    n = np.bincount(q * BINS + at[fits], minlength=len(qi) * BINS).reshape(-1, BINS)
    higher = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
    n = np.where(higher < need[:, None], n, 0).ravel()
    full = np.flatnonzero(n)
    cols = [np.full(len(full), r["dim"], np.int32), np.full(len(full), r["qb"], np.int32), (full // BINS).astype(np.int32), (full % BINS).astype(np.int32), n[full].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["dim", "qb", "q", "bin", "n"])


def _winners(r, qi, ci, s, own):
    edge, need, rows = np.frombuffer(r["low"], np.int64), np.frombuffer(r["need"], np.int64), np.frombuffer(r["rows"], np.int64)
    q, c = np.nonzero((s > edge[:, None]) & ~own)
    tq, tc = np.nonzero((s == edge[:, None]) & ~own)  # ids ascend within a block
    nth = np.arange(len(tq)) - np.searchsorted(tq, tq)
    few = nth < need[tq]
    q, c = np.r_[q, tq[few]], np.r_[c, tc[few]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[q], qi[q], ci[c], s[q, c])], names=["query", "query_id", "vec_id", "score"])


def _state(dim, qb, low, shift, span, need):
    return pd.DataFrame({"dim": [dim], "qb": [qb], "low": [low.tobytes()], "step": [shift.tobytes()], "span": [span.tobytes()], "need": [need.tobytes()], "wide": [int(shift.max())]})


def _first_state(k):
    """No score is larger than the product of the longest vectors."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                top = min(int(r.longest * r.most * (1 + 1e-9)) + 1, LIMIT)
                one = np.ones(r.n, np.int64)
                shift = max(0, (2 * top).bit_length() - 8)
                yield _state(r.dim, r.qb, -top * one, shift * one, (shift + 8) * one, max(0, min(k, r.all - 1)) * one)

    return run


def _next_state(key, hist, state):
    """The bin that holds each query's k-th score becomes its interval; need is
    the rank still to be found inside it."""
    r = state.iloc[0]
    low, shift, need = (np.frombuffer(x, np.int64).copy() for x in (r.low, r.step, r.need))
    grid = np.zeros((len(low), BINS), np.int64)
    np.add.at(grid, (hist.q.to_numpy(), hist.bin.to_numpy()), hist.n.to_numpy())
    above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]  # scores in this bin and higher
    at = np.maximum((above >= need[:, None]).sum(axis=1) - 1, 0)
    row = np.arange(len(low))
    higher = np.where(at + 1 < BINS, above[row, np.minimum(at + 1, BINS - 1)], 0)
    return _state(key[0], key[1], low + (at << shift), np.maximum(shift - 8, 0), shift, need - higher)


_STATE = "dim int, qb int, low binary, step binary, span binary, need binary, wide long"


def top_k(vectors: DataFrame, wanted: Column | str, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for each row that is
    ``wanted``: (query_id, rank from 1, vec_id, score), ties to the smaller id.

    Components become floor(scale * x). All rows but the query's own are
    candidates, those that repeat its id included; rows that repeat a query's
    id are queries each. Rows with a null id, a null vector or null or
    non-finite components (scaled ones too) take no part; a vector is scored
    against vectors of its own length. Scores are exact; beyond 2**62 - 1 in
    size they count as that. Fewer candidates than k give all; no candidates
    give no rows. Other columns are ignored.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), (F.expr(wanted) if isinstance(wanted, str) else wanted).alias("wanted"))
    rows = materialize(rows.mapInArrow(_integers(scale), "id long, dim int, v binary, wanted boolean").withColumn("row", F.monotonically_increasing_id()), "rows")

    def packed(df, size, name):
        blocks = max(1, -(-df.count() // size))
        dealt = df.select("id", "row", "dim", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias(name))
        return materialize(dealt.groupBy("dim", name).applyInPandas(_pack(name), f"dim int, {name} int, ids binary, rows binary, x binary, n long, longest double"), name), blocks

    c, n_c = packed(rows, CANDIDATES, "cb")
    q, _ = packed(rows.filter("wanted"), QUERIES, "qb")
    discard(rows)
    sizes = c.groupBy("dim").agg(F.max("longest").alias("most"), F.sum("n").alias("all"))
    state = materialize(q.join(sizes, "dim").select("dim", "qb", "n", "longest", "most", "all").mapInPandas(_first_state(k), _STATE), "state")
    blank = [F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in ("qb int", "low binary", "step binary", "span binary", "need binary"))]
    held = c.select("dim", "cb", F.lit(0).alias("side"), "ids", "rows", "x", "n", *blank)
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_c // 8)

    def meet(work, schema):
        sent = q.join(state, ["dim", "qb"]).select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), F.lit(1).alias("side"), "ids", "rows", "x", "n", "qb", "low", "step", "span", "need")
        return held.union(sent).repartition(parts, "dim", "cb").sortWithinPartitions("dim", "cb", "side").mapInArrow(_each(work), schema)

    rounds = ((state.agg(F.max("wide")).first()[0] or 0) + 7) // 8 + 1
    for _ in range(rounds):
        hist = meet(_histogram, "dim int, qb int, q int, bin int, n long").groupBy("dim", "qb", "q", "bin").agg(F.sum("n").alias("n"))
        new = materialize(hist.groupBy("dim", "qb").cogroup(state.groupBy("dim", "qb")).applyInPandas(_next_state, _STATE), "state")
        discard(state)
        state = new
    best = meet(_winners, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
