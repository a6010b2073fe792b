"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within R differing bits: cut the word in p parts; of
2p - 2 differing bits some two parts hold at most two, for if the two that
hold the fewest held three, the others would hold two each at least, 2p - 1 in
all. Half of that radius is one. Every fingerprint therefore emits, for each
pair of parts, their bits and all variants with one of these flipped; the
balls of both partners meet at a shared key. R = 3 takes thirds (131 keys in
all), R = 6 quarters (198 keys). Keys are shuffled, the fingerprints at one key
are compared and only links that span the groups found are kept.

Where a similarity is asked for (``keep_one``), fingerprints of texts that
have it lie farther apart than a ball can reach: at a Jaccard similarity of 0.8
a bit differs with probability 0.15. There each text has TABLES further, shorter
fingerprints of BITS bits, ball-hashed within two bits each, so that one of them
brings such a pair together; pairs are then compared on the whole fingerprint
and links verified on the texts' sets of shingles. So that the likeliest links
are the ones verified, each key gives a spanning forest of least distances.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import bytes_of, components, discard, materialize, spanning, unused

#: Fingerprints at one key beyond which they are compared in blocks, each its own task.
GROUP = 2048
#: Fingerprints that one task sends to the keys of their balls (about 12 MB).
SENT = 8192


#: Short fingerprints and their bits. Of texts of similarity 0.8, 0.85, 0.9 some
#: two are within two bits with probability 0.87, 0.96, 0.997.
TABLES, BITS = 10, 28
#: Differing bits of the whole fingerprint, and of all fingerprints together, up
#: to which a pair is worth verifying: five and four standard deviations above
#: those of a pair of similarity 0.8.
REACH, REACH_ALL = 24, 74
_RND = np.random.default_rng(28)
_MIXES = _RND.integers(0, 1 << 64, (TABLES // 2 - 1, 2), np.uint64) | np.uint64(1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    runs = [b" ".join(w)] if len(w) < width else map(b" ".join, zip(*(w[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, max(1, len(w) - width + 1))


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """A uint64 fingerprint for each list of hashes: bits set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    part, sizes, at = [], [], []

    def close():
        if at:
            bits = np.unpackbits(np.concatenate(part).view(np.uint8), bitorder="little").reshape(-1, 64)
            n = np.array(sizes)
            ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
            out[at] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
            for x in (part, sizes, at):
                x.clear()

    held = 0
    for i, h in enumerate(hashes):
        if len(h):
            part.append(h), sizes.append(len(h)), at.append(i)
            held += len(h)
        if held > 100_000:
            close()
            held = 0
    close()
    return out


def _mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    h = h * by[0]
    h = (h ^ (h >> np.uint64(32))) * by[1]
    return h ^ (h >> np.uint64(29))


def _print_rows(width: int, sets: bool):
    """(id, fp, row); with ``sets`` of the distinct shingles, with their hash as
    node and further fingerprints as more."""

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 200):
                b = whole.slice(s, 200)
                hashes = [shingle_hashes(t, width) for t in bytes_of(b.column(1))]
                if sets:
                    hashes = [np.unique(h) for h in hashes]
                cols = [b.column(0), pa.array(fingerprints(hashes).view(np.int64)), b.column(2)]
                if sets:
                    cols.append(pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in hashes], np.uint64).view(np.int64)))
                    more = np.stack([fingerprints([_mixed(h, m) for h in hashes]) for m in _MIXES], axis=1).view(np.int64)
                    cols.append(pa.FixedSizeListArray.from_arrays(pa.array(more.ravel()), len(_MIXES)).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "fp", "row", "node", "more"][: len(cols)])

    return run


def _differing(x: np.ndarray) -> np.ndarray:
    """The number of bits set in x (int64); as unsigned, for numpy counts the
    bits of a signed number's absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, top: int) -> np.ndarray:
    """Indexes of the pairs i-j that make a spanning forest of least distances d over 0..n-1."""
    label, out = np.arange(n), []
    for level in range(top + 1):
        at = np.flatnonzero(d == level)
        while len(at := at[label[i[at]] != label[j[at]]]):
            first = np.full(n, len(d))
            np.minimum.at(first, label[i[at]], at)
            np.minimum.at(first, label[j[at]], at)
            pick = np.unique(first[first < len(d)])
            label, before = spanning(n, label[i[pick]], label[j[pick]])[label], label
            # pairs of one distance may close a ring: keep those that join
            out.append(_joining(n, before[i[pick]], before[j[pick]], pick))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _joining(n, a, b, pick):
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    keep = []
    for x, y, p in zip(a.tolist(), b.tolist(), pick.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(p)
    return np.array(keep, np.int64)


def _linked(f: np.ndarray, g: np.ndarray | None, radius: int):
    """Spanning links of least distances among distinct f (or between f and g) within the radius."""
    same = g is None
    g = f if same else g
    nodes = np.unique(np.concatenate([f, g]))
    a, b, d = [], [], []
    for i in range(0, len(f), 512):
        far = _differing(f[i : i + 512, None] ^ g[None, :])
        x, y = np.nonzero(far <= radius)
        if same:
            x, y = x[x + i < y], y[x + i < y]
        a.append(x.astype(np.int32) + i), b.append(y.astype(np.int32)), d.append(far[x, y])
    a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
    x, y = f[a], g[b]
    keep = forest(len(nodes), np.searchsorted(nodes, x), np.searchsorted(nodes, y), d, radius)
    return np.maximum(x[keep], y[keep]), np.minimum(x[keep], y[keep])


def _rows(a, b, hot: bool):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])


def _meet(radius: int):
    """Over rows sorted by key: links of the fingerprints at each key. Those at
    a crowded key pass through, marked hot."""

    def run(batches):
        empty = np.empty(0, np.int64)
        k, f, crowded = empty, empty, None

        def close(k, f, crowded):
            if crowded is not None and (mine := k == crowded).any():
                yield _rows(k[mine], f[mine], True)
                k, f = k[~mine], f[~mine]
            if len(k) < 2:
                return
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[start, len(k)])
            s = start[size == 2]
            x, y = f[s], f[s + 1]
            near = _differing(x ^ y) <= radius
            a, b = [np.maximum(x, y)[near]], [np.minimum(x, y)[near]]
            for s, n in zip(start[size > 2], size[size > 2]):
                if n > GROUP:
                    yield _rows(k[s : s + n], f[s : s + n], True)
                else:
                    x, y = _linked(f[s : s + n], None, radius)
                    a.append(x), b.append(y)
            ab = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield _rows(ab[0], ab[1], False)

        for batch in batches:
            k = np.concatenate([k, batch.column(0).to_numpy()])
            f = np.concatenate([f, batch.column(1).to_numpy()])
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1])
            yield from close(k[:last], f[:last], crowded)
            k, f = k[last:], f[last:]
            if k[0] == crowded or len(k) > GROUP:
                yield _rows(k, f, True)
                crowded, k, f = k[0], empty, empty
        yield from close(k, f, crowded)

    return run


def _block(radius: int):
    def run(pdf):
        import pandas as pd

        f, g = (np.unique(pdf.fp[pdf.side == s].to_numpy()) for s in (0, 1))
        a, b = _linked(f, g if len(g) else None, radius) if len(f) else (f, f)
        return pd.DataFrame({"a": a, "b": b})

    return run


def ball_keys(radius: int) -> list:
    """Keys of ``fp``: for each pair of parts their bits, and these with one flipped."""
    parts = -(-(radius + 2) // 2)
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    ranges = [range(a, b) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for t, (x, y) in enumerate(combinations(ranges, 2)):
        bits = [*x, *y]
        mask = sum(1 << i for i in bits)
        # the number of the pair stands where the mask has no bits
        room = [i for i in range(64) if not mask >> i & 1]
        tag = sum(1 << room[n] for n in range(8) if t >> n & 1)
        kept = F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).bitwiseXOR(F.lit(_signed(tag)).cast("long"))
        keys += [kept] + [kept.bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in bits]
    return keys


def short_keys() -> list:
    """Keys of the short fingerprints, two of each 64 bits of ``fp`` and ``more``."""
    keys = []
    for t in range(TABLES):
        whole = F.col("fp") if t < 2 else F.get(F.col("more"), F.lit(t // 2 - 1))
        bits = F.shiftrightunsigned(whole, t % 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
        kept = bits.bitwiseOR(F.lit(t << BITS).cast("long"))
        keys += [kept] + [kept.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(BITS)]
    return keys


def near_links(prints: DataFrame, radius: int = 3, keys: list | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span every group
    of those that meet at a key and differ in at most ``radius`` bits; by default
    the keys of ``fp`` itself, at which all such fingerprints meet. prints is
    read twice, to count and to send it: best a written table."""
    keys = keys or ball_keys(radius)
    # a row becomes well over a hundred: tasks are cut by rows, not by the bytes read
    dealt = prints.repartition(max(1, -(-prints.count() // SENT)), "fp")
    met = materialize(dealt.select(F.explode(F.array(*keys)).alias("k"), "fp").repartition("k").sortWithinPartitions("k").mapInArrow(_meet(radius), "a long, b long, hot boolean"), "met")
    links = met.filter("not hot").select("a", "b").distinct()
    hot = met.filter("hot").select(F.col("a").alias("k"), F.col("b").alias("fp"))
    if not hot.isEmpty():
        size = hot.groupBy("k").agg(F.ceil(F.count("*") / F.lit(GROUP // 2)).cast("int").alias("s"))
        cut = hot.join(size, "k").withColumn("i", F.pmod(F.xxhash64("fp"), "s").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        pairs = cut.select("k", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("side"), "fp")
        links = links.union(pairs.groupBy("k", "p", "q").applyInPandas(_block(radius), "a long, b long")).distinct()
    return links


def _row(id_col: str, text_col: str):
    i = F.col(f"`{id_col}`").cast("long")
    return F.xxhash64(i.isNull(), i, F.col(f"`{text_col}`"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, row): row names a row by its id and text."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), _row(id_col, text_col).alias("row"))


def _rep():
    return F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "row")).alias("rep")


def _named(prints: DataFrame) -> DataFrame:
    """(fp, rep, g) of each distinct fingerprint: its row of smallest id as
    (without id, id, row), and what names its group."""
    reps = materialize(prints.groupBy("fp").agg(_rep()), "reps")
    group = components(near_links(reps.select("fp")))
    named = materialize(reps.join(group, reps.fp == group.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("g")), "named")
    discard(reps)
    return named


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component) for every row of docs: three-word shingles,
    links at three or fewer differing bits.

    Null and empty texts and texts of white space have fingerprint zero and
    link like any other; repeated rows stay, each with its component. A row
    with a null id takes its group's component (null if no member has an id).
    Other columns are ignored whatever their names; no rows give no rows.
    """
    prints = materialize(_texts(docs, id_col, text_col).mapInArrow(_print_rows(3, False), "id long, fp long, row long"), "prints")
    named = _named(prints)
    smallest = named.groupBy("g").agg(F.min("rep")["id"].alias("component"))
    return prints.join(named.join(smallest, "g").select("fp", "component"), "fp").select("id", "fp", "component")


def _set_rows(width: int):
    """(node, s): the distinct shingles of a text, as array<long>."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in bytes_of(b.column(1))]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "s"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: the one of smallest id,
    rows without id last; of rows that share an id but not the text, the one of
    smallest hash, while each of their groups keeps a row of its own.

    Texts link where one of their short fingerprints, of the distinct shingles
    of ``width`` words, differs in at most two bits, the whole ones in at most
    REACH and all in at most REACH_ALL, and these sets have a Jaccard similarity of at least ``similarity``;
    of the links that join a group at a key those of least distance are
    verified. Texts with one set are copies, those without words too.
    """
    row, kept = unused(docs, "_row"), unused(docs, "_kept")
    texts = _texts(docs, id_col, text_col)
    prints = materialize(texts.mapInArrow(_print_rows(width, True), "id long, fp long, row long, node long, more array<long>"), "prints")
    nodes = materialize(prints.groupBy("node").agg(_rep(), F.first("fp").alias("fp"), F.first("more").alias("more")), "nodes")
    discard(prints)
    by_print = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "more")).alias("m")).select("fp", "m.node", "m.more"), "fingerprints")
    links = near_links(by_print.select("fp", "more"), REACH, short_keys())
    a, b = (by_print.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}"), F.col("more").alias(f"m{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))), lambda n, m: n + m)
    twins = nodes.join(by_print.select("fp", F.col("node").alias("first")), "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs = materialize(links.join(a, "a").join(b, "b").filter(apart <= REACH_ALL).select(F.col("na").alias("a"), F.col("nb").alias("b")).union(twins), "pairs")
    linked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(linked, "node", "left_semi").select("node", F.col("rep.row").alias("row"))
    sets = materialize(texts.select("row", "text").join(wanted, "row").select("node", "text").mapInArrow(_set_rows(width), "node long, s array<long>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared, all_ = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    group = components(both.filter(shared >= F.lit(similarity) * (all_ - shared) - 1e-9).select("a", "b"))
    named = nodes.select("node", "rep").join(group, "node", "left").select("rep", F.coalesce("component", "node").alias("g"))
    best = materialize(named.groupBy("g").agg(F.min("rep")["row"].alias(kept)).select(kept).distinct(), "kept")
    for t in (by_print, pairs, sets):
        discard(t)
    rows = docs.withColumn(row, _row(id_col, text_col)).join(best, F.col(row) == F.col(kept), "left_semi")
    return rows.dropDuplicates([id_col, row]).select(*(f"`{c}`" for c in docs.columns))
