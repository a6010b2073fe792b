"""Language-model scores by Brown class-based n-grams.

P(text) = product over tokens of P(class | class before) * P(word | class).
Word counts cover every training token. Exchange clustering maximises the
likelihood of class bigrams in two steps. First over core items: the ``items``
most frequent words, the end token, and ``suffixes`` groups of all other words
by their endings. Then every further training word with ``seen`` occurrences
(1: each of them) is moved from its group to its best class against these, on
its sparse counts to and from classes. Other words, unknown ones among them,
take the class of their ending's group: that of the last three letters if it is
among the most frequent endings, or two, or one.

The ``frequent`` most frequent words (a bound on what every task holds, not on
what is clustered) are numbered and moved ``rounds`` times, and texts are
written once as these numbers; every later pass reads numbers. All other words
meet in a shuffle by word, which moves each of them once after the numbered ones
on all its contexts, and their classes go back to their texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import bytes_of, discard, materialize

ITEMS, SUFFIXES, CLASSES, SWEEPS, ROUNDS = 1024, 255, 64, 5, 1
#: Occurrences from which a word beyond the items is clustered by itself.
SEEN = 1
FREQUENT = 200_000
ALPHA = 0.1
END = b""  # no word is empty


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _best(g, a: int, r, l, s) -> int:
    """The class of highest likelihood for an item of class a, taken out of the
    class bigrams g: r and l are its counts to and from classes, s to itself."""
    f = _xlogx
    row, col = g.sum(axis=1) + l, g.sum(axis=0) + r  # wherever the item goes, its neighbours keep their counts
    i, j = np.flatnonzero(r), np.flatnonzero(l)  # elsewhere nothing changes
    gain = (f(g[:, i] + r[i]) - f(g[:, i])).sum(axis=1) + (f(g[j] + l[j, None]) - f(g[j])).sum(axis=0)
    d = np.diagonal(g)
    gain += f(d + r + l + s) + f(d) - f(d + r) - f(d + l)
    gain -= f(row + r.sum() + s) - f(row) + f(col + l.sum() + s) - f(col)
    b = int(np.argmax(gain))
    return b if gain[b] > gain[a] + 1e-9 else a


def _best_of(g, word, slot, n, a) -> np.ndarray:
    """_best of many words at once, each taken by itself out of its class a of the
    class bigrams g: their contexts (word, slot, count), sorted by word, a slot
    naming the class after, classes + the class before, or 2 * classes (itself)."""
    f = lambda x: x * np.log(np.maximum(x, 1.0))  # counts are whole
    classes, out = len(g), np.array(a, np.int64)
    gt, rows, cols, diagonal = np.ascontiguousarray(g.T), g.sum(axis=1), g.sum(axis=0), np.diagonal(g)
    ends = np.searchsorted(word, np.arange(len(out) + 1))
    at = 0
    while at < len(out):
        till = max(at + 1, min(int(np.searchsorted(ends, ends[at] + 10_000, "right")) - 1, at + 5_000))
        w, k, x, b = word[ends[at] : ends[till]] - at, slot[ends[at] : ends[till]], n[ends[at] : ends[till]].astype(np.float64), out[at:till]
        here = np.arange(till - at)
        dense = np.zeros((till - at, 2 * classes + 1))
        dense[w, k] = x
        r, l, s = dense[:, :classes], dense[:, classes:-1], dense[:, -1]
        gain = np.zeros((till - at, classes))
        for side, table, across in ((k < classes, gt, l), ((k >= classes) & (k < 2 * classes), g, r)):
            u, i, y = w[side], k[side] % classes, x[side]
            if not len(u):
                continue
            held = table[i]  # by entry: the bigrams of each class with the context's class, without the word
            held[np.arange(len(u)), b[u]] -= y
            own = np.flatnonzero(i == b[u])
            held[own] -= across[u[own]]
            held[own, b[u[own]]] -= s[u[own]]
            first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            gain[u[first]] += np.add.reduceat(f(held + y[:, None]) - f(held), first, axis=0)
        d = np.tile(diagonal, (till - at, 1))
        d[here, b] -= r[here, b] + l[here, b] + s
        gain += f(d + r + l + s[:, None]) + f(d) - f(d + r) - f(d + l)
        for whole, y in ((rows, r.sum(axis=1) + s), (cols, l.sum(axis=1) + s)):
            t = np.tile(whole, (till - at, 1))
            t[here, b] -= y
            gain -= f(t + y[:, None]) - f(t)
        to = np.argmax(gain, axis=1)
        out[at:till] = np.where(gain[here, to] > gain[here, b] + 1e-9, to, b)
        at = till
    return out


def exchange(m: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item from the item bigram counts m (row before column):
    items move one at a time to the class of highest likelihood, in order of
    frequency, for a number of sweeps or until none moves."""
    n = len(m)
    m = m.astype(np.float64)
    freq = m.sum(axis=0) + m.sum(axis=1)
    order = np.argsort(-freq, kind="stable")
    cls = np.empty(n, np.int64)
    cls[order] = np.arange(n) % classes
    hot = np.zeros((n, classes))
    hot[np.arange(n), cls] = 1
    right, left = m @ hot, m.T @ hot  # of each item: counts to and from classes
    g = hot.T @ right

    for _ in range(sweeps):
        moved = 0
        for i in order:
            if not freq[i]:
                continue
            a, s = cls[i], m[i, i]
            r, l = right[i].copy(), left[i].copy()
            r[a] -= s
            l[a] -= s
            g[a, :] -= r
            g[:, a] -= l
            g[a, a] -= s
            b = _best(g, int(a), r, l, s)
            g[b, :] += r
            g[:, b] += l
            g[b, b] += s
            if b != a:
                moved += 1
                cls[i] = b
                right[:, a] -= m[:, i]
                right[:, b] += m[:, i]
                left[:, a] -= m[i, :]
                left[:, b] += m[i, :]
        if not moved:
            break
    return cls


def _count(batches):
    held: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for whole in batches:
        for s in range(0, whole.num_rows, 500):
            for t in bytes_of(whole.column(0).slice(s, 500)):
                held.update(tokens(t))
                if len(held) > 150_000:
                    yield rows()
    yield rows()


def count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c) of every token of docs, the end token as an empty word."""
    text = docs.select(F.col(f"`{text_col}`").alias("text"))
    return materialize(text.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")


@dataclass
class Vocabulary:
    total: int  # training tokens
    distinct: int
    words: list = field(repr=False)  # the frequent ones, most frequent first, the end token among them
    counts: np.ndarray = field(repr=False)
    endings: dict = field(repr=False)  # ending -> number of its group; groups follow the words

    @property
    def size(self) -> int:
        return len(self.words) + len(self.endings)

    def number(self) -> dict:
        return dict(zip(self.words, range(len(self.words))))

    def group(self, word: bytes) -> int:
        w = word.decode("utf-8", "replace")
        for n in (3, 2, 1):
            at = self.endings.get(w[-n:])
            if at is not None:
                return at
        return self.endings[""]


def vocabulary(counts: DataFrame, suffixes: int = SUFFIXES, frequent: int = FREQUENT) -> Vocabulary:
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # longer words where they are frequent, so that no word's texts elsewhere outweigh a task
    short = counts.filter((F.length("word") > 0) & ((F.length("word") <= 256) | (F.col("c") >= F.length("word"))))
    # words by the size of their counts, sixteen steps a doubling: a thousand rows at most
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    low, n = 1 << 30, 1  # the end token
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        if n + r["count"] > frequent:
            break
        low, n = r.step, n + r["count"]
    top = short.filter(step >= low).toArrow()  # at most ``frequent`` short rows
    rows = sorted(zip(top.column("word").to_pylist(), top.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    ends = counts.filter(F.length("word") == 0).select("c").first()
    words, cs = [END, *(w for w, _ in rows)], [ends.c if ends else 0, *(c for _, c in rows)]
    w = F.decode("word", "utf-8")
    ends = [short.select(F.right(w, F.lit(k)).alias("e"), "c").filter(F.char_length("e") == k) for k in (1, 2, 3)]
    best = ends[0].union(ends[1]).union(ends[2]).groupBy("e").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(max(0, suffixes - 1)).collect()
    return Vocabulary(whole["n"] or 0, whole["v"], words, np.array(cs, np.int64), {e: len(words) + i for i, e in enumerate(["", *(r.e for r in best)])})


def _lists(values, ends, kind):
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _numbered(shared):
    """Texts as numbers of words or of their endings' groups, the words without
    a number, each once with its group, and the places where each stands."""

    def run(batches):
        vocabulary = shared.value
        at, group = vocabulary.number(), vocabulary.group
        for whole in batches:
            for s in range(0, whole.num_rows, 250):
                b = whole.slice(s, 250)
                ids, ends, words, groups, word_ends, places, which, place_ends = [], [0], [], [], [0], [], [], [0]
                for t in bytes_of(b.column(2)):
                    toks = tokens(t)
                    mine = list(map(at.get, toks))
                    if None in mine:
                        found: dict = {}
                        for i, x in enumerate(mine):
                            if x is None:
                                w = toks[i]
                                j = found.get(w)
                                if j is None:
                                    j = found[w] = len(found)
                                    words.append(w), groups.append(group(w))
                                mine[i] = groups[word_ends[-1] + j]
                                places.append(i), which.append(j)
                    ids += mine
                    ends.append(len(ids)), word_ends.append(len(words)), place_ends.append(len(places))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), _lists(ids, ends, pa.int32()), _lists(words, word_ends, pa.binary()), _lists(groups, word_ends, pa.int32()), _lists(places, place_ends, pa.int32()), _lists(which, place_ends, pa.int32())],
                    names=["id", "held_out", "ids", "w", "g", "at", "j"],
                )

    return run


def numbered(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """docs as (id, held_out, ids, w, g, at, j, row): written once, read by every later pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_numbered(shared), f"id {kind}, held_out boolean, ids array<int>, w array<binary>, g array<int>, at array<int>, j array<int>")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "numbers")


@dataclass
class Model:
    total: int  # training tokens
    distinct: int
    cls: np.ndarray = field(repr=False)  # number of a word or group -> class
    step: np.ndarray = field(repr=False)  # log10 P(class | class before)
    size: np.ndarray = field(repr=False)  # class -> training tokens
    kinds: np.ndarray = field(repr=False)  # class -> distinct words

    def base(self, c):
        return np.log10((c + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))

    def emit(self, c, k):
        return np.log10((c + ALPHA) / (self.size[k] + ALPHA * (self.kinds[k] + 1)))


def _pairs(batches, end: int = 0):
    """Numbers of adjacent tokens: every text follows an end token and ends with one."""
    for whole in batches:
        for s in range(0, whole.num_rows, 2000):
            v = whole.column(0).slice(s, 2000).flatten().to_numpy()
            if len(v):
                yield np.r_[end, v[:-1]], v


def _summed(k, n):
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["k", "n"])


def _bigrams(of: np.ndarray, size: int, end: int = 0):
    """Bigrams of what numbers stand for (items, classes)."""

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for u, v in _pairs(batches, end):
            total += np.bincount(of[u].astype(np.int64) * size + of[v], minlength=len(total))
        k = np.flatnonzero(total)
        yield _summed(k, total[k])

    return run


def _contexts(cls, later: np.ndarray, classes: int):
    """Counts of each later word (a number below): to each class, from each class, to itself."""
    slots = 2 * classes + 1

    def run(batches):
        held: list = []

        def rows():
            k, n = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.int64),) * 2
            held.clear()
            k, at = np.unique(k, return_inverse=True)
            return k, np.bincount(at, n, len(k)).astype(np.int64) if len(k) else n

        for u, v in _pairs(batches):
            p, q = later[u], later[v]
            same = p & (u == v)
            p, q = p & ~same, q & ~same
            u64, v64 = u.astype(np.int64), v.astype(np.int64)
            k = np.concatenate([u64[p] * slots + cls[v[p]], v64[q] * slots + classes + cls[u[q]], u64[same] * slots + 2 * classes])
            held.append(np.unique(k, return_counts=True))
            if sum(len(k) for k, _ in held) > 300_000:
                k, n = rows()
                if len(k) > 150_000:
                    yield _summed(k, n)
                else:
                    held.append((k, n))
        yield _summed(*rows())

    return run


def _insert(cls, g, classes: int):
    """Over (k, n) of _contexts from all tasks, sorted, words whole: each word's best class against the fixed ones."""
    slots = 2 * classes + 1

    def run(batches):
        k, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def close(k, n):
            k, at = np.unique(k, return_inverse=True)
            n = np.bincount(at, n, len(k))
            w, at = np.unique(k // slots, return_inverse=True)
            return _summed(w, _best_of(g, at, k % slots, n, cls[w]))

        for b in batches:
            k, n = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate((k, n)))
            if len(k):
                cut = np.searchsorted(k, k[-1] // slots * slots)
                yield close(k[:cut], n[:cut])
                k, n = k[cut:], n[cut:]
        yield close(k, n)

    return run


def _others(cls, classes: int):
    """Words without a number, a row for each text that has one: the class of its
    ending's group, its times, and in training texts its contexts as _contexts has them."""

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                row, held = b.column(0).to_numpy(), pc.fill_null(b.column(1), True).to_numpy(zero_copy_only=False)
                ids, words, groups, places, which = (b.column(i) for i in range(2, 7))
                v, count = ids.flatten().to_numpy(), np.diff(words.offsets.to_numpy())
                m = int(count.sum())
                if not m:
                    continue
                n, times = np.diff(ids.offsets.to_numpy()), np.diff(places.offsets.to_numpy())
                start, first = np.cumsum(n) - n, np.cumsum(count) - count
                p = places.flatten().to_numpy() + np.repeat(start, times)
                j = which.flatten().to_numpy() + np.repeat(first, times)
                k = cls[v]
                here = np.full(len(v) + 1, -1)  # the last one stands before the first text
                here[p] = j
                before, after = here[p - 1] == j, here[p + 1] == j
                of = np.concatenate([j[~after], j[~before], j[before]])
                slot = np.concatenate([k[p[~after] + 1], classes + np.where(p > 0, k[p - 1], cls[0])[~before], np.full(before.sum(), 2 * classes)])
                train = ~np.repeat(held, count)[of]
                of, slot = of[train], slot[train]
                order = np.argsort(of, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [words.flatten(), pa.array(np.repeat(row, count)), pa.array((np.arange(m) - np.repeat(first, count)).astype(np.int32)), pa.array(np.repeat(held, count)),
                     pa.array(np.bincount(j, minlength=m).astype(np.int32)), pa.array(cls[groups.flatten().to_numpy()].astype(np.int16)),
                     _lists(slot[order].astype(np.int16), np.r_[0, np.cumsum(np.bincount(of, minlength=m))].astype(np.int32), pa.int16())],
                    names=["word", "row", "j", "held_out", "n", "k", "slots"],
                )

    return run


def _placed(g, classes: int, seen: int | None):
    """Over the rows of _others, sorted, words whole: each word's training count and
    class, the best one against the fixed ones from ``seen`` occurrences; ``own``
    is the count at a word's first row, else 0."""
    slots = 2 * classes + 1

    def run(batches):
        def close(t):
            new = np.flatnonzero(_changes(t))
            of = np.cumsum(_changes(t)) - 1
            n = np.where(t.column("held_out").to_numpy(zero_copy_only=False), 0, t.column("n").to_numpy())
            c = np.bincount(of, n, len(new)).astype(np.int64)
            k = t.column("k").to_numpy()[new].astype(np.int64)
            lists = t.column("slots")
            key, times = np.unique(np.repeat(of, np.diff(lists.offsets.to_numpy())) * slots + lists.flatten().to_numpy(), return_counts=True)
            moved = np.flatnonzero(c >= max(1, seen)) if seen is not None else np.empty(0, np.int64)
            if len(moved):
                word = key // slots
                mine = np.isin(word, moved) if len(moved) < len(new) else slice(None)
                k[moved] = _best_of(g, np.searchsorted(moved, word[mine]), (key % slots)[mine], times[mine], k[moved])
            own = np.zeros(len(of), np.int64)
            own[new] = c
            return pa.RecordBatch.from_arrays([t.column("row"), t.column("j"), pa.array(k[of].astype(np.int16)), pa.array(c[of]), pa.array(own)], names=["row", "j", "k", "c", "own"])

        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            last = int(np.flatnonzero(_changes(b))[-1])
            if last or held and held[-1].column("word")[-1] != b.column("word")[0]:  # a word ends
                yield close(_joined([*held, b.slice(0, last)]))
                held = [b.slice(last)]
            else:
                held.append(b)
        if held:
            yield close(_joined(held))

    return run


def _changes(b) -> np.ndarray:
    """Where a row's word is another than that of the row before."""
    w = b.column("word").dictionary_encode().indices.to_numpy()
    return np.r_[True, w[1:] != w[:-1]]


def _joined(batches):
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _matrix(sequences: DataFrame, of: np.ndarray, size: int, end: int = 0) -> np.ndarray:
    pairs = sequences.mapInArrow(_bigrams(of, size, end), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # size**2 rows at most
    m = np.zeros(size * size, np.int64)
    m[pairs.column("k").to_numpy()] = pairs.column("n").to_numpy()
    return m.reshape(size, size)


def cluster(numbers: DataFrame, vocabulary: Vocabulary, items: int = ITEMS, classes: int = CLASSES, sweeps: int = SWEEPS, seen: int = SEEN, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of numbered words and of groups in training texts (``numbered`` ones), and their class bigrams."""
    ids, v = numbers.select("ids"), vocabulary
    n_words = len(v.words)
    core = min(items + 1, n_words)  # the end token is the first word
    n_items = core + len(v.endings)
    group = np.array([v.group(w) for w in v.words[core:]], np.int64) - n_words + core
    item = np.concatenate([np.arange(core), group, np.arange(core, n_items)]).astype(np.int64)
    m = _matrix(ids, item, n_items)
    first = exchange(m, classes, sweeps)
    hot = np.zeros((n_items, classes))
    hot[np.arange(n_items), first] = 1
    g = hot.T @ m @ hot
    cls = first[item]
    later = np.zeros(v.size, bool)
    later[core:n_words] = v.counts[core:] >= max(1, seen)
    slots = 2 * classes + 1
    for _ in range(rounds if later.any() else 0):
        found = ids.mapInArrow(_contexts(cls, later, classes), "k long, n long")
        found = found.repartition(F.floor(F.col("k") / F.lit(slots))).sortWithinPartitions("k").mapInArrow(_insert(cls, g, classes), "k long, n long").toArrow()  # a row for each later word
        cls = cls.copy()
        cls[found.column("k").to_numpy()] = found.column("n").to_numpy()
        g = _matrix(ids, cls, classes).astype(np.float64)
    return cls, g


def place(numbers: DataFrame, cls: np.ndarray, g: np.ndarray, seen: int = SEEN, rounds: int = ROUNDS) -> DataFrame:
    """(row, j, k, c, own) of the words without a number in every text: class and
    training count of word j of a row. However many they are, each with ``seen``
    occurrences is moved to its best class (with no rounds none is)."""
    found = numbers.select("row", "held_out", "ids", "w", "g", "at", "j").mapInArrow(_others(cls, len(g)), "word binary, row long, j int, held_out boolean, n int, k short, slots array<short>")
    dealt = found.repartition("word").sortWithinPartitions("word")
    return materialize(dealt.mapInArrow(_placed(g, len(g), seen if rounds else None), "row long, j int, k short, c long, own long"), "placed")


def _classed(shared):
    """Per text: its classes, and sums of what does not depend on their steps."""

    def run(batches):
        model, counts = shared.value
        cls, n_words = model.cls, len(counts)
        rest = np.zeros(len(cls) - n_words)  # each word of a group has its own count
        known = np.r_[counts > 0, rest].astype(np.int64)
        base, emit = np.r_[model.base(counts), rest], np.r_[model.emit(counts, cls[:n_words]), rest]
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                ids, places, which, classes, c = (b.column(i) for i in range(2, 7))
                v = ids.flatten().to_numpy()
                n, times = np.diff(ids.offsets.to_numpy()), np.diff(places.offsets.to_numpy())
                start = np.cumsum(n) - n
                count = pc.fill_null(pc.list_value_length(classes), 0).to_numpy()
                k, sums = cls[v], [known[v], base[v], emit[v]]
                if len(places.flatten()):
                    p = places.flatten().to_numpy() + np.repeat(start, times)
                    j = which.flatten().to_numpy() + np.repeat(np.cumsum(count) - count, times)
                    x, y = classes.flatten().to_numpy()[j], c.flatten().to_numpy()[j]
                    k[p], sums[0][p], sums[1][p], sums[2][p] = x, y > 0, model.base(y), model.emit(y, x)
                sums = [np.add.reduceat(x, start) if len(v) else x for x in sums]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n.astype(np.int64)), *(pa.array(x) for x in sums), _lists(k.astype(np.int16), np.r_[0, np.cumsum(n)].astype(np.int32), pa.int16())],
                    names=["id", "held_out", "n_tokens", "n_known", "base", "emit", "classes"],
                )

    return run


def classed(numbers: DataFrame, placed: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base, emit, classes) of every text."""
    shared = numbers.sparkSession.sparkContext.broadcast((model, vocabulary.counts))
    found = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("j", "k", "c"))).alias("e")).select("row", F.col("e.k").alias("k"), F.col("e.c").alias("c"))
    met = numbers.select("row", "id", "held_out", "ids", "at", "j").join(found, "row", "left").select("id", "held_out", "ids", "at", "j", "k", "c")
    id_type = numbers.schema["id"].dataType.simpleString()
    return materialize(met.mapInArrow(_classed(shared), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, emit double, classes array<short>"), "classed")


def _score(step, end: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                k = b.column(6).flatten().to_numpy()
                n = np.diff(b.column(6).offsets.to_numpy())
                steps = np.add.reduceat(step[np.r_[end, k[:-1]], k], np.cumsum(n) - n) if len(k) else np.empty(0)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(b.column(5).to_numpy() + steps)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(texts: DataFrame, model: Model) -> DataFrame:
    """Per text of ``classed``: id, held_out, n_tokens, n_known, base_score, score (log10).

    Null and empty texts are one end token; repeated rows are scored each;
    with no training text every count is 0.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_score(model.step, int(model.cls[0])), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def fit_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS, suffixes: int = SUFFIXES, classes: int = CLASSES, sweeps: int = SWEEPS, seen: int = SEEN, rounds: int = ROUNDS, frequent: int = FREQUENT):
    """(scores of all docs, model, vocabulary), learnt from those not held out."""
    counts = count(docs.filter(~held_out), text_col)
    words = vocabulary(counts, suffixes, frequent)
    numbers = numbered(docs, words, id_col, text_col, held_out)
    cls, g = cluster(numbers.filter("not held_out"), words, items, classes, sweeps, seen, rounds)
    placed = place(numbers, cls, g, seen, rounds)
    n_words = len(words.words)
    size = np.bincount(cls[:n_words], words.counts, classes).astype(np.int64)
    kinds = np.bincount(cls[:n_words][words.counts > 0], minlength=classes)
    for r in placed.filter("own > 0").groupBy("k").agg(F.sum("own").alias("size"), F.count("*").alias("kinds")).collect():
        size[r.k] += r["size"]
        kinds[r.k] += r["kinds"]
    model = Model(words.total, words.distinct, cls, np.zeros((classes, classes)), size, kinds)
    texts = classed(numbers, placed, words, model)
    discard(placed), discard(numbers)
    g = _matrix(texts.filter("not held_out").select("classes"), np.arange(classes), classes, int(cls[0]))
    model.step = np.log10((g + 0.5) / (g.sum(axis=1, keepdims=True) + 0.5 * classes))
    return score(texts, model), model, words
