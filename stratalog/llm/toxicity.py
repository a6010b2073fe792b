"""Toxicity by classifier chains.

Categories are predicted one after another by linear (logistic) models over
words, each by log2(1 + its count); each later model also sees the earlier categories'
probabilities. Those it is trained on are out-of-fold: a document's earlier
probabilities come from models that have not seen it.

The chain is fitted on at most ``max_train`` labelled documents (the ones of
smallest hash). Documents of the same words and counts are one, with the
majority's labels; likely near copies, those that share the words of smallest
checksum, are only kept in one fold. Each category's words are the ``n_words`` of highest chi-square.
The model is a few hundred words a category and weights; scoring is one pass over all texts.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import bytes_of, discard, materialize

FOLDS = 3
#: Chi-square from which a word counts as bound to a category.
CHI = 20.0
#: Letters by which longer words are also known.
STEM = 6
_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def _stem(w: bytes) -> bytes | None:
    """The first letters of a longer word, with a star."""
    if len(w) <= STEM:
        return None
    if w.isascii():
        return w[:STEM] + b"*"
    letters = w.decode("utf-8", "replace")
    return letters[:STEM].encode() + b"*" if len(letters) > STEM else None


def words(text: bytes) -> Counter:
    """Counts of words, A-Z in lower case, ASCII punctuation as white space, and
    of the first six letters of longer ones, for inflected and compound words."""
    found = Counter(text.translate(_BLANK).lower().split())
    for w, n in list(found.items()):
        if (s := _stem(w)) is not None:
            found[s] += n
    return found


@dataclass
class Chain:
    categories: list[str]
    words: dict[bytes, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)  # words, then earlier categories, then the intercept

    def _hits(self, text: bytes) -> dict[int, int]:
        """Counts, by number, of the model's words in a text: ``words`` without those unknown."""
        at, out = self.words, {}
        for w, n in Counter(text.translate(_BLANK).lower().split()).items():
            if w in at:
                out[at[w]] = n
            if (s := _stem(w)) is not None and (i := at.get(s)) is not None:
                out[i] = out.get(i, 0) + n
        return out

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, one column a category."""
        out = np.zeros((len(texts), len(self.categories)))
        hits = [(i, at, n) for i, t in enumerate(texts) for at, n in self._hits(t).items()]
        row, at, n = np.array(hits, np.int64).reshape(-1, 3).T
        much = np.log2(1 + n)
        for c, w in enumerate(self.weights):
            z = np.bincount(row, w[: len(self.words)][at] * much, len(texts)) + out[:, :c] @ w[len(self.words) : -1] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample_rows(n_labels):
    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 250):
                b = whole.slice(s, 250)
                found = [words(t) for t in bytes_of(b.column(0))]
                # near copies share the words of smallest checksum
                sketch = [b",".join(b"%08x" % x for x in sorted(zlib.crc32(w) for w in f)[:4]).decode() for f in found]
                kinds = [sorted(f) for f in found]
                counts = [[f[w] for w in k] for f, k in zip(found, kinds)]
                same = [hashlib.sha256(b" ".join(b"%b %d" % x for x in zip(k, c))).digest() for k, c in zip(kinds, counts)]
                cols = [pa.array(same), pa.array(sketch), pa.array(kinds, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32())), *b.columns[1:]]
                yield pa.RecordBatch.from_arrays(cols, names=["same", "sketch", "words", "n", *(f"y{i}" for i in range(n_labels))])

    return run


def _known(at: dict):
    """Of each row's words those of the model, by number, and their counts."""
    kinds = pa.array(list(at), pa.binary())

    def run(batches):
        for b in batches:
            words_, n = b.column(0), b.column(1)
            found = pc.index_in(words_.flatten(), value_set=kinds)
            known = found.is_valid()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(words_).to_numpy())[known.to_numpy(zero_copy_only=False)]
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            sides = [pa.ListArray.from_arrays(ends, x.filter(known)) for x in (found, n.flatten())]
            yield pa.RecordBatch.from_arrays([*sides, *b.columns[2:]], names=["at", "n", *b.schema.names[2:]])

    return run


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_train: int = 20_000, n_words: int = 256) -> Chain:
    """Fit the chain; ``labels`` has 0/1 columns named by ``categories``.

    Rows of labels with a null id or a null category are left out, repeated
    ones count once (the larger label); ids without a document are ignored. A
    category with one class only gets that class's rate as its probability; with no labelled
    documents every probability is 0.
    """
    chosen = (
        labels.filter(" and ".join(f"`{c}` is not null" for c in [id_col, *categories]))
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(*(F.max(F.col(f"`{c}`").cast("int")).alias(f"y{i}") for i, c in enumerate(categories)))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    )
    ys = [f"y{i}" for i in range(len(categories))]
    # at most max_train rows of a few bytes: bounded by that parameter
    text = docs.select(F.col(id_col).alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), "_id").select("_text", *ys)
    rows = text.mapInArrow(_sample_rows(len(ys)), "same binary, sketch string, words array<binary>, n array<int>, " + ", ".join(f"{y} int" for y in ys))
    sample = materialize(rows.groupBy("same").agg(F.first("sketch").alias("sketch"), F.first(F.struct("words", "n")).alias("t"), *(F.round(F.avg(y)).cast("int").alias(y) for y in ys)), "sample")
    total = sample.agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    chain = Chain(list(categories))
    if not total["n"]:
        chain.weights = [np.r_[np.zeros(i), -40.0] for i in range(len(ys))]
        return chain
    n = float(total["n"])
    seen = sample.select(F.explode("t.words").alias("w"), *ys).groupBy("w").agg(F.count("*").alias("d"), *(F.sum(y).alias(y) for y in ys)).filter("d >= 5")

    def chi(y):
        pos = float(total[y] or 0)
        if not 0 < pos < n:
            return F.lit(0.0)
        d, k = F.col("d").cast("double"), F.col(y).cast("double")
        return F.pow(k * n - d * pos, 2) / F.greatest(d * (n - d) * pos * (n - pos) / n, F.lit(1e-9))

    scored = seen.select("w", *(chi(y).alias(y) for y in ys))
    best = [[bytes(r.w) for r in scored.filter(F.col(y) >= CHI).orderBy(F.desc(y), "w").limit(n_words).select("w").collect()] for y in ys]
    for ws in best:
        for w in ws:
            chain.words.setdefault(w, len(chain.words))
    part = sample.select("t.words", "t.n", F.pmod(F.xxhash64("sketch"), F.lit(FOLDS)).alias("fold"), *ys)
    part = part.mapInArrow(_known(chain.words), "at array<int>, n array<int>, fold long, " + ", ".join(f"{y} int" for y in ys)).toArrow()
    x = np.zeros((part.num_rows, len(chain.words)))
    for i, (at, n) in enumerate(zip(part.column("at").to_pylist(), part.column("n").to_pylist())):
        x[i, at] = np.log2(1 + np.array(n))
    fold = part.column("fold").to_numpy()
    earlier = np.empty((len(x), 0))
    for y, own in zip(ys, best):
        mine = np.array([chain.words[w] for w in own], np.int64)  # a link sees the words of its category
        used = np.r_[mine, np.arange(x.shape[1], x.shape[1] + earlier.shape[1] + 1)]
        target = part.column(y).to_numpy().astype(float)
        z = np.hstack([x, earlier, np.ones((len(x), 1))])
        one_class = target.min() == target.max()
        z = z[:, used]
        w = np.r_[np.zeros(z.shape[1] - 1), 40.0 if target[0] else -40.0] if one_class else _logistic(z, target)
        whole = np.zeros(x.shape[1] + earlier.shape[1] + 1)
        whole[used] = w
        chain.weights.append(whole)
        out = np.empty(len(x))
        for f in range(FOLDS):
            held, rest = fold == f, fold != f
            wf = _logistic(z[rest], target[rest]) if rest.any() and target[rest].min() != target[rest].max() else w
            out[held] = 1 / (1 + np.exp(-np.clip(z[held] @ wf, -30, 30)))
        earlier = np.hstack([earlier, out[:, None]])
    discard(sample)
    return chain


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with a probability column ``p_<category>`` for each category.

    Null and empty texts get the chain's intercepts; columns of docs with the
    added names, in either case of their letters, are replaced; no row is
    dropped and none reordered.
    """
    added = [f"p_{c}" for c in chain.categories]
    kept = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    schema = docs.select(*(f"`{c}`" for c in kept)).schema
    for c in added:
        schema = schema.add(c, "double")
    at = kept.index(text_col)

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                p = chain.predict(bytes_of(b.column(at)))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in p.T)], names=[*kept, *added])

    return docs.select(*(f"`{c}`" for c in kept)).mapInArrow(run, schema)
