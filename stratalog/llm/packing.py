"""Packing documents into sequences of a token limit.

Documents become token ids; longer ones are cut so that all pieces but the
first are full. Full pieces are sequences of their own. The others are packed
best-fit decreasing within groups, then by a local search on underfull bins:
moves, one-for-one and two-for-one exchanges that raise the sum of squared
fills, until bins empty. What full bins do not hold is packed anew together with other
groups' leftovers, in ever fewer groups, to the last one.
"""

from __future__ import annotations

import bisect
import json
import re
import string
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import materialize

#: Pieces in a group: what one task packs at once.
GROUP = 20_000
#: Remembered words of an encoder.
_CACHE = 400_000
_RUN = re.compile(r" \s")
#: Runs of white space for which the fast encoder's pattern may run out of stack.
_LONG = re.compile(r"\s{256}")
_MARKS = "".join(c for c in string.punctuation if c != "'")  # an apostrophe may begin a contraction


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts, as little-endian 32-bit bytes, the end id last.

    Where the file is a byte-level BPE whose merges are in order of their ids,
    ids come from a merge-rank encoder over its vocabulary, which gives the
    same ids at a fraction of the time. Its pre-tokens never span a space that
    separates two non-space characters, so texts are encoded by chunks (a word
    with the space before it); the first chunks seen, which hold the frequent
    ones, are remembered. Texts with other white space after a space are
    encoded whole; those that hold a special token or 256 white-space
    characters in a row, and other kinds of file, go to the tokenizer itself.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tok, self.end, self.known, self.marks = Tokenizer.from_file(path), array("I", [end]).tobytes(), {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec)
        self.single = self.fast and self.fast._encode_single_piece

    @staticmethod
    def _ranks(spec: dict):
        import public_tokenizers
        import tiktoken

        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or spec.get("normalizer"):
            return None
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        if None in merged or merged != sorted(merged) or (merged and merged[0] < 256):
            return None
        ordinary = {k: v for k, v in vocab.items() if all(c in alphabet for c in k) and v < 256 + len(merged)}
        ranks = {bytes(alphabet[c] for c in k): v for k, v in ordinary.items()}
        return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, w: str) -> bytes:
        """Ids of a space and the word w. Letters, and the marks after them, are
        pre-tokens of their own; other words are cut by the pattern."""
        plain = w.rstrip(_MARKS)
        if not plain.isalpha():
            return array("I", self.fast.encode_ordinary(" " + w)).tobytes()
        ids = self.known.get(plain)
        if ids is None:
            ids = array("I", self.single(" " + plain)).tobytes()
        if len(plain) < len(w):
            marks = w[len(plain) :]
            more = self.marks.get(marks)
            if more is None:
                more = array("I", self.single(marks)).tobytes()
                if len(self.marks) < 10_000:
                    self.marks[marks] = more
            ids += more
        return ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for t in texts:
            if self.fast is None or any(s in t for s in self.special) or (len(t) >= 256 and _LONG.search(t)):
                out.append(self._slow(t) + self.end)
            elif t.startswith(" ") or t.endswith(" ") or _RUN.search(t):
                out.append(array("I", self.fast.encode_ordinary(t)).tobytes() + self.end)
            else:
                words = t.split(" ")
                first = words[0]
                parts = list(map(known.get, words))
                parts[0] = array("I", self.fast.encode_ordinary(first)).tobytes()  # no space before it
                if None in parts:
                    word, room = self._word, len(known) < _CACHE
                    for i, x in enumerate(parts):
                        if x is None:
                            w = words[i]
                            parts[i] = x = word(w)
                            if room and len(w) <= 64:
                                known[w] = x
                parts.append(self.end)
                out.append(b"".join(parts))
        return out


#: Encoders of this worker process, kept from task to task.
_ENCODERS: dict = {}


def encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def _pieces(path: str, end: int, limit: int, with_ids: bool):
    def run(batches):
        encode = encoder(path, end)
        for whole in batches:
            for s in range(0, whole.num_rows, 250):
                b = whole.slice(s, 250)
                keys, texts = b.column(0), [x or "" for x in b.column(1).to_pylist()]
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(encode(texts)):
                    n = len(raw) // 4
                    at, size, p = 0, n % limit or limit, 0
                    while at < n:
                        part = raw[4 * at : 4 * (at + size)]
                        row.append(i), piece.append(p), start.append(at), length.append(size), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                        at, size, p = at + size, limit, p + 1
                cols = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return run


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins (lists of indexes) by best-fit decreasing."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms: list[int] = []  # the rooms that some bin has, ascending
    for i in order:
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, limit - sizes[i]
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
            room -= sizes[i]
        if room:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append(b)
    return bins


def local_search(bins: list[list[int]], sizes: list[int], limit: int, width: int | None = 256) -> list[list[int]]:
    """Raise the sum of squared fills of underfull bins; empty bins go.

    The fullest underfull bin takes, from the ``width`` emptiest ones, an item
    that fits (move), a larger item for one of its own (one-for-one) or two
    items for one (two-for-one, where the one fits in place of the larger):
    the change that leaves it the least room. Items only pass from emptier to
    fuller bins, so every change raises the sum and no bin is ever added; a
    bin that nothing improves is done. ``width`` None looks at all bins.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    done = [b for b, f in zip(bins, fill) if f == limit]
    open_ = sorted(((f, list(b)) for b, f in zip(bins, fill) if f < limit), key=lambda x: x[0])
    while len(open_) > 1:
        f, target = open_.pop()
        near = open_[:width]
        fills = [x for x, _ in near]
        where = sorted((sizes[i], n, i) for n, (_, b) in enumerate(near) for i in b)
        only = [x[0] for x in where]
        changed = False
        while f < limit and where:
            room, best = limit - f, None
            at = bisect.bisect_right(only, room) - 1
            if at >= 0:
                best = (only[at], (at,), None)
            for size in sorted({sizes[i] for i in target}):
                if best and best[0] == room:
                    break
                at = bisect.bisect_right(only, room + size) - 1
                if at >= 0 and only[at] > size and (best is None or only[at] - size > best[0]):
                    best = (only[at] - size, (at,), size)
                lo, hi, want = 0, at, room + size
                while lo < hi:  # two items whose sum comes nearest to what fits
                    s = only[lo] + only[hi]
                    if s > want:
                        hi -= 1
                        continue
                    n = where[hi][1]
                    left = fills[n] - only[hi] - (only[lo] if where[lo][1] == n else 0)
                    if s > size and left + size <= limit and (best is None or s - size > best[0]):
                        best = (s - size, (lo, hi), size)
                    lo += 1
            if best is None:
                break
            gain, places, given = best
            home = where[places[-1]][1]
            for at in reversed(places):
                size, n, i = where.pop(at)
                only.pop(at)
                near[n][1].remove(i)
                fills[n] -= size
                target.append(i)
            if given is not None:
                j = next(i for i in target if sizes[i] == given)
                target.remove(j)
                near[home][1].append(j)
                fills[home] += given
                at = bisect.bisect_left(where, (given, home, j))
                where.insert(at, (given, home, j)), only.insert(at, given)
            f += gain
            changed = True
        done.append(target)
        if changed:
            open_ = sorted([(x, b) for x, (_, b) in zip(fills, near) if b] + open_[len(near) :], key=lambda x: x[0])
    return done + [b for _, b in open_]


def _pack_group(limit: int, last: bool, width: int | None):
    """Rows get their bin and place; in all but the last round those of the
    emptiest bins pass on with bin -1."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True]).reset_index(drop=True)
        sizes = pdf.length.tolist()
        bins = local_search(best_fit(sizes, limit), sizes, limit, width)
        fills = [sum(sizes[i] for i in b) for b in bins]
        under = sorted((n for n, f in enumerate(fills) if f < limit), key=lambda n: (-fills[n], n))
        passed, room = set(), sum(len(bins[n]) for n in under) // 2
        if not last:
            for n in under:
                room -= len(bins[n])
                if room < 0:
                    passed.add(n)
        bin_, offset = np.full(len(pdf), -1), np.zeros(len(pdf), np.int64)
        for n, b in enumerate(bins):
            if n not in passed:
                at = 0
                for i in b:
                    bin_[i], offset[i] = n, at
                    at += sizes[i]
        return pd.DataFrame({"row": pdf.row, "length": pdf.length, "g": key[0], "bin": bin_, "offset": offset})

    return run


def pack(docs: DataFrame, tokenizer: str, end: int, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, width: int | None = 256) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    and with ``with_ids`` the ids as little-endian 32-bit binary.

    A null or empty text is a document of the end id alone; texts of any length
    are encoded whole; repeated rows and rows with null ids are packed like
    others; only documents over the limit are cut. ``width`` bounds the bins
    that a step of the local search looks at (None: all of its group).
    Sequence ids are unique, not dense; no rows give no rows.
    """
    extra = ", ids binary" if with_ids else ""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    cut = rows.mapInArrow(_pieces(tokenizer, end, limit, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + extra)
    # written once, so that row numbers hold
    pieces = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == limit).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long")).drop("row")
    rest = pieces.filter(F.col("length") < limit).select("row", "length")
    placed, n, level = None, rest.count(), 0
    while True:
        groups = max(1, -(-n // GROUP))
        last = groups == 1
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int"))
        done = materialize(dealt.groupBy("g").applyInPandas(_pack_group(limit, last, width), "row long, length long, g int, bin long, offset long"), "placed")
        mine = done.filter("bin >= 0").select("row", ((F.lit(level).cast("long") * (1 << 56)) + F.col("g").cast("long") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
        placed = mine if placed is None else placed.union(mine)
        if last:
            break
        rest, level = done.filter("bin < 0").select("row", "length"), level + 1
        n = rest.count()
    part = pieces.filter(F.col("length") < limit).join(placed, "row").drop("row")
    return full.unionByName(part)
