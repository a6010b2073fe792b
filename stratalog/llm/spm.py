"""SentencePiece encoding and decoding by a Viterbi over an Aho-Corasick automaton.

The automaton holds every ordinary piece. One pass over a text follows it, and
at each position its output links give all pieces that end there, longest
first; each relaxes the best score at that position from the best at the
piece's start. Characters that no piece covers cost the unknown score and
become byte pieces. Of equal scores the longer last piece wins.

Pieces never hold a space mark after another character, nor a line feed (both
are checked when a model is loaded), so the best path is the concatenation of
the best paths of the spans between, and the first spans seen, which hold the frequent ones, are remembered.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "\u2581"
_CACHE = 200_000


class Model:
    """Pieces and scores of a SentencePiece model file with byte fallback,
    identity normalisation and a space before the first word; other files are
    refused."""

    #: What other normalisations would change: widths, ligatures, composed and
    #: repeated characters, cases, white space at the ends and within.
    PROBE = " \ufb01 \uff21\u2460  A e\u0301\u00e9 \u3000x\t "

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(self.PROBE) != SPACE + self.PROBE.replace(" ", SPACE):
            raise ValueError(f"{path}: texts would be normalised otherwise than by a space before them")
        self.score, self.byte_id, self.unk = [], {}, sp.unk_id()
        self.bytes_of: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        lowest, split = 0.0, True
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.score.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" \u2047 ".encode())
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.automaton.add_word(piece, (len(piece), i, sp.get_score(i)))
                    lowest = min(lowest, sp.get_score(i))
                    split = split and "\n" not in piece and SPACE not in piece.lstrip(SPACE)
        if len(self.byte_id) != 256:
            raise ValueError(f"{path}: no pieces for single bytes")
        self.automaton.make_automaton()
        self.unknown = lowest - 10
        self.spans = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if split else r"(?s).+")
        self.known: dict[str, bytes] = {}

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best segmentation of s (spaces already marked)."""
        n = len(s)
        best = [0.0] + [None] * n
        back = [None] * (n + 1)
        done = 0  # positions up to here are settled

        def unknown(upto):
            nonlocal done
            while done < upto:
                done += 1
                # a piece of one character at this place makes the unknown one needless
                if not single[done]:
                    c = best[done - 1] + self.unknown
                    if best[done] is None or c > best[done]:
                        best[done], back[done] = c, (1, None)

        single = bytearray(n + 1)
        for end, (size, i, score) in self.automaton.iter(s):
            unknown(end)
            if size == 1:
                single[end + 1] = 1
            c = best[end + 1 - size] + score
            if best[end + 1] is None or c > best[end + 1]:
                best[end + 1], back[end + 1] = c, (size, i)
        unknown(n)
        out, at = [], n
        while at:
            size, i = back[at]
            at -= size
            out.append(i) if i is not None else out.extend(self.byte_id.get(b, self.unk) for b in reversed(s[at].encode()))
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        known, parts = self.known, []
        for span in self.spans.findall(SPACE + text.replace(" ", SPACE)):
            ids = known.get(span)
            if ids is None:
                ids = np.array(self.viterbi(span), np.int32).tobytes()
                if len(span) <= 64 and len(known) < _CACHE:
                    known[span] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        """The text of ids: byte pieces join to characters, invalid ones become
        U+FFFD; the space before the first word goes. Exact for all texts but
        those that hold U+2581, which reads as a space."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


#: Models of this worker process, kept from task to task.
_MODELS: dict[str, Model] = {}


def load(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the piece ids of ``text_col`` as array<int> in ``ids_col``,
    their CRC-32 (little-endian 32-bit ids) in ``<ids_col>_crc32`` and in
    ``<ids_col>_exact`` whether they decode to the text.

    Null and empty texts have no ids. Other columns and all rows stay, columns
    of the added names, in either case of their letters, are replaced.
    """
    added = [ids_col, f"{ids_col}_crc32", f"{ids_col}_exact"]
    kept = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    rows = docs.select(*(f"`{c}`" for c in kept))
    schema = T.StructType([*rows.schema, T.StructField(added[0], T.ArrayType(T.IntegerType())), T.StructField(added[1], T.LongType()), T.StructField(added[2], T.BooleanType())])
    at = kept.index(text_col)

    def run(batches):
        m = load(model)
        for whole in batches:
            for s in range(0, whole.num_rows, 250):
                b = whole.slice(s, 250)
                texts = [x or "" for x in b.column(at).to_pylist()]
                ids = [m.encode(t) for t in texts]
                exact = [m.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array(exact, pa.bool_())], names=[*kept, *added])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of ``ids_col`` in ``text_col``; null ids give null."""
    kept = [c for c in rows.columns if c.lower() != text_col.lower()]
    part = rows.select(*(f"`{c}`" for c in kept))
    at = kept.index(ids_col)

    def run(batches):
        m = load(model)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*kept, text_col])

    return part.mapInArrow(run, T.StructType([*part.schema, T.StructField(text_col, T.StringType())]))
