"""Secret scans: patterns, and the guess cost of values in credential contexts.

Values that stand where a credential would (after a keyword, in a URL's user
part) are cut into words, dates, repeats, keyboard walks and brute-force
characters so that the product of the guesses for each part is least; a
dynamic program over the value's positions finds that segmentation. A value
that takes at least 10**GUESSES guesses is a secret.

A word costs its rank: in a vocabulary file of a public tokenizer, whose
numbers follow frequency, in the corpus itself (its most frequent words outside
credential contexts), and in a short list of words of passwords.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import discard, materialize

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more in all
HEX = re.compile(r"[0-9a-f]{32,}")
#: Places of credentials beyond the base patterns.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key|access[_-]?key|client[_-]?secret)"""
    r"""["']?\x20*(?::|=>?)\x20*["']?(?:bearer\x20+)?([^\s"'<>,;|&]{6,})|://[^\s:/@]+:([^\s/@]{6,})@""",
    re.I | re.A,
)
#: A call or an element by name: where the value is computed, not what it is.
CODE = re.compile(r"[$@]?[A-Za-z_][\w.:]*[(\[{].*|\$\{?\w+\}?|%\w+%", re.S)
GUESSES = 9.0
KINDS = ("assign", "access", "hex", "guess")
#: Frequent words of passwords, most frequent first.
WORDS = """password qwerty admin welcome login letmein dragon monkey master sunshine princess football shadow
michael superman batman trustno secret access test user guest root changeme default example hello love flower
summer winter spring autumn soccer hockey killer pepper ginger cookie cheese banana orange purple silver golden
freedom whatever computer internet service server system database token apikey public private key pass word none
null true false undefined placeholder redacted your here""".split()
#: The walks of a keyboard and of alphabets.
WALKS = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfv", "0123456789"]
_NEXT = {a + b for w in WALKS for x in (w, w[::-1]) for a, b in zip(x, x[1:])}
_LEET = str.maketrans("@4301!$57", "aaeoiisst")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)
_LETTERS = re.compile(r"[^\W\d_]{3,24}")


def vocabulary_words(path: str) -> list[str]:
    """Words of three letters and more of a byte-level tokenizer file, by their numbers."""
    from tokenizers import Tokenizer

    found = sorted(Tokenizer.from_file(path).get_vocab().items(), key=lambda x: x[1])
    words = (w.lstrip("\u0120").lower() for w, _ in found)
    return list(dict.fromkeys(w for w in words if len(w) >= 3 and w.isascii() and w.isalpha()))


def _brute(value: str) -> float:
    classes = [(r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[^0-9A-Za-z]", 33)]
    return math.log10(16 if re.fullmatch(r"[0-9a-f]+", value) else sum(n for p, n in classes if re.search(p, value)))


class Guesser:
    """Guess costs with words ranked by any of several lists."""

    def __init__(self, *ranked: list[str]):
        import ahocorasick

        rank: dict[str, int] = {}
        for words in (WORDS, *ranked):
            for i, w in enumerate(words):
                rank[w] = min(rank.get(w, i), i)
        self.words = ahocorasick.Automaton()
        for w, i in rank.items():
            self.words.add_word(w, (len(w), math.log10(i + 2)))
        self.words.make_automaton()

    def segments(self, value: str) -> tuple[float, list[tuple[str, int, int, float]]]:
        """log10 of the guesses of the cheapest segmentation, and its parts
        (kind, start, end, cost); 0 for an empty value.

        Near linear in the value's length: one pass of an automaton finds all
        words, and walks, repeats and dates are found once for each start.
        """
        n = len(value)
        low, plain = value.lower(), value.lower().translate(_LEET)
        if len(low) != n:  # letters that grow in lower case are none of the words'
            low = plain = "".join(c.lower() if c.isascii() else c for c in value)
        one = _brute(value) if value else 0.0
        ends: list[list[tuple[int, str, float]]] = [[] for _ in range(n)]  # parts by start: end, kind, cost
        double = math.log10(2)
        for text, more in ((low, 0.0), (plain, double)) if plain != low else ((low, 0.0),):
            for last, (size, cost) in self.words.iter(text):
                at = last + 1 - size
                ends[at].append((last + 1, "word", cost + more + (double if low[at : last + 1] != value[at : last + 1] else 0.0)))
        for m in _DATE.finditer(value):
            ends[m.start()].append((m.end(), "date", math.log10(366 * 120)))
        best: list[float] = [0.0] + [math.inf] * n
        back: list = [None] * (n + 1)
        walk = run = 0  # ends of the walk and of the repeat that the position is in

        def relax(i, j, kind, cost):
            if best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, (i, kind)

        for i in range(n):
            relax(i, i + 1, "brute", one)
            for j, kind, cost in ends[i]:
                relax(i, j, kind, cost)
            walk = max(walk, i + 1)
            while walk < n and low[walk - 1 : walk + 1] in _NEXT:
                walk += 1
            if walk - i >= 3:
                relax(i, walk, "walk", math.log10(2 * len(WALKS) * 10) + math.log10(walk - i))
            run = max(run, i + 1)
            while run < n and value[run] == value[i]:
                run += 1
            if run - i >= 3:
                relax(i, run, "repeat", one + math.log10(run - i))
            for size in (2, 3, 4):  # repeated blocks
                block = value[i : i + size]
                if value.startswith(block, i + size) and (i < size or value[i - size : i] != block):
                    j = i + size
                    while value.startswith(block, j):
                        j += size
                    if len(block) == size:
                        relax(i, j, "repeat", size * one + math.log10((j - i) // size))
        parts, j = [], n
        while j:
            i, kind = back[j]
            if kind == "brute" and parts and parts[-1][0] == "brute":
                parts[-1] = ("brute", i, parts[-1][2], best[parts[-1][2]] - best[i])
            else:
                parts.append((kind, i, j, best[j] - best[i]))
            j = i
        return best[n], parts[::-1]

    def cost(self, value: str) -> float:
        return self.segments(value)[0]


_GUESSERS: dict = {}


def guesser(path: str | None = None, learnt: tuple = ()) -> Guesser:
    """A guesser with the words of a vocabulary file (by default the public
    byte-level one) and those learnt from a corpus; kept in this process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    key = (path, hash(learnt))
    if key not in _GUESSERS:
        _GUESSERS.clear()
        _GUESSERS[key] = Guesser(vocabulary_words(path), list(learnt))
    return _GUESSERS[key]


def guess_cost(value: str) -> float:
    return guesser().cost(value)


def contexts(text: str) -> list[tuple[int, int]]:
    """Places of the values that stand where a credential would."""
    if ":" not in text and "=" not in text:
        return []
    return [m.span(1 if m[1] is not None else 2) for m in CONTEXT.finditer(text)]


def inspect(text: str, by: Guesser) -> tuple[list, list]:
    """Spans (kind, start, end, cost) by start, then kind, and all values in
    credential contexts (start, end, cost), those of base spans included. The
    base kinds first found stay, a guessed span joins where it reaches beyond
    each of them."""
    out, values = [], {}
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                values[m.span(2)] = by.cost(m[2])
                out.append(("assign", m.start(), m.end(), values[m.span(2)]))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), by.cost(m[0])) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), by.cost(m[0])) for m in HEX.finditer(text)]
    base = list(out)
    for s, e in contexts(text):
        if (s, e) not in values:
            values[s, e] = by.cost(text[s:e])
        if values[s, e] >= GUESSES and not any(x <= s and e <= y for _, x, y, _ in base) and not CODE.fullmatch(text, s, e):
            out.append(("guess", s, e, values[s, e]))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]))), sorted((*k, v) for k, v in values.items())


def spans(text: str, by: Guesser | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of a text."""
    return [x[:3] for x in inspect(text, by or guesser())[0]]


def _joined(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found)


def _count_words(batches):
    held: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for b in batches:
        for t in b.column(0).to_pylist():
            t, at, parts = t or "", 0, []
            for s, e in contexts(t):  # a secret that is often repeated is no word
                parts.append(t[at:s])
                at = e
            held.update(_LETTERS.findall(" ".join([*parts, t[at:]]).lower()))
            if len(held) > 200_000:
                yield rows()
    yield rows()


def learn_words(docs: DataFrame, text_col: str = "text", n_words: int = 50_000) -> tuple:
    """The most frequent words of all texts, at most n_words, most frequent first."""
    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")).filter("c >= 3")
    counts = materialize(counts, "secret-words")
    # words by the size of their counts, sixteen steps a doubling: a thousand rows at most
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    low, n = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        if n + r["count"] > n_words:
            break
        low, n = r.step, n + r["count"]
    top = counts.filter(step >= low).toArrow()
    discard(counts)
    return tuple(w for _, w in sorted(zip((-c for c in top.column("c").to_pylist()), top.column("word").to_pylist())))


_SPAN = "struct<kind string, start long, end long, cost double>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, n_words: int = 50_000) -> DataFrame:
    """Per row: doc_id, found (array of kind, start, end in code points, end
    exclusive, and log10 of the guesses), values (array of start, end, cost of
    all values in credential contexts), n_assign, n_access, n_hex, n_guess,
    base_sha256, spans.

    Words are learnt from all of docs (``n_words``; 0 learns none) beside the
    ``vocabulary`` file. A null or empty text has no spans; texts and values of
    any length are read whole; repeated rows, and rows with null ids, each give
    a row; other columns are ignored.
    """
    learnt = learn_words(docs, text_col, n_words) if n_words else ()
    shared = docs.sparkSession.sparkContext.broadcast(learnt)  # at most n_words words of at most 24 letters

    def run(batches):
        by = guesser(vocabulary, shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                both = [inspect(t or "", by) for t in b.column(1).to_pylist()]
                found, values = [x for x, _ in both], [v for _, v in both]
                base = [[x for x in f if x[0] != "guess"] for f in found]
                counts = [[sum(x[0] == k for x in f) for f in found] for k in KINDS]
                items = [[{"kind": k, "start": s, "end": e, "cost": c} for k, s, e, c in f] for f in found]
                costs = [[{"start": s, "end": e, "cost": c} for s, e, c in v] for v in values]
                place = [("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(items, pa.list_(pa.struct([("kind", pa.string()), *place]))), pa.array(costs, pa.list_(pa.struct(place))), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]), pa.array([_joined(x) for x in found])],
                    names=["doc_id", "found", "values", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, found array<{_SPAN}>, values array<struct<start long, end long, cost double>>, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
