"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path; each is paired with the nearer, by the
path they share, of its two neighbours of the same host that have a different
text, for copies of a page share all their lines. The lines of both are aligned
by longest common subsequences, those of articles (article or main elements
outside any frame) with each other and all others with each other. Shared lines
go: they are the site's frame. What differencing alone gets wrong is corrected
in either direction. Two articles may hold one passage, so a line inside the
article goes only if more than half of the host's differing pages, five at
least, each share it with their neighbour; headings stay, and so do all lines
of an article that would lose most of its characters, a version of the others.
Lines in navigation, headers, footers, asides, forms and elements whose class
or id names a notice, an advert or comments go though no neighbour has them.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import discard, materialize

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*)|/)")
_QUOTE = re.compile(r"""["'>]""")
#: Elements whose content is not text.
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template textarea iframe svg math object select title head".split()}
#: Elements that break lines.
_BLOCKS = set("""address article aside blockquote body br button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search
section summary table tbody td tfoot th thead tr ul""".split())
_FRAME = set("nav header footer aside form menu button dialog fieldset search".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BODY = {"article", "main"}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|comments?|disqus|replies|reactions|sidebar|"
    r"nav\w*|menu|breadcrumbs?|footer|header|masthead|share|social|related|recommend\w*|pagination|widget|search|login|skip)(?:$|[\s_-])",
    re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|property)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
_SPACE = re.compile(r"\s+")
#: Elements that a start tag of the key ends where their own end tags are left out.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
_INLINE = set("a abbr b cite code em font i label mark q s small span strong sub sup u".split())
_HELD = _FRAME | _BODY | {"div", "section", "ul", "ol", "p", "span", "table"}
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Headings and other lines inside the article, lines elsewhere, in the page's frame; an inline element of the frame, whose text leaves its line.
TITLE, KEPT, OPEN, FRAME, MUTE = 2, 1, 0, -1, -2


def _tag_end(html: str, at: int) -> int:
    """The place of the > that ends a tag, quoted ones passed over; the length if none does."""
    while m := _QUOTE.search(html, at):
        if m[0] == ">":
            return m.start()
        close = html.find(m[0], m.end())
        if close < 0:  # the quote is never closed: it is a mere character
            at = html.find(">", m.end())
            return at if at >= 0 else len(html)
        at = close + 1
    return len(html)


def lines(html: str) -> list[tuple[str, int]]:
    """Text lines of a page in order, each with what its structure says. Time
    is linear in the page: every character is passed once, whatever the markup."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, str]] = []  # name, state and frame around the element
    known: Counter = Counter()  # names on the stack
    state = label = OPEN  # here, and of the line begun
    frame = ""  # the element that began the frame
    heading = False
    lost = set()  # raw elements that no end tag closes any more

    def close():
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, label))

    def add(text):
        nonlocal label
        if text and state != MUTE:
            if not parts:
                label = TITLE if heading and state == KEPT else state
            parts.append(text)

    def leave(i):
        nonlocal state, frame
        state, frame = stack[i][1:]
        for s in stack[i:]:
            known[s[0]] -= 1
        del stack[i:]

    at, size = 0, len(html)
    while m := _START.search(html, at):
        begin = m.start()
        add(html[at:begin])
        if m[1]:
            end = html.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        name = m[4] and m[4].lower()
        if not name:
            end = html.find(">", m.end())
            at = size if end < 0 else end + 1
            continue
        end = _tag_end(html, m.end())
        at = end + 1
        if end == size:  # a page may end inside a tag
            break
        if not m[3] and name in _RAW and name not in lost:
            if found := _RAW[name].search(html, at):
                at = found.end()
            elif name == "head":
                lost.add(name)
            else:
                at = size
            if name not in lost:
                if name in ("title", "textarea", "select", "iframe"):
                    close()
                continue
        attributes = html[m.end() : end]
        if name in _BLOCKS:
            close()
            if name in _HEADINGS:
                heading = not m[3]
        if m[3]:
            if known[name] > 0:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
        elif name not in _VOID and not attributes.endswith("/"):
            ends = _ENDS.get(name, set()) | ({"p"} if name in _BLOCKS else set())
            i = len(stack) - 1
            while i >= 0 and any(known[e] > 0 for e in ends) and (stack[i][0] in ends or stack[i][0] in _INLINE):
                if stack[i][0] in ends:
                    leave(i)
                elif stack[i][1] != state:  # an inline frame holds what is in it
                    break
                i -= 1
            new, by = state, frame
            if name in _BODY:
                if state == FRAME:  # a teaser or a comment; but a form or a named element may be the page's wrapper
                    new = OPEN if frame == "form" or name == "main" and frame not in _FRAME else FRAME
                elif state == OPEN and not any(known[b] > 0 for b in _BODY):
                    new = KEPT
            elif state not in (FRAME, MUTE):
                inside = state == KEPT
                if name in _FRAME and not (inside and name == "header"):
                    new = FRAME
                elif attributes and name not in ("body", "html"):
                    for key, value in _ATTR.findall(attributes):
                        value = value.strip("\"'")
                        if (value.lower() in _ROLES) if key.lower() == "role" else key.lower() in ("class", "id") and _NAMED.search(value):
                            new = FRAME if name in _BLOCKS else MUTE
            if new == FRAME and state != FRAME:
                by = name
            if new != state or name in _HELD or name in _ENDS:
                stack.append((name, state, frame))
                known[name] += 1
            state, frame = new, by
    else:
        add(html[at:])
    close()
    return out


def _lengths(a: list[str], masks: dict[str, int], m: int):
    """After each of a: the bits of b at which the common subsequence does not grow."""
    v = full = (1 << m) - 1
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _masks(b: list[str]) -> dict[str, int]:
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    out = {}
    for x, at in where.items():
        bits = np.zeros(len(b), np.uint8)
        bits[at] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _growth(v: int, m: int) -> np.ndarray:
    """Lengths of the common subsequence with each prefix of b."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-m // 8), "little"), np.uint8), bitorder="little")[:m]
    return np.r_[0, np.cumsum(bits == 0)]


#: Bits of a table of shared() that is held at once (8 MB).
TABLE = 1 << 26


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indexes of a in a longest common subsequence of a and b: bit-parallel,
    64 lines an operation; where the table would be large, a is halved and b cut
    where the halves' lengths sum to the most."""
    out: set[int] = set()
    work = [(0, len(a), 0, len(b))]
    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.add(n)
        if i >= n or j >= m:
            continue
        x, y = a[i:n], b[j:m]
        if len(x) * len(y) > TABLE and len(x) > 1:
            half, v = len(x) // 2, 0
            for v in _lengths(x[:half], _masks(y), len(y)):
                pass
            w = 0
            for w in _lengths(x[half:][::-1], _masks(y[::-1]), len(y)):
                pass
            cut = int(np.argmax(_growth(v, len(y)) + _growth(w, len(y))[::-1]))
            work += [(i, i + half, j, j + cut), (i + half, n, j + cut, m)]
            continue
        table = list(_lengths(x, _masks(y), len(y)))
        row, col = len(x), len(y)
        while row and col:
            if table[row - 1] >> (col - 1) & 1:
                col -= 1
            else:
                row -= 1
                if not row or table[row - 1] >> (col - 1) & 1:
                    out.add(i + row)
                    col -= 1
    return out


def _common(mine: list[tuple[int, int]], theirs: list[int]) -> list[tuple[int, int]]:
    """What a longest common subsequence holds of mine (place, name), found on the names that both have."""
    there = set(theirs)
    x = [e for e in mine if e[1] in there]
    here = {name for _, name in x}
    return [x[k] for k in sorted(shared([name for _, name in x], [name for name in theirs if name in here]))] if x else []


def differ(own: list[tuple[int, int]], other: list[tuple[int, int]]) -> tuple[list, list]:
    """Lines (name, state) that a page shares with its neighbour, as (place, name):
    those outside the article, and those of the article other than headings.
    Places count the lines outside the frame."""
    seen = [e for e in own if e[1] != FRAME]
    gone = _common([(i, x) for i, (x, s) in enumerate(seen) if s == OPEN], [x for x, s in other if s < KEPT])
    held = _common([(i, x) for i, (x, s) in enumerate(seen) if s >= KEPT], [x for x, s in other if s >= KEPT])
    return gone, [e for e in held if seen[e[0]][1] == KEPT]


def main_text(texts: list[str], states: list[int], drop: list[int]) -> str:
    """Lines outside the frame less the dropped ones; an article that would lose most of its characters stays whole."""
    body = sum(len(t) for t, s in zip(texts, states) if s >= KEPT)
    whole = 2 * sum(len(texts[i]) for i in drop if states[i] >= KEPT) > body
    gone = {i for i in drop if states[i] == OPEN or not whole}
    return "\n".join(t for i, t in enumerate(texts) if i not in gone)


_PARSED = "page_id long, url string, host string, path string, text string, lines array<string>, states array<tinyint>, names array<long>"


def _parse(batches):
    """Each page's lines outside the frame, and the states and names (XXH64) of
    all its lines; ``text`` names those outside the frame (null without any)."""
    for whole in batches:
        for s in range(0, whole.num_rows, 250):
            b = whole.slice(s, 250)
            found = [lines(h or "") for h in b.column(4).to_pylist()]
            seen = [[t for t, s in f if s != FRAME] for f in found]
            names = [xxhash.xxh128_hexdigest("\n".join(t)) if t else None for t in seen]
            marks = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(names, pa.string()), pa.array(seen, pa.list_(pa.string())),
                 pa.array([[s for _, s in f] for f in found], pa.list_(pa.int8())), pa.array(marks, pa.list_(pa.int64()))],
                names=[c.split(" ")[0] for c in _PARSED.split(", ")],
            )


_ORDER = ["host", "path", "page_id", "row"]


def _runs(pdf: pd.DataFrame):
    """Rows in order, and the numbers of their runs of one host and text."""
    pdf = pdf.sort_values(_ORDER, na_position="first", ignore_index=True)
    new = (pdf.host != pdf.host.shift()) | (pdf.text != pdf.text.shift())
    return pdf, np.cumsum(new.to_numpy()) - 1


def _place(pdf, i):
    return [pdf.host[i], pdf.text[i], int(pdf.row[i]), pdf.path[i]]


def _edges(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A range's first and last row, and those beyond the runs of the two."""
    pdf, run = _runs(pdf)
    inner = [int(np.searchsorted(run, 1)), int(np.searchsorted(run, run[-1])) - 1]
    at = [0, inner[0] if run[-1] else -1, inner[1] if run[-1] else -1, len(pdf) - 1]
    rows = [[k, key[0], *(_place(pdf, i) if i >= 0 else [None] * 4)] for k, i in enumerate(at)]
    return pd.DataFrame(rows, columns=["k", "part", "host", "text", "row", "path"])


def _beyond(parts: list[int], edges: dict, step: int) -> dict:
    """For each range the nearest row of another text before (step -1) or after
    its edge's run, if it is of the same host."""
    first, next_, last = (3, 2, 0) if step < 0 else (0, 1, 3)
    out = {}
    for n, p in enumerate(parts):
        host, text = edges[p, last][:2]
        at = n + step
        while 0 <= at < len(parts):
            near, after = edges[parts[at], first], edges[parts[at], next_]
            if near[0] != host:
                break
            if near[1] != text:
                out[p] = near
                break
            if after is not None:  # the run goes on and ends there
                if after[0] == host:
                    out[p] = after
                break
            at += step
    return out


def _nearest(before: dict, after: dict):
    def close(path, other):
        """The length of the path that two pages share, by segments."""
        n = 0
        for x, y in zip((path or "").split("/"), (other or "").split("/")):
            if x != y:
                break
            n += 1
        return n

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, of = _runs(pdf)
        start = np.searchsorted(of, np.arange(of[-1] + 2))
        rows, others = [], []
        for i in range(len(pdf)):
            low, high = start[of[i]] - 1, start[of[i] + 1]
            a = _place(pdf, low) if low >= 0 else before.get(key[0])
            b = _place(pdf, high) if high < len(pdf) else after.get(key[0])
            near = [x for x in (a, b) if x is not None and x[0] == pdf.host[i]]
            if near:
                rows.append(pdf.row[i]), others.append(max(near, key=lambda x: close(pdf.path[i], x[3]))[2])
        return pd.DataFrame({"row": np.array(rows, np.int64), "other": np.array(others, np.int64)})

    return run


#: Pages (without their lines) that one task orders.
RANGE = 200_000


def neighbours(parsed: DataFrame) -> DataFrame:
    """(row, other) of the pages with lines outside the frame: the nearest page
    of the host with another text, the one before of two as near.

    Only hosts, paths and names of texts are ordered, in ranges; what lies
    beyond a range's edge comes from a summary of four rows a range.
    """
    able = parsed.filter("host <> '' and text is not null").select(*_ORDER, "text")
    n = max(1, -(-able.count() // RANGE))
    dealt = materialize(able.repartitionByRange(n, *_ORDER).withColumn("part", F.spark_partition_id()), "order")
    edges = {(r.part, r.k): None if r.row is None else [r.host, r.text, r.row, r.path] for r in dealt.groupBy("part").applyInPandas(_edges, "k int, part int, host string, text string, row long, path string").collect()}
    parts = sorted({p for p, _ in edges})
    return dealt.groupBy("part").applyInPandas(_nearest(_beyond(parts, edges, -1), _beyond(parts, edges, 1)), "row long, other long")


def _differences(batches):
    for whole in batches:
        for s in range(0, whole.num_rows, 250):
            b = whole.slice(s, 250)
            found = [differ(list(zip(*own)), list(zip(*other))) for own, other in zip(zip(*(b.column(i).to_pylist() for i in (3, 4))), zip(*(b.column(i).to_pylist() for i in (5, 6))))]
            places, names = pa.list_(pa.int32()), pa.list_(pa.int64())
            out = pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), pa.array([[i for i, _ in g] for g, _ in found], places), pa.array([[i for i, _ in h] for _, h in found], places), pa.array([[x for _, x in h] for _, h in found], names)],
                names=["row", "host", "text", "gone", "held", "names"],
            )
            yield out.filter(pa.array([bool(g or h) for g, h in found], pa.bool_()))


#: Differing pages of a host that must share a line of their articles before it can be frame.
TEXTS = 5


def dropped(parsed: DataFrame) -> DataFrame:
    """(row, gone, frame) of the pages that lose lines: the places of those shared
    with the neighbour outside the article, and of those in the article that
    most of the host's pages share with theirs."""
    pairs = materialize(neighbours(parsed), "pairs")
    own = parsed.select("row", "host", "text", "names", "states")
    other = parsed.select(F.col("row").alias("other"), F.col("names").alias("l"), F.col("states").alias("s"))
    met = own.join(pairs, "row").join(other, "other").select("row", "host", "text", "names", "states", "l", "s")
    found = materialize(met.mapInArrow(_differences, "row long, host string, text string, gone array<int>, held array<int>, names array<long>"), "shared")
    discard(pairs)
    held = found.select("row", "host", "text", F.explode(F.arrays_zip("held", "names")).alias("e")).select("row", "host", "text", F.col("e.held").alias("at"), F.col("e.names").alias("name"))
    n = held.select("host", "name", "text").distinct().groupBy("host", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= TEXTS)
    texts = parsed.filter("host <> '' and text is not null").select("host", "text").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    frames = materialize(n.join(texts, "host").filter("2 * n > texts").select("host", "name"), "frames")
    frame = held.join(frames, ["host", "name"], "left_semi").groupBy("row").agg(F.collect_list("at").alias("frame"))
    return found.select("row", "gone").join(frame, "row", "left").filter("size(gone) > 0 or frame is not null")


def _texts(batches):
    for whole in batches:
        for s in range(0, whole.num_rows, 250):
            b = whole.slice(s, 250)
            columns = [b.column(i).to_pylist() for i in range(2, 6)]
            texts = [main_text(t, [x for x in states if x != FRAME], (gone or []) + (frame or [])) for t, states, gone, frame in zip(*columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null and empty pages have an empty text; pages without a host (or a null
    URL), and those of a host whose pages all have one text, have no neighbour
    and are judged by structure alone; repeated rows give repeated rows; pages of any length and
    markup are read whole in linear time; other columns are ignored. Pages are
    ordered by ranges of host and path, so a host of any size spreads over
    tasks, and the result does not depend on how many there are.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.col(f"`{html_col}`").alias("html"),
    )
    parsed = materialize(rows.mapInArrow(_parse, _PARSED).withColumn("row", F.monotonically_increasing_id()), "lines")
    drop = materialize(dropped(parsed), "dropped")
    return parsed.select("page_id", "url", "lines", "states", "row").join(drop, "row", "left").select("page_id", "url", "lines", "states", "gone", "frame").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
