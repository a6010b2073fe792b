"""Surrogates for personal data, in DataFrame expressions only.

Detected entities (e-mail and IP addresses, card, phone, social-security and
bank account numbers, names) get replacements drawn from a keyed hash of their
canonical form, so one entity has one surrogate everywhere. Numbers keep their
digits' places and separators, country code and (if it held) the Luhn check;
letters keep case; names keep script and, where a title or a given name tells
it, gender.

Names are found after a title or where a given name (``given``, a parameter)
is followed by a capitalised word. Each of their words is an entity of its own:
it has one surrogate in all names, and in a text that names a person the
person's first or last name alone is replaced by the same word.

A corpus-wide check finds surrogates that two entities share or that are
another entity's own text, and draws those anew, longer from try to try: a
shape that is full (two-letter addresses, say) gets room.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import discard, materialize, unused

_L = r"\p{L}\p{N}_.+-"
_MALE = ["Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин", "господин", "г-н"]
_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "госпожа", "г-жа"]
_NEUTRAL = ["Dr", "Prof", "Professor", "Doctor"]
#: Frequent given names; ``replace`` takes others.
MALE = tuple("""James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew
Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Peter Henry
Hans Jürgen Klaus Wolfgang Heinz Werner Günter Dieter Jean Pierre Jacques Michel Philippe Alain François Antonio José Manuel Juan Luis Carlos Javier Miguel
Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир""".split())  # fmt: skip
FEMALE = tuple("""Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Ashley Emily Donna
Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Anna Jane Emma Alice Julia
Ursula Monika Renate Sabine Petra Gisela Helga Marie Nathalie Isabelle Sylvie Catherine Françoise Monique María Carmen Ana Isabel Dolores Pilar Lucía
Мария Елена Ольга Наталья Екатерина Татьяна Ирина Светлана""".split())  # fmt: skip
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: A further word of a name, and initials before it.
_MORE = rf"(?:(?: \p{{Lu}}\.){{0,2}} {_WORD})"

_IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
_CARD = r"(?<![\d+])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_HEXES = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
#: All eight groups, or some and a double colon among them; with a digit, and no mere pair of short words.
_IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?=[0-9A-Fa-f:]*\d)(?=(?:[0-9A-Fa-f]*:){{3}}|[0-9A-Fa-f]{{3,4}}::){_HEXES}::(?:{_HEXES})?)(?![\p{{L}}\p{{N}}:])"
#: Where a number after a country code is over: another entity begins.
_NEXT = rf"(?!{_IP}|{_CARD}|{_SSN})"
_INTERNATIONAL = rf"\+\d[\d ().-]{{5}}(?:{_NEXT}[\d ().-]){{1,13}}{_NEXT}\d"
#: (212) 555-1234; 212-555-1234; 06 12 34 56 78; 030 1234567 and 020 7946 0958; 8 (495) 123-45-67.
_NATIONAL = r"\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d(?:[ .-]\d\d){4}|0\d{2,4}[ /]\d{3,8}(?:[ -]\d{3,4})?|8 ?\(\d{3}\) ?\d{3}-\d\d-\d\d"

#: Kind -> pattern, in order of precedence. Groups that may repeat without
#: bound are possessive: the matcher keeps no way back, nor stack, for them.
PATTERNS = {
    "email": rf"(?<![{_L}])[{_L}]++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++",
    "ip": _IP,
    "ip6": _IP6,
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": _CARD,
    "ssn": _SSN,
    "phone": rf"(?<![\p{{L}}\d])(?:{_INTERNATIONAL}|{_NATIONAL})(?!\d)",
}
_TITLE = "|".join(sorted(_MALE + _FEMALE + _NEUTRAL, key=len, reverse=True))
_NUMBERS = "|".join(PATTERNS[k] for k in ("ip", "card", "ssn", "phone"))
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
KEY_CONF = "stratalog.surrogate.key"


def session_key(spark: SparkSession) -> str:
    """The secret of the session (``stratalog.surrogate.key``): who holds it can
    redo the mapping. Unset, a random one is drawn for the session's life."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = uuid.uuid4().hex + uuid.uuid4().hex
        spark.conf.set(KEY_CONF, key)
    return key


def _trie(words) -> str:
    """A pattern for any of the words that looks at each character once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def show(at):
        ways = [c + show(at[c]) for c in sorted(at) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)}){'?+' if '' in at else ''}" if len(ways) > 1 or "" in at else ways[0]

    return show(tree)


class Names:
    """Patterns of names, and those of all entities with them."""

    def __init__(self, male=MALE, female=FEMALE):
        self.male, self.female = tuple(male), tuple(female)
        given = rf"(?<![\p{{L}}\p{{N}}])(?:{_trie([*male, *female])})(?![\p{{L}}\p{{N}}-])" if male or female else r"(?!)"
        titled = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?(?: \p{{Lu}}\.){{0,2}} {_WORD}{_MORE}{{0,2}}"
        full = rf"{given}{_MORE}{{1,2}}"
        initial = "[" + "".join(sorted({t[0] for t in _MALE + _FEMALE + _NEUTRAL})) + "]"
        self.name = rf"(?={initial})(?:{titled})|(?=\p{{Lu}})(?:{full})"
        #: All entities; a look at the first character passes over most places.
        self.any = rf"(?:{PATTERNS['email']})|(?:{PATTERNS['ip6']})|(?=[\d+(])(?:{_NUMBERS})|(?=[A-Z])(?:{PATTERNS['iban']})|{self.name}"
        #: What a text must hold for any pattern to match: most texts are passed over at this price.
        self.hint = rf"[@\d]|::|(?={initial})(?:{_TITLE})\.? \p{{Lu}}|(?=\p{{Lu}}){given} \p{{Lu}}"


def _kind(m: Column) -> Column:
    anchored = [(k, m.rlike(rf"^(?:{p})$")) for k, p in PATTERNS.items()]
    return reduce(lambda rest, kp: F.when(kp[1], F.lit(kp[0])).otherwise(rest), reversed(anchored), F.lit("name"))


def _letters(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def _byte(h: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal digest, from the start again after the last."""
    return F.conv(F.substring(h, F.pmod(i, F.lit(32)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _hash(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))


def _same_shape(m: Column, kind: Column, h: Column) -> Column:
    """Each letter and digit of m by another of its kind; the rest stays. The
    n-th letter or digit takes the n-th byte, whatever stands between; in
    addresses, which are written in one way and may be long, the place counts."""
    code = F.length(F.regexp_extract(m, r"^\+\d{1,3}(?=\D)", 0))

    def one(c: Column, i: Column) -> Column:
        k = _byte(h, F.when(kind.isin("email", "ip6"), i + 1).otherwise(F.length(_letters(F.substring(m, F.lit(1), i + 1)))))
        return (
            F.when(i < code, c).when(c.rlike("[0-9]"), F.pmod(c.cast("int") + k, F.lit(10)).cast("string"))
            .when((kind == "ip6") & c.rlike("[A-Fa-f]"), F.when(c.rlike("[A-F]"), _pick("ABCDEF", k)).otherwise(_pick("abcdef", k)))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), F.upper(_pick(_CYRILLIC, k))).otherwise(_pick(_CYRILLIC, k)))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", k)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _invented(word: Column, kind: Column, h: Column, attempt: Column) -> Column:
    """A word of syllables in the word's script, its ending by kind."""
    cyrillic = word.rlike(r"\p{IsCyrillic}")
    n = F.lit(3) + attempt
    latin = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(_pick("bdfgklmnprstv", _byte(h, i * 2)), _pick("aeiou", _byte(h, i * 2 + 1))))
    slavic = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(_pick("бвгдклмнпрст", _byte(h, i * 2)), _pick("аеиоу", _byte(h, i * 2 + 1))))
    ends = {"first_f": ("на", "na"), "first_m": ("р", "r"), "first": ("й", "l")}
    end = reduce(lambda rest, k: F.when(kind == k, F.when(cyrillic, F.lit(ends[k][0])).otherwise(F.lit(ends[k][1]))).otherwise(rest), ends, F.when(cyrillic, F.lit("в")).otherwise(F.lit("s")))
    return F.initcap(F.concat(F.array_join(F.when(cyrillic, slavic).otherwise(latin), ""), end))


def _canonical(m: Column, kind: Column) -> Column:
    """What tells entities apart: kind and letters, digits without separators."""
    return F.concat_ws(":", kind, F.when(kind.isin("email", "ip", "ip6") | kind.startswith("first") | (kind == "last"), F.lower(m)).otherwise(_letters(F.upper(m))))


def _atoms(m: Column, kind: Column, roles: Column, names: Names) -> Column:
    """(title, parts) of a match: parts are the entities in it, (m, kind, canon);
    a name's words are entities each, another match is one."""
    title = F.when(kind == "name", F.regexp_extract(m, rf"^(?:{_TITLE})\.? (?=\p{{Lu}})", 0)).otherwise(F.lit(""))

    def words(title):
        tokens = F.split(F.substring(m, F.length(title) + 1, F.length(m)), " ")
        called = F.regexp_extract(title, r"^[^. ]+", 0)
        first = tokens[0]
        gender = F.when(called.isin(_FEMALE) | (~called.isin(_MALE) & first.isin(*names.female)), F.lit("first_f")).when(called.isin(_MALE) | first.isin(*names.male), F.lit("first_m")).otherwise(F.lit("first"))
        last = F.size(tokens) - 1
        known = F.try_element_at(roles, m)  # of a word that stands alone
        return F.when(last == 0, F.array(F.struct(tokens[0].alias("m"), F.when(title == "", F.coalesce(known, F.lit("last"))).otherwise(F.lit("last")).alias("kind")))).otherwise(
            F.transform(tokens, lambda t, i: F.struct(t.alias("m"), F.when(t.endswith("."), F.lit("initial")).when(i == last, F.lit("last")).otherwise(gender).alias("kind")))
        )

    parts = F.when(kind == "name", words(title)).otherwise(F.array(F.struct(m.alias("m"), kind.alias("kind"))))
    return F.struct(title.alias("title"), F.transform(parts, lambda p: F.struct(p.m.alias("m"), p.kind.alias("kind"), _canonical(p.m, p.kind).alias("canon"))).alias("parts"))


def entities(found: Column, roles: Column, names: Names) -> Column:
    """Matches as array of (title, parts). Each step adds one field, so that
    nothing is computed twice."""
    kinds = F.transform(found, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    return F.transform(kinds, lambda e: _atoms(e.m, e.kind, roles, names))


def surrogates(parts: Column, key: str, attempt) -> Column:
    """The replacements of entities (m, kind, canon); attempt: a function of an entity's canon."""

    def keep(e, *names):
        return [e[n].alias(n) for n in names]

    tried = F.transform(parts, lambda e: F.struct(*keep(e, "m", "kind", "canon"), attempt(e.canon).alias("attempt")))
    hashed = F.transform(tried, lambda e: F.struct(*keep(e, "m", "kind", "attempt"), _hash(key, e.kind, e.canon, e.attempt).alias("h")))

    def word(e):
        return e.kind.startswith("first") | (e.kind == "last")

    shaped = F.transform(hashed, lambda e: F.struct(*keep(e, "m", "kind", "attempt", "h"), F.when(word(e), _invented(e.m, e.kind, e.h, e.attempt)).otherwise(_same_shape(e.m, e.kind, e.h)).alias("s")))

    def final(e):
        tld = F.regexp_extract(e.m, r"\.[^.]+$", 0)
        longer = F.greatest(e.attempt - 3, F.lit(0))  # a full shape gets room
        letters = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(longer, F.lit(1))), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", _byte(e.h, i * 3))), "")
        digits = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(longer, F.lit(1))), lambda i: _pick("0123456789", _byte(e.h, i * 3))), "")
        mail = F.concat(F.when(longer > 0, letters).otherwise(F.lit("")), F.substring(e.s, F.lit(1), F.length(e.m) - F.length(tld)), tld)
        number = F.when(longer > 0, F.concat(e.s, digits)).otherwise(e.s)
        checked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.regexp_replace(number, r"\d$", ""), d.cast("string"))), lambda x: F.call_function("luhn_check", _letters(x)))[0]
        return (
            F.when(word(e) | (e.kind == "initial"), e.s).when(e.kind == "email", mail)
            .when(e.kind == "ip", F.concat_ws(".", *((F.pmod(_byte(e.h, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)))).when(e.kind == "ip6", e.s)
            .when((e.kind == "card") & F.call_function("luhn_check", _letters(e.m)), checked).otherwise(number)
        )

    return F.transform(shaped, final)


def _redrawn(found: DataFrame, key: str) -> DataFrame | None:
    """(canon, attempt) of the entities whose first surrogate collides; None if there are none.

    found: (e: struct of m, kind, canon), one row for each canon. Of the
    entities that share a surrogate the one settled first, then the smallest,
    keeps it; one that equals an entity of the corpus goes. Only those that go
    are drawn anew, and looked up among those settled.
    """

    def drawn(rows, name):
        new = surrogates(F.array("e"), key, lambda _: F.col("attempt"))
        as_entity = _canonical(new[0], F.col("e.kind"))
        return materialize(rows.select("e", "attempt", F.col("e.canon").alias("canon"), as_entity.alias("s")), name)

    fresh = drawn(found.filter("e.kind <> 'initial'").withColumn("attempt", F.lit(0)), "entities")
    canons = fresh.select(F.col("canon").alias("s"))
    settled, moved, held = None, None, [fresh]
    while True:
        owner = fresh.groupBy("s").agg(F.min("canon").alias("o"), F.count("*").alias("n"))
        bad = fresh.join(owner.filter("n > 1"), "s").filter("canon <> o").select("canon").union(fresh.join(canons, "s", "left_semi").select("canon"))
        if settled is not None:
            bad = bad.union(fresh.join(settled, "s", "left_semi").select("canon"))
        bad = bad.distinct()
        again = materialize(fresh.join(bad, "canon", "left_semi").select("e", (F.col("attempt") + 1).alias("attempt")), "again")
        held.append(again)
        done = fresh.join(bad, "canon", "left_anti")
        settled = done.select("s") if settled is None else settled.union(done.select("s"))
        late = done.filter("attempt > 0").select("canon", "attempt")
        moved = late if moved is None else moved.union(late)
        if again.isEmpty():
            break
        fresh = drawn(again, "entities")
        held.append(fresh)
    if len(held) == 2:
        for t in held:
            discard(t)
        return None
    moved = materialize(moved, "moved")
    for t in held:
        discard(t)
    return moved


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, male=MALE, female=FEMALE) -> DataFrame:
    """docs with every detected entity of ``text_col`` replaced.

    ``key`` is the caller's secret: the mapping follows from it. All columns,
    rows and their order of columns stay, a null text stays null and an empty
    one empty; equal rows get equal results; texts of any length, and entities
    of any length in them, are read whole; ``count_col`` names an added column
    with the number of entities replaced. Texts are matched twice, once to
    check all surrogates against each other and once to write; without
    collisions (see ``_redrawn``) they are never shuffled.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    names = Names(male, female)
    text = F.col(f"`{text_col}`")
    none = F.array().cast("array<string>")
    found_, text_, hash_, tries_, roles_, pattern_ = (unused(docs, n) for n in ("_m", "_t", "_h", "_a", "_r", "_p"))

    def matched(df):
        """df with its texts' pattern and entities. In a text with names, their words alone are entities as well."""
        no_roles = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
        named = F.when(text.rlike(names.hint), F.filter(F.regexp_extract_all(text, F.lit(names.name), F.lit(0)), lambda m: F.length(m) > 0)).otherwise(none)
        parts = F.filter(F.flatten(F.transform(F.transform(named, lambda m: _atoms(m, F.lit("name"), no_roles, names)), lambda e: e.parts)), lambda p: p.kind != "initial")
        # a word's first role counts
        df = df.withColumn(roles_, F.transform(parts, lambda p: F.struct(p.m.alias("key"), p.kind.alias("value"))))
        r = F.col(roles_)
        words = F.array_distinct(F.transform(r, lambda p: p.key))
        roles = F.map_from_entries(F.transform(words, lambda w: F.struct(w.alias("key"), F.filter(r, lambda p: p.key == w)[0]["value"].alias("value"))))
        longest_first = F.sort_array(words, asc=False)  # of words that begin alike
        alone = F.concat(F.lit(names.any + r"|(?=\p{Lu})(?<![\p{L}\p{N}])(?:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        df = df.withColumn(pattern_, F.when(F.size(r) > 0, alone).otherwise(F.lit(names.any))).withColumn(roles_, F.when(F.size(r) > 0, roles).otherwise(no_roles))
        found = F.when(text.rlike(names.hint), F.regexp_extract_all(text, F.col(pattern_), F.lit(0))).otherwise(none)
        return df.withColumn(found_, entities(found, F.col(roles_), names))

    m = F.col(found_)
    flat = F.flatten(F.transform(m, lambda e: e.parts))
    found = matched(docs.select(text.alias(text_col))).filter(F.size(m) > 0).select(F.explode(flat).alias("e"))
    moved = _redrawn(found.groupBy("e.canon").agg(F.min("e").alias("e")).select("e"), key)
    rows = matched(docs)
    if moved is None:
        tries = None
    else:
        held = matched(docs.select(text.alias(text_col))).filter(F.size(m) > 0).select(F.sha2(text, 256).alias(hash_), F.explode(flat).alias("e")).select(hash_, F.col("e.canon").alias("canon")).distinct()
        tries = held.join(moved, "canon").groupBy(hash_).agg(F.map_from_entries(F.collect_list(F.struct("canon", "attempt"))).alias(tries_))
        rows = rows.withColumn(hash_, F.when(F.size(m) > 0, F.sha2(text, 256))).join(tries, hash_, "left")
    attempt = (lambda _: F.lit(0)) if tries is None else (lambda c: F.coalesce(F.try_element_at(F.col(tries_), c), F.lit(0)))
    new = F.transform(m, lambda e: F.concat(e.title, F.array_join(surrogates(e.parts, key, attempt), " ")))
    pieces = F.split(text, F.col(pattern_), -1)
    rebuilt = F.when(F.size(m) > 0, F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(m)), new, lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))).otherwise(text)
    out = rows.withColumn(text_, rebuilt)
    cols = [F.col(text_).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, *([F.size(found_).cast("long").alias(count_col)] if count_col else []))
