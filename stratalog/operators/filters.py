"""Data skipping: range and Bloom filters by blob, in one or two levels.

Filters are tables: a range filter one row a blob, a Bloom filter one row for
each 64-bit word with a bit set. They never deny a key that is there.

A probe meets ranges by buckets: cuts, taken from the ranges' own ends, divide
the keys' axis; a range lies in the buckets it spans and a probe in one, so both
join by equality. For pairs that are there already Bloom words are looked up by
blob and word; a tree finds the pairs from bits laid out blob beside blob, 64 at
a time, so that no row is made for a pair that a filter denies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts of the keys' axis at most.
CUTS = 1023
#: Parts of a tree's blobs: so many, if their bits fit; the bytes that these may take in a task; blobs that share a number.
PARTS, PART_BYTES, SLICE = 32, 1 << 26, 64


def range_filter(log: DataFrame) -> DataFrame:
    return log.groupBy("blob_id").agg(F.min("key").alias("low"), F.max("key").alias("high"))


def merge_ranges(ranges: DataFrame, group: Column) -> DataFrame:
    return ranges.groupBy(group.alias("group_id")).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def axis_cuts(ranges: DataFrame, most: int = CUTS) -> list:
    """At most ``most`` of the ranges' low ends, drawn by hash: they divide the
    keys' axis about as evenly as the ranges lie."""
    rows = ranges.select("low").filter("low is not null").distinct().orderBy(F.xxhash64("low"), "low").limit(most).collect()
    return sorted(bytes(r.low) if isinstance(r.low, bytearray) else r.low for r in rows)


def _bucket(x: Column, cuts: list) -> Column:
    """How many cuts lie at or below x, by bisection."""
    if not cuts:
        return F.lit(0)
    held = F.array(*(F.lit(c) for c in cuts))
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]

    def go(at: Column, s: Column) -> Column:
        return F.when((at + s <= len(cuts)) & (F.get(held, at + s - 1) <= x), at + s).otherwise(at)

    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), go)


def candidates(ranges: DataFrame, probes: DataFrame, name: str = "blob_id") -> DataFrame:
    """(key, ``name``) of the blobs (or groups) whose range may hold the key."""
    cuts = axis_cuts(ranges)
    spans = ranges.filter("low is not null").withColumn("_b", F.explode(F.sequence(_bucket(F.col("low"), cuts), _bucket(F.col("high"), cuts))))
    rows = probes.select("key").withColumn("_b", _bucket(F.col("key"), cuts))
    return rows.join(spans, "_b").filter("key >= low and key <= high").select("key", name)


def check_filters(ranges: DataFrame, probes: DataFrame) -> DataFrame:
    """key, maybe: whether any blob may hold the key."""
    return maybe(probes, candidates(ranges, probes))


def maybe(probes: DataFrame, hits: DataFrame) -> DataFrame:
    """key, maybe for each probe, of hits by any filter."""
    allowed = hits.select("key").distinct().withColumn("_h", F.lit(True))
    return probes.select("key").join(allowed, "key", "left").select("key", F.coalesce("_h", F.lit(False)).alias("maybe"))


def either(a: Column, b: Column) -> Column:
    """Sum of two results: denied only where both deny."""
    return a | b


def bloom_bits(elements: int, hashers: int, max_bits: int, fpr: float) -> int:
    """Bits of a filter: enough for the rate, at most max_bits, at least what
    the number of hash functions is best for."""
    if hashers == 0:
        return 0
    if max_bits == 0:
        return 64
    least = elements * hashers / math.log(2)
    wanted = -hashers * elements / math.log(1 - fpr ** (1 / hashers))
    return int(max(least, min(max_bits, wanted)))


def _hashes(bits: int) -> tuple[Column, Column]:
    """First bit position of key, and the step to the next ones."""
    return F.pmod(F.xxhash64("key"), F.lit(bits)), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(bits - 1)) + 1


def _positions(hashers: int, bits: int) -> Column:
    """Bit positions of key by double hashing."""
    a, b = _hashes(bits)
    return F.array_distinct(F.array(*(F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(hashers))))


def bloom(log: DataFrame, hashers: int, bits: int, by: str = "blob_id") -> DataFrame:
    """(blob_id, word, bits): the words of each blob's filter."""
    at = log.select(by, "key").distinct().select(by, F.explode(_positions(hashers, bits)).alias("p"))
    return at.groupBy(by, F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits"))


def merge_blooms(words: DataFrame, group: Column) -> DataFrame:
    """Union of filters of one size: their words or-ed."""
    return words.groupBy(group.alias("group_id"), "word").agg(F.bit_or("bits").alias("bits"))


def bloom_check(words: DataFrame, pairs: DataFrame, hashers: int, bits: int, by: str = "blob_id") -> DataFrame:
    """Of pairs (key, blob_id) those where all bits of the key are set in the
    blob's filter: each looks up its own blob's words, as many as hash functions."""
    at = pairs.select("key", by, _positions(hashers, bits).alias("ps")).select("key", by, F.size("ps").alias("need"), F.explode("ps").alias("p")).withColumn("word", F.floor(F.col("p") / 64))
    set_ = at.join(words, [by, "word"]).filter(F.call_function("getbit", F.col("bits"), F.pmod("p", F.lit(64)).cast("int")) == 1)
    return set_.groupBy("key", by, "need").agg(F.countDistinct("p").alias("n")).filter("n = need").select("key", by)


def _part_cuts(ranges: DataFrame, bits: int) -> list[int]:
    """Blob ids that part the blobs evenly, in at most PARTS parts, or more if
    the bits of one would take more than PART_BYTES; a part has SLICE blobs or more."""
    most = max(1, PART_BYTES // (8 * bits)) * SLICE  # blobs of a part
    n, ends = ranges.agg(F.count("*"), F.percentile_approx("blob_id", [i / PARTS for i in range(1, PARTS)])).first()
    parts = max(min(PARTS, n // SLICE), -(-n // most))
    if parts > PARTS:
        ends = ranges.agg(F.percentile_approx("blob_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
        return sorted(set(ends))
    return sorted({ends[round(i * PARTS / parts) - 1] for i in range(1, parts)})


def _allowing(hashers: int, bits: int):
    """For ``bloom_pairs``: rows of a part are its ranges (kind 0), words (1)
    and probes (2), in this order. The bits of 64 blobs at one position are one
    number; where those at all positions of a key have a common bit, its blob
    allows the key."""
    width = -(-bits // 64) * 64

    def pairs(keys, first, step, table, blobs, low, high):
        for j, held in enumerate(table):
            common = held[first]
            for i in range(1, hashers):
                common &= held[(first + step * i) % bits]
            rows = np.flatnonzero(common)
            which, bit = np.nonzero(np.unpackbits(common[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            rows, at = rows[which], j * SLICE + bit
            for s in range(0, len(rows), 50_000):
                r, b = pa.array(rows[s : s + 50_000]), at[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([keys.take(r), pa.array(blobs[b]), low.take(pa.array(b)), high.take(pa.array(b))], ["key", "blob_id", "low", "high"])

    def look(batches):
        part, table, found = None, None, []
        for batch in batches:
            p, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (kind[1:] != kind[:-1])]) if len(p) else []
            for s, e in zip(starts, [*starts[1:], len(p)]):
                _, _, blob, x, y, key, high = batch.slice(s, e - s).columns
                if p[s] != part:
                    part, table, found = p[s], None, []
                if kind[s] == 0:
                    found.append((blob.to_numpy(), key, high))
                    continue
                if table is None and found:
                    blobs = np.concatenate([f[0] for f in found])
                    order = np.argsort(blobs)
                    blobs, low, highs = blobs[order], *(pa.concat_arrays([f[i] for f in found]).take(pa.array(order)) for i in (1, 2))
                    table = np.zeros((-(-len(blobs) // SLICE), width), np.uint64)
                if table is None:
                    continue
                x, y = x.to_numpy(), y.to_numpy()
                if kind[s] == 2:
                    yield from pairs(key, x, y, table, blobs, low, highs)
                    continue
                blob = blob.to_numpy()
                at = np.minimum(np.searchsorted(blobs, blob), len(blobs) - 1)
                mine = blobs[at] == blob
                at, x, y = at[mine], x[mine], y[mine]
                row, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(y, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                at = at[row]
                np.bitwise_or.at(table, (at // SLICE, x[row] * 64 + bit), np.uint64(1) << (at % SLICE).astype(np.uint64))

    return look


def bloom_pairs(ranges: DataFrame, words: DataFrame, probes: DataFrame, hashers: int, bits: int) -> DataFrame:
    """(key, blob_id) of the blobs whose range and Bloom filter allow the key,
    for distinct keys. Blobs are parted by id, a key goes once to each part
    whose range allows it, and a part's task holds the bits of its blobs and
    reads the keys one batch after another. So what is shuffled are the filters, each
    key at most as often as there are parts, and no pair of key and blob."""
    cuts = _part_cuts(ranges.filter("low is not null"), bits)
    part = _bucket(F.col("blob_id"), cuts)
    ends = ranges.filter("low is not null").groupBy(part.alias("part")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    areas = ranges.sparkSession.createDataFrame(ends.toArrow(), ends.schema)  # a row for each part
    first, step = _hashes(bits)
    keyed = candidates(areas, probes, "part").select("key", "part", first.alias("x"), step.alias("y"))
    # words that no probe asks for stay; a filter has few word numbers
    asked = probes.filter("key is not null").select(F.explode(_positions(hashers, bits)).alias("p")).select(F.floor(F.col("p") / 64).alias("word")).distinct()
    mine = words.join(F.broadcast(asked), "word", "left_semi")
    none = F.lit(None)
    rows = (
        ranges.filter("low is not null").select(part.alias("part"), F.lit(0).alias("kind"), "blob_id", none.cast("long").alias("x"), none.cast("long").alias("y"), F.col("low").alias("key"), "high")
        .unionByName(mine.select(part.alias("part"), F.lit(1).alias("kind"), "blob_id", F.col("word").alias("x"), F.col("bits").alias("y"), none.alias("key"), none.alias("high")))
        .unionByName(keyed.select("part", F.lit(2).alias("kind"), none.cast("long").alias("blob_id"), "x", "y", "key", none.alias("high")))
    )
    kind = rows.schema["key"].dataType.simpleString()
    hits = rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_allowing(hashers, bits), f"key {kind}, blob_id long, low {kind}, high {kind}")
    return hits.filter("key >= low and key <= high").select("key", "blob_id")


def bloom_to_raw(words: DataFrame, hashers: int, bits: int, by: str = "blob_id") -> DataFrame:
    """(blob_id, raw): each filter as bytes: hash functions and bits as 64-bit
    numbers, then its words with a bit set, number and bits."""
    word = F.concat(F.lpad(F.hex("word"), 16, "0"), F.lpad(F.hex("bits"), 16, "0"))
    head = f"{hashers:016X}{bits:016X}"
    return words.groupBy(by).agg(F.unhex(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(word)), ""))).alias("raw"))


def bloom_from_raw(raw: DataFrame, by: str = "blob_id") -> DataFrame:
    """(blob_id, hashers, filter_bits, word, bits) of ``bloom_to_raw``."""

    def number(at):
        return F.conv(F.hex(F.substring(F.col("raw"), at, F.lit(8))), 16, -10).cast("long")

    n = (F.length("raw") / 16).cast("int") - 1
    words = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(number(i * 16 + 1).alias("word"), number(i * 16 + 9).alias("bits")))
    rows = raw.filter(n > 0).select(by, number(F.lit(1)).alias("hashers"), number(F.lit(9)).alias("filter_bits"), F.explode(words).alias("w"))
    return rows.select(by, "hashers", "filter_bits", "w.word", "w.bits")


def combined(range_hits: DataFrame, words: DataFrame | None, hashers: int = 0, bits: int = 0) -> DataFrame:
    """Both filters must allow a blob: ranges first, Bloom filters for what they
    allow; without Bloom filters ranges decide."""
    return range_hits if words is None or not hashers else bloom_check(words, range_hits, hashers, bits)


def exact(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (key, blob_id) those whose blob has the key: what an index in memory says."""
    return pairs.join(log.select("key", "blob_id"), ["key", "blob_id"], "left_semi")


class Filter(Protocol):
    """A kind of filter: a table made from a log, that names pairs (key,
    blob_id) which may be there. ``check`` must never drop one that is."""

    def build(self, log: DataFrame) -> DataFrame: ...

    def check(self, table: DataFrame, pairs: DataFrame) -> DataFrame: ...

    def merge(self, table: DataFrame, group: Column) -> DataFrame: ...


class RangeFilter:
    def build(self, log: DataFrame) -> DataFrame:
        return range_filter(log)

    def check(self, table: DataFrame, pairs: DataFrame) -> DataFrame:
        return pairs.join(table, "blob_id").filter("key >= low and key <= high").select("key", "blob_id")

    def merge(self, table: DataFrame, group: Column) -> DataFrame:
        return merge_ranges(table, group)


@dataclass
class BloomFilter:
    hashers: int
    bits: int

    def build(self, log: DataFrame) -> DataFrame:
        return bloom(log, self.hashers, self.bits)

    def check(self, table: DataFrame, pairs: DataFrame) -> DataFrame:
        return bloom_check(table, pairs, self.hashers, self.bits)

    def merge(self, table: DataFrame, group: Column) -> DataFrame:
        return merge_blooms(table, group)


def checked(filters: list[tuple[Filter | None, DataFrame | None]], pairs: DataFrame) -> DataFrame:
    """pairs that every filter allows; an absent filter allows all."""
    for kind, table in filters:
        if kind is not None and table is not None:
            pairs = kind.check(table, pairs)
    return pairs


@dataclass(frozen=True)
class FilterTree:
    """Two levels of filters: groups of ``group_size`` blobs, each with the
    union of its blobs' filters, over the blobs. Trees are values: what changes
    one returns another. ``ranges`` (blob_id, low, high) and ``words`` (blob_id,
    word, bits) hold the leaves; groups follow from them, by a blob's id."""

    ranges: DataFrame
    words: DataFrame | None = None
    hashers: int = 0
    bits: int = 0
    group_size: int = 8

    @staticmethod
    def of(log: DataFrame, hashers: int = 0, bits: int = 0, group_size: int = 8) -> FilterTree:
        return FilterTree(range_filter(log), bloom(log, hashers, bits) if hashers else None, hashers, bits, group_size)

    def _group(self) -> Column:
        return F.floor(F.col("blob_id") / self.group_size)

    def _with(self, keep) -> FilterTree:
        return replace(self, ranges=keep(self.ranges), words=None if self.words is None else keep(self.words))

    def extend(self, other: FilterTree) -> FilterTree:
        """Blobs of another tree added; those of one id are merged."""
        if (self.hashers, self.bits) != (other.hashers, other.bits):
            raise ValueError("filters of different sizes do not merge")
        ranges = self.ranges.unionByName(other.ranges).groupBy("blob_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        words = None if self.words is None else self.words.unionByName(other.words).groupBy("blob_id", "word").agg(F.bit_or("bits").alias("bits"))
        return replace(self, ranges=ranges, words=words)

    def add(self, log: DataFrame) -> FilterTree:
        """Keys of a log (key, blob_id) added to their blobs, and so to the groups above."""
        return self.extend(FilterTree.of(log, self.hashers, self.bits, self.group_size))

    def remove(self, blob_id: int) -> FilterTree:
        return self._with(lambda t: t.filter(F.col("blob_id") != blob_id))

    def pop(self) -> tuple[FilterTree, DataFrame]:
        """The tree without its last blob, and that blob's range."""
        last = self.last_id()
        return (self, self.ranges.limit(0)) if last is None else (self.remove(last), self.get(last))

    def clear(self) -> FilterTree:
        return self._with(lambda t: t.limit(0))

    def get(self, blob_id: int) -> DataFrame:
        return self.ranges.filter(F.col("blob_id") == blob_id)

    def last_id(self) -> int | None:
        return self.ranges.agg(F.max("blob_id")).first()[0]

    def last(self) -> DataFrame:
        return self.ranges.orderBy(F.desc("blob_id")).limit(1)

    def __len__(self) -> int:
        return self.ranges.count()

    def ids(self, reverse: bool = False) -> Iterator[int]:
        order = F.desc("blob_id") if reverse else F.asc("blob_id")
        return (r.blob_id for r in self.ranges.select("blob_id").orderBy(order).toLocalIterator())

    def groups(self) -> FilterTree:
        """The upper level as a tree of its own, a group's id in place of a blob's."""
        named = merge_ranges(self.ranges, self._group()).withColumnRenamed("group_id", "blob_id")
        words = None if self.words is None else merge_blooms(self.words, self._group()).withColumnRenamed("group_id", "blob_id")
        return replace(self, ranges=named, words=words)

    def whole(self) -> FilterTree:
        """The filter of all blobs together, as blob 0."""
        named = merge_ranges(self.ranges, F.lit(0).cast("long")).withColumnRenamed("group_id", "blob_id")
        words = None if self.words is None else merge_blooms(self.words, F.lit(0).cast("long")).withColumnRenamed("group_id", "blob_id")
        return replace(self, ranges=named, words=words)

    def possible(self, probes: DataFrame) -> DataFrame:
        """(key, blob_id) that the filters of the group and of the blob allow.
        A group's filters are the unions of its blobs', and allow what any of
        these does: with Bloom filters, ranges of larger groups and 64 blobs'
        bits at a time stand for the level above; else a blob's range is looked
        at only where its group's allows the key."""
        if self.words is not None and self.hashers:
            return bloom_pairs(self.ranges, self.words, probes.select("key").distinct(), self.hashers, self.bits)
        first = candidates(self.groups().ranges, probes.select("key").distinct()).withColumnRenamed("blob_id", "_g")
        leaves = self.ranges.withColumn("_g", self._group())
        return first.join(leaves, "_g").filter("key >= low and key <= high").select("key", "blob_id")

    def visit(self, probes: DataFrame, reverse: bool = False) -> DataFrame:
        """key, blob_ids: the blobs to look into, in order of id or from the newest."""
        return self.possible(probes).groupBy("key").agg(F.sort_array(F.collect_set("blob_id"), asc=not reverse).alias("blob_ids"))

    def check(self, probes: DataFrame) -> DataFrame:
        """key, maybe for each probe."""
        return maybe(probes, self.possible(probes))

    def memory(self) -> DataFrame:
        """filter_bytes: the buffers of all blobs' and groups' Bloom filters."""
        each = -(-self.bits // 64) * 8 if self.hashers else 0
        return self.ranges.select("blob_id", self._group().alias("g")).agg(((F.count("*") + F.countDistinct("g")) * F.lit(each)).cast("long").alias("filter_bytes"))


def hierarchical(ranges: DataFrame, probes: DataFrame, group_size: int = 8) -> DataFrame:
    """(key, blob_id) as ``candidates``, by groups of blobs first."""
    return FilterTree(ranges, group_size=group_size).possible(probes)
