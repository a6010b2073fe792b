"""Point and history reads, for all keys at once; filter on key for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.columns import meta_canon, status

VERSION = ("timestamp", "blob_id", "seq")
#: Rows that one range of a history holds about.
_ROWS = 1_000_000


def newest(log: DataFrame, *columns: str) -> DataFrame:
    """Each key's newest row (columns besides key): one aggregation with partial
    results before the shuffle, so a key with any number of versions is fine."""
    wanted = list(dict.fromkeys(["is_deleted", *VERSION, *columns]))
    best = F.max_by(F.struct(*wanted), F.struct(*VERSION))
    return log.groupBy("key").agg(best.alias("_b")).select("key", "_b.*")


def read(log: DataFrame) -> DataFrame:
    """key, status, timestamp, data (null unless found) of the newest version."""
    rows = newest(log, "data")
    return rows.select("key", status(F.col("is_deleted")).alias("status"), "timestamp", F.when(~F.col("is_deleted"), F.col("data")).alias("data"))


def read_late(log: DataFrame) -> DataFrame:
    """``read`` for large payloads: winners are chosen on narrow columns and
    only their data is fetched, by (blob_id, seq)."""
    win = newest(log)
    data = log.select("blob_id", "seq", "data")
    joined = win.filter("not is_deleted").join(data, ["blob_id", "seq"]).select("key", F.lit("found").alias("status"), "timestamp", "data")
    gone = win.filter("is_deleted").select("key", F.lit("deleted").alias("status"), "timestamp", F.lit(None).cast("binary").alias("data"))
    return joined.union(gone)


def contains(log: DataFrame, probes: DataFrame) -> DataFrame:
    """key, status, timestamp for each probe key; payload is never read."""
    return probes.select("key").join(newest(log), "key", "left").select("key", status(F.col("is_deleted")).alias("status"), "timestamp")


def spread(log: DataFrame, by: list[str], version: tuple[str, ...] = VERSION) -> Column | None:
    """The number of each row's range in the order of keys and, within a key,
    of versions: a key with very many versions lies in several. The ranges' ends
    come from a sample of at most some ten thousand rows. None if one range will do."""
    from stratalog.operators import segments

    order = F.struct(*by, *version)
    n = log.count()
    parts = min(segments.range_count(log), -(-n // _ROWS))
    if parts <= 1:
        return None
    ends = sorted((r[0] for r in log.select(order.alias("o")).sample(min(1.0, 100 * parts / n), seed=1).limit(200 * parts).collect()), key=lambda o: tuple(bytes(x) if isinstance(x, bytearray) else x for x in o))
    step = max(1, len(ends) // parts)
    types = [f.dataType for f in log.select(order.alias("o")).schema["o"].dataType.fields]
    cuts = [F.struct(*(F.lit(x).cast(t).alias(name) for x, t, name in zip(e, types, [*by, *version]))) for e in ends[step::step]]
    if not cuts:
        return None
    held, steps = F.array(*cuts), [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(held, at + s - 1) <= order), at + s).otherwise(at))


def history_with_marker(log: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Versions up to and including the newest tombstone, with rank from 1
    (newest). ``by`` ("blob_id", "key") gives the history inside each blob.

    The newest tombstone comes from an aggregation. Ranks are row numbers inside
    ranges of versions, after the rows of the same key in the ranges above, so
    that no key's versions meet in one task.
    """
    by = list(by)
    stone = log.filter("is_deleted").groupBy(*by).agg(F.max(F.struct(*VERSION)).alias("_stone"))
    rows = log.join(stone, by, "left").filter(F.col("_stone").isNull() | (F.struct(*VERSION) >= F.col("_stone"))).drop("_stone").select(*log.columns)
    part = spread(log, by)
    if part is None:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) for c in VERSION))))
    rows = rows.withColumn("_b", part)
    # a row for each key and range; a key has as many as it has ranges
    newer = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    above = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n")).select(*by, "_b", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_above")).filter("_above > 0")
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*(F.desc(c) for c in VERSION))))
    return ranked.join(above, [*by, "_b"], "left").select(*log.columns, (F.col("_i") + F.coalesce("_above", F.lit(0))).cast("int").alias("rank"))


def history(log: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Live versions, newest first by rank."""
    return history_with_marker(log, by).filter(~F.col("is_deleted"))


def latest_in_blobs(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Newest version inside each blob of pairs (key, blob_id), those that the
    filters allow: key, blob_id, status, timestamp, seq; no row where the blob
    has none after all."""
    mine = log.join(pairs.select("key", "blob_id").distinct(), ["key", "blob_id"], "left_semi")
    best = mine.groupBy("key", "blob_id").agg(F.max_by("is_deleted", F.struct("timestamp", "seq")).alias("_d"), F.max(F.struct("timestamp", "seq")).alias("_v"))
    return best.select("key", "blob_id", status(F.col("_d")).alias("status"), F.col("_v.timestamp").alias("timestamp"), F.col("_v.seq").alias("seq"))


def live(log: DataFrame) -> DataFrame:
    """The rows of ``history`` without ranks: versions newer than the key's
    newest tombstone. Two aggregations and a join instead of one sort of each
    key's versions in one task; for keys with very many versions."""
    stone = log.filter("is_deleted").groupBy("key").agg(F.max(F.struct(*VERSION)).alias("_stone"))
    return log.filter("not is_deleted").join(stone, "key", "left").filter(F.col("_stone").isNull() | (F.struct(*VERSION) > F.col("_stone"))).drop("_stone")


def read_with(log: DataFrame, wanted: Column, *columns: str) -> DataFrame:
    """Newest live version whose whole metadata equals ``wanted`` (a map).

    The first tombstone or match in the newest-first order is the greatest
    among tombstones and matches, so no history is built. Keys with neither
    are not_found.
    """
    match = meta_canon(F.col("meta")) == meta_canon(wanted)
    cols = list(dict.fromkeys(["is_deleted", *VERSION, *columns]))
    hit = F.col("is_deleted") | match
    rows = log.groupBy("key").agg(F.max_by(F.when(hit, F.struct(*cols)), F.when(hit, F.struct(*VERSION))).alias("_b"))
    return rows.select("key", status(F.col("_b.is_deleted")).alias("status"), *(F.col(f"_b.{c}").alias(c) for c in cols if c != "is_deleted"))


def load(log: DataFrame) -> DataFrame:
    """Full records with ``data_ok`` and, where the log has header_checksum,
    ``header_ok``: whether data and header meet their stored checksums."""
    from stratalog.functions.checksum import crc32c

    rows = log.withColumn("data_ok", crc32c("data") == F.col("data_checksum"))
    return rows.withColumn("header_ok", crc32c(header_bytes()) == F.col("header_checksum")) if "header_checksum" in log.columns else rows


def header_bytes() -> Column:
    """A record's header as on disk, its own checksum zero: of key, meta_size,
    data_size, is_deleted, blob_offset, timestamp and data_checksum."""
    from stratalog.operators.integrity import RECORD_MAGIC

    def little(c: Column, n: int) -> Column:
        big = F.lpad(F.hex(c.cast("long")), 2 * n, "0")
        return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in range(n - 1, -1, -1)))

    parts = [little(F.lit(RECORD_MAGIC), 8), little(F.octet_length("key"), 8), F.hex("key"), little(F.col("meta_size"), 8), little(F.col("data_size"), 8), little(F.col("is_deleted").cast("int"), 1)]
    parts += [little(F.col("blob_offset"), 8), little(F.col("timestamp"), 8), little(F.col("data_checksum"), 4), F.lit("00000000")]
    return F.unhex(F.concat(*parts))
