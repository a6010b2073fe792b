"""Validation, recovery, migration and triage of damaged logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.checksum import crc32c

#: Fixed values of the file format.
BLOB_MAGIC, RECORD_MAGIC, BLOB_VERSION = 0xDEAFABCD, 0xACDCBCDE, 1


def validate(log: DataFrame) -> DataFrame:
    """Rows whose data does not meet data_checksum, with error_kind."""
    return log.withColumn("error_kind", F.when(crc32c("data") != F.col("data_checksum"), F.lit("RecordDataChecksum"))).filter("error_kind is not null")


def recover_prefix(log: DataFrame, bad: Column) -> DataFrame:
    """Records of each blob before its first bad one."""
    upto = Window.partitionBy("blob_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("_bad", F.sum(bad.cast("int")).over(upto)).filter("_bad = 0").drop("_bad")


def recover_skip(log: DataFrame, bad: Column) -> DataFrame:
    """Good records of each blob up to the first two bad ones in a row: one bad
    record is passed over, a second failure at once ends the copy."""
    w = Window.partitionBy("blob_id").orderBy("seq")
    rows = log.withColumn("_bad", bad).withColumn("_two", F.col("_bad") & F.coalesce(F.lag("_bad").over(w), F.lit(False)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_end", F.sum(F.col("_two").cast("int")).over(upto)).filter("_end = 0 and not _bad").drop("_bad", "_two", "_end")


def migrate(log: DataFrame, source: int, target: int) -> DataFrame:
    """Records of format version ``source`` in version ``target``: from 0 to 1
    the bytes of keys are reversed; the same or a lower target changes nothing."""
    if source >= target:
        return log
    if (source, target) != (0, 1):
        raise ValueError(f"unsupported migration from {source} to {target}")
    pairs = F.regexp_extract_all(F.hex("key"), F.lit("(..)"), F.lit(1))
    return log.withColumn("key", F.unhex(F.array_join(F.reverse(pairs), "")))  # reverse() itself takes binary for text


#: Kinds of damage, by where they show.
BLOB_ERRORS = ("BlobMagicByte", "BlobVersion", "BlobKeySize")
RECORD_ERRORS = ("RecordMagicByte", "RecordHeaderChecksum", "RecordDataChecksum", "Bincode")
INDEX_ERRORS = ("IndexVersion", "IndexKeySize", "IndexBlobSize", "IndexChecksum")


def first_errors(records: DataFrame) -> DataFrame:
    """(blob_id, error_kind): each blob's first damage, null for sound ones."""
    at = F.when(F.col("error_kind").isNotNull(), F.struct("seq", "error_kind"))
    return records.groupBy("blob_id").agg(F.min(at).alias("_e")).select("blob_id", F.col("_e.error_kind").alias("error_kind"))


def triage(blobs: DataFrame, ignore_corrupted: bool = False) -> DataFrame:
    """What opening does with each blob, by its ``error_kind``: open, fail (a
    version this code does not know), or quarantine (skip if corrupted blobs
    are ignored)."""
    damaged = F.lit("skip" if ignore_corrupted else "quarantine")
    version = F.lit("skip" if ignore_corrupted else "fail")
    return blobs.withColumn("action", F.when(F.col("error_kind").isNull(), "open").when(F.col("error_kind") == "BlobVersion", version).otherwise(damaged))
