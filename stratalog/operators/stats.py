"""Counts and summaries by blob."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.segments import BLOB_HEADER


def records_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("records"))


def records_count_detailed(log: DataFrame) -> DataFrame:
    return log.groupBy("blob_id").agg(F.count("*").alias("records"))


def records_count_active(log: DataFrame) -> DataFrame:
    """Records of the blob of highest id; no row for an empty log."""
    return records_count_detailed(log).agg(F.max(F.struct("blob_id", "records")).alias("m")).filter("m is not null").select("m.blob_id", "m.records")


def blobs_count(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("blob_id").alias("blobs"))


def next_blob_id(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("blob_id") + 1, F.lit(0)).alias("next_blob_id"))


def disk_used(log: DataFrame) -> DataFrame:
    """Bytes of all blobs (a ``size`` for each record, a header for each blob)."""
    return log.groupBy("blob_id").agg(F.sum("size").alias("s")).agg(F.coalesce(F.sum(F.col("s") + BLOB_HEADER), F.lit(0)).alias("disk_used"))


def blob_summary(log: DataFrame) -> DataFrame:
    """Live and tombstone records and their distinct keys, by blob. Two
    aggregations by key first, so a distinct count never gathers a blob's rows."""
    by_key = log.groupBy("blob_id", "key").agg(F.count_if(~F.col("is_deleted")).alias("p"), F.count_if(F.col("is_deleted")).alias("d"))
    return by_key.groupBy("blob_id").agg(F.sum("p").alias("records"), F.sum("d").alias("deleted"), F.count_if(F.col("p") > 0).alias("unique_records"), F.count_if(F.col("d") > 0).alias("unique_deleted"))


def index_summary(log: DataFrame) -> DataFrame:
    by_key = log.groupBy("blob_id", "key").agg(F.count("*").alias("n"))
    return by_key.groupBy("blob_id").agg(F.sum("n").alias("records"), F.count("*").alias("unique_keys"))


def read_index(log: DataFrame) -> DataFrame:
    """key -> headers, newest first, by blob (the key's versions inside one bounded blob)."""
    header = F.struct("timestamp", "seq", "is_deleted")
    return log.groupBy("blob_id", "key").agg(F.sort_array(F.collect_list(header), asc=False).alias("headers"))
