"""Record logs over the star-schema tables: each a view of a table as puts and
tombstones, with ``key`` a BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions.columns import meta


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})").cast("long")


def _text(c: str) -> Column:
    return F.encode(F.col(c).cast("string"), "utf-8")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many versions and tombstones (type 'error') a user, rising time."""
    gone = F.col("event_type") == "error"
    data = F.when(gone, F.unhex(F.lit(""))).otherwise(_text("props"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), _seconds("ts").alias("timestamp"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 1000).alias("blob_id"),
        gone.alias("is_deleted"), meta(type=F.col("event_type")).alias("meta"), data.alias("data"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version a key, blobs of disjoint key ranges."""
    gone = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), _seconds("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("seq"), F.floor(F.col("o_orderkey") / 1000).alias("blob_id"),
        gone.alias("is_deleted"), meta(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("meta"), F.when(gone, F.unhex(F.lit(""))).otherwise(_text("o_totalprice")).alias("data"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse timestamps with ties, and blobs that do not follow time. seq orders
    equal timestamps: it is each row's place among its key's rows by all columns."""
    rows = table(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[c for c in rows.columns if c != "l_orderkey"]))
    gone = F.col("l_returnflag") == "R"
    return rows.withColumn("_seq", seq).select(
        F.col("l_orderkey").alias("key"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("timestamp"), F.col("_seq").cast("long").alias("seq"), (F.col("l_suppkey") % 8).alias("blob_id"),
        gone.alias("is_deleted"), meta(status=F.col("l_linestatus")).alias("meta"), F.when(gone, F.unhex(F.lit(""))).otherwise(_text("l_extendedprice")).alias("data"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short histories in an obvious order."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("key"), F.col("turn").alias("timestamp"), F.col("turn").alias("seq"), F.lit(0).cast("long").alias("blob_id"),
        F.lit(False).alias("is_deleted"), meta(role=F.col("role")).alias("meta"), _text("text").alias("data"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large payloads of very different sizes."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.col("doc_id").alias("timestamp"), F.col("doc_id").alias("seq"), F.lit(0).cast("long").alias("blob_id"),
        F.lit(False).alias("is_deleted"), meta(lang=F.col("lang"), source=F.col("source")).alias("meta"), _text("text").alias("data"),
    )


def damaged(seq: Column) -> Column:
    """The deterministic damage of the integrity queries."""
    return (seq * 7919) % 97 < 6
