"""Conditional inserts and deletes over a stream of operations in seq order.

Operations have key, timestamp, seq, is_deleted and, for inserts by metadata,
meta. Inserts of a key that is present are silently dropped, as are deletes
(only_if_presented) of a key that is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.columns import meta_canon
from stratalog.operators.reads import newest, spread


def _before(ops: DataFrame) -> DataFrame:
    """ops with ``_g``: whether the operation before on the key is a delete
    (null: none). Keys with very many operations are cut in ranges; the last
    operation of each range is known from an aggregation."""
    part = spread(ops, ["key"], ("seq",))
    if part is None:
        return ops.withColumn("_g", F.lag("is_deleted").over(Window.partitionBy("key").orderBy("seq")))
    rows = ops.withColumn("_b", part)
    last = rows.groupBy("key", "_b").agg(F.max_by("is_deleted", "seq").alias("_l"))
    carried = last.select("key", "_b", F.lag("_l").over(Window.partitionBy("key").orderBy("_b")).alias("_c")).filter("_c is not null")
    inside = rows.withColumn("_g", F.lag("is_deleted").over(Window.partitionBy("key", "_b").orderBy("seq")))
    return inside.join(carried, ["key", "_b"], "left").withColumn("_g", F.coalesce("_g", "_c")).drop("_b", "_c")


def insert_monotone(ops: DataFrame, only_if_presented: bool = False) -> DataFrame:
    """Operations that are written when timestamps never fall in seq order: a
    put after nothing or a delete; a delete always, or after a put only."""
    put = ~F.col("is_deleted") & F.coalesce("_g", F.lit(True))
    delete = F.col("is_deleted") & (F.coalesce(~F.col("_g"), F.lit(False)) if only_if_presented else F.lit(True))
    return _before(ops).filter(put | delete).select(*ops.columns)


def insert_first_by_meta(ops: DataFrame) -> DataFrame:
    """Puts that are written when only inserts by exact metadata occur: the
    first of each (key, meta). One aggregation, whatever a key's number of puts."""
    cols = [c for c in ops.columns if c != "key"]
    rows = ops.withColumn("_m", meta_canon(F.col("meta")))
    return rows.groupBy("key", "_m").agg(F.min_by(F.struct(*cols), "seq").alias("_r")).select("key", "_r.*").select(*ops.columns)


def _fold(only_if_presented: bool):
    """Over operations sorted by key and seq: those written. One key's state is held."""

    def run(pdfs):
        key, best = None, None
        for pdf in pdfs:
            kept = []
            for k, ts, seq, gone in zip(pdf.key, pdf.timestamp, pdf.seq, pdf.is_deleted):
                if k != key:
                    key, best = k, None
                present = best is not None and not best[2]
                write = (present or not only_if_presented) if gone else not present
                kept.append(write)
                if write and (best is None or (ts, seq) >= best[:2]):
                    best = (ts, seq, gone)
            yield pdf.loc[kept, ["key", "seq"]]

    return run


def insert_any_order(ops: DataFrame, only_if_presented: bool = False) -> DataFrame:
    """``insert_monotone`` for timestamps in any order: whether a put is written
    depends on all writes before it, so each key is folded in sequence, a batch
    at a time."""
    narrow = ops.select("key", "timestamp", "seq", "is_deleted").repartition("key").sortWithinPartitions("key", "seq")
    kind = ops.schema["key"].dataType.simpleString()
    kept = narrow.mapInPandas(_fold(only_if_presented), f"key {kind}, seq {ops.schema['seq'].dataType.simpleString()}")
    return ops.join(kept, ["key", "seq"], "left_semi")


def insert_into(table: DataFrame, puts: DataFrame, by_meta: bool = False) -> DataFrame:
    """Puts whose key (or key and metadata) no live version of the table has."""
    first = insert_first_by_meta(puts) if by_meta else puts.groupBy("key").agg(F.min_by(F.struct(*[c for c in puts.columns if c != "key"]), "seq").alias("_r")).select("key", "_r.*").select(*puts.columns)
    if not by_meta:
        return first.join(newest(table).filter("not is_deleted").select("key"), "key", "left_anti")
    from stratalog.operators.reads import live

    held = live(table).select("key", meta_canon(F.col("meta")).alias("_m")).distinct()
    return first.withColumn("_m", meta_canon(F.col("meta"))).join(held, ["key", "_m"], "left_anti").drop("_m")


def delete_plan(log: DataFrame, keys: DataFrame, only_if_presented: bool = True, active: int | None = None) -> DataFrame:
    """(key, blob_id) of the blobs that get a tombstone: those whose own newest
    version of the key is live, and the active one unless only_if_presented."""
    mine = log.join(keys.select("key").distinct(), "key", "left_semi")
    last = mine.groupBy("key", "blob_id").agg(F.max_by("is_deleted", F.struct("timestamp", "seq")).alias("gone"))
    marked = last.filter("not gone").select("key", "blob_id")
    if not only_if_presented and active is not None:
        marked = marked.union(keys.select("key", F.lit(active).cast("long").alias("blob_id"))).distinct()
    return marked


def tombstones(plan: DataFrame, timestamp: int, first_seq: int, meta: Column | None = None) -> DataFrame:
    """Rows to append for a delete plan, each to its own blob, with the
    metadata given; one each, numbered from first_seq by key and blob."""
    n = F.row_number().over(Window.partitionBy("blob_id").orderBy("key"))
    rows = plan.select("key", F.lit(timestamp).cast("long").alias("timestamp"), "blob_id", (F.lit(first_seq) + n - 1).cast("long").alias("seq"), F.lit(True).alias("is_deleted"))
    return rows if meta is None else rows.withColumn("meta", meta)
