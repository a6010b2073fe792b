"""Segmentation of a log into blobs, record sizes and offsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOB_HEADER = 20
RECORD_HEADER = 57  # and the key's length


def record_size(key_len: Column | int, meta: Column | None, data: Column) -> Column:
    """Bytes of a record on disk: header, metadata, data (null is empty)."""
    n = key_len if isinstance(key_len, Column) else F.lit(key_len)
    m = F.lit(8) if meta is None else F.lit(8) + F.aggregate(F.map_entries(meta), F.lit(0), lambda a, e: a + 16 + F.octet_length(e.key) + F.octet_length(e.value))
    return (n + RECORD_HEADER + F.coalesce(m, F.lit(8)) + F.coalesce(F.octet_length(data), F.lit(0))).cast("long")


def _ranges(df: DataFrame, order: str, buckets: int) -> DataFrame | None:
    """df with ``_b``, the number of a range of the column; None for no rows."""
    if df.agg(F.min(order)).first()[0] is None:
        return None
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    if not cuts:
        return df.withColumn("_b", F.lit(0))
    # cuts by bisection
    held, steps = F.array(*(F.lit(c) for c in cuts)), [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    x = F.col(order)
    return df.withColumn("_b", F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(held, at + s - 1) <= x), at + s).otherwise(at)))


def range_count(df: DataFrame) -> int:
    """Ranges that ``numbered`` cuts: as many as shuffles have partitions, 64 to 1,024."""
    return min(1024, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def numbered(df: DataFrame, order: str, name: str = "n", buckets: int | None = None) -> DataFrame:
    """df with the global row number (from 0) by a numeric column, without one
    task for all rows: rows are numbered inside ranges of the column, and each
    range starts after the rows of the ranges below (``buckets`` counts)."""
    rows = _ranges(df, order, buckets or range_count(df))
    if rows is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    starts, at = [], 0
    for r in sorted(rows.groupBy("_b").count().collect(), key=lambda r: r["_b"]):  # at most ``buckets`` rows
        starts += [F.lit(r["_b"]), F.lit(at).cast("long")]
        at += r["count"]
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return rows.withColumn(name, F.element_at(F.create_map(*starts), F.col("_b")) + inside - 1).drop("_b")


def rotate_by_count(log: DataFrame, max_records: int, order: str = "seq") -> DataFrame:
    """log with blob_id: a new blob after every max_records rows in order."""
    return numbered(log.drop("blob_id"), order, "_n").withColumn("blob_id", F.floor(F.col("_n") / max_records)).drop("_n")


def rotate(sizes: DataFrame, max_bytes: int, max_records: int = 1 << 62, used_bytes: int = BLOB_HEADER, used_records: int = 0, buckets: int | None = None) -> DataFrame:
    """(seq, size) -> (seq, blob_id): the record that takes a blob to max_bytes
    or beyond, or to max_records, is its last; a null size is none. The first
    blob, number 0, has used_bytes and used_records already.

    Where a blob ends depends on where the last one did, but only through two
    numbers: the total of sizes, and the row, at which the open blob closes.
    Each range of records maps them as they come in to what goes out and the
    blobs ended, a step function of few steps, for blobs that begin apart soon
    end together. The steps of all ranges are composed in order; then every
    range numbers its records by itself.
    """
    room, most = max_bytes - BLOB_HEADER, max_records
    if room <= 0 or most <= 1:  # no blob takes a second record
        return numbered(sizes.select("seq"), "seq", "blob_id")
    rows = _ranges(sizes.select("seq", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "seq", buckets or range_count(sizes))
    if rows is None:
        return sizes.select("seq", F.lit(None).cast("long").alias("blob_id"))
    total_at, row_at, start = 0, 0, {}
    for r in sorted(rows.groupBy("_b").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect(), key=lambda r: r["_b"]):
        start[r["_b"]] = (total_at, row_at)
        total_at, row_at = total_at + r["s"], row_at + r["n"]

    def ends_after(total: np.ndarray) -> np.ndarray:
        """For each row that ends a blob, the row that ends the next (the number of rows if none here)."""
        n = len(total)
        return np.minimum(np.minimum(np.searchsorted(total, total + room), np.arange(n) + min(most, n)), n)

    def steps(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """For each row that may end the first blob: its total and place, what closes the last blob begun here, blobs ended."""
        begin, base = start[key[0]]
        total = begin + pdf.sort_values("seq")["size"].cumsum().to_numpy()
        n = len(total)
        reach = min(n, most, int(np.searchsorted(total, begin + room)) + 1)
        jump = ends_after(total)
        last, ended = np.arange(n), np.ones(n, np.int64)
        while len(i := np.flatnonzero(jump < n)):  # pointers double
            last[i], ended[i], jump[i] = last[jump[i]], ended[i] + ended[jump[i]], jump[jump[i]]
        found = pd.DataFrame({"total": total[:reach], "place": base + np.arange(reach), "close": total[last[:reach]] + room, "close_place": base + last[:reach] + most, "ended": ended[:reach]})
        same = (found.close == found.close.shift(-1)) & (found.close_place == found.close_place.shift(-1)) & (found.ended == found.ended.shift(-1))
        return found[~same].assign(b=key[0])[["b", "total", "place", "close", "close_place", "ended"]]

    def compose(batches):
        """What closes the open blob as each range begins, and the blobs before it."""
        close, place, blobs, b, done = max_bytes - used_bytes, most - used_records - 1, 0, None, False
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.b != b:
                    b, done = r.b, False
                    out.append((b, close, place, blobs))
                if not done and (close <= r.total or place <= r.place):
                    close, place, blobs, done = r.close, r.close_place, blobs + r.ended, True
            yield pd.DataFrame(out, columns=["b", "close", "place", "blobs"])

    found = rows.groupBy("_b").applyInPandas(steps, "b int, total long, place long, close long, close_place long, ended long")
    begin = {r.b: (r.close, r.place, r.blobs) for r in found.repartition(1).sortWithinPartitions("b", "place").mapInPandas(compose, "b int, close long, place long, blobs long").collect()}  # a row for each range

    def number(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        total = start[key[0]][0] + pdf["size"].cumsum().to_numpy()
        close, place, blobs = begin[key[0]]
        after, n = ends_after(total), len(total)
        i = max(0, min(int(np.searchsorted(total, close)), place - start[key[0]][1]))
        ends = np.zeros(n + 1, np.int64)
        while i < n:
            ends[i + 1] = 1
            i = after[i]
        return pd.DataFrame({"seq": pdf.seq, "blob_id": blobs + np.cumsum(ends)[:-1]})

    return rows.groupBy("_b").applyInPandas(number, "seq long, blob_id long")


def rotate_by_size(sizes: DataFrame, max_bytes: int, buckets: int | None = None) -> DataFrame:
    """``rotate`` by sizes alone."""
    return rotate(sizes, max_bytes, buckets=buckets)


def offsets(log: DataFrame) -> DataFrame:
    """log with blob_offset: bytes of its blob before a record (size column ``size``)."""
    before = Window.partitionBy("blob_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("blob_offset", F.lit(BLOB_HEADER) + F.coalesce(F.sum("size").over(before), F.lit(0)))
