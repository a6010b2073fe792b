"""Structured Streaming over operations (key, timestamp, blob_id, seq, is_deleted, data).

State has one small tuple a key and is never dropped: late records always
count, so there is no watermark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def append(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream of records to a Parquet log, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def _parts(pdfs):
    return pd.concat(list(pdfs), ignore_index=True).sort_values(["timestamp", "blob_id", "seq"])


def latest(stream: DataFrame) -> DataFrame:
    """Each key's newest version, updated with every batch that touches the key."""
    kind = stream.schema["key"].dataType.simpleString()
    out = f"key {kind}, timestamp long, blob_id long, seq long, is_deleted boolean, data binary"

    def step(key, pdfs, state):
        last = _parts(pdfs).iloc[-1]
        new = (int(last.timestamp), int(last.blob_id), int(last.seq), bool(last.is_deleted), last.data)
        if not state.exists or new[:3] >= tuple(state.get)[:3]:
            state.update(new)
        t, b, s, gone, data = state.get
        yield pd.DataFrame({"key": [key[0]], "timestamp": [t], "blob_id": [b], "seq": [s], "is_deleted": [gone], "data": [data]})

    state = "timestamp long, blob_id long, seq long, is_deleted boolean, data binary"
    return stream.select("key", "timestamp", "blob_id", "seq", "is_deleted", "data").groupBy("key").applyInPandasWithState(step, out, state, "update", "NoTimeout")


def insert(stream: DataFrame, only_if_presented: bool = False) -> DataFrame:
    """Operations that a conditional insert writes, in order of seq within a
    batch; timestamps may come in any order."""
    narrow = stream.select("key", "timestamp", "seq", "is_deleted")
    kind = stream.schema["key"].dataType.simpleString()

    def step(key, pdfs, state):
        best = tuple(state.get) if state.exists else None
        ops, kept = pd.concat(list(pdfs), ignore_index=True).sort_values("seq"), []
        for ts, seq, gone in zip(ops.timestamp, ops.seq, ops.is_deleted):
            present = best is not None and not best[2]
            write = (present or not only_if_presented) if gone else not present
            kept.append(write)
            if write and (best is None or (ts, seq) >= best[:2]):
                best = (int(ts), int(seq), bool(gone))
        if best is not None:
            state.update(best)
        yield ops[kept]

    return narrow.groupBy("key").applyInPandasWithState(step, f"key {kind}, timestamp long, seq long, is_deleted boolean", "timestamp long, seq long, is_deleted boolean", "append", "NoTimeout")
