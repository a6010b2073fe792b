"""CRC-32C (Castagnoli) of binary columns: Spark's crc32 is another polynomial."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Bytes of a block: what is summed byte by byte, for all blocks of all values at once.
BLOCK = 1024


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0x82F63B78), c >> 1)
    return c


_TABLE = _table()


def _shift_tables(n: int) -> np.ndarray:
    """What n zero bytes make of a register, which is linear: by its four bytes."""
    c = (np.arange(4, dtype=np.uint32)[:, None] * 8).astype(np.uint32)
    c = (np.arange(256, dtype=np.uint32)[None, :] << c).astype(np.uint32)
    for _ in range(n):
        c = _TABLE[c & 0xFF] ^ (c >> 8)
    return c


_SHIFT = _shift_tables(BLOCK)


def _shifted(c: np.ndarray) -> np.ndarray:
    return _SHIFT[0][c & 0xFF] ^ _SHIFT[1][c >> 8 & 0xFF] ^ _SHIFT[2][c >> 16 & 0xFF] ^ _SHIFT[3][c >> 24]


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """Checksums of many values at once. Values are cut in blocks, the first the
    shorter one; a step takes one byte of every block that still has one, so
    Python runs BLOCK times whatever the sizes, and once more for each block
    of the longest value, to join the blocks."""
    size = np.array([len(v) for v in values], np.int64)
    flat = np.frombuffer(b"".join(values), np.uint8)
    blocks = np.maximum(1, -(-size // BLOCK))
    last = np.cumsum(blocks)
    first = last - blocks
    length = np.full(last[-1] if len(last) else 0, BLOCK, np.int64)
    length[first] = size - (blocks - 1) * BLOCK
    begin = np.cumsum(length) - length
    crc = np.zeros(len(length), np.uint32)
    crc[first] = 0xFFFFFFFF
    order = np.argsort(-length, kind="stable")
    b, n_, c = begin[order], length[order], crc[order]
    for p in range(n_[0] if len(n_) else 0):
        n = np.searchsorted(-n_, -p, "left")  # blocks longer than p
        x = c[:n]
        c[:n] = _TABLE[(x ^ flat[b[:n] + p]) & 0xFF] ^ (x >> 8)
    crc[order] = c
    out = crc[first]
    order = np.argsort(-blocks, kind="stable")
    for k in range(1, blocks.max() if len(blocks) else 0):
        at = order[: np.searchsorted(-blocks[order], -k, "left")]  # values of more than k blocks
        out[at] = _shifted(out[at]) ^ crc[first[at] + k]
    return out ^ np.uint32(0xFFFFFFFF)


_PLAIN = _TABLE.tolist()


def crc32c_one(value: bytes) -> int:
    """Checksum of one value: short ones byte by byte."""
    if len(value) > BLOCK:
        return int(crc32c_many([value])[0])
    c = 0xFFFFFFFF
    for x in value:
        c = _PLAIN[(c ^ x) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


@pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """Unsigned checksum; null for null."""
    sums = crc32c_many([x if x is not None else b"" for x in data]).astype("int64")
    return pd.Series(sums, index=data.index).where(data.notna(), None).astype("Int64")
