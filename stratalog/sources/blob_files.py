"""Binary blob files: one append-only file a blob, named {prefix}.{id}.blob.

All numbers are little-endian, lengths 64-bit.
  blob header    magic u64, version u32, flags u64
  record header  magic u64, key (length, bytes), meta_size u64, data_size u64,
                 flags u8 (1: tombstone), blob_offset u64, timestamp u64,
                 data_crc u32, header_crc u32 (CRC-32C over the header with
                 this field zero)
  record         header, metadata (count, then length and bytes of each name
                 and value), data
Files are read as whole rows by Spark's binary source, so they may lie in any
store; a blob's size is bounded by its rotation limit. What writes files
(blobs, recovered ones) needs a directory that all executors mount.
"""

from __future__ import annotations

import struct
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.checksum import crc32c_one
from stratalog.operators.integrity import BLOB_MAGIC, BLOB_VERSION, RECORD_MAGIC, first_errors, triage

_U64 = struct.Struct("<Q")
SCHEMA = (
    "blob_id long, seq long, key binary, timestamp long, meta map<string,binary>, data binary, is_deleted boolean, "
    "blob_offset long, meta_size long, data_size long, data_checksum long, header_checksum long, error_kind string"
)


def pack_meta(meta: dict) -> bytes:
    out = [_U64.pack(len(meta))]
    for k, v in meta.items():
        name = k.encode()
        out += [_U64.pack(len(name)), name, _U64.pack(len(v)), bytes(v)]
    return b"".join(out)


def _unpack_meta(raw: bytes) -> dict:
    (n,), at, out = _U64.unpack_from(raw), 8, {}
    for _ in range(n):
        parts = []
        for _ in range(2):
            (size,) = _U64.unpack_from(raw, at)
            if at + 8 + size > len(raw):
                raise struct.error("metadata ends early")
            parts.append(raw[at + 8 : at + 8 + size])
            at += 8 + size
        out[parts[0].decode()] = parts[1]
    return out


def pack_record(key: bytes, timestamp: int, meta: dict, data: bytes, is_deleted: bool, offset: int) -> bytes:
    m = pack_meta(meta)
    head = _U64.pack(RECORD_MAGIC) + _U64.pack(len(key)) + key + struct.pack("<QQBQQI", len(m), len(data), int(is_deleted), offset, timestamp, crc32c_one(data))
    return head + struct.pack("<I", crc32c_one(head + bytes(4))) + m + data


def pack_blob(records) -> bytes:
    """A blob of (key, timestamp, meta, data, is_deleted) in order."""
    out = bytearray(struct.pack("<QIQ", BLOB_MAGIC, BLOB_VERSION, 0))
    for r in records:
        out += pack_record(*r, offset=len(out))
    return bytes(out)


def unpack_blob(raw, check_data: bool = True, size: int | None = None):
    """Records as dicts with error_kind (None if sound). A header that fails is
    passed over by its own sizes, where they lie inside the file; a second one
    at once ends the blob, as does a blob header that fails. raw: the bytes, or
    a function of place and number of bytes, with the file's size."""
    read, total = (raw, size) if size is not None else (lambda at, n: raw[at : at + n], len(raw))
    if total < 20:
        yield {"error_kind": "Bincode"}
        return
    magic, version, _ = struct.unpack("<QIQ", read(0, 20))
    if magic != BLOB_MAGIC or version != BLOB_VERSION:
        yield {"error_kind": "BlobMagicByte" if magic != BLOB_MAGIC else "BlobVersion"}
        return
    at, failed = 20, False
    while at < total:
        try:
            magic, key_size = struct.unpack("<QQ", read(at, 16))
            end = at + 16 + key_size + 41
            if end > total:
                if magic != RECORD_MAGIC:
                    yield {"error_kind": "RecordMagicByte", "blob_offset": at}
                    return
                raise struct.error("header ends early")
            head = read(at, end - at)
            meta_size, data_size, flags, offset, ts, data_crc, head_crc = struct.unpack_from("<QQBQQII", head, 16 + key_size)
            wrong = "RecordMagicByte" if magic != RECORD_MAGIC else "RecordHeaderChecksum" if crc32c_one(head[:-4] + bytes(4)) != head_crc else None
            if wrong:
                yield {"error_kind": wrong, "blob_offset": at}
                if failed or end + meta_size + data_size > total:
                    return
                at, failed = end + meta_size + data_size, True
                continue
            if end + meta_size + data_size > total:
                raise struct.error("record ends early")
            meta, data = _unpack_meta(read(end, meta_size)), read(end + meta_size, data_size)
        except (struct.error, UnicodeDecodeError):
            yield {"error_kind": "Bincode", "blob_offset": at}
            return
        failed = False
        bad = check_data and crc32c_one(data) != data_crc
        yield {"key": head[16 : 16 + key_size], "timestamp": ts, "meta": meta, "data": data, "is_deleted": bool(flags & 1), "blob_offset": at, "meta_size": meta_size, "data_size": data_size,
               "data_checksum": data_crc, "header_checksum": head_crc, "error_kind": "RecordDataChecksum" if bad else None}
        at = end + meta_size + data_size


def recovered(raw: bytes, skip_wrong: bool = True):
    """The sound records of a damaged blob, as (key, timestamp, meta, data,
    is_deleted): one bad record is passed over (skip_wrong), a second at once,
    or bytes that are no record, end the copy."""
    failed = False
    for r in unpack_blob(raw):
        kind = r["error_kind"]
        if kind is None:
            failed = False
            yield r["key"], r["timestamp"], r["meta"], r["data"], r["is_deleted"]
        elif failed or not skip_wrong or kind in ("Bincode", "BlobMagicByte", "BlobVersion"):
            return
        else:
            failed = True


_COLUMNS = [c.split(" ")[0] for c in SCHEMA.replace("map<string,binary>", "map").split(", ")]


def read_blobs(spark: SparkSession, path: str, check_data: bool = True) -> DataFrame:
    """All records of the *.blob files in a directory, in file order by seq
    (unique over blobs of under 2**32 bytes). Files whose name has no id are
    passed over. Damage shows in error_kind, never as an exception."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(path)
    blob_id = F.regexp_extract("path", r"/[^/.]+\.(\d+)\.blob$", 1)
    named = files.select(blob_id.alias("id"), "content").filter("id <> ''").select(F.col("id").cast("long").alias("blob_id"), "content")

    return parse_blobs(named, check_data)


def _frames(blob: int, raw: bytes, check_data: bool):
    """A blob's records as frames of 2,000 at most."""
    records = enumerate(unpack_blob(raw, check_data))
    while rows := [{**dict.fromkeys(_COLUMNS), "blob_id": blob, "seq": (blob << 32) + n, **r} for n, r in islice(records, 2000)]:
        yield pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in ("timestamp", "blob_offset", "meta_size", "data_size", "data_checksum", "header_checksum")})


def parse_blobs(contents: DataFrame, check_data: bool = True) -> DataFrame:
    """All records of blobs (blob_id, content), as ``read_blobs`` gives them.
    Spark hands over up to 10,000 rows at once; for blobs made of a log see
    ``parse_log``."""

    def parse(batches):
        for pdf in batches:
            for blob, raw in zip(pdf.blob_id, pdf.content):
                yield from _frames(blob, raw, check_data)

    return contents.select("blob_id", "content").mapInPandas(parse, SCHEMA)


def parse_log(log: DataFrame, *steps, check_data: bool = True) -> DataFrame:
    """The records of a log written as blobs' bytes and read again, as
    ``read_blobs`` gives them. steps: what becomes of the bytes in between, each
    a function of a blob's id and bytes. A task holds one blob, as bytes never
    leave it."""

    def parse(blob, raw):
        for step in steps:
            raw = step(blob, raw)
        frames = list(_frames(blob, raw, check_data))
        return pd.concat(frames) if frames else pd.DataFrame(columns=_COLUMNS)

    return _each_blob(log, parse, SCHEMA)


def recover_content(blob: int, raw: bytes) -> bytes:
    """The sound records of a blob's bytes: a step of ``parse_log``."""
    return pack_blob(recovered(raw))


def recover_contents(contents: DataFrame, skip_wrong: bool = True) -> DataFrame:
    """(blob_id, content) of the sound records of blobs (blob_id, content).
    Spark hands over up to 10,000 rows at once."""

    def copy(batches):
        for pdf in batches:
            for blob, raw in zip(pdf.blob_id, pdf.content):
                yield pd.DataFrame({"blob_id": [blob], "content": [pack_blob(recovered(raw, skip_wrong))]})

    return contents.select("blob_id", "content").mapInPandas(copy, "blob_id long, content binary")


def blob_headers(spark: SparkSession, path: str) -> DataFrame:
    """(blob_id, magic, version, flags, file_size) of the *.blob files in a
    directory; null where a file is shorter than a header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(path)
    head = F.hex(F.substring("content", 1, 20))

    def number(at: int, n: int):
        return F.conv(F.concat(*(F.substring(head, 2 * (at + i) + 1, 2) for i in range(n - 1, -1, -1))), 16, 10).cast("long")

    whole = F.length("content") >= 20
    named = files.withColumn("id", F.regexp_extract("path", r"/[^/.]+\.(\d+)\.blob$", 1)).filter("id <> ''")
    return named.select(F.col("id").cast("long").alias("blob_id"), *(F.when(whole, number(at, n)).alias(c) for c, at, n in (("magic", 0, 8), ("version", 8, 4), ("flags", 12, 8))), F.col("length").alias("file_size"))


def _each_blob(log: DataFrame, f, schema: str) -> DataFrame:
    """The frames f(blob_id, bytes) of each blob of a log, records by seq. A blob
    is one task's work; rotation bounds it. f runs in the task that makes the
    bytes, so that a task holds one blob: rows of bytes would be handed from
    step to step 10,000 at once."""

    def build(key, pdf):
        pdf = pdf.sort_values("seq")
        raw = pack_blob((bytes(k), int(t), dict(m or {}), bytes(d if d is not None else b""), bool(x)) for k, t, m, d, x in zip(pdf.key, pdf.timestamp, pdf.meta, pdf.data, pdf.is_deleted))
        return f(int(key[0]), raw)

    return log.select("blob_id", "seq", "key", "timestamp", "meta", "data", "is_deleted").groupBy("blob_id").applyInPandas(build, schema)


def blob_contents(log: DataFrame) -> DataFrame:
    """(blob_id, content): the bytes of each blob."""
    return _each_blob(log, lambda blob, raw: pd.DataFrame({"blob_id": [blob], "content": [raw]}), "blob_id long, content binary")


def write_blobs(log: DataFrame, directory: str, prefix: str = "log") -> DataFrame:
    """Write each blob to a directory that all executors mount; returns
    (blob_id, path, bytes), evaluated once by the caller. A file appears whole
    or not at all, so a repeated task does no harm."""
    if not prefix or "." in prefix:
        raise ValueError("a prefix must not be empty or hold a dot")

    def save(blob, raw):
        import os

        path = os.path.join(directory, f"{prefix}.{blob}.blob")
        _save(path, raw)
        return pd.DataFrame({"blob_id": [blob], "path": [path], "bytes": [len(raw)]})

    return _each_blob(log, save, "blob_id long, path string, bytes long")


def _save(path: str, raw: bytes) -> None:
    import os

    with open(f"{path}.{os.getpid()}", "wb") as f:
        f.write(raw)
    os.replace(f"{path}.{os.getpid()}", path)


def _reread(path: str, records: list, every: int) -> None:
    """Compare a written blob with what it was made of, ``every`` records at a time."""
    with open(path, "rb") as f:
        back = recovered(f.read(), skip_wrong=False)
    for s in range(0, len(records), every):
        if list(islice(back, every)) != records[s : s + every]:
            raise OSError(f"{path}: records from {s} differ from what was written")
    if next(back, None) is not None:
        raise OSError(f"{path}: more records than were written")


def recover_blobs(spark: SparkSession, source: str, target: str, validate_every: int = 0, skip_wrong: bool = True) -> DataFrame:
    """Copy the sound records of every *.blob file of a directory to files of
    the same names in another; (blob_id, path, records, dropped, bytes),
    evaluated once by the caller. With validate_every the written file is read
    again and compared, as many records at a time."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a blob is not recovered onto itself")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(source)
    named = files.select(F.regexp_extract("path", r"/([^/.]+\.\d+\.blob)$", 1).alias("name"), "content").filter("name <> ''")

    def copy(batches):
        import os

        for pdf in batches:
            for name, raw in zip(pdf.name, pdf.content):
                records = list(recovered(raw, skip_wrong))
                path, new = os.path.join(target, name), pack_blob(records)
                os.makedirs(target, exist_ok=True)
                _save(path, new)
                if validate_every:
                    _reread(path, records, validate_every)
                dropped = sum(r["error_kind"] is not None for r in unpack_blob(raw))
                yield pd.DataFrame({"blob_id": [int(name.split(".")[1])], "path": [path], "records": [len(records)], "dropped": [dropped], "bytes": [len(new)]})

    return named.mapInPandas(copy, "blob_id long, path string, records long, dropped long, bytes long")


def _files(spark: SparkSession, directory: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _move(spark: SparkSession, directory: str, names: list[str], target: str) -> None:
    fs, _ = _files(spark, directory)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(target))
    for n in names:
        if not fs.rename(path(directory, n), path(target, n)):
            raise OSError(f"cannot move {n} to {target}")


def _names(spark: SparkSession, directory: str) -> dict[int, str]:
    """Blob files of a directory by id; names without one are passed over."""
    fs, path = _files(spark, directory)
    found = {}
    for s in fs.listStatus(path) if fs.exists(path) else []:
        parts = s.getPath().getName().split(".")
        if len(parts) == 3 and parts[2] == "blob" and parts[1].isdigit():
            found[int(parts[1])] = s.getPath().getName()
    return found


def move_and_recover(spark: SparkSession, directory: str, backup: str, validate_every: int = 0) -> list:
    """Move a directory's blob files to another and put what can be recovered
    of each in its place; the rows of ``recover_blobs``."""
    _move(spark, directory, list(_names(spark, directory).values()), backup)
    return recover_blobs(spark, backup, directory, validate_every).collect()


def open_blobs(spark: SparkSession, directory: str, corrupted: str = "corrupted", ignore_corrupted: bool = False, check_data: bool = False) -> tuple[DataFrame, list]:
    """(log, actions) of a directory's blobs. Damaged ones move to the directory
    named by ``corrupted`` (under this one), or stay and are passed over if
    ignored; a version that is not known fails unless ignored. actions: rows of
    blob_id, error_kind and action, one a blob."""
    records = read_blobs(spark, directory, check_data)
    actions = triage(first_errors(records), ignore_corrupted).orderBy("blob_id").collect()
    unknown = [r.blob_id for r in actions if r.action == "fail"]
    if unknown:
        raise ValueError(f"BlobVersion: blobs {unknown}")
    names = _names(spark, directory)
    _move(spark, directory, [names[r.blob_id] for r in actions if r.action == "quarantine"], f"{directory.rstrip('/')}/{corrupted}")
    sound = [r.blob_id for r in actions if r.action == "open"]
    return read_blobs(spark, directory, check_data).filter(F.col("blob_id").isin(sound) if sound else F.lit(False)), actions


def corrupted_blobs_count(spark: SparkSession, directory: str, corrupted: str = "corrupted") -> int:
    return len(_names(spark, f"{directory.rstrip('/')}/{corrupted}"))


INDEX_VERSION = 1
_HEADER = ["key", "timestamp", "seq", "is_deleted", "blob_offset", "meta_size", "data_size", "data_checksum", "header_checksum"]


def regenerate_index(spark: SparkSession, directory: str, check_data: bool = False) -> DataFrame:
    """The headers of all records, read from the blobs; check_data leaves out
    records whose data fails."""
    return headers_of(read_blobs(spark, directory, check_data))


def headers_of(records: DataFrame) -> DataFrame:
    return records.filter("error_kind is null").select("blob_id", *_HEADER)


def _digest():
    """A checksum of a blob's headers that any order of reading gives."""
    return F.sum(F.xxhash64(*_HEADER).cast("decimal(38,0)")).alias("digest")


def write_index(index: DataFrame, path: str) -> None:
    """Write an index by key, so that a lookup reads few row groups, and a row
    a blob of what it was made from."""
    ordered = index.repartitionByRange("blob_id", "key").sortWithinPartitions("blob_id", "key", F.desc("timestamp"), F.desc("seq"))
    ordered.write.mode("overwrite").parquet(f"{path}/headers")
    size = F.max(F.col("blob_offset") + F.octet_length("key") + 57 + F.col("meta_size") + F.col("data_size"))
    about = index.groupBy("blob_id").agg(F.max(F.octet_length("key")).alias("key_size"), size.alias("blob_size"), F.count("*").alias("records"), _digest())
    about.withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite").parquet(f"{path}/blobs")


def validate_index(spark: SparkSession, path: str, directory: str, key_size: int | None = None) -> DataFrame:
    """(blob_id, error_kind): the first that is wrong of each blob's index:
    version, key size, blob size, checksum of the headers, a header that the
    blob does not hold. Sound ones have no row."""
    about, headers = spark.read.parquet(f"{path}/blobs"), spark.read.parquet(f"{path}/headers")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(directory).select(F.regexp_extract("path", r"/[^/.]+\.(\d+)\.blob$", 1).cast("long").alias("blob_id"), F.col("length").alias("file_size"))
    now = headers.groupBy("blob_id").agg(_digest().alias("now"))
    held = read_blobs(spark, directory, False).filter("error_kind is null").select("blob_id", "blob_offset", "header_checksum")
    stray = headers.select("blob_id", "blob_offset", "header_checksum").join(held, ["blob_id", "blob_offset", "header_checksum"], "left_anti").select("blob_id").distinct().withColumn("stray", F.lit(True))
    rows = about.join(files, "blob_id", "left").join(now, "blob_id", "left").join(stray, "blob_id", "left")
    wrong_key = F.lit(False) if key_size is None else F.col("key_size") != key_size
    kind = (
        F.when(F.col("version") != INDEX_VERSION, "IndexVersion").when(wrong_key, "IndexKeySize").when(~F.col("blob_size").eqNullSafe(F.col("file_size")), "IndexBlobSize")
        .when(~F.col("digest").eqNullSafe(F.col("now")), "IndexChecksum").when(F.col("stray"), "RecordHeaderChecksum")
    )
    return rows.select("blob_id", kind.alias("error_kind")).filter("error_kind is not null")


def write_clustered(log: DataFrame, path: str, files: int | None = None) -> None:
    """Write a log as Parquet by ranges of keys, sorted, newest first: what a key
    needs lies in one file and few row groups, and their statistics tell.
    ``files``: how many (by default as Spark sizes its shuffles)."""
    ordered = (log.repartitionByRange(files, "key", "timestamp") if files else log.repartitionByRange("key", "timestamp")).sortWithinPartitions("key", F.desc("timestamp"), F.desc("blob_id"), F.desc("seq"))
    ordered.write.mode("overwrite").parquet(path)
