"""A store: a directory of Parquet segments with the log's operators as methods.

Writes append whole batches; reads are queries over the segments that the
filters allow. A manifest holds what a writer must know (next number, segments
and their sizes), so writes need no query over the log but the look for
duplicates. Each batch adds its keys' ranges and Bloom words to the filters'
tables. One process writes a store at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import filters, reads, segments, stats, writes
from stratalog.sources import blob_files

SCHEMA = "key binary, timestamp long, seq long, is_deleted boolean, meta map<string,binary>, data binary, size long, blob_id long"
_COLUMNS = [c.split(" ")[0] for c in SCHEMA.replace("map<string,binary>", "map").split(", ")]


class StoreError(Exception):
    """kind: Uninitialized, ActiveBlobExists, ActiveBlobDoesntExist, WorkDirUnavailable, BlobKeySize or BlobVersion."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind} {detail}".strip())
        self.kind = kind


@dataclass
class Options:
    """Limits and modes of a store; the first three have no default."""

    work_dir: str | None = None
    max_data_in_blob: int | None = None
    max_blob_size: int | None = None
    key_size: int | None = None
    allow_duplicates: bool = False
    create_work_dir: bool = True
    corrupted_dir: str = "corrupted"
    ignore_corrupted: bool = False
    blob_file_name_prefix: str = "log"
    validate_data_during_index_regen: bool = False
    bloom_hashers: int = 2
    bloom_elements: int = 100_000
    bloom_max_bits: int = 8_388_608
    bloom_fpr: float = 0.001
    bloom_group_size: int = 8

    def build(self, spark: SparkSession) -> Store:
        for name in ("work_dir", "max_data_in_blob", "max_blob_size"):
            if not getattr(self, name):
                raise StoreError("Uninitialized", f"{name} is missing")
        return Store(spark, self)


class Store:
    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.options, self.active, self._ready = spark, options, None, False
        self._bits = filters.bloom_bits(options.bloom_elements, options.bloom_hashers, options.bloom_max_bits, options.bloom_fpr) if options.bloom_hashers else 0
        self._state = {"seq": 0, "last": -1, "segments": {}}  # segments: id -> [records, bytes without header]

    # files

    def _at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.options.work_dir.rstrip('/')}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _save(self) -> None:
        """Replace the manifest: it appears whole or not at all."""
        fs, new = self._at("manifest.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self._state).encode()))
        out.close()
        _, path = self._at("manifest.json")
        fs.delete(path, False)
        fs.rename(new, path)

    def _load(self) -> bool:
        for name in ("manifest.json", "manifest.new"):  # the latter where a writer was stopped between the two steps
            fs, path = self._at(name)
            if fs.exists(path):
                text = self.spark.read.option("wholetext", True).text(path.toString()).first()[0]
                self._state = json.loads(text)
                self._state["segments"] = {int(k): v for k, v in self._state["segments"].items()}
                return True
        return False

    def init(self, lazy: bool = False) -> Store:
        """Open or create the directory; the newest segment becomes active again
        unless lazy. A new store always gets an active segment."""
        fs, path = self._at()
        if not fs.exists(path):
            if not self.options.create_work_dir:
                raise StoreError("WorkDirUnavailable", self.options.work_dir)
            fs.mkdirs(path)
        self._ready = True
        found = self._load() and self._state["segments"]
        self.active = (None if lazy else self._state["last"]) if found else 0
        self._state["last"] = max(self._state["last"], -1 if self.active is None else self.active)
        return self

    def _table(self, name: str, schema: str) -> DataFrame:
        fs, path = self._at(name)
        return self.spark.read.schema(schema).parquet(path.toString()) if fs.exists(path) else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        if not self._ready:
            raise StoreError("Uninitialized")
        return self._table("blobs", SCHEMA)

    def tree(self) -> filters.FilterTree:
        """The filters of all segments, from what each batch has added."""
        o = self.options
        ranges = self._table("ranges", "blob_id long, low binary, high binary").groupBy("blob_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        words = self._table("words", "blob_id long, word long, bits long").groupBy("blob_id", "word").agg(F.bit_or("bits").alias("bits")) if o.bloom_hashers else None
        return filters.FilterTree(ranges, words, o.bloom_hashers, self._bits, o.bloom_group_size)

    # writes

    def write(self, key: bytes, value: bytes, timestamp: int) -> None:
        self.write_with(key, value, timestamp, {})

    def write_with(self, key: bytes, value: bytes, timestamp: int, meta: dict[str, bytes]) -> None:
        if self.options.key_size and len(key) != self.options.key_size:
            raise StoreError("BlobKeySize")
        schema = "key binary, timestamp long, seq long, meta map<string,binary>, data binary"
        one = self.spark.createDataFrame([(bytearray(key), timestamp, self._state["seq"], {k: bytearray(v) for k, v in meta.items()}, bytearray(value))], schema).withColumn("is_deleted", F.lit(False))
        if not self.options.allow_duplicates and self._state["segments"] and writes.insert_into(self._of(key), one, bool(meta)).isEmpty():
            return
        self._append_one(one)

    def write_rows(self, rows: DataFrame, by_meta: bool = False) -> None:
        """Append puts (key, timestamp, meta, data) in order of seq; without
        duplicates those whose key (by_meta: and metadata) is present are dropped.
        Segments rotate inside the batch."""
        puts = rows.withColumn("is_deleted", F.lit(False))
        if self.options.key_size and not puts.filter(F.octet_length("key") != self.options.key_size).isEmpty():
            raise StoreError("BlobKeySize")
        if not self.options.allow_duplicates:
            puts = writes.insert_into(self._possible(puts.select("key").distinct()), puts, by_meta)
        numbered = segments.numbered(puts, "seq", "_n")
        self._append(numbered.withColumn("seq", F.col("_n") + self._state["seq"]).drop("_n"))

    def _possible(self, keys: DataFrame) -> DataFrame:
        """The log's rows of keys, from the segments whose filters allow them."""
        pairs = self.tree().possible(keys)
        return self.log().join(pairs, ["blob_id", "key"], "left_semi")

    def _append(self, rows: DataFrame) -> None:
        """Write rows (with seq) to the active segment and, as it fills, to new ones."""
        o = self.options
        if self.active is None:
            self.try_create_active_blob()
        sized = rows.withColumn("size", segments.record_size(F.octet_length("key"), F.col("meta"), F.col("data")))
        held = self._state["segments"].get(self.active, [0, 0])
        fresh = segments.rotate(sized.select("seq", "size"), o.max_blob_size, o.max_data_in_blob, held[1] + segments.BLOB_HEADER, held[0])
        self._write(sized.join(fresh.withColumn("blob_id", F.col("blob_id") + self.active), "seq"))
        self.active = max([self.active, *self._state["segments"]])
        self._rotate()

    def _append_one(self, row: DataFrame) -> None:
        """Write one row to the active segment, which has room: full ones rotate at once."""
        if self.active is None:
            self.try_create_active_blob()
        self._write(row.withColumn("size", segments.record_size(F.octet_length("key"), F.col("meta"), F.col("data"))).withColumn("blob_id", F.lit(self.active)))
        self._rotate()

    def _rotate(self) -> None:
        o, n = self.options, self._state["segments"].get(self.active, [0, 0])
        self._state["last"] = max(self._state["last"], self.active)
        if n[0] >= o.max_data_in_blob or n[1] + segments.BLOB_HEADER >= o.max_blob_size:
            self.active = self._state["last"] = self._state["last"] + 1
        self._save()

    def _write(self, rows: DataFrame) -> None:
        """Write rows with blob_id, their filters and their counts."""
        o = self.options
        part = rows.withColumn("blob_id", F.col("blob_id").cast("long")).select(*_COLUMNS).persist()
        try:
            new = part.groupBy("blob_id").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.max("seq").alias("last")).collect()  # a row a segment
            if not new:
                return
            part.write.mode("append").partitionBy("blob_id").parquet(self._at("blobs")[1].toString())
            filters.range_filter(part).write.mode("append").parquet(self._at("ranges")[1].toString())
            if o.bloom_hashers:
                filters.bloom(part, o.bloom_hashers, self._bits).write.mode("append").parquet(self._at("words")[1].toString())
        finally:
            part.unpersist()
        for r in new:
            n = self._state["segments"].setdefault(r.blob_id, [0, 0])
            n[0], n[1] = n[0] + r.n, n[1] + r.s
            self._state["seq"] = max(self._state["seq"], r["last"] + 1)

    def delete(self, key: bytes, timestamp: int, only_if_presented: bool = True, meta: dict[str, bytes] | None = None) -> int:
        """Append tombstones: to every closed segment whose own newest version
        of the key is live, and to the active one if its is, or always (not
        only_if_presented). Returns the number of segments marked."""
        one = self.spark.createDataFrame([(bytearray(key),)], "key binary")
        if self.active is None and not only_if_presented:
            self.try_create_active_blob()
        marked = [r.blob_id for r in writes.delete_plan(self._possible(one), one, only_if_presented, self.active).orderBy("blob_id").collect()]
        if marked:
            rows = [(bytearray(key), timestamp, self._state["seq"] + i, True, {k: bytearray(v) for k, v in (meta or {}).items()}, bytearray(), b) for i, b in enumerate(marked)]
            stones = self.spark.createDataFrame(rows, "key binary, timestamp long, seq long, is_deleted boolean, meta map<string,binary>, data binary, blob_id long")
            self._write(stones.withColumn("size", segments.record_size(F.octet_length("key"), F.col("meta"), F.col("data"))))
            self._rotate() if self.active is not None else self._save()
        return len(marked)

    # segments

    def has_active_blob(self) -> bool:
        return self.active is not None

    def try_create_active_blob(self) -> None:
        if self.active is not None:
            raise StoreError("ActiveBlobExists")
        self.active = self._state["last"] = self._state["last"] + 1

    def try_close_active_blob(self) -> None:
        if self.active is None:
            raise StoreError("ActiveBlobDoesntExist")
        self.active = None

    def try_restore_active_blob(self) -> None:
        if self.active is not None:
            raise StoreError("ActiveBlobExists")
        if self._state["last"] < 0:
            raise StoreError("Uninitialized")
        self.active = self._state["last"]

    def force_update_active_blob(self, wanted: Callable[[dict | None], bool]) -> None:
        """Rotate if the predicate holds for the active segment's statistics."""
        n = self._state["segments"].get(self.active, [0, 0]) if self.active is not None else None
        if wanted(n and {"records_count": n[0], "file_size": n[1] + segments.BLOB_HEADER}):
            self.active = self._state["last"] = self._state["last"] + 1

    def close(self) -> None:
        if self._ready:
            self._save()
        self.active, self._ready = None, False

    # blob files

    def import_blobs(self, directory: str) -> list:
        """Append the records of a directory's blob files, each file a segment of
        its own; damaged files move to ``corrupted_dir`` (or are ignored). The
        actions taken, one a file."""
        o = self.options
        try:
            log, actions = blob_files.open_blobs(self.spark, directory, o.corrupted_dir, o.ignore_corrupted, o.validate_data_during_index_regen)
        except ValueError as e:
            raise StoreError("BlobVersion", str(e)) from e
        if o.key_size and not log.filter(F.octet_length("key") != o.key_size).isEmpty():
            raise StoreError("BlobKeySize")
        first = self._state["last"] + 1
        ids = {r.blob_id: first + i for i, r in enumerate(r for r in actions if r.action == "open")}
        if ids:
            names = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
            rows = segments.numbered(log, "seq", "_n").withColumn("seq", F.col("_n") + self._state["seq"]).withColumn("blob_id", F.element_at(names, F.col("blob_id")))
            self._write(rows.withColumn("size", segments.record_size(F.octet_length("key"), F.col("meta"), F.col("data"))))
            self._state["last"] = max(ids.values())
            self._save()
        return actions

    def export_blobs(self, directory: str) -> DataFrame:
        """Write every segment as a blob file; see ``blob_files.write_blobs``."""
        return blob_files.write_blobs(self.log(), directory, self.options.blob_file_name_prefix)

    def corrupted_blobs_count(self, directory: str) -> int:
        return blob_files.corrupted_blobs_count(self.spark, directory, self.options.corrupted_dir)

    # reads: DataFrames over all keys; pass a key for one

    def _of(self, key: bytes | None) -> DataFrame:
        """The log, of one key those segments that the filters allow."""
        log = self.log()
        if key is None:
            return log
        one = self.spark.createDataFrame([(bytearray(key),)], "key binary")
        blobs = [r.blob_id for r in self.tree().possible(one).collect()]  # one key's segments
        return log.filter((F.col("blob_id").isin(blobs) if blobs else F.lit(False)) & (F.col("key") == F.lit(bytearray(key))))

    def read(self, key: bytes | None = None) -> DataFrame:
        return reads.read(self._of(key))

    def read_with(self, meta: Column, key: bytes | None = None) -> DataFrame:
        return reads.read_with(self._of(key), meta, "data")

    def read_all(self, key: bytes | None = None) -> DataFrame:
        return reads.history(self._of(key))

    def read_all_with_deletion_marker(self, key: bytes | None = None) -> DataFrame:
        return reads.history_with_marker(self._of(key))

    def contains(self, probes: DataFrame) -> DataFrame:
        return reads.contains(self._possible(probes.select("key").distinct()), probes)

    def check_filters(self, probes: DataFrame) -> DataFrame:
        """key, maybe: by ranges and Bloom filters of groups and segments."""
        return self.tree().check(probes)

    def filter_memory_allocated(self) -> int:
        return self.tree().memory().first()[0]

    def records_count(self) -> int:
        return sum(n for n, _ in self._state["segments"].values())

    def records_count_detailed(self) -> DataFrame:
        return stats.records_count_detailed(self.log())

    def records_count_in_active_blob(self) -> int | None:
        return None if self.active is None else self._state["segments"].get(self.active, [0, 0])[0]

    def blobs_count(self) -> int:
        return self._state["last"] + 1

    def next_blob_id(self) -> int:
        return self._state["last"] + 1

    def disk_used(self) -> int:
        return sum(s + segments.BLOB_HEADER for _, s in self._state["segments"].values())
