import os

import pytest
from pyspark.sql import functions as F

from stratalog.plans.store import Options, StoreError
from stratalog.sources import blob_files
from stratalog.streaming import stateful

RECORDS = [(b"\x00\x01", 5, {"v": b"1"}, b"hello", False), (b"\x00\x02", 6, {}, b"", True), (b"\x00\x03", 7, {"a": b"x", "b": b""}, b"z" * 300, False)]
SCHEMA = "key binary, timestamp long, meta map<string,binary>, data binary, is_deleted boolean, blob_id long, seq long"


def _log(spark):
    return spark.createDataFrame([(bytearray(k), t, {a: bytearray(b) for a, b in m.items()}, bytearray(d), x, n // 2, n) for n, (k, t, m, d, x) in enumerate(RECORDS)], SCHEMA)


def test_blob_round_trip(spark, tmp_path):
    assert blob_files.write_blobs(_log(spark), str(tmp_path)).orderBy("blob_id").collect()[0]["path"].endswith("log.0.blob")
    (tmp_path / "other.blob").write_bytes(b"")
    got = blob_files.read_blobs(spark, str(tmp_path)).orderBy("blob_id", "seq").collect()
    assert [(bytes(r.key), r.timestamp, {k: bytes(v) for k, v in r.meta.items()}, bytes(r.data), r.is_deleted) for r in got] == RECORDS
    assert all(r.error_kind is None for r in got) and got[0].blob_offset == 20


@pytest.mark.parametrize("at, kind, left", [(0, "BlobMagicByte", 0), (8, "BlobVersion", 0), (20, "RecordMagicByte", 2), (40, "RecordHeaderChecksum", 0), (55, "RecordHeaderChecksum", 2), (-1, "RecordDataChecksum", 2)])
def test_damage_is_a_row(at, kind, left):
    """A header is passed over by its own sizes, unless these are what is damaged."""
    raw = bytearray(blob_files.pack_blob(RECORDS))
    raw[at] ^= 0x55
    got = list(blob_files.unpack_blob(bytes(raw)))
    assert [r["error_kind"] for r in got if r["error_kind"]] == [kind]
    assert len(got) == left + 1
    assert [r[0] for r in blob_files.recovered(bytes(raw))] == [r["key"] for r in got if r["error_kind"] is None]


def _damaged(spark, directory):
    """Blobs 0 to 4: sound; one bad header; bad data twice in a row; another version; cut short."""
    records = [(bytes([0, i]), i, {}, b"data %d" % i, False) for i in range(6)]
    for n in range(5):
        raw = bytearray(blob_files.pack_blob([(bytes([n, i]), *r[1:]) for i, r in enumerate(records)]))
        size = (len(raw) - 20) // 6
        for at in {1: [20 + size + 50], 2: [20 + 3 * size - 1, 20 + 4 * size - 1], 3: [8]}.get(n, []):
            raw[at] ^= 0x55
        (directory / f"log.{n}.blob").write_bytes(bytes(raw[:-3] if n == 4 else raw))


def test_data_source_reads_what_the_binary_source_reads(spark, tmp_path):
    from stratalog.sources.blob_source import BlobSource

    spark.dataSource.register(BlobSource)
    (tmp_path / "none").mkdir()
    assert spark.read.format("record_blobs").option("path", str(tmp_path / "none")).load().count() == 0
    _damaged(spark, tmp_path)
    for check in ("true", "false"):
        a = spark.read.format("record_blobs").option("path", str(tmp_path)).option("check_data", check).load()
        b = blob_files.read_blobs(spark, str(tmp_path), check == "true")
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    heads = {r.blob_id: (r.version, r.flags) for r in blob_files.blob_headers(spark, str(tmp_path)).collect()}
    assert heads == {0: (1, 0), 1: (1, 0), 2: (1, 0), 3: (1 ^ 0x55, 0), 4: (1, 0)}


def test_recovery_from_file_to_file(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    _damaged(spark, src)
    got = {r.blob_id: (r.records, r.dropped) for r in blob_files.recover_blobs(spark, str(src), str(out), validate_every=2).collect()}
    assert got == {0: (6, 0), 1: (5, 1), 2: (2, 2), 3: (0, 1), 4: (5, 1)}
    back = blob_files.read_blobs(spark, str(out)).filter("error_kind is null").groupBy("blob_id").count().collect()
    assert {r.blob_id: r["count"] for r in back} == {0: 6, 1: 5, 2: 2, 4: 5}
    with pytest.raises(ValueError):
        blob_files.recover_blobs(spark, str(src), str(src) + "/")
    rows = blob_files.move_and_recover(spark, str(src), str(tmp_path / "backup"))
    assert len(rows) == 5 and sorted(os.listdir(tmp_path / "backup")) == sorted(f"log.{n}.blob" for n in range(5))
    assert blob_files.read_blobs(spark, str(src)).filter("error_kind is not null").count() == 0
    (out / "log.0.blob").write_bytes(b"other")
    with pytest.raises(OSError):
        blob_files._reread(str(out / "log.0.blob"), [(b"k", 1, {}, b"", False)], 10)


def test_damaged_blobs_move_away(spark, tmp_path):
    _damaged(spark, tmp_path)
    with pytest.raises(ValueError, match="BlobVersion"):
        blob_files.open_blobs(spark, str(tmp_path))
    log, actions = blob_files.open_blobs(spark, str(tmp_path), ignore_corrupted=True)
    assert {r.blob_id: r.action for r in actions} == {0: "open", 1: "skip", 2: "open", 3: "skip", 4: "skip"} and log.count() == 12
    (tmp_path / "log.3.blob").unlink()
    assert blob_files.corrupted_blobs_count(spark, str(tmp_path)) == 0
    log, actions = blob_files.open_blobs(spark, str(tmp_path), check_data=True)
    assert {r.blob_id: r.action for r in actions} == {0: "open", 1: "quarantine", 2: "quarantine", 4: "quarantine"}
    assert log.count() == 6 and blob_files.corrupted_blobs_count(spark, str(tmp_path)) == 3
    assert sorted(os.listdir(tmp_path / "corrupted")) == ["log.1.blob", "log.2.blob", "log.4.blob"]


def test_index_is_regenerated_and_validated(spark, tmp_path):
    blobs, index = tmp_path / "blobs", str(tmp_path / "index")
    blobs.mkdir()
    blob_files.write_blobs(_log(spark), str(blobs)).collect()
    blob_files.write_index(blob_files.regenerate_index(spark, str(blobs), check_data=True), index)
    assert blob_files.validate_index(spark, index, str(blobs), key_size=2).count() == 0
    assert {r.error_kind for r in blob_files.validate_index(spark, index, str(blobs), key_size=4).collect()} == {"IndexKeySize"}
    raw = bytearray((blobs / "log.0.blob").read_bytes())
    (blobs / "log.0.blob").write_bytes(bytes(raw[:-1]))
    assert [tuple(r) for r in blob_files.validate_index(spark, index, str(blobs)).collect()] == [(0, "IndexBlobSize")]
    raw[55] ^= 1
    (blobs / "log.0.blob").write_bytes(bytes(raw))
    assert [tuple(r) for r in blob_files.validate_index(spark, index, str(blobs)).collect()] == [(0, "RecordHeaderChecksum")]
    changed = spark.read.parquet(f"{index}/headers").withColumn("timestamp", F.col("timestamp") + 1)
    changed.write.parquet(f"{index}2/headers")
    spark.read.parquet(f"{index}/blobs").write.parquet(f"{index}2/blobs")
    assert {r.error_kind for r in blob_files.validate_index(spark, f"{index}2", str(blobs)).collect()} == {"IndexChecksum"}


def test_clustered_writes_prune(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("key"), F.col("id").alias("timestamp"), F.lit(0).cast("long").alias("blob_id"), F.col("id").alias("seq"))
    blob_files.write_clustered(rows.repartition(8), str(tmp_path / "c"), files=4)
    found = spark.read.parquet(str(tmp_path / "c")).filter("key = 17")
    assert found.count() == 1 and "EqualTo(key,17)" in found._jdf.queryExecution().executedPlan().toString()
    ends = spark.read.parquet(str(tmp_path / "c")).groupBy(F.input_file_name()).agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("a").collect()
    assert len(ends) == 4 and all(x.b < y.a for x, y in zip(ends, ends[1:]))


def test_blobs_of_a_log_stay_in_their_task(spark, sf_dir, tmp_path):
    """No plan hands rows of blobs' bytes on; records come as they do from such rows."""
    from stratalog.plans import kv

    rows = [kv.QUERIES[q](spark, sf_dir) for q in ("kv_blob_round_trip", "kv_index_regenerate", "kv_recover_blobs")]
    for df in [*rows, blob_files.write_blobs(_log(spark), str(tmp_path))]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" in plan and "MapInPandas" not in plan and "content" not in plan
    long = spark.range(5_000).select(F.encode(F.col("id").cast("string"), "utf-8").alias("key"), F.col("id").alias("timestamp"), F.create_map(F.lit("v"), F.encode(F.lit("1"), "utf-8")).alias("meta"), F.encode(F.lit("x"), "utf-8").alias("data"), (F.col("id") % 7 == 0).alias("is_deleted"), F.floor(F.col("id") / 4_500).alias("blob_id"), F.col("id").alias("seq"))
    cut = lambda blob, raw: raw[:20] if blob else raw[:-3]
    got = blob_files.parse_log(long, cut, blob_files.recover_content).collect()
    want = blob_files.parse_blobs(blob_files.recover_contents(blob_files.blob_contents(long).select("blob_id", F.expr("if(blob_id = 0, substring(content, 1, length(content) - 3), substring(content, 1, 20))").alias("content")))).collect()
    assert len(got) == 4_499 and sorted(map(str, got)) == sorted(map(str, want))
    empty = blob_files.parse_log(long, lambda blob, raw: b"").collect()
    assert [(r.blob_id, r.error_kind) for r in sorted(empty)] == [(0, "Bincode"), (1, "Bincode")]


@pytest.mark.parametrize("cut", [0, 1, 30, 200])
def test_truncated_blobs(cut):
    assert list(blob_files.unpack_blob(blob_files.pack_blob(RECORDS)[:cut]))[-1]["error_kind"] == "Bincode"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "key long, timestamp long, blob_id long, seq long, is_deleted boolean, data binary"
    batches = [[(1, 5, 0, 0, False, bytearray(b"a")), (2, 1, 0, 1, False, bytearray(b"b"))], [(1, 3, 0, 2, False, bytearray(b"late")), (2, 9, 0, 3, True, bytearray(b""))], [(2, 10, 0, 4, False, bytearray(b"c")), (1, 6, 0, 5, False, bytearray(b"d"))]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for f in os.listdir(src):
            if f.endswith(".parquet"):
                os.utime(os.path.join(src, f), (1e9 + n, 1e9 + n)) if os.stat(os.path.join(src, f)).st_mtime > 2e9 or n == 0 else None
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stateful.latest(stream).writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("newest").collect():
        if r.key not in last or (r.timestamp, r.seq) >= last[r.key][:2]:
            last[r.key] = (r.timestamp, r.seq, r.is_deleted)
    assert last == {1: (6, 5, False), 2: (10, 4, False)}
    q = stateful.append(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_store(spark, tmp_path):
    with pytest.raises(StoreError, match="Uninitialized"):
        Options(work_dir="x").build(spark)
    s = Options(work_dir=str(tmp_path / "s"), max_data_in_blob=3, max_blob_size=10_000, key_size=2).build(spark).init()
    s.write(b"k1", b"one", 1)
    s.write(b"k1", b"again", 2)
    s.write_with(b"k1", b"v2", 3, {"version": b"2"})
    s.write(b"k2", b"two", 4)
    assert s.records_count() == 3 and s.blobs_count() == 2
    assert s.read(b"k1").first().data == b"v2"
    want = F.create_map(F.lit("version"), F.encode(F.lit("2"), "utf-8"))
    assert s.read_with(want, b"k1").first().data == b"v2"
    assert s.read_all(b"k1").count() == 2
    assert s.delete(b"k1", 9) == 1 and s.delete(b"zz", 9) == 0
    assert s.read(b"k1").first().status == "deleted"
    assert s.read_all_with_deletion_marker(b"k1").count() == 1
    probes = spark.createDataFrame([(bytearray(b"k1"),), (bytearray(b"q9"),)], "key binary")
    assert {bytes(r.key): r.maybe for r in s.check_filters(probes).collect()} == {b"k1": True, b"q9": False}
    assert {bytes(r.key): r.status for r in s.contains(probes).collect()} == {b"k1": "deleted", b"q9": "not_found"}
    with pytest.raises(StoreError, match="ActiveBlobExists"):
        s.try_create_active_blob()
    s.try_close_active_blob()
    assert not s.has_active_blob() and s.records_count_in_active_blob() is None
    s.try_restore_active_blob()
    s.force_update_active_blob(lambda stat: stat["records_count"] > 0)  # the tombstone went to the closed segment
    assert s.next_blob_id() == 2
    s.force_update_active_blob(lambda stat: stat["file_size"] == 20)
    assert s.next_blob_id() == 3 and s.disk_used() > 0
    with pytest.raises(StoreError, match="BlobKeySize"):
        s.write(b"long key", b"", 1)
    s.close()
    again = Options(work_dir=str(tmp_path / "s"), max_data_in_blob=3, max_blob_size=10_000).build(spark).init(lazy=True)
    assert again.records_count() == 4 and not again.has_active_blob()


def test_store_rotates_inside_a_batch_and_reads_through_filters(spark, tmp_path):
    s = Options(work_dir=str(tmp_path / "s"), max_data_in_blob=3, max_blob_size=1_000_000).build(spark).init()
    rows = spark.createDataFrame([(bytearray(b"%03d" % i), i, {}, bytearray(b"v%d" % i), i) for i in range(20)], "key binary, timestamp long, meta map<string,binary>, data binary, seq long")
    s.write(b"zzz", b"first", 1)
    s.write_rows(rows)
    assert {r.blob_id: r.records for r in s.records_count_detailed().collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3}
    assert s.records_count() == 21 and s.active == 7 and s.blobs_count() == 8
    log = s.log().orderBy("seq").collect()
    assert [bytes(r.key) for r in log] == [b"zzz", *(b"%03d" % i for i in range(20))] and all(r.blob_id == r.seq // 3 for r in log)
    assert s.tree().visit(spark.createDataFrame([(bytearray(b"004"),)], "key binary")).first().blob_ids == [1]
    plan = s._of(b"004")._jdf.queryExecution().executedPlan().toString()
    assert "blob_id" in plan.split("PartitionFilters")[1].split("]")[0]  # only the segments allowed are read
    assert s.read(b"004").first().data == b"v4" and s.read(b"nope").count() == 0
    s.write(b"004", b"again", 50)  # present: dropped
    assert s.records_count() == 21
    assert s.delete(b"004", 60, meta={"why": b"test"}) == 1
    stone = s.read_all_with_deletion_marker(b"004").first()
    assert (stone.blob_id, stone.is_deleted, dict(stone.meta)) == (1, True, {"why": bytearray(b"test")})
    assert s.delete(b"005", 60, only_if_presented=False) == 2 and s.records_count_in_active_blob() == 1
    assert s.filter_memory_allocated() == (8 + 1) * (-(-s._bits // 64) * 8)
    s.close()
    again = Options(work_dir=str(tmp_path / "s"), max_data_in_blob=3, max_blob_size=1_000_000).build(spark).init()
    assert again.records_count() == 24 and again.active == 7 and again.read(b"004").first().status == "deleted"


def test_store_imports_and_exports_blob_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    _damaged(spark, tmp_path / "in")
    o = Options(work_dir=str(tmp_path / "s"), max_data_in_blob=100, max_blob_size=10**6, key_size=2, validate_data_during_index_regen=True, blob_file_name_prefix="seg")
    s = o.build(spark).init()
    with pytest.raises(StoreError, match="BlobVersion"):
        s.import_blobs(str(tmp_path / "in"))
    (tmp_path / "in" / "log.3.blob").unlink()
    assert [r.action for r in s.import_blobs(str(tmp_path / "in"))] == ["open", "quarantine", "quarantine", "quarantine"]
    assert s.corrupted_blobs_count(str(tmp_path / "in")) == 3 and s.records_count() == 6 and s.next_blob_id() == 2
    assert s.read(bytes([0, 3])).first().data == b"data 3"
    assert [r.path.rsplit("/", 1)[1] for r in s.export_blobs(str(tmp_path / "out")).collect()] == ["seg.1.blob"]


def test_build_info():
    import stratalog

    info = stratalog.build_info()
    assert (info.name, info.version) == ("stratalog", stratalog.__version__) and info.spark
