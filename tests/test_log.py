import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions.checksum import crc32c, crc32c_many
from stratalog.functions.columns import latest_of, meta_canon, meta_insert, unwrap
from stratalog.operators import filters, integrity, reads, segments, writes

SCHEMA = "key long, timestamp long, blob_id long, seq long, is_deleted boolean, meta map<string,binary>, data binary"


def log(spark, rows):
    """rows: (key, timestamp, blob_id, seq, is_deleted[, version])"""
    return spark.createDataFrame([(*r[:5], {"version": bytearray(str(r[5]).encode())} if len(r) > 5 else {}, bytearray(b"" if r[4] else str(r[3]).encode())) for r in rows], SCHEMA)


def seqs(df):
    return [r.seq for r in df.orderBy("key", "rank").collect()]


@pytest.mark.parametrize("blobs", [(0, 0, 0), (0, 1, 2)])
def test_put_delete_put(spark, blobs):
    rows = log(spark, [(1, 1, blobs[0], 0, False), (1, 2, blobs[1], 1, True), (1, 3, blobs[2], 2, False)])
    assert seqs(reads.history_with_marker(rows)) == [2, 1]
    assert seqs(reads.history(rows)) == [2]
    assert reads.read(rows).first().data == b"2"


@pytest.mark.parametrize("blobs", [(0, 0, 0, 0), (0, 1, 2, 3)])
def test_an_older_tombstone_deletes_nothing_newer(spark, blobs):
    rows = log(spark, [(1, 10, blobs[0], 0, False), (1, 10, blobs[1], 1, False), (1, 5, blobs[2], 2, False), (1, 0, blobs[3], 3, True)])
    assert seqs(reads.history_with_marker(rows)) == [1, 0, 2, 3]
    got = reads.read(rows).first()
    assert (got.status, got.data) == ("found", b"1")


def test_read_with_meets_the_first_tombstone(spark):
    rows = log(spark, [(1, 1, 0, 0, False, "1.0"), (1, 2, 0, 1, False, "2.0"), (2, 1, 0, 2, False, "1.0"), (2, 2, 0, 3, True), (3, 1, 0, 4, False, "x")])
    want = F.create_map(F.lit("version"), F.encode(F.lit("1.0"), "utf-8"))
    got = {r.key: (r.status, r.seq) for r in reads.read_with(rows, want).collect()}
    assert got == {1: ("found", 0), 2: ("deleted", 3), 3: ("not_found", None)}


def test_contains_and_empty_log(spark):
    rows = log(spark, [(1, 1, 0, 0, False), (2, 1, 0, 1, True)])
    probes = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    assert {r.key: r.status for r in reads.contains(rows, probes).collect()} == {1: "found", 2: "deleted", 3: "not_found"}
    assert reads.read(rows.limit(0)).count() == 0
    assert {r.maybe for r in filters.check_filters(filters.range_filter(rows.limit(0)), probes).collect()} == {False}


def test_random_histories_against_blobwise_reads(spark):
    rnd, rows = random.Random(7), []
    for key in range(300):
        blob, seq = 0, key * 100
        for _ in range(rnd.randrange(1, 9)):
            rows.append((key, rnd.randrange(5), blob, seq, rnd.random() < 0.25))
            seq, blob = seq + 1, blob + (rnd.random() < 0.4)
    df = log(spark, rows)
    got = {k: [] for k in range(300)}
    for r in reads.history_with_marker(df).orderBy("key", "rank").collect():
        got[r.key].append(r.seq)
    newest = {r.key: r.seq for r in reads.newest(df).collect()}
    for key in range(300):
        mine = [r for r in rows if r[0] == key]
        merged, used = [], 0
        for blob in sorted({r[2] for r in mine}, reverse=True):
            part = sorted((r for r in mine if r[2] == blob), key=lambda r: (r[1], r[3]), reverse=True)
            cut = next((i + 1 for i, r in enumerate(part) if r[4]), len(part))
            merged, used = merged + part[:cut], used + 1
        if used > 1:
            merged.sort(key=lambda r: -r[1])
            merged = merged[: next((i + 1 for i, r in enumerate(merged) if r[4]), len(merged))]
        assert got[key] == [r[3] for r in merged]
        assert newest[key] == merged[0][3]
    live = sorted(r.seq for r in reads.live(df).collect())
    assert live == sorted(r.seq for r in reads.history(df).collect())


def test_fold_equals_lag_rule_for_rising_time(spark):
    rnd = random.Random(3)
    rows = log(spark, [(rnd.randrange(20), t, 0, t, rnd.random() < 0.3) for t in range(400)])
    for flag in (False, True):
        a, b = writes.insert_monotone(rows, flag), writes.insert_any_order(rows, flag)
        assert sorted(r.seq for r in a.collect()) == sorted(r.seq for r in b.collect())


def test_inserts_of_hot_keys(spark, monkeypatch):
    rnd = random.Random(6)
    rows = log(spark, [(0 if t % 3 else rnd.randrange(30), t, 0, t, rnd.random() < 0.4) for t in range(2000)])
    plain = [sorted(r.seq for r in writes.insert_monotone(rows, flag).collect()) for flag in (False, True)]
    monkeypatch.setattr(reads, "_ROWS", 100)
    monkeypatch.setattr(segments, "range_count", lambda df: 16)
    assert [sorted(r.seq for r in writes.insert_monotone(rows, flag).collect()) for flag in (False, True)] == plain
    state, want = {}, [[], []]
    for r in sorted(rows.collect(), key=lambda r: r.seq):
        present = state.get(r.key, False)
        for w, flag in zip(want, (False, True)):
            if (present or not flag) if r.is_deleted else not present:
                w.append(r.seq)
        state[r.key] = not r.is_deleted
    assert plain == want and writes.insert_monotone(rows).columns == rows.columns


def test_insert_into_and_delete_plan(spark):
    table = log(spark, [(1, 1, 0, 0, False, "a"), (2, 1, 0, 1, True), (1, 2, 1, 2, True)])
    puts = log(spark, [(1, 5, 0, 10, False, "a"), (2, 5, 0, 11, False, "b"), (2, 6, 0, 12, False, "b"), (3, 5, 0, 13, False, "c")])
    assert sorted(r.seq for r in writes.insert_into(table, puts).collect()) == [10, 11, 13]
    assert sorted(r.seq for r in writes.insert_into(table, puts, by_meta=True).collect()) == [10, 11, 13]
    plan = writes.delete_plan(table, table, only_if_presented=True)
    assert [(r.key, r.blob_id) for r in plan.collect()] == [(1, 0)]
    assert writes.delete_plan(table, table, False, active=1).count() == 3
    assert writes.tombstones(plan, 9, 100).first().seq == 100


def test_crc32c_vector(spark):
    assert [hex(x) for x in crc32c_many([b"123456789", b"", b"a" * 100])][:2] == ["0xe3069283", "0x0"]
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,), (bytearray(),)], "data binary")
    assert [r[0] for r in df.select(crc32c("data")).collect()] == [0xE3069283, None, 0]


def test_meta_canon_and_results(spark):
    df = spark.sql("select map('a', X'01', 'b', X'02') x, map('b', X'02', 'a', X'01') y, cast(map() as map<string,binary>) z")
    r = df.select((meta_canon(F.col("x")) == meta_canon(F.col("y"))).alias("same"), meta_canon(F.col("z")).alias("none"), meta_canon(meta_insert(F.col("x"), "a", F.unhex(F.lit("03")))).alias("new")).first()
    assert r.same and r.none == "" and "61:03" in r.new
    pair = spark.sql("select named_struct('status','found','timestamp',5L) a, named_struct('status','deleted','timestamp',5L) b, named_struct('status','not_found','timestamp',cast(null as long)) c")
    got = pair.select(latest_of(F.col("a"), F.col("b")).alias("x"), latest_of(F.col("c"), F.col("b")).alias("y"), latest_of(F.col("a"), F.col("c")).alias("z")).first()
    assert (got.x.status, got.y.status, got.z.status) == ("found", "deleted", "found")
    with pytest.raises(Exception, match="result is deleted"):
        pair.select(unwrap(F.col("b.status"), F.unhex(F.lit("")))).collect()


def test_recovery_and_migration(spark):
    rows = log(spark, [(1, t, 0, t, False) for t in range(8)])
    bad = F.col("seq").isin(2, 5, 6)
    assert [r.seq for r in integrity.recover_prefix(rows, bad).orderBy("seq").collect()] == [0, 1]
    assert [r.seq for r in integrity.recover_skip(rows, bad).orderBy("seq").collect()] == [0, 1, 3, 4]
    keys = spark.sql("select X'01C3FF' key")
    assert integrity.migrate(keys, 0, 1).first().key == b"\xff\xc3\x01"
    assert integrity.migrate(keys, 1, 1).first().key == b"\x01\xc3\xff"
    with pytest.raises(ValueError):
        integrity.migrate(keys, 0, 2)


def test_numbered_over_ranges(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "seq")
    assert all(r.n * 3 == r.seq for r in segments.numbered(df, "seq").collect())
    assert segments.numbered(df.limit(0), "seq").count() == 0


def test_bloom_sizes():
    assert filters.bloom_bits(100_000, 2, 8_388_608, 0.001) == 6_224_019
    assert filters.bloom_bits(10, 0, 100, 0.1) == 0 and filters.bloom_bits(10, 2, 0, 0.1) == 64


def test_plans(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    log(spark, [(k, 1, 0, k, False) for k in range(10)]).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = reads.history(stored).filter("key = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,3)" in plan
    plan = reads.read(stored)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Python" not in plan
    narrow = reads.contains(stored, spark.range(3).withColumnRenamed("id", "key"))._jdf.queryExecution().executedPlan().toString()
    assert "data:binary" not in narrow.split("ReadSchema")[1]


def test_histories_of_hot_keys(spark, monkeypatch):
    """Versions of one key over many ranges have the ranks of one sort."""
    from stratalog.operators import segments

    rnd = random.Random(5)
    rows = log(spark, [(0 if i % 3 else rnd.randrange(40), rnd.randrange(200), rnd.randrange(4), i, rnd.random() < 0.002) for i in range(3000)])
    plain = {(r.key, r.seq): r["rank"] for r in reads.history_with_marker(rows).collect()}
    monkeypatch.setattr(reads, "_ROWS", 100)
    monkeypatch.setattr(segments, "range_count", lambda df: 16)
    spread = reads.history_with_marker(rows)
    assert {(r.key, r.seq): r["rank"] for r in spread.collect()} == plain
    versions, n = {}, 0
    for r in sorted(rows.collect(), key=lambda r: (r.key, -r.timestamp, -r.blob_id, -r.seq)):
        if r.key not in versions or not versions[r.key]:
            n = n + 1 if r.key in versions else 1
            assert plain[r.key, r.seq] == n
            versions[r.key] = r.is_deleted
    by_blob = {(r.key, r.blob_id, r.seq): r["rank"] for r in reads.history(rows, ("blob_id", "key")).collect()}
    assert max(by_blob.values()) > 100 and len(by_blob) > len(plain)


@pytest.mark.parametrize("n, size, records, used", [(500, 300, 1 << 62, 20), (300, 300, 4, 20), (400, 5000, 37, 900), (3, 1000, 2, 20), (200, 20, 9, 20), (200, 10**9, 50, 20), (100, 500, 1, 20), (50, 500, 5, 480)])
def test_rotation_is_the_sequential_fold(spark, n, size, records, used):
    rnd = random.Random(n)
    sizes = [rnd.choice([None, 0, 10, 60, 90, 200]) for _ in range(n)]
    df = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sizes)], "seq long, size long")
    got = {r.seq: r.blob_id for r in segments.rotate(df, size, records, used, 1 if used > 20 else 0, buckets=7).collect()}
    blob, held, n_held = 0, used, 1 if used > 20 else 0
    for i, s in enumerate(sizes):
        assert got[i * 3] == blob
        held, n_held = held + (s or 0), n_held + 1
        if held >= size or n_held >= records:
            blob, held, n_held = blob + 1, 20, 0


def test_null_data_is_an_empty_record(spark):
    df = spark.createDataFrame([(1, None, None), (2, {"a": bytearray(b"x")}, bytearray(b"abc"))], "seq long, meta map<string,binary>, data binary")
    assert [r[0] for r in df.select(segments.record_size(8, F.col("meta"), F.col("data"))).collect()] == [73, 73 + 18 + 3]


def test_filter_trees(spark):
    rows = log(spark, [(k, 1, k // 10, k, False) for k in range(0, 400, 2)])
    tree = filters.FilterTree.of(rows, 2, 4096, group_size=4)
    probes = spark.createDataFrame([(k,) for k in range(-5, 420)], "key long")
    got = {r.key: r.blob_ids for r in tree.visit(probes).collect()}
    assert all(k // 10 in got[k] for k in range(0, 400, 2)) and sum(k % 2 for k in got) < 20 and -1 not in got
    assert len(tree) == 40 and tree.last_id() == 39 and tree.get(3).first().low == 30 and tree.last().first().blob_id == 39
    assert list(tree.ids(reverse=True))[:2] == [39, 38] and len(tree.groups()) == 10
    less, last = tree.pop()
    assert len(less) == 39 and last.first().high == 398 and len(tree.remove(5)) == 39 and len(tree.clear()) == 0
    more = less.add(rows.filter("blob_id = 39"))
    assert {r.key: r.blob_ids for r in more.visit(probes, reverse=True).collect()} == got
    assert {r.key for r in tree.whole().check(probes).filter("maybe").collect()} >= set(range(0, 400, 2))
    assert tree.memory().first()[0] == 50 * 512 and filters.FilterTree.of(rows).memory().first()[0] == 0
    with pytest.raises(ValueError):
        tree.extend(filters.FilterTree.of(rows, 3, 4096))
    pairs = filters.candidates(tree.ranges, probes)
    kinds = [filters.RangeFilter(), filters.BloomFilter(2, 4096), None]
    held = filters.checked([(k, k and k.build(rows)) for k in kinds], pairs).collect()
    assert {(r.key, r.blob_id) for r in held} == {(r.key, r.blob_id) for r in filters.combined(pairs, tree.words, 2, 4096).collect()}
    back = filters.bloom_from_raw(filters.bloom_to_raw(tree.words, 2, 4096))
    assert {tuple(r) for r in back.select("blob_id", "word", "bits").collect()} == {tuple(r) for r in tree.words.select("blob_id", "word", "bits").collect()}
    empty = filters.FilterTree.of(rows.limit(0), 2, 4096)
    assert empty.possible(probes).count() == 0 and empty.last_id() is None and len(empty.pop()[0]) == 0
    binary = spark.createDataFrame([(bytearray(b"k%03d" % k), k // 10) for k in range(100)], "key binary, blob_id long")
    one = spark.createDataFrame([(bytearray(b"k042"),), (bytearray(b"zz"),)], "key binary")
    assert [(bytes(r.key), r.blob_id) for r in filters.FilterTree.of(binary, 2, 4096).possible(one).collect()] == [(b"k042", 4)]


def test_result_functions(spark):
    from stratalog.functions import columns

    df = spark.sql("select 'found' s, X'01' d union all select 'deleted', null union all select 'not_found', null")
    s, d = F.col("s"), F.col("d")
    got = df.select(s, columns.is_found(s).alias("f"), columns.is_deleted(s).alias("x"), columns.is_not_found(s).alias("n"), columns.map_found(s, d, F.hex).alias("m")).collect()
    assert {tuple(r) for r in got} == {("found", True, False, False, "01"), ("deleted", False, True, False, None), ("not_found", False, False, True, None)}
    assert [r[0] for r in df.filter("s <> 'found'").select(columns.cast_absent(s, "int")).collect()] == [None, None]
    with pytest.raises(Exception, match="result is found"):
        df.select(columns.cast_absent(s, "int")).collect()


def test_crc32c_of_blocks():
    from stratalog.functions import checksum

    def plain(v):
        c = 0xFFFFFFFF
        for x in v:
            c = int(checksum._TABLE[(c ^ x) & 255]) ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    rnd = random.Random(1)
    values = [rnd.randbytes(n) for n in (0, 1, checksum.BLOCK - 1, checksum.BLOCK, checksum.BLOCK + 1, 3 * checksum.BLOCK, 5000, 0, 10_240)]
    assert crc32c_many(values).tolist() == [plain(v) for v in values] == [checksum.crc32c_one(v) for v in values] and len(crc32c_many([])) == 0


def _shuffled(spark, df):
    """Rows of df, and how many rows were shuffled for them."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    rows = df().collect()
    return rows, sum(n for k, n in stages().items() if k not in before)


def test_trees_shuffle_no_pairs(spark):
    """All blobs' ranges overlap: the filters name the pairs that each blob's
    own name, and four times the log shuffles no more than five times the rows."""
    counts = []
    for n in (10_000, 40_000):
        rows = spark.range(n).select((F.xxhash64("id") % (n // 10)).alias("key"), F.floor(F.col("id") / 5).alias("blob_id")).localCheckpoint()
        tree = filters.FilterTree.of(rows, 2, 200)
        probes = rows.select("key").distinct().localCheckpoint()
        got, shuffled = _shuffled(spark, lambda: tree.possible(probes))
        counts.append(shuffled)
        if n == 10_000:
            want = filters.bloom_check(tree.words, filters.candidates(tree.ranges, probes), 2, 200).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > rows.distinct().count()
    assert counts[1] < 5 * counts[0], counts
    few, shuffled = _shuffled(spark, lambda: tree.possible(probes.limit(1)))
    assert few and shuffled < counts[1] / 2


def test_parts_of_a_tree_follow_the_bits(spark):
    """Wide filters, many hash functions, gaps between blobs' ids, null keys and texts."""
    rows = spark.range(3_000).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("k"), F.xxhash64("id") % 500)).alias("key"), (F.floor(F.col("id") / 10) * 1_000_003 - 7).alias("blob_id")).localCheckpoint()
    probes = rows.select("key").distinct()
    for hashers, bits in ((3, 1_000), (1, 70)):
        tree = filters.FilterTree.of(rows, hashers, bits)
        want = sorted(map(tuple, filters.bloom_check(tree.words, filters.candidates(tree.ranges, probes), hashers, bits).collect()))
        assert sorted(map(tuple, tree.possible(probes).collect())) == want
    assert len(filters._part_cuts(tree.ranges, 8_388_608)) == 4 and len(filters._part_cuts(tree.ranges, 70)) == 3
