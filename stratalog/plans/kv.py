"""The kv queries: operators over the table-derived logs, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.checksum import crc32c
from stratalog.functions.columns import is_deleted, is_found, key_of_long, map_found, meta_canon
from stratalog.operators import filters, integrity, reads, segments, stats, writes
from stratalog.sources import blob_files, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

_E = """e AS (SELECT user_id AS k, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS t, event_id AS seq, event_id // 1000 AS blob_id,
 event_type = 'error' AS gone, event_type, CASE WHEN event_type = 'error' THEN '' ELSE props END AS data FROM events)"""
_O = """o AS (SELECT o_orderkey AS k, o_orderkey // 1000 AS blob_id, o_orderstatus = 'F' AS gone FROM orders)"""
_L = """l AS (SELECT l_orderkey AS k, year(l_shipdate) * 100 + month(l_shipdate) AS t, l_suppkey % 8 AS blob_id, l_returnflag = 'R' AS gone, l_linestatus,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM lineitem)"""
_HIST = """h AS (SELECT *, coalesce(sum(CAST(gone AS INT)) OVER (PARTITION BY k ORDER BY t DESC, blob_id DESC, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 row_number() OVER (PARTITION BY k ORDER BY t DESC, blob_id DESC, seq DESC) AS rank FROM {0})"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _out(df: DataFrame, *columns: str) -> DataFrame:
    """key as k, binary as text, booleans as numbers: types that any engine compares."""
    kinds = dict(df.dtypes)
    show = {"binary": lambda c: F.decode(c, "utf-8"), "boolean": lambda c: c.cast("int")}
    return df.select(*(show.get(kinds[c], lambda x: x)(F.col(c)).alias("k" if c == "key" else c) for c in columns))


@query(f"WITH {_E} SELECT k, CASE WHEN arg_max(gone, (t, blob_id, seq)) THEN 'deleted' ELSE 'found' END AS status, max(t) AS \"timestamp\", CASE WHEN arg_max(gone, (t, blob_id, seq)) THEN NULL ELSE arg_max(data, (t, blob_id, seq)) END AS data FROM e GROUP BY k")
def kv_read_latest(spark, sf_dir):
    return _out(reads.read(tables.events(spark, sf_dir)), "key", "status", "timestamp", "data")


@query(SQL["kv_read_latest"])
def kv_read_late(spark, sf_dir):
    return _out(reads.read_late(tables.events(spark, sf_dir)), "key", "status", "timestamp", "data")


@query(f"WITH {_E}, p AS (SELECT DISTINCT c_custkey AS k FROM customer), w AS (SELECT k, arg_max(gone, (t, blob_id, seq)) AS g, max(t) AS t FROM e GROUP BY k) SELECT p.k, CASE WHEN g IS NULL THEN 'not_found' WHEN g THEN 'deleted' ELSE 'found' END AS status, t AS \"timestamp\" FROM p LEFT JOIN w USING (k)")
def kv_contains(spark, sf_dir):
    probes = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).distinct()
    return _out(reads.contains(tables.events(spark, sf_dir), probes), "key", "status", "timestamp")


@query(f"WITH {_E}, {_HIST.format('e')} SELECT k, rank, seq, t AS \"timestamp\", data FROM h WHERE before = 0 AND NOT gone")
def kv_read_all(spark, sf_dir):
    return _out(reads.history(tables.events(spark, sf_dir)), "key", "rank", "seq", "timestamp", "data")


@query(f"WITH {_E}, {_HIST.format('e')} SELECT k, rank, seq, CAST(gone AS INT) AS is_deleted FROM h WHERE before = 0")
def kv_read_all_with_marker(spark, sf_dir):
    return _out(reads.history_with_marker(tables.events(spark, sf_dir)), "key", "rank", "seq", "is_deleted")


@query(f"WITH {_E}, {_HIST.format('e')} SELECT k, seq FROM h WHERE before = 0 AND NOT gone")
def kv_live_versions(spark, sf_dir):
    return _out(reads.live(tables.events(spark, sf_dir)), "key", "seq")


@query(f"WITH {_E} SELECT k, blob_id, CASE WHEN arg_max(gone, (t, seq)) THEN 'deleted' ELSE 'found' END AS status, max(t) AS \"timestamp\", arg_max(seq, (t, seq)) AS seq FROM e WHERE k % 3 = 0 GROUP BY k, blob_id")
def kv_blob_latest(spark, sf_dir):
    """Newest version inside each blob that the filters allow."""
    log = tables.events(spark, sf_dir)
    probes = log.filter("key % 3 = 0").select("key").distinct()
    pairs = filters.FilterTree.of(log, *_BLOOM).possible(probes)
    return _out(reads.latest_in_blobs(log, pairs), "key", "blob_id", "status", "timestamp", "seq")


@query(f"WITH {_E}, h AS (SELECT *, coalesce(sum(CAST(gone AS INT)) OVER (PARTITION BY k, blob_id ORDER BY t DESC, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY k, blob_id ORDER BY t DESC, seq DESC) AS rank FROM e) SELECT k, blob_id, rank, seq, CAST(gone AS INT) AS is_deleted FROM h WHERE before = 0")
def kv_blob_history(spark, sf_dir):
    return _out(reads.history_with_marker(tables.events(spark, sf_dir), ("blob_id", "key")), "key", "blob_id", "rank", "seq", "is_deleted")


@query("SELECT doc_id AS k, (doc_id * 7919) % 97 >= 6 AS data_ok, doc_id % 11 <> 0 AS header_ok FROM documents")
def kv_load_checked(spark, sf_dir):
    """Full records against the checksums of their data and headers; every eleventh header is damaged."""
    log = _with_damage(tables.documents(spark, sf_dir)).withColumn("key", key_of_long(F.col("key")))
    sized = log.withColumns({"meta_size": F.lit(0).cast("long"), "data_size": F.octet_length("data").cast("long"), "blob_offset": F.col("seq") * 100})
    stamped = sized.withColumn("header_checksum", crc32c(reads.header_bytes()) + F.when(F.col("seq") % 11 == 0, 1).otherwise(0))
    return reads.load(stamped).select(F.col("seq").alias("k"), "data_ok", "header_ok")


@query(f"WITH {_E}, w AS (SELECT k, arg_max(gone, (t, blob_id, seq)) AS gone, arg_max(data, (t, blob_id, seq)) AS data FROM e GROUP BY k) SELECT k, CAST(NOT gone AS INT) AS found, CAST(gone AS INT) AS deleted, CASE WHEN NOT gone THEN octet_length(encode(data)) END AS bytes FROM w")
def kv_result_algebra(spark, sf_dir):
    """is_found, is_deleted and map of read results."""
    r = reads.read(tables.events(spark, sf_dir))
    bytes_ = map_found(F.col("status"), F.col("data"), lambda d: F.octet_length(d).cast("long"))
    return r.select(F.col("key").alias("k"), is_found(F.col("status")).cast("int").alias("found"), is_deleted(F.col("status")).cast("int").alias("deleted"), bytes_.alias("bytes"))


_WITH = "SELECT k, CASE WHEN arg_max(gone, (t, blob_id, seq)) FILTER (gone OR {0}) IS NULL THEN 'not_found' WHEN arg_max(gone, (t, blob_id, seq)) FILTER (gone OR {0}) THEN 'deleted' ELSE 'found' END AS status, arg_max(seq, (t, blob_id, seq)) FILTER (gone OR {0}) AS seq FROM {1} GROUP BY k"


def _meta(**values):
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.encode(F.lit(v), "utf-8"))))


@query(f"WITH {_E} " + _WITH.format("event_type = 'purchase'", "e"))
def kv_read_with_meta(spark, sf_dir):
    return _out(reads.read_with(tables.events(spark, sf_dir), _meta(type="purchase")), "key", "status", "seq")


@query(f"WITH {_L} " + _WITH.format("l_linestatus = 'O'", "l"))
def kv_read_with_meta_lineitem(spark, sf_dir):
    return _out(reads.read_with(tables.lineitem(spark, sf_dir), _meta(status="O")), "key", "status", "seq")


@query("SELECT conv_id AS k, CASE WHEN max(turn) FILTER (role = 'user') IS NULL THEN 'not_found' ELSE 'found' END AS status, max(turn) FILTER (role = 'user') AS seq FROM conversations GROUP BY conv_id")
def kv_read_with_meta_conversation(spark, sf_dir):
    return _out(reads.read_with(tables.conversations(spark, sf_dir), _meta(role="user")), "key", "status", "seq")


@query("SELECT conv_id AS k, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, text AS data FROM conversations")
def kv_history_conversation(spark, sf_dir):
    return _out(reads.history(tables.conversations(spark, sf_dir)), "key", "seq", "rank", "data")


@query(f"WITH {_L} SELECT k, CASE WHEN arg_max(gone, (t, blob_id, seq)) THEN 'deleted' ELSE 'found' END AS status, arg_max(seq, (t, blob_id, seq)) AS seq, arg_max(blob_id, (t, blob_id, seq)) AS blob_id FROM l GROUP BY k")
def kv_tie_break(spark, sf_dir):
    rows = reads.newest(tables.lineitem(spark, sf_dir))
    return _out(rows.withColumn("status", F.when(F.col("is_deleted"), "deleted").otherwise("found")), "key", "status", "seq", "blob_id")


@query(f"WITH {_L}, {_HIST.format('l')} SELECT k, rank, seq FROM h WHERE before = 0 AND NOT gone")
def kv_tie_break_history(spark, sf_dir):
    return _out(reads.history(tables.lineitem(spark, sf_dir)), "key", "rank", "seq")


@query(f"WITH {_E}, w AS (SELECT k, blob_id, arg_max(gone, (t, blob_id, seq)) AS gone, max(t) AS t FROM e GROUP BY k, blob_id) SELECT k, arg_max(CASE WHEN gone THEN 'deleted' ELSE 'found' END, (t, blob_id)) AS status, max(t) AS \"timestamp\" FROM w GROUP BY k")
def kv_latest_fold(spark, sf_dir):
    """``latest`` of two results, over halves of the blobs: the higher half first."""
    from stratalog.functions.columns import latest_of

    log = tables.events(spark, sf_dir)
    split = log.withColumn("_r", F.struct("timestamp", "blob_id", "seq"))
    parts = [split.filter(F.col("blob_id") % 2 == i).groupBy("key").agg(F.max_by(F.struct("timestamp", "blob_id", "seq", "is_deleted"), "_r").alias("b")) for i in (0, 1)]

    def result(alias):
        b = F.col(f"{alias}.b")
        return F.struct(F.when(b.isNull(), "not_found").when(b["is_deleted"], "deleted").otherwise("found").alias("status"), b["timestamp"].alias("timestamp"))

    both = parts[0].alias("x").join(parts[1].alias("y"), F.col("x.key") == F.col("y.key"), "full")
    x, y = F.struct(result("x")["status"].alias("status"), result("x")["timestamp"].alias("timestamp")), result("y")
    x_first = F.coalesce(F.struct("x.b.blob_id") > F.struct("y.b.blob_id"), F.lit(True))
    best = F.when(x_first, latest_of(x, y)).otherwise(latest_of(y, x))
    return both.select(F.coalesce("x.key", "y.key").alias("k"), best["status"].alias("status"), best["timestamp"].alias("timestamp"))


@query("SELECT count(*) AS records FROM events")
def kv_records_count(spark, sf_dir):
    return stats.records_count(tables.events(spark, sf_dir))


@query("SELECT event_id // 1000 AS blob_id, count(*) AS records FROM events GROUP BY 1")
def kv_records_count_detailed(spark, sf_dir):
    return stats.records_count_detailed(tables.events(spark, sf_dir))


@query("SELECT event_id // 1000 AS blob_id, count(*) AS records FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def kv_records_count_active(spark, sf_dir):
    return stats.records_count_active(tables.events(spark, sf_dir))


@query("SELECT count(DISTINCT event_id // 1000) AS blobs FROM events")
def kv_blobs_count(spark, sf_dir):
    return stats.blobs_count(tables.events(spark, sf_dir))


@query("SELECT max(event_id // 1000) + 1 AS next_blob_id FROM events")
def kv_next_blob_id(spark, sf_dir):
    return stats.next_blob_id(tables.events(spark, sf_dir))


_SIZE = "65 + 8 + 16 + 4 + octet_length(encode(event_type)) + octet_length(encode(data))"


def _sized(spark, sf_dir):
    return tables.events(spark, sf_dir).withColumn("size", segments.record_size(8, F.col("meta"), F.col("data")))


@query(f"WITH {_E} SELECT CAST(sum({_SIZE}) + 20 * count(DISTINCT blob_id) AS BIGINT) AS disk_used FROM e")
def kv_disk_used(spark, sf_dir):
    return stats.disk_used(_sized(spark, sf_dir))


@query(f"WITH {_E} SELECT blob_id, CAST(count(*) FILTER (NOT gone) AS BIGINT) AS records, CAST(count(*) FILTER (gone) AS BIGINT) AS deleted, count(DISTINCT k) FILTER (NOT gone) AS unique_records, count(DISTINCT k) FILTER (gone) AS unique_deleted FROM e GROUP BY 1")
def kv_blob_summary(spark, sf_dir):
    return stats.blob_summary(tables.events(spark, sf_dir))


@query(f"WITH {_E} SELECT blob_id, count(*) AS records, count(DISTINCT k) AS unique_keys FROM e GROUP BY 1")
def kv_index_summary(spark, sf_dir):
    return stats.index_summary(tables.events(spark, sf_dir))


@query(f"WITH {_E} SELECT blob_id, k, string_agg(seq, ',' ORDER BY t DESC, seq DESC) AS seqs FROM e GROUP BY 1, 2")
def kv_read_index(spark, sf_dir):
    index = stats.read_index(tables.events(spark, sf_dir))
    return index.select("blob_id", F.col("key").alias("k"), F.array_join(F.transform("headers", lambda h: h.seq.cast("string")), ",").alias("seqs"))


@query(f"WITH {_O} SELECT blob_id, min(k) AS low, max(k) AS high FROM o GROUP BY 1")
def kv_range_filter(spark, sf_dir):
    return filters.range_filter(tables.orders(spark, sf_dir))


def _probes(spark, sf_dir):
    """Order keys, half of them beyond the table's."""
    return tables.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("key"))


_RANGES = f"WITH {_O}, r AS (SELECT blob_id, min(k) AS low, max(k) AS high FROM o GROUP BY 1), p AS (SELECT o_orderkey * 2 AS k FROM orders)"


@query(_RANGES + " SELECT p.k, CAST(bool_or(r.blob_id IS NOT NULL) AS INT) AS maybe FROM p LEFT JOIN r ON p.k BETWEEN low AND high GROUP BY p.k")
def kv_check_filters_range(spark, sf_dir):
    return _out(filters.check_filters(filters.range_filter(tables.orders(spark, sf_dir)), _probes(spark, sf_dir)), "key", "maybe")


@query(f"WITH {_E}, r AS (SELECT blob_id, min(k) AS low, max(k) AS high FROM e GROUP BY 1), p AS (SELECT c_custkey AS k FROM customer) SELECT p.k, CAST(bool_or(r.blob_id IS NOT NULL) AS INT) AS maybe FROM p LEFT JOIN r ON p.k BETWEEN low AND high GROUP BY p.k")
def kv_check_filters_overlap(spark, sf_dir):
    probes = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return _out(filters.check_filters(filters.range_filter(tables.events(spark, sf_dir)), probes), "key", "maybe")


@query(_RANGES + " SELECT p.k, r.blob_id FROM p JOIN r ON p.k BETWEEN low AND high")
def kv_hierarchical_prune(spark, sf_dir):
    return _out(filters.hierarchical(filters.range_filter(tables.orders(spark, sf_dir)), _probes(spark, sf_dir)), "key", "blob_id")


_BLOOM = (2, filters.bloom_bits(1000, 2, 100_000, 0.001))


def _present(spark, sf_dir):
    """Order keys, all in the table: no filter may deny them."""
    return tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))


@query(f"WITH {_O} SELECT k, blob_id FROM o")
def kv_bloom_check(spark, sf_dir):
    """Every key against the Bloom filters of the blobs whose range allows it."""
    log = tables.orders(spark, sf_dir)
    pairs = filters.candidates(filters.range_filter(log), _present(spark, sf_dir))
    return _out(filters.bloom_check(filters.bloom(log, *_BLOOM), pairs, *_BLOOM), "key", "blob_id")


@query(f"WITH {_O}, r AS (SELECT min(k) AS low, max(k) AS high FROM o) SELECT CAST(count(*) FILTER (k % 4 = 0) AS BIGINT) AS present, CAST(0 AS BIGINT) AS denied, true AS rarely_wrong FROM o")
def kv_combined_check(spark, sf_dir):
    """Range and Bloom filters over a log of every fourth order: its keys are never denied, others inside its ranges rarely pass."""
    log = tables.orders(spark, sf_dir).filter("key % 4 = 0")
    tree = filters.FilterTree.of(log, *_BLOOM)
    hits = filters.combined(filters.candidates(tree.ranges, _present(spark, sf_dir)), tree.words, *_BLOOM)
    found = filters.maybe(_present(spark, sf_dir), hits)
    held = F.col("key") % 4 == 0
    counts = found.agg(F.count_if(held).alias("present"), F.count_if(held & ~F.col("maybe")).alias("denied"), F.count_if(~held & F.col("maybe")).alias("wrong"), F.count_if(~held).alias("absent"))
    return counts.select("present", "denied", (F.col("wrong") <= 0.01 * F.col("absent")).alias("rarely_wrong"))


@query(f"WITH {_O}, p AS (SELECT o_orderkey * 2 AS k FROM orders) SELECT p.k, CAST(o.k IS NOT NULL AS INT) AS maybe FROM p LEFT JOIN o USING (k)")
def kv_exact_check(spark, sf_dir):
    """What an index in memory says: exact, of the blobs that ranges allow."""
    log, probes = tables.orders(spark, sf_dir), _probes(spark, sf_dir)
    hits = filters.exact(log, filters.candidates(filters.range_filter(log), probes))
    return _out(filters.maybe(probes, hits), "key", "maybe")


@query(f"WITH {_E} SELECT k, string_agg(DISTINCT CAST(blob_id AS VARCHAR), ',' ORDER BY CAST(blob_id AS VARCHAR)) AS blobs FROM (SELECT k, blob_id, max(blob_id) OVER (PARTITION BY k) AS m FROM e) WHERE blob_id = m GROUP BY k")
def kv_hierarchical_reverse(spark, sf_dir):
    """The newest blob that may hold each user's records, by a reverse visit of the two-level tree."""
    log = tables.events(spark, sf_dir)
    tree = filters.FilterTree.of(log, *_BLOOM)
    held = log.select("key", "blob_id").distinct()
    visit = tree.visit(log.select("key").distinct(), reverse=True).select("key", F.posexplode("blob_ids").alias("n", "blob_id"))
    first = visit.join(held, ["key", "blob_id"], "left_semi").groupBy("key").agg(F.min_by("blob_id", "n").alias("b"))
    return first.select(F.col("key").alias("k"), F.col("b").cast("string").alias("blobs"))


@query(f"WITH {_O} SELECT k // 8000 AS group_id, true AS same FROM o GROUP BY 1")
def kv_bloom_merge(spark, sf_dir):
    """Merged filters of eight blobs are the filter of their keys together."""
    log = tables.orders(spark, sf_dir)
    group = F.floor(F.col("blob_id") / 8)
    merged = filters.merge_blooms(filters.bloom(log, *_BLOOM), group)
    whole = filters.bloom(log.withColumn("group_id", group), *_BLOOM, by="group_id")
    both = merged.join(whole.withColumnRenamed("bits", "other"), ["group_id", "word"], "full")
    return both.groupBy("group_id").agg(F.bool_and(F.col("bits").eqNullSafe(F.col("other"))).alias("same"))


@query(f"WITH {_O} SELECT blob_id, true AS same FROM o GROUP BY 1")
def kv_bloom_raw(spark, sf_dir):
    """Filters as bytes and back."""
    words = filters.bloom(tables.orders(spark, sf_dir), *_BLOOM)
    back = filters.bloom_from_raw(filters.bloom_to_raw(words, *_BLOOM))
    ok = (F.col("bits").eqNullSafe(F.col("other"))) & (F.col("hashers") == _BLOOM[0]) & (F.col("filter_bits") == _BLOOM[1])
    return words.join(back.withColumnRenamed("bits", "other"), ["blob_id", "word"], "full").groupBy("blob_id").agg(F.bool_and(ok).alias("same"))


@query(f"WITH {_O} SELECT CAST((count(DISTINCT blob_id) + count(DISTINCT blob_id // 8)) * {-(-_BLOOM[1] // 64) * 8} AS BIGINT) AS filter_bytes FROM o")
def kv_filter_memory(spark, sf_dir):
    return filters.FilterTree.of(tables.orders(spark, sf_dir), *_BLOOM).memory()


@query(f"WITH {_E} SELECT min(k) AS low, max(k) AS high FROM e")
def kv_storage_filter(spark, sf_dir):
    """The filter of the whole storage."""
    return filters.FilterTree.of(tables.events(spark, sf_dir)).whole().ranges.select("low", "high")


_CONFIGS = [(1000, 2, 1000, 0.01), (100_000, 2, 8_388_608, 0.001), (1000, 3, 0, 0.01), (1000, 0, 100, 0.01), (50_000, 5, 10_000_000, 0.0001)]


@query("SELECT n, k, m, CASE WHEN k = 0 THEN 0 WHEN m = 0 THEN 64 ELSE CAST(floor(greatest(n * k / ln(2), least(m, -k * n / ln(1 - pow(p, 1.0 / k))))) AS BIGINT) END AS bits FROM (VALUES " + ", ".join(f"({n}, {k}, {m}, CAST({p} AS DOUBLE))" for n, k, m, p in _CONFIGS) + ") v(n, k, m, p)")
def kv_bloom_config(spark, sf_dir):
    return spark.createDataFrame([(n, k, m, filters.bloom_bits(n, k, m, p)) for n, k, m, p in _CONFIGS], "n int, k int, m int, bits long")


@query(f"WITH {_E} SELECT k, seq FROM (SELECT k, seq, gone, lag(gone) OVER (PARTITION BY k ORDER BY seq) AS g FROM e) WHERE gone OR g IS NULL OR g")
def kv_insert_no_duplicates(spark, sf_dir):
    return _out(writes.insert_monotone(tables.events(spark, sf_dir)), "key", "seq")


@query(f"WITH {_E} SELECT k, seq FROM (SELECT k, seq, gone, lag(gone) OVER (PARTITION BY k ORDER BY seq) AS g FROM e) WHERE (gone AND NOT g) OR (NOT gone AND (g IS NULL OR g))")
def kv_insert_delete_if_present(spark, sf_dir):
    return _out(writes.insert_monotone(tables.events(spark, sf_dir), only_if_presented=True), "key", "seq")


_STEP = "CASE WHEN o.gone THEN {p} ELSE NOT {p} END"


@query(f"""WITH RECURSIVE {_L.replace("l AS (", "l AS (")}, o AS (SELECT k, t, seq, gone, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM l),
 f AS (SELECT k, n, seq, NOT gone AS written, CASE WHEN NOT gone THEN t END AS bt, CASE WHEN NOT gone THEN seq END AS bs, CASE WHEN NOT gone THEN false END AS bg FROM o WHERE n = 1
  UNION ALL SELECT x.k, x.n, x.seq, x.w, CASE WHEN x.take THEN x.t ELSE x.bt END, CASE WHEN x.take THEN x.seq ELSE x.bs END, CASE WHEN x.take THEN x.gone ELSE x.bg END
  FROM (SELECT y.*, y.w AND (y.bt IS NULL OR (y.t, y.seq) >= (y.bt, y.bs)) AS take FROM
   (SELECT o.k, o.n, o.seq, o.t, o.gone, f.bt, f.bs, f.bg, {_STEP.format(p="coalesce(NOT f.bg, false)")} AS w FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1) y) x)
 SELECT k, seq FROM f WHERE written""")
def kv_insert_any_order(spark, sf_dir):
    """Conditional inserts and deletes where timestamps rise and fall: each key is folded in sequence."""
    return _out(writes.insert_any_order(tables.lineitem(spark, sf_dir), only_if_presented=True), "key", "seq")


@query(f"WITH {_E} SELECT k, min(seq) AS seq FROM e WHERE NOT gone GROUP BY k, event_type")
def kv_insert_no_duplicates_meta(spark, sf_dir):
    return _out(writes.insert_first_by_meta(tables.events(spark, sf_dir).filter("not is_deleted")), "key", "seq")


@query(f"WITH {_E}, w AS (SELECT k, arg_max(gone, (t, blob_id, seq)) AS gone FROM e WHERE blob_id < 5 GROUP BY k) SELECT k, min(seq) AS seq FROM e WHERE blob_id >= 5 AND NOT gone AND k NOT IN (SELECT k FROM w WHERE NOT gone) GROUP BY k")
def kv_insert_into(spark, sf_dir):
    log = tables.events(spark, sf_dir)
    return _out(writes.insert_into(log.filter("blob_id < 5"), log.filter("blob_id >= 5 and not is_deleted")), "key", "seq")


@query(f"WITH {_E} SELECT k, blob_id FROM e GROUP BY k, blob_id HAVING NOT arg_max(gone, (t, seq))")
def kv_delete_plan(spark, sf_dir):
    log = tables.events(spark, sf_dir)
    return _out(writes.delete_plan(log, log), "key", "blob_id")


@query(f"WITH {_E}, w AS (SELECT k, blob_id FROM e GROUP BY k, blob_id HAVING NOT arg_max(gone, (t, seq))) SELECT k, blob_id, 2000000000 AS \"timestamp\", 1000000 + row_number() OVER (PARTITION BY blob_id ORDER BY k) - 1 AS seq, 'cleanup' AS reason FROM w")
def kv_delete_with(spark, sf_dir):
    """Tombstones with metadata, in every blob whose own newest version is live."""
    log = tables.events(spark, sf_dir)
    stones = writes.tombstones(writes.delete_plan(log, log), 2_000_000_000, 1_000_000, _meta(reason="cleanup"))
    return _out(stones.withColumn("reason", F.decode(F.col("meta")["reason"], "utf-8")), "key", "blob_id", "timestamp", "seq", "reason")


@query(f"WITH {_E}, w AS (SELECT k, blob_id FROM e GROUP BY k, blob_id HAVING NOT arg_max(gone, (t, seq))) SELECT k, blob_id FROM w UNION SELECT DISTINCT k, (SELECT max(blob_id) FROM e) AS blob_id FROM e")
def kv_delete_active(spark, sf_dir):
    """A delete that also marks the active blob, whether or not it has the key."""
    log = tables.events(spark, sf_dir)
    return _out(writes.delete_plan(log, log.select("key").distinct(), False, log.agg(F.max("blob_id")).first()[0]), "key", "blob_id")


@query("SELECT event_id AS seq, CAST((row_number() OVER (ORDER BY event_id) - 1) // 700 AS BIGINT) AS blob_id FROM events")
def kv_rotate_by_count(spark, sf_dir):
    return segments.rotate_by_count(tables.events(spark, sf_dir), 700).select("seq", "blob_id")


_DOC_SIZE = "65 + 8 + 16 + 4 + octet_length(encode(lang)) + 16 + 6 + octet_length(encode(source)) + octet_length(encode(text))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_DOC_SIZE} AS size, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
 f AS (SELECT n, doc_id, 0 AS blob_id, 20 + size AS used FROM d WHERE n = 1
  UNION ALL SELECT d.n, d.doc_id, f.blob_id + CAST(f.used >= 100000 AS INT), CASE WHEN f.used >= 100000 THEN 20 ELSE f.used END + d.size FROM f JOIN d ON d.n = f.n + 1)
 SELECT doc_id AS seq, CAST(blob_id AS BIGINT) AS blob_id FROM f""")
def kv_rotate_by_size(spark, sf_dir):
    sizes = tables.documents(spark, sf_dir).select("seq", segments.record_size(8, F.col("meta"), F.col("data")).alias("size"))
    return segments.rotate_by_size(sizes, 100_000)


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_DOC_SIZE} AS size, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
 f AS (SELECT n, doc_id, 0 AS blob_id, 20 + size AS used, 1 AS held FROM d WHERE n = 1
  UNION ALL SELECT d.n, d.doc_id, f.blob_id + CAST(f.used >= 100000 OR f.held >= 20 AS INT), CASE WHEN f.used >= 100000 OR f.held >= 20 THEN 20 ELSE f.used END + d.size, CASE WHEN f.used >= 100000 OR f.held >= 20 THEN 1 ELSE f.held + 1 END FROM f JOIN d ON d.n = f.n + 1)
 SELECT doc_id AS seq, CAST(blob_id AS BIGINT) AS blob_id FROM f""")
def kv_rotate(spark, sf_dir):
    """Rotation by size and count, whichever is reached first."""
    sizes = tables.documents(spark, sf_dir).select("seq", segments.record_size(8, F.col("meta"), F.col("data")).alias("size"))
    return segments.rotate(sizes, 100_000, 20)


@query(f"WITH {_E} SELECT seq, blob_id, CAST(20 + coalesce(sum({_SIZE}) OVER (PARTITION BY blob_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS blob_offset FROM e")
def kv_offsets(spark, sf_dir):
    return segments.offsets(_sized(spark, sf_dir)).select("seq", "blob_id", "blob_offset")


def _with_damage(log):
    sums = log.withColumn("data_checksum", crc32c("data"))
    return sums.withColumn("data_checksum", F.when(tables.damaged(F.col("seq")), (F.col("data_checksum") + 1) % (1 << 32)).otherwise(F.col("data_checksum")))


@query("SELECT doc_id AS k, doc_id AS seq, 'RecordDataChecksum' AS error_kind FROM documents WHERE (doc_id * 7919) % 97 < 6")
def kv_validate_checksums(spark, sf_dir):
    return _out(integrity.validate(_with_damage(tables.documents(spark, sf_dir))), "key", "seq", "error_kind")


_BAD = "(seq * 7919) % 97 < 6 AS bad"


@query(f"WITH {_E} SELECT k, seq FROM (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY blob_id ORDER BY seq) AS n FROM (SELECT *, {_BAD} FROM e)) WHERE n = 0")
def kv_recover_prefix(spark, sf_dir):
    return _out(integrity.recover_prefix(tables.events(spark, sf_dir), tables.damaged(F.col("seq"))), "key", "seq")


@query(f"WITH {_E}, b AS (SELECT *, {_BAD} FROM e), c AS (SELECT *, bad AND coalesce(lag(bad) OVER (PARTITION BY blob_id ORDER BY seq), false) AS two FROM b) SELECT k, seq FROM (SELECT *, sum(CAST(two AS INT)) OVER (PARTITION BY blob_id ORDER BY seq) AS n FROM c) WHERE n = 0 AND NOT bad")
def kv_recover_skip(spark, sf_dir):
    return _out(integrity.recover_skip(tables.events(spark, sf_dir), tables.damaged(F.col("seq"))), "key", "seq")


@query(f"WITH {_E}, x AS (SELECT seq, printf('%016X', k) AS h FROM e) SELECT seq, substr(h,15,2)||substr(h,13,2)||substr(h,11,2)||substr(h,9,2)||substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2) AS key_hex FROM x")
def kv_migrate_v0_v1(spark, sf_dir):
    log = tables.events(spark, sf_dir).withColumn("key", key_of_long(F.col("key")))
    return integrity.migrate(log, 0, 1).select("seq", F.hex("key").alias("key_hex"))


_KIND = "CASE WHEN (blob_id * 7919) % 7 = 0 THEN 'BlobVersion' WHEN (blob_id * 7919) % 7 = 1 THEN 'Bincode' WHEN (blob_id * 7919) % 7 = 2 THEN 'RecordDataChecksum' END"
_RECORD_KIND = "CASE WHEN (seq * 7919) % 97 < 3 THEN 'RecordHeaderChecksum' WHEN (seq * 7919) % 97 < 6 THEN 'RecordDataChecksum' END"


@query(f"WITH {_E}, b AS (SELECT blob_id, seq, {_RECORD_KIND} AS kind FROM e) SELECT blob_id, arg_min(kind, seq) FILTER (kind IS NOT NULL) AS error_kind FROM b GROUP BY 1")
def kv_first_errors(spark, sf_dir):
    """The damage that opening each blob meets first."""
    return integrity.first_errors(tables.events(spark, sf_dir).withColumn("error_kind", F.expr(_RECORD_KIND)))


@query(f"WITH {_E}, b AS (SELECT DISTINCT blob_id, coalesce({_KIND}, '') IN ('Bincode', 'RecordDataChecksum') AS bad FROM e) SELECT CAST(count(*) FILTER (bad) AS BIGINT) AS corrupted FROM b")
def kv_corrupted_blobs_count(spark, sf_dir):
    """Blobs that triage would move away."""
    blobs = tables.events(spark, sf_dir).select("blob_id").distinct().withColumn("error_kind", F.expr(_KIND))
    return integrity.triage(blobs).agg(F.count_if(F.col("action") == "quarantine").alias("corrupted"))




@query(f"WITH {_E}, b AS (SELECT DISTINCT blob_id FROM e) SELECT blob_id, CASE WHEN {_KIND} IS NULL THEN 'open' WHEN {_KIND} = 'BlobVersion' THEN 'fail' ELSE 'quarantine' END AS action FROM b")
def kv_quarantine(spark, sf_dir):
    blobs = tables.events(spark, sf_dir).select("blob_id").distinct().withColumn("error_kind", F.expr(_KIND))
    return integrity.triage(blobs).select("blob_id", "action")


def _keyed(spark, sf_dir):
    """The events' log with keys of bytes, as blob files hold it."""
    return tables.events(spark, sf_dir).withColumn("key", key_of_long(F.col("key")))


def _long_of(key):
    return F.conv(F.hex(key), 16, 10).cast("long")


@query(f"WITH {_E} SELECT k, t AS \"timestamp\", blob_id, CAST(gone AS INT) AS is_deleted, octet_length(encode(data)) AS bytes, row_number() OVER (PARTITION BY blob_id ORDER BY seq) - 1 AS n FROM e")
def kv_blob_round_trip(spark, sf_dir):
    """Records written as blob files' bytes and read again, all checksums held."""
    rows = blob_files.parse_log(_keyed(spark, sf_dir)).filter("error_kind is null")
    return rows.select(_long_of("key").alias("k"), "timestamp", "blob_id", F.col("is_deleted").cast("int").alias("is_deleted"), F.col("data_size").alias("bytes"), (F.col("seq") % (1 << 32)).alias("n"))


@query(f"WITH {_E} SELECT blob_id, k, CAST(20 + coalesce(sum({_SIZE}) OVER (PARTITION BY blob_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS blob_offset FROM e")
def kv_index_regenerate(spark, sf_dir):
    """The index that the blobs' bytes give."""
    index = blob_files.headers_of(blob_files.parse_log(_keyed(spark, sf_dir), check_data=False))
    return index.select("blob_id", _long_of("key").alias("k"), "blob_offset")


def _damage_headers(blob, raw):
    """Break the checksum of every record header that the deterministic damage names, by the events' numbers."""
    new = bytearray(raw)
    for n, r in enumerate(blob_files.unpack_blob(raw, check_data=False)):
        if (blob * 1000 + n) * 7919 % 97 < 6:
            new[r["blob_offset"] + 16 + len(r["key"]) + 40] ^= 0x55
    return bytes(new)


@query(f"WITH {_E}, b AS (SELECT *, {_BAD} FROM e), c AS (SELECT *, bad AND coalesce(lag(bad) OVER (PARTITION BY blob_id ORDER BY seq), false) AS two FROM b), d AS (SELECT *, sum(CAST(two AS INT)) OVER (PARTITION BY blob_id ORDER BY seq) AS n FROM c) SELECT k, t AS \"timestamp\", blob_id, row_number() OVER (PARTITION BY blob_id ORDER BY seq) - 1 AS place FROM d WHERE n = 0 AND NOT bad")
def kv_recover_blobs(spark, sf_dir):
    """Blobs with damaged headers, recovered as bytes and read again: one bad record is passed over, two in a row end the copy."""
    rows = blob_files.parse_log(_keyed(spark, sf_dir), _damage_headers, blob_files.recover_content).filter("error_kind is null")
    return rows.select(_long_of("key").alias("k"), "timestamp", "blob_id", (F.col("seq") % (1 << 32)).alias("place"))


@query("SELECT o_orderkey AS k, 'priority:' || o_orderpriority || ',status:' || o_orderstatus AS meta FROM orders")
def kv_meta_attributes(spark, sf_dir):
    rows = tables.orders(spark, sf_dir).withColumn("canon", meta_canon(F.col("meta")))
    hexed = F.transform(F.split("canon", ","), lambda p: F.concat_ws(":", *(F.decode(F.unhex(F.split(p, ":")[i]), "utf-8") for i in (0, 1))))
    return rows.select(F.col("key").alias("k"), F.array_join(hexed, ",").alias("meta"))
