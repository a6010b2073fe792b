import math

import duckdb
import pytest

from stratalog.plans import kv

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(kv.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = kv.QUERIES[name](spark, sf_dir)
    q = duck.execute(kv.SQL[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, q.fetchall())


def test_bloom_rarely_errs(spark, sf_dir):
    """Of keys that are absent, inside the ranges of a log with every other order's key, few pass."""
    from pyspark.sql import functions as F

    from stratalog.operators import filters
    from stratalog.sources import tables

    log = tables.orders(spark, sf_dir).withColumn("key", F.col("key") * 2)
    hashers, bits = 2, filters.bloom_bits(1000, 2, 100_000, 0.001)
    tree = filters.FilterTree.of(log, hashers, bits)
    n = log.count()
    probes = spark.range(2 * n).withColumnRenamed("id", "key")
    got = {r.key: r.maybe for r in tree.check(probes).collect()}
    assert all(got[k] for k in range(0, 2 * n, 2)) and sum(got[k] for k in range(1, 2 * n, 2)) <= 0.01 * n
    plan = tree.check(probes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rotation_by_size_is_the_sequential_fold(spark, sf_dir):
    got = {r.seq: r.blob_id for r in kv.kv_rotate_by_size(spark, sf_dir).collect()}
    blob, used = 0, 20
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        assert got[r.doc_id] == blob
        meta = 8 + sum(16 + len(k) + len(v.encode()) for k, v in (("lang", r.lang), ("source", r.source)))
        used += 65 + meta + len(r.text.encode())
        if used >= 100_000:
            blob, used = blob + 1, 20
