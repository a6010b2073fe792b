"""Reading, shared storage and connected components for the operators here."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    In one process (a local master: tests) a temporary folder is made where the
    setting is absent, and recorded in the session; a cluster must name it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="stratalog-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables of materialize() that are still there.
_WRITTEN: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan starts anew
    from files that survive the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalog_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    path = getattr(df, "_stratalog_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Within it results may be read or written; what operators have written
    for them goes at its end::

        with scratch(spark):
            simhash.simhash_groups(docs).write.parquet(path)
    """
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN - before:
            _delete(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in either case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 by links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contract(batches):
    """Links of each batch, replaced by stars with the same components."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(a):
            continue
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = nodes[spanning(len(nodes), at[: len(a)], at[len(a) :])]
        out = low != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(low[out])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long).

    Returns (node, component): component is the smallest node reachable; nodes
    without links do not occur. Alternates large-star and small-star steps,
    each of them aggregations and joins, with every round written to the shared
    folder. Links and components stay on the executors. Null ends and loops
    are dropped.
    """
    spark = links.sparkSession
    spark_edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b")
    edges = materialize(spark_edges.mapInArrow(_contract, "a long, b long").distinct(), "links")
    before = None
    while True:
        if not before:
            before = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if not before[0]:
                break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every link now points down (a > b)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        new = materialize(small, "links")
        discard(edges)
        edges = new
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
